"""Problem 1: text decoded with the wrong character encoding.

A garbled text is repaired by a best-first search. A state is a text; an edge undoes one wrong step: it
encodes the suspicious runs in one code page and decodes them in another, or it unescapes character
references. A heap holds reached states by plausibility cost plus the cost of the way there; visited states
are kept by hash, so no text is expanded twice. The cheapest of all texts within ``MAX_STEPS`` undone steps is the
result: a state is left out only where no way on can be cheaper than the best one found.

The cost is a sum over blank-separated tokens, so that tokens, which recur, are priced once per worker.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.sources.tables import spread

# Code pages a wrong decoder commonly used, and pairs of single-byte pages that get mixed up.
TO_UTF8 = ("cp1252", "latin-1", "cp1250", "cp1251", "mac-roman", "cp437", "cp850", "koi8-r", "iso8859-2")
SINGLE = (
    ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("latin-1", "cp1251"), ("latin-1", "cp1250"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("latin-1", "koi8-r"), ("cp1252", "koi8-r"),
    ("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("latin-1", "iso8859-2"), ("cp1252", "iso8859-2"),
    ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"),
    ("cp1250", "cp1252"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"),
)
CHARSET_COST, ESCAPE_COST, GAIN, MAX_STEPS = 1.0, 0.3, 0.25, 3
DOUBLE = (("cp1252", "cp932"), ("latin-1", "cp932"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"))
OPENERS, CLOSERS = set("“„‚‘«¿¡‹"), set("”’»…›–—‐‑·•")
SYMBOLS_AFTER_WORD = set("™®²³°ºª€%′″")
RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё")
UNUSUAL_LATIN = set("ìòøåæðþÿÌÒØÅÆÐÞĂăĹĺĽľŢţĐđŐőŰűŕŔşŞÏƒŸ")
# Letters that never meet in one word of a language: the first stand for Czech ones in another page.
FOREIGN, CZECH = set("ìøùèòåæ"), set("ýíáúůž")
# An isolated character that stands for lost bytes, or a control character no text holds.
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
# First bytes of two-byte characters whose second byte was dropped on the way.
BROKEN = re.compile(r"ï»¿|[a-zà-ÿ][ÃÂÄÅÐÑ](?![A-ZÀ-Þ])|\bÃ(?=[a-zà-ÿ])|(?<!\w)[ÃÂ](?!\w)")
REFERENCE = re.compile(r"&#?\w+;")
SUSPECT = r"[^\x00-\x7F]|&#?\w+;"


def _kind(c: str) -> str:
    """One-letter class of a character."""
    o = ord(c)
    if o < 128:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "p"
    if o == 0xFFFD:
        return "r"
    if o < 0xA0:
        return "x"
    if c in OPENERS:
        return "q"
    if c in CLOSERS:
        return "e"
    if c in "\xa0 ​﻿ 　":
        return "n"
    if o == 0xAD:
        return "h"
    if (o < 0x180 or c in "șțȘȚƒ") and c.isalpha() and c not in "ªº":
        return "l" if c.islower() else "U"
    if 0x400 <= o < 0x530:
        low = c.lower()
        return ("c" if c == low else "C") if low in RUSSIAN else "y"
    if 0x370 <= o < 0x400:
        return "g"
    if o >= 0x2E80 and unicodedata.category(c)[0] in "LPSN":
        return "j"
    if 0x2190 <= o < 0x2600 and o not in (0x2192, 0x2190):
        return "b"
    if unicodedata.category(c) in ("Mn", "Mc"):
        return "m"
    return "s" if o < 0x2600 and not c.isalpha() or c in "ªº" else "o"


BASE = {"a": 0, "A": 0, "0": 0, "p": 0, "l": 0.03, "U": 0.05, "c": 0, "C": 0.03, "y": 2.5, "j": 0.01, "q": 0.1, "e": 0.03, "s": 0.2, "n": 0.05, "h": 1.5, "x": 5, "r": 6, "b": 3, "g": 1.5, "m": 0.5, "o": 2.0}
# Common Russian words, whose pairs of letters tell right words from swapped ones.
RUSSIAN_WORDS = (
    "человек время рука дело жизнь день голова друг дом слово место лицо сторона нога дверь работа земля конец голос"
    " город вода стол ребёнок сила отец женщина машина случай ночь вид начало вопрос деньги минута правда страна свет"
    " товарищ дорога окно комната стена система тело власть история общество закон месяц причина помощь новый первый"
    " последний хороший большой маленький русский целый лучший лёгкий тёплый удобный прочный красный чёрный синий белый"
    " быстрый длинный широкий мягкий тяжёлый дешёвый свежий который можно только также после между через почему потому"
    " чтобы если когда сейчас теперь всегда очень сегодня вчера вместе думать говорить делать знать стать хотеть видеть"
    " идти стоять спросить получить понять работать выберите откройте сравните читайте магазин товар цена скидка доставка"
    " заказ покупатель размер цвет качество подарок отзыв склад гарантия оплата возврат корзина кухня посуда одежда обувь"
    " мебель инструмент книга игрушка сумка зонт часы лампа ключ ящик нож шкаф полка ковёр плита щётка дача поход хобби"
    " шерсть хлопок кожа сталь стекло дерево бумага семья июль объём съезд вьюга юбка ящерица эхо фонарь цепь хвост"
    " жжение шлюз"
).split()
RUSSIAN_PAIRS = frozenset(a + b for w in RUSSIAN_WORDS for a, b in zip(w, w[1:]))
LETTER, LATIN, LATIN_MARKED, CYRILLIC = set("aAlUcCygj"), set("aAlU"), set("lU"), set("cCy")
_kinds: dict[str, str] = {}
_costs: dict[str, float] = {}


def token_cost(token: str) -> float:
    """Implausibility of one blank-free token; 0 for plain ASCII."""
    if token.isascii():
        return 0.0
    known = _costs.get(token)
    if known is not None:
        return known
    total, before, last, marked = 0.0, "", "", 0
    if token in ("Ã", "Â"):
        total = 1.5
    elif not FOREIGN.isdisjoint(token) and not CZECH.isdisjoint(token):
        total = 1.6
    for c in token:
        k = _kinds.get(c) or _kinds.setdefault(c, _kind(c))
        total += BASE[k] if before or k != "b" else 0.5
        if c in UNUSUAL_LATIN:
            total += 1.0 if c in "ƒŸ" else 0.7
        elif "\uff61" <= c <= "\uff9f" or "\ue000" <= c <= "\uf8ff":  # half-width kana, private use
            total += 2.0
        if before:
            pair = before + k
            if before in LATIN_MARKED:
                if k in "sbxhg":
                    total += 3.0
                elif k == "n":
                    total += 3.0 if before == "U" else 1.0
                elif k == "q":
                    total += 3.0
                elif k == "e" and (before == "U" or c not in "”’»…›"):
                    total += 2.0
            elif before in LETTER and k == "q":
                total += 2.0
            elif before in "aA0c" and k == "s" and c not in SYMBOLS_AFTER_WORD:
                total += 2.0
            if last == "‚" and k in LATIN_MARKED or before == "e" and k == "q":
                total += 2.0
            if before in "sb" and k in LETTER and not (last == "°" and c in "CF"):
                total += 1.5
            if before in "sb" and k in "sbqe":
                total += 2.0
            if before in "qe" and k in "sb":
                total += 2.0
            if last == "€" and k not in "p0":
                total += 1.0
            if pair in ("aU", "lU", "lA"):
                total += 0.5
            elif pair in ("cC", "cy", "gU"):
                total += 1.0
            if before in "cC" and k in "cC" and (last + c).lower() not in RUSSIAN_PAIRS:
                total += 0.4
            if (before in LATIN and k in "cCyg") or (before in "cCyg" and k in LATIN):
                total += 2.0
            if (before == "j" and k in LATIN) or (before in LATIN and k == "j"):
                total += 2.0
        if k in LATIN_MARKED:
            marked += 1
            if marked == 2:
                total += 0.4
            elif marked > 2:
                total += 1.6
        elif k != "h":
            marked = 0
        before, last = k, c
    if len(_costs) > 400_000:
        _costs.clear()
    _costs[token] = total
    return total


def cost(text: str) -> float:
    """Implausibility of a text: the sum over its tokens plus a little for each character reference."""
    if text.isascii():
        return 1.0 * len(REFERENCE.findall(text)) if "&" in text else 0.0
    total = sum(map(token_cost, text.split(" ")))
    return total + len(REFERENCE.findall(text)) if "&" in text else total


def _bytes_of(codec: str) -> dict[int, int]:
    """Map of code points to bytes 0x80..0xFF of one code page; undefined bytes stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        table[b] = b
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
    if codec in ("cp437", "cp850", "mac-roman", "koi8-r", "cp866"):  # every byte is defined: nothing stands for itself
        table = {ord(bytes([b]).decode(codec)): b for b in range(0x80, 0x100)}
    else:  # a byte that is defined as another character never stands for itself
        table = {p: b for p, b in table.items() if p >= 0xA0 or _undefined(codec, p) or codec == "latin-1"}
    return table


def _undefined(codec: str, b: int) -> bool:
    try:
        return ord(bytes([b]).decode(codec)) == b
    except UnicodeDecodeError:
        return True


TABLES = {c: _bytes_of(c) for c in {*TO_UTF8, *(a for a, _ in SINGLE)}}
RUNS = {c: re.compile("[" + "".join(map(re.escape, map(chr, t))) + "]{2,}") for c, t in TABLES.items()}
WELL_FORMED = re.compile(
    rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}"
)
# 0xA0 that became a blank: Ã followed by a blank that a word border or an apostrophe precedes was à.
LOST_NBSP = re.compile(r"(?<![^\s(])Ã {1,2}(?=[\w“«(])|(?<![^\s(])Ã$|(?<=[’'])Ã(?=\s|$)")
PAIRS = {(a, b): {p: bytes([x]).decode(b, "replace") for p, x in TABLES[a].items()} for a, b in SINGLE}
WORDS = re.compile(r"[^\s!-/:-@\[-`{-~]*[^\x00-\x7f\s][^\s!-/:-@\[-`{-~]*")


def _redecode(text: str, codec: str) -> str:
    """Replace every run that is well-formed UTF-8 read in ``codec`` by what it stood for."""
    table = TABLES[codec]

    def fix(m: re.Match) -> str:
        run = m.group()
        raw = bytes(table[ord(c)] for c in run)
        if not WELL_FORMED.search(raw):
            return run
        out, at = [], 0
        for part in WELL_FORMED.finditer(raw):
            try:
                said = part.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [run[at : part.start()], said]
            at = part.end()
        return "".join(out) + run[at:]

    return RUNS[codec].sub(fix, text)


def _swap(text: str, pair: tuple[str, str]) -> str:
    """Re-read the words that hold non-ASCII characters of one single-byte page in another page.

    Where no word becomes more plausible the text stays; else words that become less plausible stay.
    """
    table = PAIRS[pair]
    words = {w for w in WORDS.findall(text) if all(ord(c) < 128 or ord(c) in table for c in w)}
    said = {w: w.translate(table) for w in words}
    gain = {w: token_cost(w) - token_cost(v) for w, v in said.items()}
    if not any(g > 0 for g in gain.values()):
        return text
    return WORDS.sub(lambda m: said[m.group()] if gain.get(m.group(), -1.0) >= -1e-9 else m.group(), text)


def _double_byte(text: str, codec: str, target: str) -> str:
    """Re-read blank-free parts in a double-byte page, whose second bytes may be ASCII."""
    table = TABLES[codec]
    out = []
    for token in text.split(" "):
        codes = [ord(c) for c in token]
        if sum(x > 127 for x in codes) > 1 and all(x < 128 or x in table for x in codes):
            raw = bytes(table.get(x, x) for x in codes)
            for end in (len(raw), len(raw) - 1):  # a cut text may end within a character
                try:
                    token = raw[:end].decode(target) + "\ufffd" * (end < len(raw))
                    break
                except UnicodeDecodeError:
                    pass
        out.append(token)
    return " ".join(out)


def neighbours(text: str) -> Iterator[tuple[str, str, float]]:
    """Texts one undone step away: name of the step, text, cost of the step."""
    if "&" in text and REFERENCE.search(text):
        yield "unescape", html.unescape(text), ESCAPE_COST
    if text.isascii():
        return
    for codec in TO_UTF8:
        out = _redecode(text, codec)
        if out != text:
            yield f"{codec}>utf-8", out, CHARSET_COST + (0.0 if codec in TO_UTF8[:2] else 0.1)
    if LOST_NBSP.search(text):
        yield "nbsp>utf-8", LOST_NBSP.sub(lambda m: "à " if m.group().endswith(" ") else "à", text), CHARSET_COST
    for codec, target in DOUBLE:
        out = _double_byte(text, codec, target)
        if out != text:
            yield f"{codec}>{target}", out, CHARSET_COST + 0.3
    for pair in SINGLE:
        out = _swap(text, pair)
        if out != text and out.count("�") <= text.count("�"):
            yield ">".join(pair), out, CHARSET_COST + 0.1


def repair(text: str | None, max_steps: int = MAX_STEPS) -> tuple[str | None, str, bool]:
    """Cheapest text within ``max_steps``, the steps there, and whether the text was garbled (recoverable or not).

    Null and empty texts, and plain ASCII without character references, are returned as they are.
    """
    if not text or (text.isascii() and "&" not in text):
        return text, "", False
    start = cost(text)
    best, best_total, steps = text, start, ""
    if start > CHARSET_COST and "�" in text and cost(text.replace("�", "")) <= CHARSET_COST:
        return text, "", True  # nothing but lost characters
    if start > CHARSET_COST:
        heap = [(start, 0, start, 0.0, 0, text, "")]
        seen, order = {hash(text)}, 0
        while heap:
            _, _, total, way, depth, state, path = heapq.heappop(heap)
            if total < best_total - 1e-9:
                best, best_total, steps = state, total, path
            if depth == max_steps or way + (ESCAPE_COST if "&" in state else CHARSET_COST) + (GAIN if way else 0.0) >= best_total:
                continue  # any way on costs about as much as the best text found, or more
            for name, out, step in neighbours(state):
                key = hash(out)
                if key not in seen:
                    seen.add(key)
                    order += 1
                    there = cost(out) + way + step
                    # Well-formed UTF-8 is no accident: such states are looked at before others as plausible.
                    first = there - 0.8 * (there - way - step) if name.endswith(">utf-8") else there
                    heapq.heappush(heap, (first, order, there, way + step, depth + 1, out, f"{path} {name}".strip()))
    wrong = ">" in steps or bool(LOST.search(text) or BROKEN.search(text))
    return best, steps, wrong


def repair_column(df: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Rows of ``df`` with non-ASCII characters or character references in ``field``, with the repaired text.

    Returns ``keys``, ``field``, ``repaired``, ``steps`` and ``garbled``. Plain rows never leave the JVM; the
    rest is priced token by token. Nulls and empty texts give no row; repeated rows stay repeated.
    """
    kept = df.select(*keys, F.col(field).alias("original")).filter(F.col("original").rlike(SUSPECT))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part["original"].unique()
            found = {t: repair(t) for t in texts}
            part["repaired"] = [found[t][0] for t in part["original"]]
            part["steps"] = [found[t][1] for t in part["original"]]
            part["garbled"] = [found[t][2] for t in part["original"]]
            yield part

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return spread(kept).mapInPandas(run, f"{schema}, repaired string, steps string, garbled boolean")
