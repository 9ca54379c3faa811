"""HTML documents: a tolerant tree, the page record extracted from it, redaction, and selectors.

Everything runs once per document in an Arrow batch and returns one nested record, so later steps are native.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlmill.functions import vectorized
from crawlmill.functions.text import simhash_hex
from crawlmill.functions.urls import resolve_url

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title".split())
HIDDEN = frozenset("head script style template noscript title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
WHITE = "\t\n\v\f\r \x85\xa0                　"
SPACE = re.compile(f"[{WHITE}]+")
MARKUP = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
MAX_EVIDENCE = 1000


class Node:
    """An element: tag, attributes (first of a name), children, element around it."""

    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None) -> None:
        self.tag, self.attrs, self.up = tag, attrs, up
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name, "").strip(WHITE)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack.extend(reversed(node.children))

    def text(self) -> str:
        return clean(" ".join(self.texts()))

    def inner(self) -> str:
        """Markup of the children."""
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(html.escape(node, quote=False))
            else:
                out.append("<" + node.tag + "".join(f' {k}="{html.escape(v)}"' for k, v in node.attrs.items()) + ">")
                if node.tag not in VOID:
                    stack.append((f"</{node.tag}>",))
                    stack.extend(reversed(node.children))
        return "".join(out)


def clean(text: str) -> str:
    """White space runs become one blank; the ends are trimmed."""
    return SPACE.sub(" ", text).strip(" ")


def parse(body: str) -> Node:
    """Tree of a document; what HTML closes by itself is closed, nothing is refused."""
    root = Node("#document", {}, None)
    top, pos, size = root, 0, len(body)
    lower = None
    while pos < size:
        m = MARKUP.search(body, pos)
        if not m:
            top.children.append(html.unescape(body[pos:]))
            break
        if m.start() > pos:
            top.children.append(html.unescape(body[pos : m.start()]))
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            node: Node | None = top
            while node is not None and node.tag != tag:
                node = node.up
            if node is not None and node.up is not None:
                top = node.up
            continue
        if tag in CLOSES_P:
            top = _close(top, ("p",), ("table", "td", "th", "button"))
        if tag in IMPLIED:
            for _ in range(2 if tag == "tr" else 1):
                top = _close(top, IMPLIED[tag], STOPS[tag])
        if tag == "body":
            top = _close(top, ("head",), ())
        attrs: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(m.group(3)):
            value = next((v for v in a.groups()[1:] if v is not None), "")
            attrs.setdefault(a.group(1).lower(), html.unescape(value))
        node = Node(tag, attrs, top)
        top.children.append(node)
        if tag in RAW:
            if lower is None:
                lower = body.lower()
            end = lower.find(f"</{tag}", pos)
            said = body[pos : end if end >= 0 else size]
            if said:
                node.children.append(html.unescape(said) if tag in ("title", "textarea") else said)
            pos = body.find(">", end) + 1 if end >= 0 else size
            pos = pos or size
        elif tag not in VOID:
            top = node
    return root


def _close(top: Node, tags: tuple[str, ...], stops: tuple[str, ...]) -> Node:
    node: Node | None = top
    while node is not None and node.up is not None and node.tag not in stops:
        if node.tag in tags:
            return node.up
        node = node.up
    return top


def _hides(node: Node) -> bool:
    style = node.get("style").lower().replace(" ", "")
    return node.tag in HIDDEN or node.get("aria-hidden").lower() == "true" or "hidden" in node.attrs or "display:none" in style or "visibility:hidden" in style


def visible_text(root: Node) -> str:
    """Text a reader sees, pieces joined by one blank."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            said = clean(node)
            if said:
                out.append(said)
        elif not _hides(node):
            stack.extend(reversed(node.children))
    return " ".join(out)


def json_ld(text: str) -> dict[str, Any]:
    """Evidence of one JSON-LD block: sorted types, properties, contexts, errors, and its typed nodes.

    Each list holds at most ``MAX_EVIDENCE`` values in sorted order of discovery; more set ``truncated``.
    """
    out: dict[str, Any] = {"format": "json-ld", "valid": True, "error": "", "types": [], "properties": [], "contexts": [], "structural_errors": [], "nodes": [], "truncated": False}
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as x:
        return out | {"valid": False, "error": str(x)}
    found: dict[str, set[str]] = {k: set() for k in ("types", "properties", "contexts", "structural_errors")}

    def add(kind: str, said: str) -> None:
        said = said if kind == "structural_errors" else said.strip() if kind != "properties" else said
        if said and said not in found[kind]:
            if len(found[kind]) >= MAX_EVIDENCE:
                out["truncated"] = True
            else:
                found[kind].add(said)

    def context(node: Any) -> None:
        for item in node if isinstance(node, list) else [node]:
            if isinstance(item, str):
                add("contexts", item)
            elif isinstance(item, dict):
                add("contexts", "[inline context]")
            elif isinstance(item, list):
                context(item)
            elif item is not None:
                add("structural_errors", "@context must be a string, object, or array")

    stack: list[tuple[Any, str]] = [(value, "$")]
    while stack:
        node, path = stack.pop()
        if isinstance(node, list):
            stack.extend((v, f"{path}[{i}]") for i, v in reversed(list(enumerate(node))))
        elif isinstance(node, dict):
            types: list[str] = []
            if "@type" in node:
                said = node["@type"]
                if isinstance(said, str):
                    types = [said.strip()]
                elif isinstance(said, list):
                    types = [t.strip() for t in said if isinstance(t, str)]
                    if len(types) < len(said):
                        add("structural_errors", "@type arrays must contain only strings")
                else:
                    add("structural_errors", "@type must be a string or an array of strings")
            if "@context" in node:
                context(node["@context"])
            names = sorted(k for k in node if not k.startswith("@"))
            for t in types:
                add("types", t)
            for k in names:
                add("properties", k)
            if types or names:
                if len(out["nodes"]) >= MAX_EVIDENCE:
                    out["truncated"] = True
                else:
                    out["nodes"].append({"path": path, "types": sorted(types), "properties": names})
            stack.extend((node[k], f"{path}.{k}") for k in sorted(node, reverse=True) if k != "@context" and isinstance(node[k], (dict, list)))
    return out | {k: sorted(v) for k, v in found.items()}


PAGE = (
    "struct<language string, title string, meta_description string, meta_robots string, viewport string, social map<string,string>,"
    " canonicals array<string>, pagination_next string, pagination_previous string,"
    " hreflangs array<struct<language string, raw string, url string>>, mobile_alternate string, amp_url string,"
    " links array<struct<raw string, url string, text string, rel string, element string>>,"
    " images array<struct<raw string, url string, alt string, alt_present boolean, width int, height int, loading string, srcset boolean>>,"
    " headings array<struct<level int, text string>>,"
    " structured_data array<struct<format string, valid boolean, error string, types array<string>, properties array<string>, contexts array<string>,"
    " structural_errors array<string>, nodes array<struct<path string, types array<string>, properties array<string>>>, truncated boolean>>,"
    " visible_text string, word_count int, text_bytes long, html_hash string, content_hash string, similarity_hash string>"
)


def _number(text: str) -> int:
    return min(int(text), 2**31 - 1) if re.fullmatch(r"\+?\d{1,18}", text) else 0


def extract(url: str | None, body: str | None) -> dict[str, Any] | None:
    """Page record of a document; None for a null body. A null url leaves relative references out."""
    if body is None:
        return None
    root = parse(body)
    page: dict[str, Any] = {
        "language": "", "title": "", "meta_description": "", "meta_robots": "", "viewport": "", "social": {}, "canonicals": [], "pagination_next": "",
        "pagination_previous": "", "hreflangs": [], "mobile_alternate": "", "amp_url": "", "links": [], "images": [], "headings": [], "structured_data": [],
    }
    base, first_html, first_base = url or "", True, True
    for node in root.walk():
        if node.tag == "html" and first_html:
            page["language"], first_html = node.get("lang"), False
        elif node.tag == "base" and first_base:
            base, first_base = resolve_url(base, node.get("href")) or base, False
    memo: dict[str, str] = {}

    def at(raw: str) -> str:
        if raw not in memo:
            memo[raw] = resolve_url(base, raw) or ""
        return memo[raw]

    for node in root.walk():
        tag = node.tag
        if tag == "title":
            page["title"] = page["title"] or node.text()
        elif tag == "meta":
            name, prop, content = node.get("name").lower(), node.get("property").lower(), node.get("content")
            field = {"description": "meta_description", "robots": "meta_robots", "viewport": "viewport"}.get(name)
            if field:
                page[field] = page[field] or content
            if prop.startswith("og:") or name.startswith("twitter:"):
                page["social"].setdefault(prop or name, content)
        elif tag == "link":
            raw, target = node.get("href"), at(node.get("href"))
            for rel in node.get("rel").lower().split():
                if rel == "canonical" and target:
                    page["canonicals"].append(target)
                elif rel == "next":
                    page["pagination_next"] = target
                elif rel in ("prev", "previous"):
                    page["pagination_previous"] = target
                elif rel == "alternate" and target and node.get("hreflang"):
                    page["hreflangs"].append({"language": node.get("hreflang"), "raw": raw, "url": target})
                elif rel == "alternate" and target and node.get("media"):
                    page["mobile_alternate"] = page["mobile_alternate"] or target
                elif rel == "amphtml":
                    page["amp_url"] = page["amp_url"] or target
        elif tag in ("a", "area"):
            if target := at(node.get("href")):
                page["links"].append({"raw": node.get("href"), "url": target, "text": node.text(), "rel": node.get("rel"), "element": tag})
        elif tag in ("iframe", "frame"):
            if target := at(node.get("src")):
                page["links"].append({"raw": node.get("src"), "url": target, "text": "", "rel": "", "element": tag})
        elif tag == "img":
            if target := at(node.get("src")):
                page["images"].append(
                    {"raw": node.get("src"), "url": target, "alt": node.get("alt"), "alt_present": "alt" in node.attrs, "width": _number(node.get("width")), "height": _number(node.get("height")), "loading": node.get("loading").lower(), "srcset": node.get("srcset") != ""}
                )
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            page["headings"].append({"level": int(tag[1]), "text": node.text()})
        elif tag == "script" and node.get("type").lower() == "application/ld+json":
            page["structured_data"].append(json_ld("".join(node.texts())))
        for attr, kind in (("itemtype", "microdata"), ("typeof", "rdfa")):
            if node.get(attr):
                page["structured_data"].append({"format": kind, "valid": True, "error": "", "types": node.get(attr).split(), "properties": [], "contexts": [], "structural_errors": [], "nodes": [], "truncated": False})
    text = visible_text(root)
    raw_text = text.encode("utf-8", "replace")
    return page | {
        "visible_text": text, "word_count": len(text.split(" ")) if text else 0, "text_bytes": len(raw_text), "html_hash": hashlib.sha256(body.encode("utf-8", "replace")).hexdigest(),
        "content_hash": hashlib.sha256(raw_text).hexdigest(), "similarity_hash": simhash_hex(text),
    }


@vectorized(PAGE)
def page_record(urls: pd.Series, bodies: pd.Series) -> pd.DataFrame:
    """Column form of ``extract``."""
    return pd.DataFrame([extract(u, b) or {k: None for k in _FIELDS} for u, b in zip(urls, bodies)], columns=_FIELDS)


_FIELDS = list(extract("", ""))


def page(url: Column, body: Column) -> Column:
    """Page record of a body; a record of nulls for a null body."""
    return page_record(url, body)


REFERENCES = {"a": "href", "area": "href", "link": "href", "iframe": "src", "frame": "src"}
MAX_REFERENCE = 8192


def discover(url: str | None, body: str | None, most: int) -> list[str]:
    """Distinct http references of a document in order of their first place, at most ``most``.

    Links, areas, link elements and frames count; the first ``base`` holds for what follows it. References that are
    empty or longer than ``MAX_REFERENCE`` bytes are left out. Null documents have none.
    """
    if not url or not body or most < 1:
        return []
    base, fixed = url, False
    found: dict[str, None] = {}
    for node in parse(body).walk():
        if node.tag == "base" and not fixed:
            fixed, base = True, resolve_url(base, node.get("href")) or base
        raw = node.get(REFERENCES[node.tag]).strip() if node.tag in REFERENCES else ""
        if not raw or len(raw.encode("utf-8", "replace")) > MAX_REFERENCE:
            continue
        target = resolve_url(base, raw)
        if target:
            found.setdefault(target)
            if len(found) == most:
                break
    return list(found)


def discovered(url: Column, body: Column, most: int) -> Column:
    """Column form of ``discover``."""

    @vectorized("array<string>")
    def run(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([discover(u, b, most) for u, b in zip(urls, bodies)], dtype=object)

    return run(url, body)


SECRET = re.compile(r"(?i)token|secret|passw|auth|session|api-?key|nonce|csrf")


def redact(body: str | None) -> str | None:
    """Document without script and form contents, secret attributes, and queries of URLs."""
    if body is None:
        return None
    root = parse(body)
    for node in root.walk():
        if node.tag in ("script", "textarea") and node.children:
            node.children = ["[redacted]"]
        for name, value in node.attrs.items():
            if (node.tag == "input" and name == "value") or SECRET.search(name):
                node.attrs[name] = "[redacted]"
            elif name in ("href", "src", "action", "formaction", "poster"):
                node.attrs[name] = re.split(r"[?#]", value, maxsplit=1)[0]
    return root.inner()


@vectorized("string")
def redacted(bodies: pd.Series) -> pd.Series:
    """Column form of ``redact``."""
    return bodies.map(redact)


# Selectors.

_SIMPLE = re.compile(r"\s*(?:(>)\s*)?([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[\w-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\s]+))?\])*)")
_CONDITION = re.compile(r"([#.])([\w-]+)|\[([\w-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+)))?\]")
Step = tuple[bool, str, list[tuple[str, str | None]]]


def css_steps(selector: str) -> list[Step]:
    """Steps (direct child, tag, conditions) of a selector: tags, ids, classes, attributes, descendants, children."""
    selector = selector.strip()
    if not selector or "," in selector or ":" in selector or len(selector.encode()) > 512:
        raise ValueError("selector")
    steps: list[Step] = []
    at = 0
    while at < len(selector):
        m = _SIMPLE.match(selector, at)
        if not m or m.end() == at or not (m.group(2) or m.group(3)):
            raise ValueError("selector")
        conditions: list[tuple[str, str | None]] = []
        for mark, name, attr, *values in _CONDITION.findall(m.group(3)):
            if mark:
                conditions.append(("id" if mark == "#" else "class", name))
            else:
                said = next((v for v in values if v), None)
                conditions.append((attr.lower(), said if said is not None or "=" not in m.group(3) else said))
        tag = (m.group(2) or "*").lower()
        steps.append((bool(m.group(1)) and bool(steps), tag, conditions))
        at = m.end()
    return steps


def xpath_steps(expression: str) -> list[Step]:
    """Steps of a path of ``/``, ``//``, tags and ``[@name='value']``; the first step may be anywhere."""
    said = expression.strip().removeprefix(".")
    if not said.startswith("/") or len(said.encode()) > 512:
        raise ValueError("path")
    steps: list[Step] = []
    for slashes, tag, rest in re.findall(r"(//?)([a-zA-Z*][\w-]*|\*)((?:\[[^\]]*\])*)", said):
        conditions: list[tuple[str, str | None]] = []
        for name, a, b in re.findall(r"\[\s*@([\w-]+)(?:\s*=\s*(?:'([^']*)'|\"([^\"]*)\"))?\s*\]", rest):
            conditions.append((name.lower(), a or b or None))
        if rest and not conditions:
            raise ValueError("path")
        steps.append((slashes == "/" and bool(steps), tag.lower(), conditions))
    if not steps or "".join(re.findall(r"//?(?:[a-zA-Z*][\w-]*|\*)(?:\[[^\]]*\])*", said)) != said:
        raise ValueError("path")
    return steps


def _fits(node: Node, tag: str, conditions: list[tuple[str, str | None]]) -> bool:
    if tag not in ("*", node.tag):
        return False
    for name, value in conditions:
        if name == "class" and value is not None:
            if value not in node.get("class").split():
                return False
        elif name not in node.attrs or (value is not None and node.get(name) != value):
            return False
    return True


def select(root: Node, steps: list[Step], most: int = 10_000) -> list[Node]:
    """Elements the steps lead to, in document order, at most ``most``."""
    here: list[Node] = [root]
    for child, tag, conditions in steps:
        seen: set[int] = set()
        out: list[Node] = []
        for node in here:
            inner = (c for c in node.children if isinstance(c, Node)) if child else (n for n in node.walk() if n is not node)
            for n in inner:
                if id(n) not in seen and _fits(n, tag, conditions):
                    seen.add(id(n))
                    out.append(n)
                    if len(out) > most:
                        break
        here = out
    return here[: most + 1]
