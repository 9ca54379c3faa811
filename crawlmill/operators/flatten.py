"""Problem 7: deeply nested JSON records to related flat tables.

One pass over each value: a depth-first visitor emits, for every object and every list element that is no
object, a row with its table tag, own key, parent key and payload. The tag is the path without list positions,
so all parts of one shape share a table; ``write_tables`` writes them partitioned by tag and ``typed_table``
puts a schema on one of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlmill.sources.tables import spread

ROWS_AT_ONCE = 20_000
FIELDS, KINDS = ("tag", "pk", "parent_pk", "object_path", "kind", "payload"), ("object", "element", "value")
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))[ \t\n\r]*')


def _refuse(name: str) -> Any:
    raise ValueError(name)


def _load_deep(text: str) -> Any:
    """Read JSON of any depth without recursion: a stack of open containers and their pending names."""
    stack: list[tuple[Any, Any]] = []
    value: Any = None
    have, pos, want_name = False, 0, False
    name: Any = None
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError("token")
        pos = m.end()
        mark, string, plain = m.groups()
        if mark in ("{", "["):
            if have or want_name:
                raise ValueError("container")
            stack.append(({} if mark == "{" else [], name))
            name, want_name = None, mark == "{"
            if text.startswith("}", pos):
                want_name = False
        elif mark in ("}", "]"):
            if not stack or isinstance(stack[-1][0], dict) != (mark == "}") or (name is not None and not have):
                raise ValueError("close")
            box, own = stack.pop()
            if have:
                box.append(value) if isinstance(box, list) else box.__setitem__(name, value)
            elif box:
                raise ValueError("comma")
            value, have, name, want_name = box, True, own, False
        elif mark == ",":
            if not stack or not have:
                raise ValueError("comma")
            box = stack[-1][0]
            box.append(value) if isinstance(box, list) else box.__setitem__(name, value)
            have, name, want_name = False, None, isinstance(box, dict)
        elif mark == ":":
            if not stack or not isinstance(stack[-1][0], dict) or name is None or have:
                raise ValueError("colon")
        elif want_name:
            if string is None:
                raise ValueError("name")
            name, want_name = json.loads(string), False
            if not text.startswith(":", pos):
                raise ValueError("colon")
        else:
            if have:
                raise ValueError("value")
            value, have = json.loads(string or plain), True
    if stack or not have:
        raise ValueError("open")
    return value


def load(text: str) -> Any:
    """Value of a JSON text; ValueError where it is none (NaN and Infinity are none)."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _load_deep(text)


def _value(text: str | None) -> tuple[bool, Any]:
    """Whether a text is JSON, and its value; one that holds JSON once more is read once more."""
    if not text:
        return False, None
    try:
        value = load(text)
        return True, load(value) if isinstance(value, str) else value
    except ValueError:
        return False, None


def parts(text: str | None) -> Iterator[tuple[int, int | None, str, str, str, Any]]:
    """Number, number of the enclosing object, tag, path, kind and value of each part, depth first.

    Parts are numbered in the order they are met, so two parts never share a number, whatever dots or brackets
    stand in member names. Null, empty and invalid texts have no parts.
    """
    valid, value = _value(text)
    stack: list[tuple[Any, str, str, int | None]] = [(value, "$", "$", None)] if valid else []
    number = 0
    while stack:
        node, tag, path, parent = stack.pop()
        if isinstance(node, dict):
            yield number, parent, tag, path, "object", node
            stack.extend([(v, f"{tag}.{k}", f"{path}.{k}", number) for k, v in reversed(node.items()) if isinstance(v, (dict, list))])
            number += 1
        elif isinstance(node, list):
            inner = []
            for i, v in enumerate(node):
                at = f"{path}[{i}]"
                if isinstance(v, (dict, list)):
                    inner.append((v, tag + "[]" if isinstance(v, list) else tag, at, parent))
                else:
                    yield number, parent, tag + "[]", at, "element", v
                    number += 1
            stack.extend(reversed(inner))
        elif parent is None:
            yield number, None, tag, path, "value", node
            number += 1


def _said(text: str | None) -> str | None:
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def flatten(df: DataFrame, kind: str, key: str, field: str, fields: tuple[str, ...] = FIELDS, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """All parts of ``field``: ``record_kind, record_key``, then ``fields`` of parts that are one of ``kinds``.

    ``pk`` is record kind, record key, digest of the value and number of the part; ``parent_pk`` that of the
    enclosing object (null at the top). A null key or value gives no part. Where keys are asked for, a record
    delivered twice is read once; else its parts come twice. The payload of an object is its plain members as
    JSON. A lone surrogate in a member name, which no text may hold, becomes a question mark. Rows are handed on
    in bounded numbers, however many parts a value has, and only ``fields`` are made.
    """
    named = F.col(key).cast("string").alias("record_key")
    rows = df.filter(F.col(key).isNotNull() & F.col(field).isNotNull()).select(named, F.col(field).alias("value"))
    if "pk" in fields or "parent_pk" in fields:
        rows = rows.distinct().withColumn("digest", F.lower(F.hex(F.xxhash64("value"))))
    else:
        rows = rows.withColumn("digest", F.lit(""))
    dump = json.JSONEncoder(separators=(",", ":")).encode
    make = {
        "tag": lambda own, number, parent, tag, path, what, value: _said(kind + tag[1:]),
        "pk": lambda own, number, parent, tag, path, what, value: f"{own}{number}",
        "parent_pk": lambda own, number, parent, tag, path, what, value: None if parent is None else f"{own}{parent}",
        "object_path": lambda own, number, parent, tag, path, what, value: _said(path),
        "kind": lambda own, number, parent, tag, path, what, value: what,
        "payload": lambda own, number, parent, tag, path, what, value: dump({k: v for k, v in value.items() if not isinstance(v, (dict, list))} if what == "object" else value),
    }
    wanted = [make[f] for f in fields]
    names = ["record_key", *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for record, text, digest in zip(*(batch.column(n).to_pylist() for n in ("record_key", "value", "digest"))):
                own = f"{kind}:{record}:{digest}:"
                for part in parts(text):
                    if part[4] in kinds:
                        out.append((record, *[f(own, *part) for f in wanted]))
                        if len(out) == ROWS_AT_ONCE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names)
                            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names)

    found = spread(rows).mapInArrow(run, ", ".join(f"{n} string" for n in names))
    return found.select(F.lit(kind).alias("record_kind"), *names)


def write_tables(flat: DataFrame, path: str) -> None:
    """Write the parts partitioned by table tag."""
    flat.write.mode("overwrite").partitionBy("tag").parquet(path)


def typed_table(flat: DataFrame, tag: str, schema: str) -> DataFrame:
    """One flat table with its members as columns of ``schema``; members that don't fit become null."""
    rows = flat.filter((F.col("tag") == tag) & (F.col("kind") == "object"))
    return rows.select("record_kind", "record_key", "pk", "parent_pk", "object_path", F.from_json("payload", schema).alias("m")).select("record_kind", "record_key", "pk", "parent_pk", "object_path", "m.*")
