"""Repair of broken records: tolerant JSON, misspelt keys, declared field types."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_SPLIT = re.compile(r"""(?:"[^"]*"|'[^']*'|\[[^\]]*\]|\{[^}]*\}|[^,])+""")
_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")


def repair(text: str | None) -> str | None:
    """The first object of a text as JSON: what stands before it goes, and what follows it, unless that goes on with a comma;
    closers missing at the end are supplied.

    An object cut inside a string, or after a comma, colon or key, is not guessed at: null.
    """
    t = _FENCE.sub("", text or "")
    at = t.find("{")
    if at < 0:
        return None
    t = t[at:]
    try:
        found, end = json.JSONDecoder().raw_decode(t)
        return None if t[end:].lstrip().startswith(",") else _written(found)
    except ValueError:
        pass
    closers = _open_closers(t)
    try:
        return _written(json.loads(t.rstrip() + closers)) if closers else None
    except ValueError:
        return None


def _written(found: object) -> str:
    return json.dumps(found, ensure_ascii=False, sort_keys=True)


def _open_closers(t: str) -> str:
    """The closers that would end what a text leaves open; none if it ends inside a string or closes what is not open."""
    bare = _STRING.sub('""', t)
    if bare.count('"') % 2:
        return ""
    depth: list[str] = []
    for c in re.findall(r"[{}\[\]]", bare):
        if c in "{[":
            depth.append("}" if c == "{" else "]")
        elif not depth or depth.pop() != c:
            return ""
    return "".join(reversed(depth))


def repair_json(text: Column) -> Column:
    """Arrow-batched, evaluated once for each row; null texts cost nothing but their place in the batch."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else repair(t))

    return run.asNondeterministic()(text)


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object and nothing else, told in the JVM; its reader alone would overlook what follows one."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(alone & text.rlike(r"(?s)^\s*\{.*\}\s*$") & ~text.rlike(r"\}\s*\]\s*\[\s*\{"), F.lit(False))


def parse(text: Column) -> Column:
    """The record as it is if it is a JSON object, else its first object repaired; Python gets null for the good ones."""
    good = is_object(text)
    return F.coalesce(F.when(good, text), repair_json(F.when(~good, text)))


def loose_pairs(text: str | None, names: tuple[str, ...] = ()) -> dict[str, str]:
    """Keys and values of something like an object: quotes and colons may be missing.

    Entries are cut at commas outside quotes and brackets; a part without a key of its own goes on with the value before it.
    A part without a colon is split after the longest of ``names`` it begins with.
    """
    body = (text or "").strip()
    if body[:1] == "{":
        body = body[1:].rstrip()
        body = body[:-1] if body.endswith("}") else body
    out: dict[str, str] = {}
    last = None
    for part in _SPLIT.findall(body):
        part = part.strip()
        m = re.match(r"""\s*["']?([A-Za-z_][A-Za-z0-9_ ]*?)["']?\s*[:=]\s*(.*)\Z""", part, re.S)
        name = next((x for x in sorted(names, key=len, reverse=True) if part.lower().startswith(x.lower()) and not part[len(x) : len(x) + 1].isalnum()), None)
        if m and (not names or m[1] in names or name is None):
            last, value = m[1], m[2]
        elif name is not None:
            last, value = name, part[len(name) :]
        elif part and last is not None:
            out[last] += ", " + part
            continue
        else:
            continue
        out[last] = value.strip().strip("\"'")
    return out


def loose_object(text: Column, names: tuple[str, ...] = ()) -> Column:
    @F.pandas_udf("map<string,string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else loose_pairs(t, names))

    return run(text)


def outermost(text: Column) -> Column:
    """From the first to the last brace of a text if that is an object, else an empty one."""
    t = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(is_object(t), t).otherwise("{}")


def with_spans(fields: list[tuple[str, Column]]) -> Column:
    """An object written in the given order, and of each value the characters [begin, end) in it: struct (text, spans)."""
    parts = F.array(*(F.struct(F.lit(name).alias("name"), F.concat(F.lit("{" if i == 0 else ", "), F.lit(json.dumps(name) + ": ")).alias("head"), F.coalesce(value, F.lit("null")).alias("body")) for i, (name, value) in enumerate(fields)))
    sizes = lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda n, p: n + F.char_length(p["head"]) + F.char_length(p["body"]))
    span = lambda p, i: F.struct(p["name"].alias("name"), (sizes(i) + F.char_length(p["head"])).alias("begin"), (sizes(i) + F.char_length(p["head"]) + F.char_length(p["body"])).alias("end"))
    return F.struct(F.concat(F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"])), ""), F.lit("}")).alias("text"), F.transform(parts, span).alias("spans"))


def closest_key(allowed: list[str], cutoff: float = 0.8):
    """A pandas UDF: the key itself, or the allowed key most like it, or null."""

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else k if k in allowed else next(iter(difflib.get_close_matches(k, allowed, 1, cutoff)), None))

    return run


def compile_spec(spec: str) -> str:
    """A field declaration (``enum:a|b -- prose``, ``list[int]`` ...) as a Spark type."""
    head = spec.split(" -- ")[0].strip()
    kinds = {"bool": "boolean", "int": "int", "string": "string", "list[int]": "array<int>", "list[string]": "array<string>", "list[object]": "array<map<string,string>>", "object": "map<string,string>"}
    if head.startswith("enum:"):
        return "string"
    if head not in kinds:
        raise ValueError(f"unknown type {head!r}")
    return kinds[head]


def enum_values(spec: str) -> list[str]:
    head = spec.split(" -- ")[0].strip()
    return head[5:].split("|") if head.startswith("enum:") else []


def coerce(value: Column, spec: str) -> Column:
    """A text value as its declared type, null if it is none; enums by separators and unique prefix."""
    from . import text as t

    head = spec.split(" -- ")[0].strip()
    if head.startswith("enum:"):
        return t.enum_by_prefix(t.enum_separators(value), enum_values(spec))
    if head == "bool":
        return t.as_bool(value)
    if head == "int":
        return value.try_cast("int")
    if head == "string":
        return value
    if head == "list[int]":
        found = F.regexp_extract_all(value, F.lit(r"(?<![\w.])(-?[0-9]+)(?![\w.])"), F.lit(1))
        return F.transform(found, lambda x: x.cast("int"))
    return F.from_json(value, compile_spec(spec))


def coerce_noted(value: Column, spec: str) -> Column:
    """(value as text, note): the note is null for a value that fits as it is, ``repaired`` for one that was brought to fit, ``unreadable`` for one that cannot be."""
    got = coerce(value, spec)
    text = got.cast("string") if not spec.split(" -- ")[0].strip().startswith(("list", "object")) else F.to_json(got)
    note = F.when(value.isNull(), None).when(got.isNull(), "unreadable").when(text != value, "repaired")
    return F.struct(text.alias("value"), note.alias("note"))
