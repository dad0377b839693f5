"""Operator 9, PII: information-theoretic sanitisation.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers, found by pattern.  Their values are the
protected entities.  From windows of words around every occurrence in the corpus, the operator estimates how far a term
reveals an entity: the share of the term's occurrences, over all texts, that stand near that entity, and the pointwise
mutual information of the two: the share near the entity against the share that chance would put into the entity's windows.  Terms over both thresholds are spans of kind ``term`` wherever they stand.  Copies of a text repeat
one piece of evidence, so a term's surroundings are counted, not its occurrences: a surrounding is the whole window of
words around the term, and an equal window counts once, near the entity and away from it.  A term must stand near its
entity in several surroundings.

Sanitising replaces entities and terms by their kind (generalised), or by nothing.

Null and empty texts have no spans.  Null ids and repeated rows are handled row by row (copies count as one surrounding);
spans that begin together are ordered by kind; an empty table gives an empty result; other columns are kept by ``sanitise``
and not read by ``find``, whatever their names.  Texts are always read whole, in time linear in their length and spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HELD = 500_000  # surroundings that a task gathers before it gives them on
KINDS = ("email", "ip", "card", "phone", "term")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Disclosure:
    """``window`` words to each side; a term needs ``support`` surroundings, ``share`` of all its surroundings and ``bits`` of information."""

    window: int = 10
    support: int = 3
    share: float = 0.5
    bits: float = 6.0
    letters: int = 4
    block: int = 200_000  # terms that are sent to every executor; more are joined


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind.  A match that fails its test is dropped with its text."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            i = m.start()
            while i > free and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append((i, m.end(), "email"))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], _ORDER[s[2]]))
    return out


def term_of(word: str, letters: int) -> str | None:
    """The term that a word stands for: lower case, without marks at its ends; short ones and numbers are none."""
    term = _EDGE.sub("", word).lower()
    return term if len(term) >= letters and not term.isdigit() else None


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _around(words: list[str], i: int, window: int) -> int:
    """The surrounding of a word: the hash of the words up to ``window`` places from it."""
    return _hash(*words[max(0, i - window) : i + window + 1])


def evidence(text: str, d: Disclosure) -> tuple[set[tuple[int, str | None, int]], int]:
    """{(entity, term, surrounding)} for the terms near each base span, with a null term for the span itself, and the text's words.

    Words that touch a span are no terms.
    """
    spans = base_spans(text)
    if not spans:
        return set(), len(text.split())
    found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
    ends = [w[1] for w in found]
    begins = [w[0] for w in found]
    words = [w[2] for w in found]
    touched = set()
    places = []
    for a, b, kind in spans:
        first, last = bisect_right(ends, a), bisect_left(begins, b)
        touched.update(range(first, last))
        places.append((first, last, kind + (text[a:b].lower() if kind == "email" else _NOT_DIGIT.sub("", text[a:b]) if kind != "ip" else text[a:b])))
    out: set[tuple[int, str | None, int]] = set()
    for first, last, entity in places:
        near = _hash(entity)
        out.add((near, None, _hash(*words[max(0, first - d.window) : last + d.window])))
        for i in (*range(max(0, first - d.window), first), *range(last, min(len(found), last + d.window))):
            if i not in touched and (term := term_of(words[i], d.letters)):
                out.add((near, term, _around(words, i, d.window)))
    return out, len(words)


def _evidence_rows(docs: DataFrame, d: Disclosure) -> DataFrame:
    """(entity, term, around, words): evidence, each once in a piece of texts; a row without entity has the words of the piece."""

    def run(ids: list, rows: list[str]) -> dict:
        found: set = set()
        total = 0
        for t in rows:
            own, n = evidence(t, d)
            found |= own
            total += n
        flat = [*found, (None, None, None)]
        return {"entity": [k[0] for k in flat], "term": [k[1] for k in flat], "around": [k[2] for k in flat], "words": [0] * len(found) + [total]}

    return common.per_text(docs, run, "entity long, term string, around long, words long")


def _sent(terms: DataFrame, columns: list[str], bound: int) -> list | None:
    """The rows if there are no more than ``bound``."""
    rows = terms.select(*columns).limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def _occurrences(docs: DataFrame, terms: DataFrame, d: Disclosure) -> DataFrame:
    """(term, around): the surroundings in all texts of the terms (term, most), each once in a task, or in HELD of them.

    A term with more than ``most`` surroundings in one task is over its bound in the corpus too: its row has no surrounding.
    Up to ``block`` terms are sent to the executors; beyond that the words of all texts are joined to them.
    """
    rows = _sent(terms, ["term", "most"], d.block)
    held = None if rows is None else docs.sparkSession.sparkContext.broadcast({r.term: r.most for r in rows})

    out = pa.schema([("term", pa.string()), ("around", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        bound = held.value if held is not None else None
        known: dict[str, str | None] = {}
        found: dict[str, set[int]] = {}
        total = 0

        def settled() -> pa.RecordBatch:
            rows = [(term, a) for term, seen in found.items() for a in (seen if bound is None or len(seen) <= bound[term] else (None,))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(out)], schema=out)

        for batch in batches:
            for _, rows in common.pieces(batch, 250_000):
                for t in rows:
                    words = t.split()
                    for i, w in enumerate(words):
                        if w not in known:
                            term = term_of(w, d.letters)
                            known[w] = term if bound is None or term in bound else None
                        if (term := known[w]) is not None:
                            seen = found.setdefault(term, set())
                            if bound is None or len(seen) <= bound[term]:
                                total -= len(seen)
                                seen.add(_around(words, i, d.window))
                                total += len(seen)
                if len(known) > 1_000_000:
                    known.clear()
                if total > HELD:
                    yield settled()
                    found.clear()
                    total = 0
        yield settled()

    every = docs.mapInArrow(run, "term string, around long")
    return every if held is not None else every.join(terms.select("term"), "term", "left_semi")


def disclosing_terms(docs: DataFrame, d: Disclosure = Disclosure(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, entity, n_near, n_all, bits): the terms of the corpus that reveal a protected entity."""
    spark = docs.sparkSession
    own = common.texts(docs, key, text)
    seen = common.materialise(_evidence_rows(own, d).groupBy("entity", "term", "around").agg(F.sum("words").alias("words")), "evidence")
    near = seen.filter("term IS NOT NULL").groupBy("entity", "term").agg(F.count("*").alias("n_near")).filter(F.col("n_near") >= d.support)
    near = common.materialise(near, "near")
    wanted = near.groupBy("term").agg(F.floor(F.max("n_near") / F.lit(d.share)).alias("most"))
    every = _occurrences(own, wanted, d).groupBy("term", "around").agg(F.count("*").alias("c")).groupBy("term")
    every = every.agg(F.count("around").alias("n_all"), F.count_if(F.col("around").isNull()).alias("over")).filter("over = 0").drop("over")
    every = common.materialise(every, "every")
    by_entity = seen.filter("entity IS NOT NULL AND term IS NULL").groupBy("entity").agg(F.count("*").alias("n_entity"))
    n_words = seen.filter("entity IS NULL").agg(F.sum("words").cast("double").alias("w")).first()[0] or 0.0
    scored = near.join(every, "term").join(by_entity, "entity")
    # P(entity near | term) against P(entity near): its windows' share of all places
    bits = F.log2(F.col("n_near") * F.lit(n_words) / (F.col("n_all") * F.col("n_entity") * (2.0 * d.window)))
    scored = scored.withColumn("bits", bits).filter((F.col("n_near") >= d.share * F.col("n_all")) & (F.col("bits") >= d.bits))
    scored = common.materialise(scored.select("term", "entity", "n_near", "n_all", "n_entity", "bits"), "disclosing")
    common.discard(seen, near, every)
    return scored


def term_spans(text: str, terms: set[str] | frozenset[str], letters: int) -> list[tuple[int, int, str]]:
    """Spans of the terms that stand in a text, without the marks at their ends."""
    if not terms or not any(term_of(w, letters) in terms for w in {*text.split()}):
        return []
    out = []
    for m in _WORD.finditer(text):
        if term_of(m[0], letters) in terms:
            lead = re.match(r"[\W_]*", m[0]).end()
            out.append((m.start() + lead, m.start() + lead + len(_EDGE.sub("", m[0])), "term"))
    return out


def merged(base: list[tuple[int, int, str]], terms: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """All spans in order; terms that touch base spans are left out.  Both lists come in order, and terms are apart from each other."""
    out, k, reach = list(base), 0, 0
    for t in terms:
        while k < len(base) and base[k][0] < t[1]:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= t[0]:
            out.append(t)
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def all_spans(text: str, terms: set[str] | frozenset[str], letters: int) -> list[tuple[int, int, str]]:
    return merged(base_spans(text), term_spans(text, terms, letters))


def written(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _with_terms(docs: DataFrame, d: Disclosure, key: str, text: str) -> tuple[DataFrame, object]:
    """The rows with ``_terms``, the disclosing terms of the text, if they had to be joined, and else the terms, sent to the executors."""
    spark = docs.sparkSession
    terms = disclosing_terms(docs, d, key, text)
    rows = _sent(terms.select("term").distinct(), ["term"], d.block)
    if rows is not None:
        common.discard(terms)
        return docs.withColumn("_terms", F.lit(None).cast("array<string>")), spark.sparkContext.broadcast(frozenset(r.term for r in rows))

    @F.pandas_udf("array<string>")
    def words(column: pd.Series) -> pd.Series:
        return column.map(lambda t: sorted({x for w in {*(t or "").split()} if (x := term_of(w, d.letters))}))

    digest = F.unhex(F.sha2(F.col(text).cast("string"), 256))
    held = docs.select(digest.alias("_digest"), F.explode(words(F.col(text).cast("string"))).alias("term")).distinct().join(terms.select("term").distinct(), "term")
    held = held.groupBy("_digest").agg(F.collect_set("term").alias("_terms"))
    return docs.withColumn("_digest", digest).join(held, "_digest", "left").drop("_digest"), spark.sparkContext.broadcast(frozenset())


def find(docs: DataFrame, d: Disclosure = Disclosure(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of each row; n_spans counts all spans, terms too."""
    own, held = _with_terms(common.texts(docs, key, text), d, "doc_id", "text")
    out = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for doc_id, t, terms in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    base = base_spans(t or "")
                    kinds = Counter(s[2] for s in base)
                    all_ = merged(base, term_spans(t or "", held.value or frozenset(terms or ()), d.letters))
                    rows.append((doc_id, *(kinds[k] for k in KINDS[:4]), hashlib.sha256(written(base).encode()).hexdigest(), written(all_), len(all_)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return own.select("doc_id", "text", "_terms").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def clean(text: str, spans: list[tuple[int, int, str]], generalise: bool = True) -> str:
    """The text with its spans generalised to their kind, or removed; spans that overlap count as one of the first's kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{kind.upper()}]" if generalise else "")
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, d: Disclosure = Disclosure(), generalise: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same rows and columns with sanitised texts; null texts stay null."""
    own, held = _with_terms(docs, d, key, text)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, terms: pd.Series) -> pd.Series:
        common.trim()
        rows = ((t, held.value or frozenset(() if x is None else x)) for t, x in zip(texts, terms))
        return pd.Series([None if t is None else clean(t, all_spans(t, x, d.letters), generalise) for t, x in rows], index=texts.index, dtype="object")

    return own.withColumn(text, cleaned(F.col(text).cast("string"), F.col("_terms"))).select(docs.columns)
