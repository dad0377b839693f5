"""Operator 5, suffix-array dedup: run-length index.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller doc_id.

0. Of equal texts the one with the smallest doc_id is looked at; the others hold nothing that it does not.
1. Each window of ``length`` bytes names an anchor: of the ``gram``-byte strings in it the one least in a fixed order.
   Equal windows have equal anchors, so only windows whose anchor stands in two documents can repeat.  Anchors are dealt out
   by hash in packed lots; one met twice within a lot's texts is sent once, so a common one does not gather in one task.
2. The windows of one anchor lie in one region.  Equal regions are one variant, known by its digest, beside the anchor's
   hash, and by its first document.
3. The variants of many anchors together get a run-length index: their run-compressed Burrows-Wheeler transform with
   sampled run ends.  From the samples alone the matching statistics are streamed along the variants; matches of ``length``
   bytes join equal windows, whose least document is the first that has them.  An anchor with more than ``most`` variants
   is dealt out anew by the next longer anchors of ``grams`` inside its regions, and they are indexed in the same way; at
   ``length`` bytes a window is its own anchor and has one variant, so no index holds an unbounded group.
4. Each document's windows with a first document before it are united to spans.

Null and empty texts have no bytes.  Rows without doc_id neither remove nor lose anything.  Repeated rows are equal and do
not remove each other; a doc_id is taken to name one text, and rows that share one without sharing the text get the spans
of all of them, cut to their length.  Long texts are laid out one at a time, some 60 bytes of memory for each of theirs.
An empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .run_index import RunIndex
from .words import _powers

PIECE = 200_000  # bytes of variants in an index, and those of one more anchor
LOT = 2_000_000  # code points of the texts whose anchors are dealt out together
GRAMS = (20, 36)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of the anchors of a text's bytes, in order.

    The order of grams is that of their hashes.
    """
    n = len(raw)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[:n], out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    width = length - gram + 1
    # sliding minimum by doubling; 32 bits of the hash and the place in one number, so the first of equals wins
    low, span = h & _HIGH | np.arange(len(h), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = (low & _LOW).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return place, first, last, h[place]


def _pieces(ids: list, rows: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    for i, t in zip(ids, rows):
        if i is not None and t:
            yield i, np.frombuffer(t.encode(), np.uint8)


_DEALT = "lot long, h binary, doc_id binary, place binary"


def _dealt_anchors(docs: DataFrame, length: int, gram: int, lots: int) -> DataFrame:
    """Packed anchors: those met once in their piece of the texts with their hash's lot, the others known to be shared, in lots below 0.

    Of an anchor that its piece holds several times the lot gets the hash twice, which tells other pieces that it is shared.
    """

    def run(ids: list, rows: list[str]) -> dict:
        got = []
        for i, raw in _pieces(ids, rows):
            place, _, _, h = anchors(raw, length, gram)
            got.append((h, np.full(len(h), i, np.int64), place.astype(np.int32)))
        out: dict = {"lot": [], "h": [], "doc_id": [], "place": []}

        def add(lot: int, h, doc, place) -> None:
            for name, x in (("lot", lot), ("h", h.tobytes()), ("doc_id", doc.tobytes()), ("place", place.tobytes())):
                out[name].append(x)

        if got:
            h, doc, place = (np.concatenate(c) for c in zip(*got))
            uniq, nth, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            low, high = np.full(len(uniq), np.iinfo(np.int64).max), np.full(len(uniq), np.iinfo(np.int64).min)
            np.minimum.at(low, inverse, doc)
            np.maximum.at(high, inverse, doc)
            shared = low < high
            known = shared[inverse]
            if known.any():
                add(-1 - int(doc[0]) % (1 << 40), h[:0], doc[known], place[known])
            # anchors that one document holds several times go with all their places; of shared ones the hash goes alone, twice
            single = np.flatnonzero(~known)
            hs = np.concatenate([h[single], uniq[shared], uniq[shared]])
            ds = np.concatenate([doc[single], low[shared], high[shared]])
            ps = np.concatenate([place[single], np.full(2 * int(shared.sum()), -1, np.int32)])
            lot = (hs % np.uint64(lots)).astype(np.int64)
            order = np.argsort(lot, kind="stable")
            hs, ds, ps, lot = hs[order], ds[order], ps[order], lot[order]
            begin = np.flatnonzero(np.append(True, lot[1:] != lot[:-1]))
            for a, b in zip(begin.tolist(), np.append(begin[1:], len(lot)).tolist()):
                add(int(lot[a]), hs[a:b], ds[a:b], ps[a:b])
        return out

    return common.per_text(docs, run, _DEALT, LOT)


def _shared_places(dealt: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, place) of the anchors that stand in two documents or more."""
    out = pa.schema([("doc_id", pa.int64()), ("place", pa.int32())])

    def settle(h: list[bytes], doc: list[bytes], place: list[bytes]) -> pa.RecordBatch:
        h, doc, place = np.frombuffer(b"".join(h), np.uint64), np.frombuffer(b"".join(doc), np.int64), np.frombuffer(b"".join(place), np.int32)
        order = np.argsort(h, kind="stable")
        h, doc, place = h[order], doc[order], place[order]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        shared = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
        keep = np.repeat(shared, np.diff(np.append(begin, len(h)))) & (place >= 0)
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(place[keep])], schema=out)

    def run(batches):
        lot, held = None, ([], [], [])
        for batch in batches:
            for own, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[1], np.int64)), pa.array(np.frombuffer(row[2], np.int32))], schema=out)
                    continue
                if own != lot and held[0]:
                    yield settle(*held)
                    held = ([], [], [])
                lot = own
                for x, values in zip(row, held):
                    values.append(x)
        if held[0]:
            yield settle(*held)

    return dealt.repartition(partitions, "lot").sortWithinPartitions("lot").mapInArrow(run, "doc_id long, place int")


def _regions(held: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, v, doc_id, begin, windows) of the anchors at the given places of (doc_id, text, places); v: the region's digest."""
    out = pa.schema([("h", pa.int64()), ("v", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int32()), ("windows", pa.int32())])

    def run(batches):
        for batch in batches:
            for i, t, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = t.encode()
                place, first, last, h = anchors(np.frombuffer(data, np.uint8), length, gram)
                own = np.flatnonzero(np.isin(place, places.values.to_numpy()))
                digests = b"".join(hashlib.blake2b(data[a : b + length], digest_size=8).digest() for a, b in zip(first[own].tolist(), last[own].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(np.frombuffer(digests, "<i8")), pa.array(np.full(len(own), i, np.int64)), pa.array(first[own].astype(np.int32)), pa.array((last[own] - first[own] + 1).astype(np.int32))], schema=out)

    return held.select("doc_id", "text", "places").mapInArrow(run, "h long, v long, doc_id long, begin int, windows int")


def _spelled(held: DataFrame, length: int) -> DataFrame:
    """(h, v, doc, kinds, region) of (doc_id, text, at): the bytes of the regions at the given places."""
    out = pa.schema([("h", pa.int64()), ("v", pa.int64()), ("doc", pa.int64()), ("kinds", pa.int64()), ("region", pa.binary())])

    def run(batches):
        for batch in batches:
            for i, t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data, rows = t.encode(), at.values
                regions = [data[a : a + w - 1 + length] for a, w in zip(rows.field("begin").to_pylist(), rows.field("windows").to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.field("h"), rows.field("v"), pa.array([i] * len(regions), pa.int64()), rows.field("kinds"), pa.array(regions, pa.binary())], schema=out)

    return held.select("doc_id", "text", "at").mapInArrow(run, "h long, v long, doc long, kinds long, region binary")


def first_documents(regions: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each region and each of its windows the smallest of the documents of the regions that hold the window."""
    flat = RunIndex(regions).lowest(docs, length)
    windows = np.maximum(0, np.fromiter(map(len, regions), np.int64, len(regions)) - length + 1)
    return np.split(flat, np.cumsum(windows)[:-1])


def _indexed(variants: DataFrame, length: int, partitions: int) -> DataFrame:
    """(h, v, firsts) of (h, v, doc, region): the variants of an anchor meet in one index, with those of others."""
    out = pa.schema([("h", pa.int64()), ("v", pa.int64()), ("firsts", pa.list_(pa.int64()))])

    def settle(keys: list, docs: list, regions: list) -> pa.RecordBatch:
        found = first_documents(regions, np.array(docs, np.int64), length)
        at = np.cumsum([0, *map(len, found)])
        hs, vs = zip(*keys)
        return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(vs, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found)))], schema=out)

    def run(batches):
        keys, docs, regions, size, last = [], [], [], 0, None
        for batch in batches:
            for h, v, doc, region in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > PIECE and h != last:
                    yield settle(keys, docs, regions)
                    keys, docs, regions, size = [], [], [], 0
                keys.append((h, v))
                docs.append(doc)
                regions.append(region)
                size += len(region) + 1
                last = h
        if keys:
            yield settle(keys, docs, regions)

    return variants.select("h", "v", "doc", "region").repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(run, "h long, v long, firsts array<long>")


def _anew(variants: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, v, at, h2, v2, doc, region) of variants (h, v, doc, region): the regions inside a region by anchors of ``gram`` bytes."""
    schema = "h long, v long, at int, h2 long, v2 long, doc long, region binary"

    def run(batches):
        for batch in batches:
            rows = []
            for h, v, doc, region in zip(*(batch.column(i).to_pylist() for i in range(4))):
                _, first, last, own = anchors(np.frombuffer(region, np.uint8), length, gram)
                for a, b, k in zip(first.tolist(), last.tolist(), own.view(np.int64).tolist()):
                    part = region[a : b + length]
                    rows.append((h, v, a, k, _digest(part), doc, part))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["h", "v", "at", "h2", "v2", "doc", "region"])

    return variants.select("h", "v", "doc", "region").mapInArrow(run, schema)


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _firsts(variants: DataFrame, length: int, grams: tuple[int, ...], most: int, partitions: int) -> DataFrame:
    """(h, v, firsts) of (h, v, doc, kinds, region); kinds: how many variants the anchor has."""
    alone = variants.filter("kinds = 1").select("h", "v", F.array_repeat("doc", F.length("region") - length + 1).alias("firsts"))
    found = alone.unionAll(_indexed(variants.filter((F.col("kinds") > 1) & (F.col("kinds") <= most)), length, partitions))
    many = variants.filter(F.col("kinds") > most)
    if not many.head(1):
        return found
    inner = common.materialise(_anew(many, length, grams[0] if grams else length), "inner")
    own = inner.groupBy(F.col("h2").alias("h"), F.col("v2").alias("v")).agg(F.min(F.struct("doc", "region")).alias("r")).select("h", "v", "r.doc", "r.region")
    own = common.materialise(own.join(own.groupBy("h").agg(F.count("*").alias("kinds")), "h"), "inner-variants")
    got = _firsts(own, length, grams[1:], most, partitions).select(F.col("h").alias("h2"), F.col("v").alias("v2"), "firsts")
    parts = inner.select("h", "v", "at", "h2", "v2").join(got, ["h2", "v2"]).groupBy("h", "v").agg(F.array_sort(F.collect_list(F.struct("at", "firsts"))).alias("f"))
    return found.unionAll(parts.select("h", "v", F.flatten(F.transform("f", lambda x: x["firsts"])).alias("firsts")))


def repeated_spans(docs: DataFrame, length: int = 50, grams: tuple[int, ...] = GRAMS, most: int = 4_000, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(spans, copies): (doc_id, spans) of the documents that have any of the byte spans [a, b) to remove, which may touch or overlap;
    (doc_id) of the documents whose whole text an earlier one has."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = common.texts(docs, key, text).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    named = common.materialise(own.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = common.materialise(named.join(first, "digest").filter("doc_id > first").select(F.col("doc_id").alias("id")).distinct(), "copies")
    common.discard(named)
    own = common.rows_without(own, copies, "doc_id")
    places = _shared_places(_dealt_anchors(own, length, grams[0], 16 * partitions), partitions)
    places = common.materialise(places.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "places")
    common.release(spark)
    regions = common.materialise(_regions(own.join(places, "doc_id"), length, grams[0]), "regions")
    common.discard(places)
    common.release(spark)

    variants = regions.groupBy("h", "v").agg(F.min(F.struct("doc_id", "begin", "windows")).alias("at"), F.max("doc_id").alias("last"))
    variants = common.materialise(variants.select("h", "v", F.col("at.doc_id").alias("doc"), "at.begin", "at.windows", "last"), "variants")
    common.release(spark)
    counted = common.materialise(variants.join(variants.groupBy("h").agg(F.count("*").alias("kinds")), "h"), "counted")
    common.discard(variants)
    common.release(spark)
    single = counted.filter("kinds = 1 AND last > doc").select("h", "v", F.array("doc").alias("firsts"))
    wanted = counted.filter("kinds > 1").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("h", "v", "begin", "windows", "kinds")).alias("at"))
    spelled = common.materialise(_spelled(own.join(wanted, "doc_id"), length).dropDuplicates(["h", "v"]), "spelled")
    common.release(spark)
    firsts = common.materialise(single.unionAll(_firsts(spelled, length, grams[1:], most, partitions)), "firsts")
    common.discard(counted, spelled)
    common.release(spark)
    marked = _marked(regions.join(firsts, ["h", "v"]), length)
    spans = common.materialise(marked.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    common.discard(regions, firsts)
    common.release(spark)
    return spans, copies


def _marked(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, a, b): the bytes covered by runs of windows that an earlier document has."""
    out = pa.schema([("doc_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, begin, windows = (batch.column(i).to_numpy() for i in range(3))
            firsts = batch.column(3)
            counts = np.diff(firsts.offsets.to_numpy())
            flat = firsts.flatten().to_numpy()
            row = np.repeat(np.arange(len(doc)), counts)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            early = flat < doc[row]
            opens = early & np.append(True, ~early[:-1] | (row[1:] != row[:-1]))
            closes = early & np.append(~early[1:] | (row[1:] != row[:-1]), True)
            own = row[opens]
            a = begin[own] + at[opens]
            b = begin[own] + np.where(counts[own] == 1, windows[own] - 1, at[closes]) + length  # one value stands for all windows
            yield pa.RecordBatch.from_arrays([pa.array(doc[own], pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], schema=out)

    return rows.select("doc_id", "begin", "windows", "firsts").mapInArrow(run, "doc_id long, a int, b int")


def remove_repeats(docs: DataFrame, length: int = 50, grams: tuple[int, ...] = GRAMS, most: int = 4_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; kept: the bytes that remain."""
    spans, copies = repeated_spans(docs, length, grams, most, key, text)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(2**31 - 1).alias("b")))
    spans = spans.select("doc_id", "spans").unionAll(copies.select(F.col("id").alias("doc_id"), whole.alias("spans")))
    spans = spans.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = common.texts(docs, key, text).join(spans.withColumnRenamed("doc_id", "k"), F.col("doc_id") == F.col("k"), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            size = 0
            for i, t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = (t or "").encode()
                kept, removed, merged = cut(data, found) if len(data) >= length else (data, 0, 0)
                rows.append((i, len(data), removed, merged, hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return joined.mapInArrow(run, schema)


def cut(data: bytes, spans: pa.Scalar) -> tuple[bytes, int, int]:
    """What remains of the bytes, how many went, and in how many maximal runs."""
    if not data or not spans.is_valid or not len(spans):
        return data, 0, 0
    held = spans.values
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.minimum(held.field("a").to_numpy(), len(data)), 1)
    np.add.at(edge, np.minimum(held.field("b").to_numpy(), len(data)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs
