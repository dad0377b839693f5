"""Operator 4, token-ID / binary output: patched frame-of-reference blocks.

A file holds the ids of a run of documents, in ascending doc_id order:

    b"PFR1", then blocks, each: minimum u32, width u8, pad u8, exceptions u16, ids u32 | the low ``width`` bits of (id - minimum),
    packed | exception places u16 | exception values u32
    index: block starts u64 | doc ids i64 | null flags u8 | first id of each doc u64 (one more at the end)
    tail: blocks u64, docs u64, index place u64, block size u32, b"PFR1"

A block's width is that of the given percentile of its (id - minimum); what does not fit is an exception.  The index of
block starts lets a reader take any id range without reading the blocks before it.

Files are written under the shared folder with names of their own for each task attempt; the manifest, committed by
Spark's writer, names those that count, so a lost executor's files are never read.  Null texts are empty and get the
end id only.  Null doc_ids come first; repeated ids are ordered by text.  An empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, bpe_codec, common, words

MAGIC = b"PFR1"
GROUP = 1024  # partitions summed up together
_HEAD, _TAIL = struct.Struct("<IBBHI"), struct.Struct("<QQQI4s")


# --- blocks

def pack_blocks(ids: np.ndarray, size: int, percentile: float) -> list[bytes]:
    """The blocks of ``ids``, in order; those of equal width are packed together."""
    n = len(ids)
    if not n:
        return []
    count = -(-n // size)
    filled = np.full(count * size, ids[-1], np.uint32)
    filled[:n] = ids
    table = filled.reshape(count, size)
    low = table.min(axis=1)
    rest = table - low[:, None]
    k = min(size - 1, int(percentile * (size - 1) + 0.5))
    bound = np.partition(rest, k, axis=1)[:, k]
    width = np.maximum(1, np.ceil(np.log2(bound.astype(np.float64) + 1))).astype(np.int64)
    out: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        part = rest[rows]
        packed = _pack(part, w)
        over = (part >> np.uint32(w)) != 0 if w < 32 else np.zeros(part.shape, bool)
        for i, row in enumerate(rows.tolist()):
            own = size if row < count - 1 else n - row * size
            places = np.flatnonzero(over[i, :own])
            out[row] = _HEAD.pack(int(low[row]), w, 0, len(places), own) + packed[i].tobytes() + places.astype("<u2").tobytes() + part[i, places].astype("<u4").tobytes()
    return out


def _pack(part: np.ndarray, w: int) -> np.ndarray:
    if w == 16:
        return (part & 0xFFFF).astype("<u2").view(np.uint8)
    bits = np.unpackbits(part.astype("<u4").view(np.uint8).reshape(len(part), -1, 4), axis=2, bitorder="little", count=None)[:, :, :w]
    return np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")


def unpack_blocks(data: bytes, starts: np.ndarray, size: int) -> np.ndarray:
    """The ids of the blocks at ``starts``, end to end."""
    raw = np.frombuffer(data, np.uint8)
    heads = [_HEAD.unpack_from(data, s) for s in starts.tolist()]
    out = np.zeros((len(heads), size), np.uint32)
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        length = (size * w + 7) // 8
        body = raw[starts[rows][:, None] + _HEAD.size + np.arange(length)]
        if w == 16:
            out[rows] = np.ascontiguousarray(body).view("<u2")
        else:
            bits = np.unpackbits(body, axis=1, bitorder="little", count=size * w).reshape(len(rows), size, w)
            wide = np.zeros((len(rows), size, 32), np.uint8)
            wide[:, :, :w] = bits
            out[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for i, (s, (low, w, _, exceptions, _n)) in enumerate(zip(starts.tolist(), heads)):
        if exceptions:
            at = s + _HEAD.size + (size * w + 7) // 8
            out[i, np.frombuffer(data, "<u2", exceptions, at)] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
        out[i] += np.uint32(low)
    flat = out.reshape(-1)
    return flat[: len(flat) - size + heads[-1][4]] if heads else flat


def file_bytes(doc_ids: list, first: np.ndarray, ids: np.ndarray, size: int, percentile: float) -> bytes:
    blocks: list[bytes] = []
    for i in range(0, len(ids), 256 * size):
        blocks += pack_blocks(ids[i : i + 256 * size], size, percentile)
    starts = len(MAGIC) + np.cumsum([0, *map(len, blocks)])
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    index = starts[:-1].astype("<u8").tobytes() + docs.tobytes() + nulls.tobytes() + first.astype("<u8").tobytes()
    return b"".join([MAGIC, *blocks, index, _TAIL.pack(len(blocks), len(doc_ids), int(starts[-1]), size, MAGIC)])


class Reader:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        blocks, docs, at, self.size, magic = _TAIL.unpack_from(data, len(data) - _TAIL.size)
        if magic != MAGIC or data[:4] != MAGIC:
            raise ValueError("not a PFR1 file")
        self.data = data
        self.starts = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        keys, nulls = np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), nulls.tolist())]
        self.first = np.frombuffer(data, "<u8", docs + 1, at + 9 * docs).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1 of the file; only the blocks that hold them are unpacked."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.size, (b - 1) // self.size + 1
        return unpack_blocks(self.data, self.starts[i:j], self.size)[a - i * self.size : b - i * self.size]


# --- encoding with the tokenizers library

def _library(path: str) -> words.WordStore:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def make(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.fromiter(map(len, got), np.int32, len(got)), np.array([i for e in got for i in e], np.uint32)

    return words.WordStore(make)


def library_encode(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, end to end, and where each begins: the library encodes each word that is new to the worker."""
    return bpe_codec.gather(texts, common.kept("library ids", path, lambda: _library(path)), bpe.vocabulary(path))


# --- files

def _store(folder: str, name: str, data: bytes) -> None:
    if folder.startswith("file:"):
        at = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(at, exist_ok=True)
        with open(f"{at}/{name}", "wb") as f:
            f.write(data)
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    with system.open_output_stream(f"{at}/{name}") as f:
        f.write(data)


def write_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, block: int = 512, percentile: float = 0.95, file_ids: int = 8_000_000, chars: int = 500_000, partitions: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode the documents and write them, in ascending order, as files in ``folder``.

    Returns the committed manifest: (part, number, name, n_docs, n_ids), whose order by (part, number) is that of doc_id.
    A file ends after the piece, of about ``chars`` characters, with which it reaches ``file_ids`` ids.
    """
    path = vocabulary or bpe.vocabulary_path()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        keys: list = []
        got: list[np.ndarray] = []
        sizes: list[int] = []
        number = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:04d}-{attempt}.pfr"
            ids = np.concatenate(got)
            _store(folder, name, file_bytes(keys, np.concatenate([[0], np.cumsum(sizes)]), ids, block, percentile))
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "name": [name], "n_docs": [len(keys)], "n_ids": [len(ids)]}, manifest)

        total = 0
        for batch in batches:
            for own, rows in common.pieces(batch, chars):
                ids, at = library_encode(rows, path)
                whole = np.insert(ids, at[1:], np.uint32(end_id))  # every text is followed by the end id
                keys += own
                got.append(whole)
                sizes += (np.diff(at) + 1).tolist()
                total += len(whole)
                if total >= file_ids:
                    yield close()
                    keys, got, sizes, total = [], [], [], 0
                    number += 1
        if keys:
            yield close()

    ordered = common.texts(docs, key, text).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, number int, name string, n_docs long, n_ids long").write.parquet(f"{folder}-manifest")
    return spark.read.schema("part int, number int, name string, n_docs long, n_ids long").parquet(f"{folder}-manifest")


def _load(folder: str, name: str) -> bytes:
    if folder.startswith("file:"):
        with open(f"/{folder.removeprefix('file:').lstrip('/')}/{name}", "rb") as f:
            return f.read()
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{at}/{name}") as f:
        return f.read()


def file_starts(manifest: DataFrame) -> DataFrame:
    """(name, base): the ids of all files before each file, by running totals in parts, in groups of parts, and over groups."""
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, *keys: F.coalesce(F.sum(c).over(upto(*keys)), F.lit(0))
    files = manifest.withColumn("group", F.floor(F.col("part") / GROUP))
    parts = files.groupBy("group", "part").agg(F.sum("n_ids").alias("ids"))
    groups = parts.groupBy("group").agg(F.sum("ids").alias("ids")).select("group", before("ids", "group").alias("a"))  # a row for GROUP partitions
    parts = parts.select("group", "part", before("ids", "group", "part").alias("b"))
    own = files.select("group", "part", "number", "name", before("n_ids", "group", "part", "number").alias("c"))
    return own.join(parts, ["group", "part"]).join(groups, "group").select("name", (F.col("a") + F.col("b") + F.col("c")).cast("long").alias("base"))


def read_files(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document from the files: (doc_id, start, n_tokens, ids_crc32).  Each file is read by one task; nothing is sent to all."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = Reader(_load(folder, name))
                step = 256 * r.size
                held, at, crcs = np.zeros(0, np.uint32), 0, []
                for a, b in zip(r.first[:-1].tolist(), r.first[1:].tolist()):
                    if b > at + len(held):
                        held, at = r.ids(a, min(int(r.first[-1]), max(b, a + step))), a
                    crcs.append(zlib.crc32(held[a - at : b - at].astype("<u4", copy=False).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64()), pa.array(base + r.first[:-1]), pa.array(np.diff(r.first)), pa.array(crcs, pa.int64())], schema=out)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return file_starts(manifest).repartition(n, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    folder = common.fresh_path(docs.sparkSession, "ids")
    return read_files(folder, write_files(docs, folder, vocabulary, end_id))
