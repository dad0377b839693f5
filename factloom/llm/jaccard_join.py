"""Operator 7, n-gram Jaccard join: signature trees.

Two documents link when the Jaccard similarity of their shingle sets is at least ``share`` percent.

1. Documents of equal sets become one node, named by its smallest doc_id.
2. Sets that link share a key among their first n - ceil(t n) + 1 keys in any common order; long shingles come first in
   it, so phrases of common words hardly count.  Nodes with a key in common, in size classes that can link, are a group.
3. Each group's nodes are compared with its smallest node first, on the whole texts.  Components of the links found make
   most groups whole.
4. Groups still in several components are searched with signature trees: nodes hold OR-combined bitmaps, size ranges and
   the most shingles that share a bit; two trees are walked together and node pairs dropped when no pair under them can
   overlap enough.  What is left joins documents to clusters of possible partners: a group gives one row for each document
   that has any.  Clusters over several components are walked with trees again, this time with the shingles of their
   documents, each sent once: pairs are compared, and a link is kept only if it joins components that no link kept before has
   joined.  So links stay fewer than documents, however many pairs of a group are close.
5. Large groups and clusters are cut into blocks, each pair of blocks a task of its own, so no task holds an unbounded group
   and nothing is capped.  Components of all links give the result.

Shingles are known by 64-bit hashes, words of over 32 bytes by a cryptographic one.

Null and empty texts have no shingles and link with nothing.  A null doc_id cannot be named, so such a row links with
nothing and has a null component.  Repeated rows each get their row; a doc_id is taken to name one text, and rows that share
one without sharing the text are each placed by their own text, but met with others by one of them.  Ties go to the smallest doc_id.  Texts are read whole, some 50 bytes of memory for each of
a long text's.  An empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles
from .components import components

LEAF = 16
BLOCK = 2048
SPAN = 48


def _needed(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """The least overlap with which sizes a and b link: 100 i >= share (a + b - i)."""
    return -(-share * (a + b) // (100 + share))


# --- signature trees

class Tree:
    """A binary tree over members sorted by size.  Level 0 are leaves of up to LEAF members, the last level is the root."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        self.bits, self.size = bits, size
        ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        cuts = np.arange(0, len(size), LEAF)
        self.levels = [(np.bitwise_or.reduceat(bits, cuts, axis=0), np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts), np.maximum.reduceat(size - ones, cuts))]
        while len(self.levels[-1][1]) > 1:
            b, low, high, excess = self.levels[-1]
            cuts = np.arange(0, len(low), 2)
            self.levels.append((np.bitwise_or.reduceat(b, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(excess, cuts)))


def dual_traversal(x: Tree, y: Tree, share: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Member pairs (of x, of y) that no bound rules out, walking both trees from their roots, level by level."""
    i, j = len(x.levels) - 1, len(y.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        bx, lx, hx, ex = x.levels[i]
        by, ly, hy, ey = y.levels[j]
        common_bits = np.bitwise_count(bx[a] & by[b]).sum(axis=1).astype(np.int64)
        most = np.minimum(np.minimum(hx[a], hy[b]), common_bits + np.minimum(ex[a], ey[b]))
        keep = most >= _needed(lx[a], ly[b], share)
        keep &= (100 * hx[a] >= share * ly[b]) & (100 * hy[b] >= share * lx[a])
        a, b = a[keep], b[keep]
        if not len(a):
            return
        if i == j == 0:
            break
        if i >= j:
            a, b, i = *_children(a, b, len(x.levels[i - 1][1])), i - 1
        else:
            b, a, j = *_children(b, a, len(y.levels[j - 1][1])), j - 1
    for at in range(0, len(a), 256):
        p = (a[at : at + 256, None] * LEAF + np.arange(LEAF)).repeat(LEAF, axis=1).ravel()
        q = np.tile(b[at : at + 256, None] * LEAF + np.arange(LEAF), LEAF).ravel()
        real = (p < len(x.size)) & (q < len(y.size))
        p, q = p[real], q[real]
        close = (100 * x.size[p] >= share * y.size[q]) & (100 * y.size[q] >= share * x.size[p])
        p, q = p[close], q[close]
        only_x = np.bitwise_count(x.bits[p] & ~y.bits[q]).sum(axis=1).astype(np.int64)
        only_y = np.bitwise_count(y.bits[q] & ~x.bits[p]).sum(axis=1).astype(np.int64)
        most = np.minimum(x.size[p] - only_x, y.size[q] - only_y)
        good = most >= _needed(x.size[p], y.size[q], share)
        yield p[good], q[good]


def _children(a: np.ndarray, b: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    two, other = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
    real = two < below
    return two[real], other[real]


# --- the join

def _sets(docs: DataFrame, k: int, share: int) -> DataFrame:
    """(doc_id, n, digest, bits, prefix) of each row."""

    def run(ids: list, rows: list[str]) -> dict:
        import hashlib

        out: dict = {"doc_id": ids, "n": [], "digest": [], "bits": [], "prefix": []}
        for s in shingles.shingle_sets(rows, k):
            n = len(s)
            out["n"].append(n)
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            out["bits"].append(shingles.bitmap(s).tobytes() if n else b"")
            out["prefix"].append(s[: n - -(-share * n // 100) + 1].view(np.int64).tolist() if n else [])
        return out

    return common.per_text(docs, run, "doc_id long, n long, digest binary, bits binary, prefix array<long>")


def _bucket(n: Column, share: int) -> Column:
    """Size classes such that linked sets are in the same or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / share)) + 1e-9).cast("int")


def _verify(pairs: DataFrame, own: DataFrame, block: DataFrame, k: int, share: int, partitions: int) -> DataFrame:
    """The pairs (u, v) that link, told from the whole texts.

    ``block`` (node, block) puts nodes likely to be paired into small blocks; the pairs of two blocks are compared together,
    so a text is sent once for each pair of blocks and not for each pair.
    """
    side = lambda c: block.select(F.col("node").alias(c), F.col("block").alias(f"b{c}"))
    placed = common.materialise(pairs.join(side("u"), "u").join(side("v"), "v").select(F.least("bu", "bv").alias("i"), F.greatest("bu", "bv").alias("j"), "u", "v"), "placed")
    need = placed.select("i", "j", "u").unionAll(placed.select("i", "j", F.col("v").alias("u"))).distinct()
    need = common.materialise(need, "need")
    ids = common.materialise(need.select(F.col("u").alias("id")).distinct(), "ids")
    texts = common.rows_of(own, ids, "doc_id").select(F.col("doc_id").alias("u"), "text")
    rows = need.join(texts, "u").select("i", "j", F.lit(0).alias("kind"), "u", F.lit(0).cast("long").alias("v"), "text")
    rows = rows.unionAll(placed.select("i", "j", F.lit(1).alias("kind"), "u", "v", F.lit(None).cast("string").alias("text")))
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        common.trim()
        at, sets, waiting, good = None, {}, [], []

        def build() -> None:
            if waiting:
                sets.update(zip([w[0] for w in waiting], shingles.shingle_sets([w[1] for w in waiting], k)))
                waiting.clear()

        for batch in batches:
            for i, j, kind, u, v, t in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (i, j) != at:
                    at = (i, j)
                    sets.clear()
                    waiting.clear()
                if kind == 0:
                    waiting.append((u, t or ""))
                    if len(waiting) >= 64:
                        build()
                    continue
                build()
                a, b = sets.get(u), sets.get(v)
                if a is not None and b is not None and len(a) and len(b) and 100 * min(len(a), len(b)) >= share * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= share * (len(a) + len(b) - both):
                        good.append((u, v))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good)], schema=out)
                good = []

    dealt = rows.repartition(partitions, "i", "j").sortWithinPartitions("i", "j", "kind")
    found = common.materialise(dealt.mapInArrow(run, "u long, v long").distinct(), "hub-links")
    common.discard(placed, need, ids)
    return found


def _bits_allow(rows: DataFrame, share: int) -> DataFrame:
    """Of (u, v, nu, nv, bu, bv) the pairs whose bitmaps allow enough overlap."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v, nu, nv = (batch.column(i).to_numpy() for i in range(4))
            most = np.empty(len(u), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                words = min(len(x), len(y)) // 8
                x, y = shingles.folded(x, words), shingles.folded(y, words)
                most[i] = min(nu[i] - int(np.bitwise_count(x & ~y).sum()), nv[i] - int(np.bitwise_count(y & ~x).sum()))
            good = most >= _needed(nu, nv, share)
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], schema=out)

    return rows.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(run, "u long, v long")


_GROUP = ("token", "low", "i", "j")


def _group_walk(rows: DataFrame, payload: str, fn, partitions: int, schema: str, out: pa.Schema) -> DataFrame:
    """``fn(columns)`` of each (token, low, i, j): columns by name, ``payload`` an array of bytes; it yields lists for ``out``.

    ``rows``: token, low (the lower size class), i, j (blocks), own (block of the row), bucket, node, n, label, hub, payload.
    """
    columns = (*_GROUP, "own", "bucket", "node", "n", "label", "hub", payload)

    def run(batches):
        common.trim()
        held: dict[str, np.ndarray] | None = None

        def group(c):
            for found in fn(c):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, out)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(k).to_numpy() for k, name in enumerate(columns[:-1])}
            c[payload] = np.empty(batch.num_rows, object)
            c[payload][:] = batch.column(len(columns) - 1).to_pylist()
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in c}
            key = np.stack([c[k].astype(np.int64) for k in _GROUP])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            begin = [0, *cut.tolist()]
            for a, b in zip(begin, begin[1:]):
                yield from group({k: x[a:b] for k, x in c.items()})
            held = {k: x[begin[-1] :] for k, x in c.items()}
        if held is not None:
            yield from group(held)

    dealt = rows.select(*columns).repartition(partitions, *_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, schema)


def _candidates(c: dict[str, np.ndarray], bits: np.ndarray, share: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of different components that the dual traversal of a group's two signature trees leaves; pairs with the class's hub are known."""
    low, i, j = c["low"][0], c["i"][0], c["j"][0]
    lower = c["bucket"] == low
    sides = [(lower & (c["own"] == i), lower & (c["own"] == j)), (lower & (c["own"] == i), ~lower & (c["own"] == j))]
    if i != j:
        sides.append((lower & (c["own"] == j), ~lower & (c["own"] == i)))
    for left, right in sides:
        x, y = np.flatnonzero(left), np.flatnonzero(right)
        if not len(x) or not len(y):
            continue
        x, y = x[np.argsort(c["n"][x], kind="stable")], y[np.argsort(c["n"][y], kind="stable")]
        for p, q in dual_traversal(Tree(bits[x], c["n"][x]), Tree(bits[y], c["n"][y]), share):
            p, q = x[p], y[q]
            hub_known = (c["node"][q] == c["hub"][q]) | (c["bucket"][p] == c["bucket"][q]) & (c["node"][p] == c["hub"][p])
            new = (c["label"][p] != c["label"][q]) & ~hub_known
            yield p[new], q[new]


def _candidate_stars(rows: DataFrame, share: int, partitions: int) -> DataFrame:
    """(u, v): each row with a possible partner in another component, joined to one row of those it is connected with in its group."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def fn(c):
        words = min(map(len, c["bits"])) // 8
        root = np.arange(len(c["node"]))
        live = np.zeros(len(root), bool)
        for p, q in _candidates(c, np.stack([shingles.folded(b, words) for b in c["bits"]]), share):
            live[p] = live[q] = True
            while True:  # rows point to the least row they are connected with, as far as the pairs seen tell
                a, b = root[p], root[q]
                if (a == b).all():
                    break
                low = np.minimum(a, b)
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                while not (root[root] == root).all():
                    root = root[root]
        at = np.flatnonzero(live)
        u, v = c["node"][at], c["node"][root[at]]
        apart = u != v
        if apart.any():
            yield np.maximum(u, v)[apart], np.minimum(u, v)[apart]

    return _group_walk(rows, "bits", fn, partitions, "u long, v long", out).distinct()


def _tree_links(rows: DataFrame, share: int, partitions: int) -> DataFrame:
    """(u, v): links found in each group that join components which its links so far have not joined; payload: the shingles."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def fn(c):
        sets = [np.frombuffer(b, np.uint64) for b in c["keys"]]
        maps = [shingles.bitmap(s) for s in sets]
        words = min(map(len, maps))
        bits = np.stack([shingles.folded(m.tobytes(), words) for m in maps])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        u, v = [], []
        for p, q in _candidates(c, bits, share):
            for a, b in zip(p.tolist(), q.tolist()):
                one, two = root(int(c["label"][a])), root(int(c["label"][b]))
                if one == two:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                    parent[max(one, two)] = min(one, two)
                    u.append(max(c["node"][a], c["node"][b]))
                    v.append(min(c["node"][a], c["node"][b]))
        if u:
            yield u, v

    return _group_walk(rows, "keys", fn, partitions, "u long, v long", out).distinct()


def _keys(docs: DataFrame, k: int) -> DataFrame:
    """(node, keys): the shingles of each document."""
    return common.per_text(docs, lambda ids, rows: {"node": ids, "keys": [s.tobytes() for s in shingles.shingle_sets(rows, k)]}, "node long, keys binary")


def links(docs: DataFrame, k: int = 5, share: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, edges): (doc_id, n_shingles, node) of each row, and links (u, v) that connect all nodes that links connect."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = common.texts(docs, key, text)
    sets = common.materialise(_sets(own, k, share), "sets")
    named = sets.filter("n > 0 AND doc_id IS NOT NULL")
    node = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    members = sets.select("doc_id", "n", "digest").join(node, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    members = common.materialise(members, "members")
    first = node.select(F.col("digest").alias("d"), F.col("node"))
    nodes = common.materialise(named.join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("node"))).select("node", "n", "bits", "prefix", _bucket(F.col("n"), share).alias("bucket")).dropDuplicates(["node", "n", "bits"]), "nodes")
    common.discard(sets)

    tokens = nodes.select("node", "bucket", F.explode("prefix").alias("token"))
    groups = tokens.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1")
    rows = common.materialise(tokens.join(groups, "token"), "groups")
    hubs = common.materialise(rows.groupBy("token", "bucket").agg(F.min("node").alias("hub")), "hubs")
    facts = nodes.select("node", "n", "bits")

    own_hub = rows.join(hubs, ["token", "bucket"]).select("node", "hub")
    next_hub = rows.withColumn("bucket", F.col("bucket") + 1).join(hubs, ["token", "bucket"]).select("node", "hub")
    pairs = own_hub.unionAll(next_hub).filter("node <> hub").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
    sized = pairs.join(facts.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu")), "u").join(facts.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv")), "v").filter((100 * F.col("nu") >= share * F.col("nv")) & (100 * F.col("nv") >= share * F.col("nu")))
    pairs = common.materialise(_bits_allow(sized, share).distinct(), "hub-pairs")

    # nodes of one first shared key are likely to be near copies of each other: they make blocks of about SPAN nodes
    homes = rows.groupBy("node").agg(F.min("token").alias("home"))
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / SPAN).alias("parts"))
    block = common.materialise(homes.join(sizes, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "blocks")
    near = _verify(pairs, own, block, k, share, partitions)
    common.discard(pairs, block)
    common.release(spark)
    label = components(near)

    labelled = rows.filter("members > 2").join(label, "node", "left").select("token", "bucket", "node", F.coalesce("label", "node").alias("label"))
    open_ = labelled.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("token")
    counts = labelled.join(open_, "token", "left_semi").groupBy("token", "bucket").agg(F.count("*").alias("c"))
    # a row serves its own class as the lower one, and the class below as the upper one
    at_low = labelled.withColumn("low", F.explode(F.array("bucket", F.col("bucket") - 1)))
    lows = counts.select("token", F.explode(F.array("bucket", F.col("bucket") - 1)).alias("low"), "c", (F.col("bucket")).alias("of")).groupBy("token", "low").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("of") == F.col("low"), F.col("c"))).alias("lower"))
    lows = lows.filter("lower IS NOT NULL AND c > 2").select("token", "low", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    dealt = at_low.join(lows, ["token", "low"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", "low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "bucket", "node", "label")
    dealt = dealt.join(hubs, ["token", "bucket"]).join(facts, "node")
    stars = common.materialise(_candidate_stars(dealt, share, partitions), "candidates")
    common.release(spark)
    cluster = components(stars).select("node", F.col("label").alias("token"))
    cluster = common.materialise(cluster.join(label, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label")), "clusters")
    sizes = cluster.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("a <> b").select("token", "blocks")
    met = cluster.join(sizes, "token").join(facts.select("node", "n"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("token", F.lit(0).alias("low"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.lit(0).alias("bucket"), "node", "n", "label", F.lit(-(2**63)).cast("long").alias("hub"))  # no hub: all pairs of a cluster are open
    met = common.materialise(met, "cluster-rows")
    ids = common.materialise(met.select(F.col("node").alias("id")).distinct(), "live-ids")
    more = _tree_links(met.join(_keys(common.rows_of(own, ids, "doc_id"), k), "node"), share, partitions)
    edges = common.materialise(near.unionAll(more).distinct(), "links")
    common.discard(nodes, rows, hubs, near, stars, cluster, met, ids)
    common.release(spark)
    return members, edges


def join(docs: DataFrame, k: int = 5, share: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id is the smallest doc_id reachable by links."""
    members, edges = links(docs, k, share, key, text)
    label = components(edges).withColumnRenamed("node", "node_")
    return members.join(label, F.col("node") == F.col("node_"), "left").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, share: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are their component's smallest document, with all their columns.

    Rows that repeat a doc_id are one document and stay or go together; rows without doc_id stay.
    """
    gone = join(docs, k, share, key, text).filter("component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct()
    return common.rows_without(docs, common.materialise(gone, "copies"), key)
