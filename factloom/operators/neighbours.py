"""Exact nearest neighbours of many among many, by the order of a projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled

_GRID = 1 << 20  # projections as integers, widened by one on both sides
_PARTS = 32  # blocks a side is cut into once it has more rows than these hold, so every row is sent this often at most
_NUMBERS = 1 << 22  # of one block at most
_TILE = 1 << 18  # products looked at in one go


def _axis(rows: DataFrame) -> tuple[int, float]:
    """The coordinate that varies most, and its spread."""
    size = rows.agg(F.max(F.size("v"))).first()[0]
    if not size or size < 0:
        return 0, 1.0
    spread = rows.agg(*(F.var_pop(F.col("v")[i]).alias(str(i)) for i in range(size))).first()
    best = max(range(size), key=lambda i: (spread[i] or 0.0, -i))
    return best, float(spread[best] or 0.0) ** 0.5 or 1.0


def _blocks(rows: DataFrame, axis: int, unit: float, block: int, width: int, name: str, keep: list[str]) -> DataFrame:
    """Rows in the order of their projection, a block to a row: (name, name_low, name_high, name_vectors, keep as lists).

    A block has ``block`` rows, or more where that would make more than ``_PARTS`` blocks, but ``_NUMBERS`` numbers at most.
    """
    n = rows.count()
    held = max(1, min(max(block, -(-n // _PARTS)), _NUMBERS // max(1, width)))
    placed = rows.withColumn("at", F.round(F.col("v")[axis] / unit * _GRID).cast("long")).repartitionByRange(max(1, -(-n // held)), "at", keep[0])
    gathered = placed.groupBy(F.spark_partition_id().alias(name)).agg(F.min("at").alias(f"{name}_low"), F.max("at").alias(f"{name}_high"), F.collect_list(F.struct("v", *keep)).alias("r"))
    return gathered.select(name, f"{name}_low", f"{name}_high", F.flatten("r.v").alias(f"{name}_vectors"), *(F.col(f"r.{k}").alias(f"{name}_{k}") for k in keep))


def _nearest(ids: np.ndarray, a: np.ndarray, first: np.ndarray, second: np.ndarray | None, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, d2, label) of the rows of ``a`` that have a nearest row in ``b``, of equals the least label.

    Products in single precision tell who may be nearest, within what their rounding can hide; distances of these are worked out in
    double precision.  With ``second`` a row's own id is no label: its vector's second label stands for it, if there is one.
    """
    good = np.isfinite(b).all(axis=1)
    if not good.all():
        b, first, second = b[good], first[good], None if second is None else second[good]
    none = np.zeros(0, int), np.zeros(0), first[:0]
    if not len(b):
        return none
    middle = b.mean(axis=0)
    scale = max(np.abs(b - middle).max(), np.abs(np.where(np.isfinite(a), a - middle, 0)).max()) or 1.0
    right = np.empty((len(b), b.shape[1] + 1), np.float32)
    right[:, :-1] = (b - middle) / scale
    norm = np.square(right[:, :-1], dtype=float).sum(axis=1)
    right[:, -1] = -norm / 2
    left = np.ones((len(a), a.shape[1] + 1), np.float32)
    left[:, :-1] = (a - middle) / scale
    far = np.sqrt(norm.max())
    slack = (2 * (a.shape[1] + 8) * 2.0**-23 * far * (np.linalg.norm(left[:, :-1].astype(float), axis=1) + far) + 1e-30).astype(np.float32)
    own = None
    if second is not None:
        order = np.argsort(first, kind="stable")
        begin, end = np.searchsorted(first[order], ids, "left"), np.searchsorted(first[order], ids, "right")
        at = np.repeat(np.arange(len(ids)), end - begin)
        own = at, order[np.arange(len(at)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)]
        lone = pd.isna(second)
    found, step = [], max(16, _TILE // len(b))
    for i in range(0, len(a), step):
        s = left[i : i + step] @ right.T
        if own is not None:
            here = slice(*np.searchsorted(own[0], (i, i + step)))
            rows, cols = own[0][here] - i, own[1][here]
            s[rows[lone[cols]], cols[lone[cols]]] = -np.inf
        top = s.max(axis=1)
        where, which = np.divmod(np.flatnonzero(s >= (top - slack[i : i + step])[:, None]), len(b))
        kept = np.isfinite(top[where])
        where, which = where[kept] + i, which[kept]
        exact = np.cumsum(np.square(a[where] - b[which]), axis=1)[:, -1] if len(where) else np.zeros(0)
        label = first[which]
        if own is not None:
            label = np.where(label == ids[where], second[which], label)
        order = np.lexsort((label, exact, where))
        order = order[np.unique(where[order], return_index=True)[1]]
        found.append((where[order], exact[order], label[order]))
    return tuple(map(np.concatenate, zip(*found))) if found else none


def _closest(pairs: DataFrame, id_type: str, label_type: str, width: int, others: bool) -> DataFrame:
    """(q, id, d2, label) of each left row's nearest right row in each pair of blocks; of equals the least label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, ids, a, first, second, b in zip(*(pdf[c] for c in ("q", "q_id", "q_vectors", "c_first", "c_second", "c_vectors"))):
                ids, a, b = np.asarray(ids), np.asarray(a, float).reshape(-1, width), np.asarray(b, float).reshape(-1, width)
                where, d2, label = _nearest(ids, a, np.asarray(first), np.asarray(second, object) if others else None, b)
                yield pd.DataFrame({"q": q, "id": ids[where], "d2": d2, "label": label})

    return pairs.select("q", "q_id", "q_vectors", "c_first", "c_second", "c_vectors").mapInPandas(run, f"q int, id {id_type}, d2 double, label {label_type}")


def _labelled(right: DataFrame, others: bool) -> DataFrame:
    """(v, first, second): every vector once, with its least label, and the next one if a row's own id is no label."""
    found = right.groupBy("v").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    none = F.lit(None).cast(dict(right.dtypes)["id"])
    if not others:
        return found.select("v", "first", none.alias("second"))
    found = settled(found)
    several = found.filter("last > first")
    if several.isEmpty():
        return found.select("v", "first", none.alias("second"))
    second = right.join(several.select("v", "first"), "v").filter("id > first").groupBy("v").agg(F.min("id").alias("second"))
    return found.join(second, "v", "left").select("v", "first", "second")


def nearest_of_many(rows: DataFrame, key: str, vector: str, centres: DataFrame, label: str, centre: str, block: int = 1024, others: bool = False) -> DataFrame:
    """(key, nearest, d2): the nearest centre of each row, of equally near ones the smallest label; with ``others`` not itself.

    Centres of equal vectors are one.  Both sides are cut into blocks along the coordinate that varies most.  A block of rows first meets
    the block of centres that is nearest in that order, which bounds how far a nearest centre can be, and then all blocks that this bound
    leaves: a difference in one coordinate is never more than the distance.  Where no coordinate tells vectors apart, every block meets
    every other one; blocks grow with the table, so rows are sent ``_PARTS`` times at most until a block has ``_NUMBERS`` numbers.
    Neither side passes through the driver.  Vectors are of one length; rows with null ones are left out.
    """
    kind = "array<float>" if {dict(df.dtypes)[c] for df, c in ((rows, vector), (centres, centre))} == {"array<float>"} else "array<double>"
    take = lambda df, k, v: df.select(F.col(k).alias("id"), F.col(v).cast(kind).alias("v")).dropna()
    left, right = take(rows, key, vector), take(centres, label, centre)
    types = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    axis, unit = _axis(right)
    width = right.agg(F.max(F.size("v"))).first()[0] or 1
    q, c = settled(_blocks(left, axis, unit, block, width, "q", ["id"])), settled(_blocks(settled(_labelled(right, others)), axis, unit, block, width, "c", ["first", "second"]))
    places = q.select("q", "q_low", "q_high").crossJoin(c.select("c", "c_low", "c_high"))
    gap = F.greatest(F.col("q_low") - F.col("c_high"), F.col("c_low") - F.col("q_high"), F.lit(0))
    between = F.abs(F.col("q_low") / 2 + F.col("q_high") / 2 - F.col("c_low") / 2 - F.col("c_high") / 2)
    home = settled(places.groupBy("q").agg(F.min_by("c", F.struct(gap, between, "c")).alias("c")))

    def met(pairs: DataFrame) -> DataFrame:
        named = F.broadcast(pairs.select("q", "c"))
        by_pair = [side.join(named, name).withColumn("pair", F.struct("q", "c")).drop("q" if name == "c" else "c") for side, name in ((q, "q"), (c, "c"))]
        return _closest(by_pair[0].join(by_pair[1], "pair"), *types, width, others)

    near = settled(met(home))
    known = q.select("q", F.size("q_id").alias("size")).join(near.groupBy("q").agg(F.count("*").alias("n"), F.max("d2").alias("d2")), "q", "left")
    reach = F.when(F.col("n") == F.col("size"), (F.ceil(F.sqrt("d2") / unit * _GRID) + 1).cast("long"))  # null: a row of the block has met no centre
    rest = places.withColumn("gap", gap).join(known.select("q", reach.alias("reach")), "q").filter("reach IS NULL OR gap <= reach").join(home, ["q", "c"], "left_anti")
    best = near.unionByName(met(settled(rest.select("q", "c")))).groupBy("id").agg(F.min(F.struct("d2", "label")).alias("b"))
    return best.select(F.col("id").alias(key), F.col("b.label").alias("nearest"), F.col("b.d2").alias("d2"))
