"""Voxels as rows: exact distance transforms, connected parts, thresholds on them.

A volume is never gathered: rows are shuffled by tile, by line (one axis of a volume) or by slab (some planes of a label); of labels, those
of few voxels are whole in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import settled
from .graphs import components

_CELLS = 1 << 24  # of a tile's grid at most
_SIDE = 64  # of a tile, in voxels
_WHOLE = 50_000  # voxels of a label that is joined in one task


def lower_envelope(at: list[int], height: list[float], unit: float, bound: float) -> Iterator[tuple[int, float]]:
    """(place, value) of the lower envelope of the parabolas ``(unit * (place - at))^2 + height`` where it is ``bound`` at most.

    ``at`` ascends.  A parabola is on the envelope between its crossings with its neighbours there.
    """
    square = unit * unit
    kept: list[int] = []
    since: list[float] = []
    for k in range(len(at)):
        cross = float("-inf")
        while kept:
            j = kept[-1]
            cross = (height[k] - height[j] + square * (at[k] ** 2 - at[j] ** 2)) / (2 * square * (at[k] - at[j]))
            if cross > since[-1]:
                break
            kept.pop()
            since.pop()
            cross = float("-inf")
        kept.append(k)
        since.append(cross)
    for n, k in enumerate(kept):
        reach = int(max(0.0, bound - height[k]) ** 0.5 / unit)
        low, high = at[k] - reach, at[k] + reach
        if n:
            low = max(low, int(since[n] // 1) + 1)
        if n + 1 < len(kept):
            high = min(high, int(since[n + 1] // 1))
        for place in range(low, high + 1):
            value = square * (place - at[k]) ** 2 + height[k]
            if value <= bound:
                yield place, value


def _along(rows: DataFrame, keys: list[str], axes: list[str], axis: str, unit: float, bound: float) -> DataFrame:
    """One pass of the transform: each line's envelope, in place of the heights ``d2`` on it."""
    others = [*keys, *(a for a in axes if a != axis)]
    lines = rows.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).alias("at"), "d2"))).alias("line"))  # as long as a volume's axis

    @F.pandas_udf("array<struct<at:bigint,d2:double>>")
    def envelope(line: pd.Series) -> pd.Series:
        return pd.Series([[{"at": p, "d2": v} for p, v in lower_envelope([int(s["at"]) for s in one], [float(s["d2"]) for s in one], unit, bound)] for one in line])

    return lines.select(*others, F.explode(envelope("line")).alias("p")).select(*others, F.col("p.at").alias(axis), F.col("p.d2").alias("d2"))


def squared_distances(sites: DataFrame, keys: list[str], axes: list[str], spacing: list[float], bound: float) -> DataFrame:
    """(keys, axes, d2): the exact squared distance to the nearest site of the same keys, at every place within ``bound`` of one.

    Separable: what one pass gives are the next one's heights, so a pass is a shuffle by the lines of its axis.  The rows between passes
    are the places within ``bound`` of a site along the axes done so far.
    """
    rows = sites.select(*keys, *(F.col(a).cast("long").alias(a) for a in axes)).dropna().distinct().withColumn("d2", F.lit(0.0))
    for axis, unit in zip(axes, spacing):
        rows = _along(rows, keys, axes, axis, unit, bound * bound)
    return rows


def _of_tile(at: np.ndarray, of: np.ndarray, spacing: list[float], reach: list[int]) -> np.ndarray:
    """Squared distances of one tile's places ``at`` to the nearest of ``of``: each axis in turn takes the least over its offsets."""
    low, high = at.min(axis=0) - reach, at.max(axis=0) + reach
    grid = np.full(high - low + 1, np.inf)
    grid[tuple((of[((of >= low) & (of <= high)).all(axis=1)] - low).T)] = 0.0
    for axis, (unit, far) in enumerate(zip(spacing, reach)):
        n = grid.shape[axis] - 2 * far
        part = lambda k: grid[(slice(None),) * axis + (slice(k, k + n),)]  # noqa: E731, B023
        least = part(far).copy()
        for k in range(2 * far + 1):
            np.minimum(least, part(k) + unit * unit * (k - far) ** 2, out=least)
        grid = least
    return grid[tuple((at - at.min(axis=0)).T)]


def _by_tiles(asked: DataFrame, sites: DataFrame, keys: list[str], axes: list[str], spacing: list[float], reach: list[int], bound: float) -> DataFrame:
    """(keys, axes, d2) of asked voxels within ``bound`` of a site; a site goes to every tile that its reach touches."""
    sides = [max(_SIDE, 2 * r) for r in reach]
    tiles = [f"_t{n}" for n in range(len(axes))]
    tile = lambda a, by, side: F.floor((F.col(a) + by) / side).cast("long")
    own = asked.select(*keys, *axes, F.lit(False).alias("_site"), *(tile(a, 0, s).alias(t) for t, a, s in zip(tiles, axes, sides)))
    spread = sites.withColumn("_site", F.lit(True))
    for t, a, r, s in zip(tiles, axes, reach, sides):
        spread = spread.withColumn(t, F.explode(F.sequence(tile(a, -r, s), tile(a, r, s))))
    kinds = dict(asked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, *axes)) + ", d2 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates()
        group = pdf.groupby([*keys, *tiles], sort=False).ngroup().to_numpy()
        order = np.lexsort((pdf["_site"], group))
        pdf, group = pdf.iloc[order], group[order]
        places, site, d2 = pdf[axes].to_numpy("int64"), pdf["_site"].to_numpy(bool), np.full(len(pdf), np.inf)
        ends = np.flatnonzero(np.diff(group, append=-1)) + 1
        for low, high in zip(np.concatenate(([0], ends[:-1])), ends):
            n = low + int((~site[low:high]).sum())
            if low < n < high:
                d2[low:n] = _of_tile(places[low:n], places[n:high], spacing, reach)
        good = d2 <= bound * bound
        return pdf.loc[good, [*keys, *axes]].assign(d2=d2[good])

    both = own.unionByName(spread)
    tasks = asked.count() // 50_000 + 1
    return both.groupBy(F.pmod(F.xxhash64(*keys, *tiles), F.lit(tasks)).alias("_some")).applyInPandas(run, schema)


def near(rows: DataFrame, sites: DataFrame, keys: list[str], axes: list[str], spacing: list[float], bound: float) -> DataFrame:
    """``rows`` with ``d2``, the squared distance to the nearest site if that is within ``bound``, else null.

    Tiles of asked voxels meet the sites around them, in one shuffle of no more rows than both sides have (and copies at tiles' borders).
    Only if ``bound`` is so many voxels that a tile with its surroundings would be too large does the transform go line by line.
    """
    placed = rows.withColumns({a: F.col(a).cast("long") for a in axes})
    reach = [int(bound / unit) + 1 for unit in spacing]
    if np.prod([float(max(_SIDE, 2 * r) + 2 * r) for r in reach]) > _CELLS:
        found = squared_distances(sites, keys, axes, spacing, bound)
    else:
        of = sites.select(*keys, *(F.col(a).cast("long").alias(a) for a in axes)).dropna()
        found = _by_tiles(placed.select(*keys, *axes).dropna(), of, keys, axes, spacing, reach, bound)
    return placed.join(found, [*keys, *axes], "left")


def _joined_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of one slab with the first run of their part: runs that overlap in neighbouring lines are one part."""
    pdf = pdf.sort_values(["z", "y", "x0"], ignore_index=True)
    z, y, low, high = (pdf[c].tolist() for c in ("z", "y", "x0", "x1"))
    root = list(range(len(z)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    lines: dict[tuple[int, int], tuple[int, int]] = {}
    start = 0
    for k in range(1, len(z) + 1):
        if k == len(z) or (z[k], y[k]) != (z[start], y[start]):
            for side in ((z[start], y[start] - 1), (z[start] - 1, y[start])):
                j, end = lines.get(side, (0, 0))
                i = start
                while i < k and j < end:
                    if low[i] <= high[j] and low[j] <= high[i]:
                        a, b = sorted((top(i), top(j)))
                        root[b] = a
                    if high[i] < high[j]:
                        i += 1
                    else:
                        j += 1
            lines[z[start], y[start]] = (start, k)
            start = k
    first = [top(k) for k in range(len(z))]
    return pdf.assign(rz=[z[k] for k in first], ry=[y[k] for k in first], rx=[low[k] for k in first])


def _whole_labels(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """(keys, z, y, x, n) of the parts of some whole labels: neighbours along each axis are edges, the least voxel of a part its root."""
    pdf = pdf.drop_duplicates(ignore_index=True)
    g = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["x"], pdf["y"], pdf["z"], g))
    pdf, g = pdf.iloc[order], g[order]
    x, y, z = (pdf[c].to_numpy("int64") for c in "xyz")
    edges = []
    for along, b, c in ((x, y, z), (y, x, z), (z, x, y)):
        line = np.lexsort((along, b, c, g))
        u, v = line[:-1], line[1:]
        next_to = (g[u] == g[v]) & (b[u] == b[v]) & (c[u] == c[v]) & (along[v] - along[u] == 1)
        edges.append((u[next_to], v[next_to]))
    u, v = (np.concatenate(e) for e in zip(*edges))
    root = np.arange(len(pdf))
    while (root[u] != root[v]).any():
        low = np.minimum(root[u], root[v])
        for side in (u, v):
            np.minimum.at(root, root[side], low)
        while (root != (up := root[root])).any():
            root = up
    first, n = np.unique(root, return_counts=True)
    return pdf.iloc[first].assign(n=n)[[*keys, "z", "y", "x", "n"]]


def parts(voxels: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z", depth: int = 16, whole: int = _WHOLE) -> DataFrame:
    """(keys, part, n): face-connected parts of the voxels of each key and their sizes; ``part`` is the first voxel (z, y, x).

    Labels of up to ``whole`` voxels are whole in one task, many of them together.  Of larger ones voxels become runs along x, runs of a
    slab of ``depth`` planes are joined in one task, and parts that touch across slabs are joined as a graph.  A label of any extent is
    as many slabs as it needs.
    """
    own = voxels.select(*keys, *(F.col(c).cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z")))).dropna(subset=["x", "y", "z"])
    large = settled(own.groupBy(*keys).count().filter(F.col("count") > whole).select(*keys))
    if large.isEmpty():
        return _small_parts(own, keys)
    match = F.lit(True)
    for k in keys:
        match = match & own[k].eqNullSafe(large[k])
    return _small_parts(own.join(large, match, "left_anti"), keys).unionByName(_large_parts(own.join(large, match, "left_semi"), keys, depth))


def _small_parts(own: DataFrame, keys: list[str]) -> DataFrame:
    tasks = own.count() // 100_000 + 1
    kinds = dict(own.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", z long, y long, x long, n long"
    run = lambda pdf: _whole_labels(pdf[[*keys, "x", "y", "z"]], keys)
    found = own.groupBy(F.pmod(F.xxhash64(*keys), F.lit(tasks)).alias("_some")).applyInPandas(run, schema)
    return found.select(*keys, F.struct("z", "y", "x").alias("part"), "n")


def _large_parts(own: DataFrame, keys: list[str], depth: int) -> DataFrame:
    own = own.distinct()
    run = F.col("x") - F.row_number().over(W.partitionBy(*keys, "z", "y").orderBy("x"))
    runs = own.withColumn("_r", run).groupBy(*keys, "z", "y", "_r").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_r").withColumn("slab", F.floor(F.col("z") / depth))
    kinds = dict(runs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in runs.columns) + ", rz long, ry long, rx long"
    held = runs.groupBy(*keys, "slab").applyInPandas(_joined_runs, schema)
    held = held.withColumn("node", F.struct(*keys, F.col("rz").alias("z"), F.col("ry").alias("y"), F.col("rx").alias("x")))
    below = held.filter((F.col("z") + 1) % depth == 0).select(*keys, (F.col("z") + 1).alias("z"), "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("node").alias("under"))
    touching = held.filter(F.col("z") % depth == 0).join(below, [*keys, "z", "y"]).filter("x0 <= a1 AND a0 <= x1").select("node", "under")
    label = components(touching, "node", "under")
    sizes = held.groupBy("node").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).join(label, "node", "left").withColumn("whole", F.coalesce("label", "node"))
    return sizes.groupBy("whole").agg(F.sum("n").alias("n")).select(*(F.col(f"whole.{k}").alias(k) for k in keys), F.struct("whole.z", "whole.y", "whole.x").alias("part"), "n")


def largest_part(found: DataFrame, keys: list[str], unit: float, least: float | Column) -> DataFrame:
    """(keys, n_parts, largest, present): the largest part's voxels, and whether its volume is ``least`` or more."""
    per = found.groupBy(*keys).agg(F.count("*").alias("n_parts"), F.max("n").alias("largest"))
    return per.withColumn("present", F.col("largest") * F.lit(unit) >= least)


def voxels(volumes: DataFrame, key: str, shape: str = "shape", data: str = "voxels", kind: str = "<i2", planes: int = 16) -> DataFrame:
    """(key, label, x, y, z) of every labelled voxel of stored volumes: ``data`` holds x fastest, ``shape`` is (z, y, x).

    A few planes of a volume are read at a time, so what a task holds besides the stored bytes is bounded.
    """
    own = volumes.select(F.col(key).alias("_k"), F.col(shape).cast("array<int>").alias("_s"), F.col(data).alias("_d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, (depth, height, width), raw in zip(pdf["_k"], pdf["_s"], pdf["_d"]):
                for z in range(0, depth, planes):
                    some = min(planes, depth - z)
                    grid = np.frombuffer(raw, kind, some * height * width, z * height * width * np.dtype(kind).itemsize).reshape(some, height, width)
                    at = np.nonzero(grid)
                    if len(at[0]):
                        yield pd.DataFrame({"_k": name, "label": grid[at].astype("int32"), "x": at[2], "y": at[1], "z": at[0] + z})

    return own.mapInPandas(run, f"_k {dict(volumes.dtypes)[key]}, label int, x long, y long, z long").withColumnRenamed("_k", key)
