"""Queries of distances, parts, intervals and neighbours, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grids, neighbours, ranges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as voxels: a volume for each supplier, of days of the month by quantities by line numbers."""
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("volume"), F.col("l_returnflag").alias("label"), F.dayofmonth("l_shipdate").cast("long").alias("x"), F.col("l_quantity").cast("long").alias("y"), F.col("l_linenumber").cast("long").alias("z"))


_VOXELS_SQL = "v AS (SELECT l_suppkey AS volume, l_returnflag AS label, day(l_shipdate) AS x, CAST(l_quantity AS BIGINT) AS y, CAST(l_linenumber AS BIGINT) AS z FROM lineitem)"


@query(f"""WITH {_VOXELS_SQL}, q AS (SELECT DISTINCT volume, x, y, z FROM v WHERE label = 'R'), s AS (SELECT DISTINCT volume, x, y, z FROM v WHERE label = 'A'),
 d AS (SELECT q.volume, q.x, q.y, q.z, min(pow((q.x - s.x) * 0.5, 2) + pow((q.y - s.y) * 0.25, 2) + pow(q.z - s.z, 2)) AS d2 FROM q JOIN s USING (volume)
  WHERE abs(q.x - s.x) <= 4 AND abs(q.y - s.y) <= 8 AND abs(q.z - s.z) <= 2 GROUP BY ALL)
 SELECT q.volume, count(*) AS n_voxels, count(*) FILTER (d2 <= 4.0) AS n_near, round(min(d2) FILTER (d2 <= 4.0), 6) AS least_d2, round(sum(d2) FILTER (d2 <= 4.0), 6) AS sum_d2
 FROM q LEFT JOIN d USING (volume, x, y, z) GROUP BY q.volume""")
def near_structure(spark, sf_dir):
    """Voxels of one label within 2.0 of another label's, and how near they come."""
    v = _voxels(spark, sf_dir)
    axes = ["x", "y", "z"]
    asked = v.filter("label = 'R'").select("volume", *axes).distinct()
    found = grids.near(asked, v.filter("label = 'A'").select("volume", *axes), ["volume"], axes, [0.5, 0.25, 1.0], 2.0)
    return found.groupBy("volume").agg(F.count("*").alias("n_voxels"), F.count("d2").alias("n_near"), F.round(F.min("d2"), 6).alias("least_d2"), F.round(F.sum("d2"), 6).alias("sum_d2"))


@query(f"""WITH RECURSIVE {_VOXELS_SQL}, c AS (SELECT DISTINCT volume, label, x, y, z, z * 1000000 + y * 1000 + x AS id FROM v),
 e AS (SELECT a.volume, a.label, a.id, b.id AS near FROM c a JOIN c b ON a.volume = b.volume AND a.label = b.label AND ((a.y = b.y AND a.z = b.z AND abs(a.x - b.x) = 1) OR (a.x = b.x AND a.z = b.z AND abs(a.y - b.y) = 1) OR (a.x = b.x AND a.y = b.y AND abs(a.z - b.z) = 1))),
 r AS (SELECT volume, label, id, id AS reach FROM c UNION SELECT r.volume, r.label, r.id, e.near FROM r JOIN e ON e.volume = r.volume AND e.label = r.label AND e.id = r.reach),
 p AS (SELECT volume, label, id, min(reach) AS part FROM r GROUP BY ALL), s AS (SELECT volume, label, part, count(*) AS n FROM p GROUP BY ALL)
 SELECT volume, label, count(*) AS n_parts, max(n) AS largest, max(n) * 20.0 >= 50 AS present FROM s GROUP BY ALL""")
def largest_parts(spark, sf_dir):
    """Parts of every label of every volume, and whether the largest holds 50 of volume."""
    found = grids.parts(_voxels(spark, sf_dir), ["volume", "label"], depth=3)
    return grids.largest_part(found, ["volume", "label"], 20.0, 50)


_SPANS_SQL = "SELECT o_orderkey, o_totalprice, epoch_us(TIMESTAMP '2024-01-01') // 1000000 + (o_orderkey * 7919) % 2592000 AS t0, (o_orderkey * 104729) % 40000 AS len, o_orderkey % 5 AS k FROM orders"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans of seconds in the events' month, from none to eleven hours long."""
    k = F.col("o_orderkey").cast("long")
    t0 = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) + (k * 7919) % 2592000
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", t0.alias("t0"), (t0 + (k * 104729) % 40000 - 1).alias("t1"), (k % 5).alias("k"))


@query(f"""WITH s AS ({_SPANS_SQL}), p AS (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events)
 SELECT event_id, count(o_orderkey) AS n_open, round(coalesce(sum(o_totalprice), 0), 2) AS worth FROM p LEFT JOIN s ON t BETWEEN t0 AND t0 + len - 1 GROUP BY event_id""")
def open_spans(spark, sf_dir):
    """How many orders are open when an event happens, and their worth."""
    points = _read(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("t"))
    found = ranges.held(points, _spans(spark, sf_dir), "t", "t0", "t1", {"n_open": F.lit(1).cast("long"), "w": F.col("o_totalprice").cast("decimal(18,6)")})
    return found.select("event_id", "n_open", F.round(F.col("w").cast("double"), 2).alias("worth"))


@query(f"""WITH s AS ({_SPANS_SQL}), a AS (SELECT * FROM s WHERE o_orderkey % 2 = 0 AND len > 0), b AS (SELECT * FROM s WHERE o_orderkey % 2 = 1 AND len > 0)
 SELECT a.o_orderkey, count(*) AS n_over, min(b.o_orderkey) AS first_over FROM a JOIN b ON a.k = b.k AND a.t0 <= b.t0 + b.len - 1 AND b.t0 <= a.t0 + a.len - 1 GROUP BY ALL""")
def overlapping_spans(spark, sf_dir):
    """Spans of odd orders that share a second with a span of an even one of the same kind."""
    s = _spans(spark, sf_dir).drop("o_totalprice").filter("t1 >= t0")
    b = s.filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("other"), F.col("t0").alias("b0"), F.col("t1").alias("b1"), "k")
    found = ranges.overlap_summary(s.filter("o_orderkey % 2 = 0"), b, ("t0", "t1"), ("b0", "b1"), "o_orderkey", "other", ["k"])
    return found.select("o_orderkey", F.col("n").alias("n_over"), F.col("least").alias("first_over"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 d AS (SELECT a.vec_id, b.vec_id AS l, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
 SELECT vec_id, min_by(l, (d, l)) AS nearest, round(min(d), 6) AS d2 FROM d GROUP BY vec_id""")
def nearest_other(spark, sf_dir):
    """Of every vector the nearest other one: all vectors are centres."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nearest_of_many(e, "vec_id", "embedding", e, "vec_id", "embedding", block=256, others=True)
    return found.select("vec_id", "nearest", F.round("d2", 6).alias("d2"))


@query("""WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
 slots AS (SELECT vec_id, label, max(x) FILTER (i = 1) AS a, max(x) FILTER (i = 2) AS b FROM e GROUP BY ALL),
 d AS (SELECT q.vec_id, s.vec_id AS slot, (q.a - s.a) * (q.a - s.a) + (q.b - s.b) * (q.b - s.b) AS d FROM slots q JOIN slots s ON s.label = 0 WHERE q.label = 1)
 SELECT vec_id, min_by(slot, (d, slot)) AS nearest, round(min(d), 6) AS d2 FROM d GROUP BY vec_id""")
def nearest_free_slot(spark, sf_dir):
    """Of every object of one label the nearest free slot, a place of another label in the plane."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 2).alias("place"))
    found = neighbours.nearest_of_many(e.filter("label = 1"), "vec_id", "place", e.filter("label = 0"), "vec_id", "place", block=16)
    return found.select("vec_id", "nearest", F.round("d2", 6).alias("d2"))
