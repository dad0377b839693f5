"""Gates between sources and blocks of sections, bound to the test tables: an order is a case, its lines are its positions, their keys what sources say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gates, sections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL_ON = gates.Gates(cross_validate=True, impaction=True, endodontic=True, fillings=True, absent_is_not_impacted=True)


def query(sql: str):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


def _one_of(number: str, *answers: str | None) -> str:
    return f"CASE ({number}) % {len(answers)} " + " ".join(f"WHEN {i} THEN {a if a in ('true', 'false') else repr(a)}" for i, a in enumerate(answers) if a is not None) + " END"


def _trit(k: int) -> str:
    """Yes, no or no answer, by a digit of the row's number in base three."""
    return _one_of(f"m // {3 ** k}", "true", "false", None)


#: what the sources say, from a number m of the row; // is whole division
READINGS = {
    "overview": _one_of("m // 5", "absent", "normal", "caries", "filling", "post_and_core", "root_canal_treatment", "impacted", "unreadable", None),
    "absent": "m % 11 = 0", "detected": _one_of("m", "yes", "no", None, None, None, None, None), "eruption": _one_of("m", "fully_erupted", "absent", None, "partially_erupted", "unclear"),
    "with_caries": _trit(0), "with_endo": _trit(1), "with_post_and_core": _trit(2), "with_full_crown": _trit(3), "with_fillings": _trit(4), "is_remnant": _trit(5), "impacted": _trit(6), "near_canal": _trit(7),
    "periapical": "m % 4 = 0", "filling_quality": _one_of("m", "none", "good", "short", "", None), "bone_lesion": "m % 13 = 0",
    "orientation": _one_of("m", "mesial", "normal", "distal", "none", None, "lingual"), "canal_location": _one_of("m", "lingual", "buccal", "regular", None),
}
_MIX = "l_partkey * 7919 + l_suppkey * 31 + l_orderkey"
_PLACE = "CAST(CASE WHEN l_suppkey % 2 = 0 THEN 41 ELSE 31 END + l_linenumber - CASE WHEN l_orderkey % 3 = 0 THEN 20 ELSE 0 END AS INT)"
_ARCH = "CASE WHEN l_orderkey % 3 = 0 THEN 'maxilla' ELSE 'mandible' END"
_READINGS_SQL = f"""WITH b AS (SELECT l_orderkey AS case_id, {_ARCH} AS arch, {_PLACE} AS fdi, min({_MIX})::BIGINT AS m FROM lineitem GROUP BY ALL),
 r AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in READINGS.items())} FROM b),
 g AS (SELECT * FROM (VALUES ('off'), ('on')) v(gate))"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each position; of lines at the same place the one with the least number speaks."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS case_id", f"{_ARCH} AS arch", f"{_PLACE} AS fdi", f"CAST({_MIX} AS BIGINT) AS m")
    return rows.groupBy("case_id", "arch", "fdi").agg(F.min("m").alias("m")).selectExpr("case_id", "arch", "fdi", *(f"{v.replace('//', 'DIV')} AS {k}" for k, v in READINGS.items()))


def _both(make: Callable[[gates.Gates], DataFrame]) -> DataFrame:
    """With the gates as they come and with all of them on."""
    each = [make(g).withColumn("gate", F.lit(name)) for name, g in (("off", gates.Gates()), ("on", ALL_ON))]
    return each[0].unionByName(each[1])


def _arch_vote(rank: int) -> str:
    return f"CASE WHEN seen IS NULL THEN 0 WHEN seen = {rank} THEN 1 WHEN seen < {rank} THEN 0 ELSE -1 END"


def _vote(answer: str) -> str:
    return f"CASE WHEN {answer} THEN 1 WHEN NOT {answer} THEN -1 ELSE 0 END"


@query(_READINGS_SQL + f""", o AS (SELECT *, CASE WHEN with_post_and_core THEN 'post_and_core' WHEN with_full_crown THEN 'crown' WHEN with_fillings THEN 'fillings' WHEN coalesce(with_post_and_core, with_full_crown, with_fillings) IS NOT NULL THEN 'none' END AS own,
   CASE overview WHEN 'impacted' THEN 1 WHEN 'post_and_core' THEN 2 WHEN 'root_canal_treatment' THEN 3 WHEN 'filling' THEN 4 WHEN 'caries' THEN 5 WHEN 'normal' THEN 9 END AS seen, fdi % 10 = 8 AS wisdom FROM r),
 v AS (SELECT case_id, arch, fdi, 'caries' AS finding, [{_vote('with_caries')}, CASE WHEN overview = 'caries' THEN 1 WHEN overview IN ('normal', 'filling') THEN -1 ELSE 0 END, CASE WHEN own IN ('fillings', 'crown', 'post_and_core') THEN -1 ELSE 0 END] AS votes, NULL AS detail FROM o WHERE NOT absent AND is_remnant IS NOT TRUE
   UNION ALL SELECT case_id, arch, fdi, 'impacted', [CASE WHEN wisdom THEN {_vote('impacted')} ELSE 0 END, CASE WHEN wisdom OR overview = 'impacted' THEN {_arch_vote(1)} ELSE 0 END], CASE WHEN wisdom AND impacted AND orientation NOT IN ('normal', 'none') THEN orientation ELSE 'unspecified' END FROM o
   UNION ALL SELECT case_id, arch, fdi, 'root_canal_treatment', [{_vote('with_endo')}, {_arch_vote(3)}], nullif(nullif(filling_quality, ''), 'none') FROM o WHERE NOT absent
   UNION ALL SELECT case_id, arch, fdi, 'periapical_lesion', [1], NULL FROM o WHERE NOT absent AND periapical
   UNION ALL SELECT case_id, arch, fdi, 'post_and_core', [CASE WHEN own IS NULL OR own = 'crown' THEN 0 WHEN own = 'post_and_core' THEN 1 ELSE -1 END, {_arch_vote(2)}], NULL FROM o WHERE NOT absent
   UNION ALL SELECT case_id, arch, fdi, 'fillings', [CASE WHEN own IS NULL THEN 0 WHEN own = 'fillings' THEN 1 ELSE -1 END, {_arch_vote(4)}], NULL FROM o WHERE NOT absent AND own IS DISTINCT FROM 'crown'),
 c AS (SELECT v.*, gate, len(list_filter(votes, lambda x: x > 0)) AS yes, len(list_filter(votes, lambda x: x < 0)) AS no FROM v, g),
 d AS (SELECT *, CASE WHEN finding = 'impacted' THEN yes > no ELSE no = 0 END AS stands FROM c WHERE yes > 0),
 e AS (SELECT d.*, stands OR gate = 'off' AS held FROM d),
 x AS (SELECT e.*, o.absent AND held AND finding = 'impacted' AS gone FROM e JOIN o USING (case_id, fdi)),
 y AS (SELECT gate, arch, fdi, case_id, finding, held AND NOT (gone AND gate = 'on') AS kept, NOT stands OR gone AS dropped, CASE WHEN finding <> 'root_canal_treatment' OR held THEN detail END AS detail FROM x
   UNION ALL SELECT gate, arch, fdi, case_id, 'crown', true, false, NULL FROM o, g WHERE NOT absent AND own = 'crown' AND NOT EXISTS (FROM x WHERE x.gate = g.gate AND x.case_id = o.case_id AND x.fdi = o.fdi AND finding = 'post_and_core' AND held))
 SELECT gate, arch, finding, detail, count(*) FILTER (kept) AS n_kept, count(*) FILTER (dropped) AS n_dropped, coalesce(sum(fdi) FILTER (kept), 0)::BIGINT AS kept_sum FROM y GROUP BY ALL""")
def tooth_gates(spark, sf_dir):
    """Caries, impaction, root fillings, lesions and restorations of all positions, with gates off and on."""
    found = _both(lambda g: gates.tooth_gates(_readings(spark, sf_dir), g))
    return found.groupBy("gate", "arch", "finding", "detail").agg(F.count_if("kept").alias("n_kept"), F.count_if("dropped").alias("n_dropped"), F.sum(F.when(F.col("kept"), F.col("fdi")).otherwise(0)).alias("kept_sum"))


_CANALS_SQL = _READINGS_SQL + """, f AS (SELECT o_orderkey AS case_id, side, k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN []::INT[] ELSE [q + 4 + o_custkey % 5, q + 8, q] END AS adjacent, CASE o_custkey % 4 WHEN 0 THEN 'lingual' WHEN 1 THEN 'buccal' WHEN 2 THEN 'regular' END AS location
   FROM orders, (VALUES ('right', 4, 40), ('left', 3, 30)) s(side, k, q))"""


def _canals(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")

    def of(side: str, base: int):
        said = [F.concat(F.lit(" "), (base + 4 + customer % 5).cast("string")), F.lit(str(base + 8)), F.lit("none"), F.lit(str(base))]
        listed = F.when(key % 5 == 0, None).when(key % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(*said))
        where = F.when(customer % 4 == 0, "lingual").when(customer % 4 == 1, "buccal").when(customer % 4 == 2, "regular")
        return F.struct(F.lit(side).alias("side"), listed.alias("adjacent"), where.alias("location"))

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(key.alias("case_id"), F.inline(F.array(of("right", 40), of("left", 30))))


@query(_CANALS_SQL + f""", w AS (SELECT f.case_id, side, (k * 10 + i)::INT AS fdi, near_canal, coalesce(r.absent, false) AS absent, [CASE WHEN adjacent IS NULL THEN 0 WHEN list_contains(adjacent, k * 10 + i) THEN 1 ELSE -1 END, {_vote('near_canal')}] AS votes
   FROM f CROSS JOIN range(4, 9) n(i) LEFT JOIN r ON r.case_id = f.case_id AND r.fdi = k * 10 + i),
 d AS (SELECT gate, side, w.fdi, absent, list_contains(votes, -1) AS denied FROM w, g WHERE list_contains(votes, 1))
 SELECT gate, side, fdi, count(*) FILTER ((NOT denied OR gate = 'off') AND NOT absent) AS n_kept, count(*) FILTER (denied) AS n_dropped FROM d WHERE denied OR NOT absent GROUP BY ALL""")
def canal_gate(spark, sf_dir):
    """Contacts with canals by two sources, by side and position."""
    found = _both(lambda g: gates.canal_contacts(_canals(spark, sf_dir), _readings(spark, sf_dir), g))
    return found.groupBy("gate", "side", "fdi").agg(F.count_if("kept").alias("n_kept"), F.count_if("dropped").alias("n_dropped"))


@query(_CANALS_SQL + """, a AS (SELECT case_id, fdi // 10 AS k, count(*) FILTER (canal_location = 'lingual') - count(*) FILTER (canal_location = 'buccal') AS lean FROM r WHERE fdi % 10 > 5 AND fdi > 30 GROUP BY ALL),
 z AS (SELECT f.side, CASE WHEN lean > 0 THEN 'lingual' WHEN lean < 0 THEN 'buccal' END AS near, CASE WHEN location <> 'regular' THEN location END AS far FROM f LEFT JOIN a USING (case_id, k))
 SELECT side, coalesce(near, far) AS location, CASE WHEN near IS NOT NULL THEN 'composite' WHEN far IS NOT NULL THEN '3d_render' END AS source, CASE WHEN near <> far THEN far END AS other, count(*) AS n FROM z GROUP BY ALL""")
def canal_places(spark, sf_dir):
    """Where canals run: the molars' majority before the answer for the arch."""
    return gates.canal_locations(_canals(spark, sf_dir), _readings(spark, sf_dir)).groupBy("side", "location", "source", "other").agg(F.count("*").alias("n"))


@query(_READINGS_SQL + """, i AS (SELECT o_orderkey AS case_id, CASE WHEN o_custkey % 2 = 0 THEN 'maxilla' ELSE 'mandible' END AS arch, CASE WHEN o_custkey % 7 > 0 THEN (CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 30 END + CASE WHEN o_custkey % 5 > 2 THEN 10 ELSE 0 END + 2 + o_custkey % 4) END AS fdi FROM orders),
 x AS (SELECT i.arch, CASE WHEN detected = 'yes' THEN 'segmented_tooth' WHEN eruption IN ('fully_erupted', 'partially_erupted') THEN 'composite_erupted' WHEN r.arch = i.arch AND overview NOT IN ('absent', 'unreadable') THEN 'panoramic=' || overview END AS evidence FROM i LEFT JOIN r ON r.case_id = i.case_id AND r.fdi = i.fdi)
 SELECT gate, arch, evidence, count(*) FILTER (evidence IS NULL OR gate = 'off') AS n_kept, count(*) FILTER (evidence IS NOT NULL) AS n_dropped FROM x, g GROUP BY ALL""")
def implant_gate(spark, sf_dir):
    """Implants where a tooth is still seen, by what sees it."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    place = F.when(customer % 7 > 0, F.when(key % 3 == 0, 10).otherwise(30) + F.when(customer % 5 > 2, 10).otherwise(0) + 2 + customer % 4).cast("int")
    entries = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("case_id"), F.when(customer % 2 == 0, "maxilla").otherwise("mandible").alias("arch"), place.alias("fdi"))
    found = _both(lambda g: gates.implants(entries, _readings(spark, sf_dir), g))
    return found.groupBy("gate", "arch", "evidence").agg(F.count_if("kept").alias("n_kept"), F.count_if("dropped").alias("n_dropped"))


@query(_READINGS_SQL + """, t AS (SELECT case_id, bool_or(bone_lesion) AS seen FROM r GROUP BY ALL),
 x AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'maxilla' ELSE 'mandible' END AS arch, o_custkey % 4 < 2 AS present, CASE o_orderkey % 5 WHEN 0 THEN 'radiopaque' WHEN 1 THEN 'radiolucent' WHEN 2 THEN 'mixed' WHEN 3 THEN 'radiopaque' END AS type,
   CASE o_custkey % 3 WHEN 0 THEN 'near 36' WHEN 1 THEN 'none' END AS location, coalesce(seen, false) AS seen FROM orders LEFT JOIN t ON case_id = o_orderkey),
 y AS (SELECT gate, x.*, present AND type IN ('radiopaque', 'radiolucent') IS TRUE AS known, present AND type IN ('radiopaque', 'radiolucent') IS TRUE AND (seen OR gate = 'off') AS told FROM x, g)
 SELECT gate, arch, present, CASE WHEN told THEN type END AS type, CASE WHEN told AND location <> 'none' THEN location END AS location, CASE WHEN known THEN seen END AS confirmed, count(*) AS n FROM y GROUP BY ALL""")
def bone_gate(spark, sf_dir):
    """Lesions of an arch that a position's own reading confirms, or none does."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 5 == 0, "radiopaque").when(key % 5 == 1, "radiolucent").when(key % 5 == 2, "mixed").when(key % 5 == 3, "radiopaque")
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        key.alias("case_id"), F.when(key % 3 == 0, "maxilla").otherwise("mandible").alias("arch"), F.when(customer % 4 < 2, F.lit(True)).when(customer % 4 == 2, F.lit(False)).alias("present"),
        kind.alias("type"), F.when(customer % 3 == 0, " near 36 ").when(customer % 3 == 1, "none").alias("location"),
    )
    return _both(lambda g: gates.bone(facts, _readings(spark, sf_dir), g)).groupBy("gate", "arch", "present", "type", "location", "confirmed").agg(F.count("*").alias("n"))


# --- blocks of sections: an order's keys are the answers for its arches

_FACTS = {  # from k, a number of the order
    "cr": _one_of("k", "fully_included", "partially_included", "not_included", "  ", None), "cl": _one_of("k // 5", "fully_included", " fully_included ", "not_included", "odd", None, "fully_included"),
    "mi": _one_of("k // 2", "fully_included", "included", "not_included", None), "rs": _one_of("k // 3", "fully_included", "not_included", "", None, "fully_included"), "ls": _one_of("k // 7", "not_included", "fully_included", None),
    "rm": _one_of("k // 11", "normal", "thickened", None), "lm": _one_of("k // 13", "normal", None, "cyst"), "rc": _one_of("k // 17", "air", None, "opaque"), "lc": _one_of("k // 19", "air", "fluid", None),
    "edent": _one_of("k // 4", "true", "false", None), "bare": _one_of("k // 6", "true", "false", None), "atrophic": _one_of("k // 8", "true", "false", None),
    "extent": _one_of("k // 9", "none", "mild", "severe", None), "pattern": _one_of("k // 10", "horizontal", "none", None),
}
_FACTS_SQL = f"""WITH b AS (SELECT o_orderkey AS case_id, (o_orderkey * 31 + o_custkey * 7)::BIGINT AS k FROM orders), f AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _FACTS.items())}, k % 17 > 1 AS rf, k % 23 > 1 AND k % 17 > 0 AS lf FROM b)"""


def _facts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS case_id", "CAST(o_orderkey * 31 + o_custkey * 7 AS BIGINT) AS k")
    rows = rows.selectExpr("*", *(f"{v.replace('//', 'DIV')} AS {k}" for k, v in _FACTS.items()))

    def of(side: str, there, base: int):
        teeth = F.when(F.col("k") % 3 == 0, F.array(F.lit(base + 6), F.lit(base + 7))).when(F.col("k") % 3 == 1, F.array().cast("array<int>"))
        return F.when(there, F.struct(F.col(f"{side}s").alias("scope"), F.col(f"{side}m").alias("mucosa_state"), F.col(f"{side}c").alias("sinus_content"), teeth.alias("intrasinusal_teeth")))

    return rows.withColumns({
        "right": of("r", F.col("k") % 17 > 1, 10), "left": of("l", (F.col("k") % 23 > 1) & (F.col("k") % 17 > 0), 20),
        "ridge": F.struct(F.col("edent").alias("present"), F.col("bare").alias("fully_edentulous"), F.col("atrophic").alias("atrophy")), "loss": F.struct("extent", "pattern"),
    })


@query(_FACTS_SQL + """, n AS (SELECT *, nullif(trim(cr), '') AS r, nullif(trim(cl), '') AS l, CASE WHEN rf THEN nullif(rs, '') END AS rsc, CASE WHEN lf THEN ls END AS lsc FROM f)
 SELECT CASE WHEN (cr = 'fully_included' OR r IS NULL) AND (cl = 'fully_included' OR l IS NULL) AND coalesce(r, l) IS NOT NULL THEN 'complete' ELSE 'partial' END AS mandible,
  CASE WHEN r = 'not_included' OR l = 'not_included' THEN 'not_included' WHEN nullif(l, 'odd') IS NULL AND r IS NULL THEN 'unknown' ELSE 'included' END AS condyles,
  CASE WHEN mi = 'not_included' THEN 'none' WHEN mi = 'fully_included' AND coalesce(rsc, 'fully_included') = 'fully_included' AND coalesce(lsc, 'fully_included') = 'fully_included' THEN 'complete' ELSE 'partial' END AS maxilla,
  CASE WHEN edent AND atrophic IS NOT NULL THEN atrophic END AS atrophy, CASE WHEN edent AND atrophic IS NOT NULL AND bare THEN true END AS bare,
  CASE WHEN extent <> 'none' THEN extent END AS extent, CASE WHEN extent <> 'none' AND pattern <> 'none' THEN pattern END AS pattern, count(*) AS n FROM n GROUP BY ALL""")
def scope_blocks(spark, sf_dir):
    """What is in the volume, condyles as one, ridges and bone loss."""
    right, left, loss = F.col("right"), F.col("left"), sections.resorption(F.col("loss"))
    inside = sections.consistent(F.col("mi"), [right["scope"], left["scope"]])
    ridge = sections.ridge(F.col("ridge"))
    keys = [
        sections.mandible_scope(F.col("cr"), F.col("cl"))["level"].alias("mandible"), sections.condyles(F.col("cr"), F.col("cl")).alias("condyles"), sections.maxilla_scope(inside, F.lit(None).cast("string"))["level"].alias("maxilla"),
        ridge["atrophy"].alias("atrophy"), ridge["fully_edentulous"].alias("bare"), loss["extent"].alias("extent"), F.get(loss["pattern"], F.lit(0)).alias("pattern"),
    ]
    return _facts(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))


@query(_FACTS_SQL + """, s AS (SELECT k, CASE WHEN rf THEN coalesce(nullif(rs, ''), 'unknown') WHEN lf THEN 'unknown' ELSE 'not_included' END AS scope_right, CASE WHEN lf THEN coalesce(ls, 'unknown') WHEN rf THEN 'unknown' ELSE 'not_included' END AS scope_left,
   NOT rf AND NOT lf AS inferred, rf, lf, (NOT rf OR coalesce(rm, 'normal') = 'normal' AND coalesce(rc, 'air') = 'air') AS rn, (NOT lf OR coalesce(lm, 'normal') = 'normal' AND coalesce(lc, 'air') = 'air') AS ln FROM f),
 t AS (SELECT *, scope_right <> 'not_included' AS ri, scope_left <> 'not_included' AS li FROM s)
 SELECT scope_right, scope_left, inferred, CASE WHEN ri AND li THEN CASE WHEN rn AND ln THEN 'all_normal' ELSE 'mixed' END WHEN ri THEN 'right_only' WHEN li THEN 'left_only' ELSE 'none_included' END AS status,
  CASE WHEN ri THEN rn END AS right_normal, CASE WHEN li THEN ln END AS left_normal, CASE WHEN k % 3 = 0 THEN concat_ws(',', CASE WHEN rf THEN '16,17' END, CASE WHEN lf THEN '26,27' END) ELSE '' END AS teeth, count(*) AS n FROM t GROUP BY ALL""")
def sinus_blocks(spark, sf_dir):
    """Sinuses of both sides: scope, state of the pair, roots inside."""
    group, roots = sections.sinus_group(F.col("right"), F.col("left")), sections.intrasinusal(F.col("right"), F.col("left"))
    keys = [
        group["scope_right"].alias("scope_right"), group["scope_left"].alias("scope_left"), group["source"].isNotNull().alias("inferred"), group["status"].alias("status"),
        group["right"]["normal"].alias("right_normal"), group["left"]["normal"].alias("left_normal"), F.array_join(roots["teeth"].cast("array<string>"), ",").alias("teeth"),
    ]
    return _facts(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))


@query(_READINGS_SQL + """, p AS (SELECT case_id, arch, list_sort(list(fdi) FILTER (is_remnant)) AS kept, list_sort(list(fdi) FILTER (is_remnant AND filling_quality IN ('good', 'short'))) AS lost, list_sort(list(fdi) FILTER (absent AND is_remnant IS NOT TRUE)) AS gone FROM r GROUP BY ALL)
 SELECT case_id, arch, array_to_string(kept, ',') AS remnants, CASE WHEN kept IS NOT NULL THEN coalesce(array_to_string(lost, ','), '') END AS resorbed, coalesce(array_to_string(gone, ','), '') AS toothless FROM p""")
def remnant_blocks(spark, sf_dir):
    """Roots left in each arch, those with bone loss around them, and positions with nothing left."""
    found = sections.remnants(_readings(spark, sf_dir).withColumnRenamed("filling_quality", "bone_loss"))
    joined = lambda items: F.array_join(F.transform(items, lambda x: x.cast("string")), ",")
    fdis = lambda rows: F.transform(rows, lambda r: r["fdi"])
    return found.select("case_id", "arch", joined(fdis(F.col("remnants"))).alias("remnants"), joined(fdis(F.filter("remnants", lambda r: r["resorbed"]))).alias("resorbed"), joined(F.col("toothless")).alias("toothless"))
