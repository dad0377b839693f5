"""Operators on cases, arches and reports, bound to the test tables: an order is a case, its lines are its teeth.

A line's position is 30 + its number, or 40 + its number if its supplier's key is even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import positional, repair, text, verdicts
from .operators import arch_rules, audit, calls, expansion, metrics, report_audit, series, training, volumes, votes
from .plans import report
from .plans.dims import SWEEP
from .streaming import incremental

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


FDI_SQL = "(CASE WHEN l_suppkey % 2 = 0 THEN 40 ELSE 30 END + l_linenumber)::INT"


def _fdi():
    return (F.when(F.col("l_suppkey") % 2 == 0, 40).otherwise(30) + F.col("l_linenumber")).cast("int")


def _joined(*names: str):
    return [F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n) for n in names]


# --- rules with their sources

_ARCHES_SQL = f"""WITH t AS (SELECT l_orderkey AS case_id, {FDI_SQL} AS fdi, * FROM lineitem),
 c AS (SELECT case_id, list_sort(list(DISTINCT fdi) FILTER (l_returnflag = 'R')) AS absent, list_sort(list(DISTINCT fdi) FILTER (l_returnflag = 'A')) AS endo, list_sort(list(DISTINCT fdi) FILTER (l_quantity > 30)) AS fill,
   list_sort(list(DISTINCT fdi) FILTER (l_tax > 0.06)) AS crowns, list_sort(list(DISTINCT fdi) FILTER (l_discount > 0.08)) AS implants, list_sort(list(DISTINCT fdi) FILTER (l_quantity < 8)) AS near,
   max(l_tax) AS tax, min(l_linenumber) AS first FROM t GROUP BY case_id),
 g AS (SELECT case_id, fdi, CASE WHEN max(l_quantity) > 25 THEN 'lingual' ELSE 'buccal' END AS v FROM t GROUP BY ALL), w AS (SELECT case_id, list(DISTINCT v) FILTER (fdi IN (36, 37)) AS vl, list(DISTINCT v) FILTER (fdi IN (46, 47)) AS vr FROM g GROUP BY case_id),
 o AS (SELECT c.*, vl, vr, o_orderstatus, o_totalprice FROM c JOIN w USING (case_id) JOIN orders ON case_id = o_orderkey),
 l AS (SELECT *, coalesce(absent, []) AS gone FROM o)
"""


@query(_ARCHES_SQL + """SELECT case_id, array_to_string(gone, ',') AS absent, 16 - len(gone) AS n_present,
  array_to_string(list_filter(coalesce(endo, []), lambda x: NOT list_contains(gone, x)), ',') AS endodontic, array_to_string(list_filter(coalesce(fill, []), lambda x: NOT list_contains(gone, x)), ',') AS fillings,
  array_to_string(list_filter(CASE WHEN crowns IS NULL THEN [31, 47] ELSE crowns END, lambda x: NOT list_contains(gone, x)), ',') AS crown,
  array_to_string(CASE WHEN implants IS NULL THEN [36] ELSE implants END, ',') AS implants,
  CASE WHEN o_totalprice > 200000 THEN true WHEN o_totalprice > 100000 THEN false END AS bridge,
  array_to_string(list_filter(coalesce(near, []), lambda x: x > 40), ',') AS close_right, CASE WHEN len(vr) = 1 THEN vr[1] ELSE 'lingual' END AS location_right, CASE WHEN len(vl) = 1 THEN vl[1] ELSE 'lingual' END AS location_left,
  CASE WHEN o_orderstatus = 'F' OR o_orderstatus = 'P' THEN 'not_included' ELSE 'fully_included' END AS condyle,
  CASE WHEN first = 1 THEN '38:unspecified:composite_eruption' WHEN tax > 0.05 THEN '38:mesial:3d_render' ELSE '' END AS impacted
 FROM l""")
def arch_rules_lower(spark, sf_dir):
    """The mandible of each order after all rules, with facts and answers made of its lines."""
    return _arches(spark, sf_dir).filter("arch = 'mandible'").select(
        "case_id", *_joined("absent"), F.size("present").cast("long").alias("n_present"), *_joined("endodontic", "fillings", "crown"), F.array_join(F.transform("implants", lambda i: i["fdi"].cast("string")), ",").alias("implants"),
        "bridge", F.array_join(F.transform("canal_right.adjacent", lambda x: x.cast("string")), ",").alias("close_right"), F.col("canal_right.location").alias("location_right"), F.col("canal_left.location").alias("location_left"),
        F.col("condyle_right").alias("condyle"), F.array_join(F.transform("impacted", lambda i: F.concat_ws(":", i["tooth"], i["impacted"], i["source"])), ",").alias("impacted"),
    )


@query("SELECT l_orderkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'unassessable' ELSE 'scatter' END AS pattern, CASE WHEN o_orderstatus = 'P' THEN 16 ELSE 0 END::BIGINT AS n_unassessable, CASE WHEN o_orderstatus <> 'P' THEN 16 END::BIGINT AS n_present FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey")
def arch_rules_upper(spark, sf_dir):
    """The maxilla of the same cases: outside the volume nothing of it can be told."""
    rows = _arches(spark, sf_dir).filter("arch = 'maxilla'")
    return rows.select("case_id", "pattern", F.greatest(F.size("unassessable"), F.lit(0)).cast("long").alias("n_unassessable"), F.when(F.col("present").isNotNull(), F.size("present")).cast("long").alias("n_present"))


_AND_SQL = "CASE len({0}) WHEN 1 THEN {0}[1]::VARCHAR WHEN 2 THEN {0}[1] || ' and ' || {0}[2] ELSE array_to_string({0}[1:len({0}) - 1], ', ') || ', and ' || {0}[len({0})] END"


@query(_ARCHES_SQL + f""", k AS (SELECT *, list_filter(coalesce(endo, []), lambda x: NOT list_contains(gone, x)) AS e, list_filter(coalesce(fill, []), lambda x: NOT list_contains(gone, x)) AS f, list_filter(coalesce(near, []), lambda x: x > 40) AS nr, list_filter(coalesce(near, []), lambda x: x < 40) AS nl FROM l)
 SELECT case_id, concat_ws(' ', 'Mandible is completely included in the scan volume.',
  'Right mandibular canal with a regular course, predominantly ' || CASE WHEN len(vr) = 1 THEN vr[1] ELSE 'lingual' END || CASE WHEN len(nr) > 0 THEN ', with close relationship with the ' || CASE WHEN len(nr) = 1 THEN 'root of tooth ' ELSE 'roots of teeth ' END || {_AND_SQL.format('nr')} ELSE '' END || '.',
  'Left mandibular canal with a regular course, predominantly ' || CASE WHEN len(vl) = 1 THEN vl[1] ELSE 'lingual' END || CASE WHEN len(nl) > 0 THEN ', with close relationship with the ' || CASE WHEN len(nl) = 1 THEN 'root of tooth ' ELSE 'roots of teeth ' END || {_AND_SQL.format('nl')} ELSE '' END || '.',
  CASE WHEN len(gone) > 0 THEN 'Absence of ' || CASE WHEN len(gone) = 1 THEN 'tooth ' ELSE 'teeth ' END || {_AND_SQL.format('gone')} || '.' END,
  CASE WHEN first = 1 OR tax > 0.05 THEN 'Tooth 38 is impacted.' END, CASE WHEN len(e) > 0 THEN 'Endodontic treatment involving teeth ' || {_AND_SQL.format('e')} || '.' END,
  CASE WHEN len(f) > 0 THEN 'Conservative composite restoration' || CASE WHEN len(f) = 1 THEN ' on tooth ' ELSE 's on teeth ' END || {_AND_SQL.format('f')} || '.' END,
  CASE WHEN implants IS NULL THEN 'Endosseous implant in position 36, restored with an implant-supported crown, with radiographically well osseointegration.'
       ELSE concat_ws(' ', CASE WHEN implants[1] = 36 THEN 'Endosseous implant in position 36, restored with an implant-supported crown, with radiographically well osseointegration.' END,
         CASE WHEN len(list_filter(implants, lambda x: x <> 36)) = 1 THEN 'Endosseous implant in position ' || list_filter(implants, lambda x: x <> 36)[1] || '.' WHEN len(list_filter(implants, lambda x: x <> 36)) > 1 THEN 'Endosseous implants in position ' || array_to_string(list_filter(implants, lambda x: x <> 36), ', ') || '.' END,
         CASE WHEN list_contains(implants, 36) AND implants[1] <> 36 THEN 'Endosseous implant in position 36, restored with an implant-supported crown, with radiographically well osseointegration.' END) END,
  CASE WHEN o_totalprice > 200000 THEN 'Prosthetic bridge exists.' END, 'No definite osteolytic or osteocondensing lesions.',
  CASE WHEN o_orderstatus IN ('F', 'P') THEN 'Condyles not included in the scan volume.' ELSE 'Condyles included in the scan volume.' END) AS report FROM k""")
def lower_reports(spark, sf_dir):
    """The mandible's whole report of each case after the arch rules."""
    none = F.lit(None)
    return report.lower_arch(_arches(spark, sf_dir), F.lit("complete"), F.lit("permanent"), none.cast("array<int>"), F.lit(False))


def _arches(spark, sf_dir):
    fdi, flag, q = _fdi(), F.col("l_returnflag"), F.col("l_quantity")
    some = lambda c: F.collect_set(F.when(c, fdi)).cast("array<int>")
    voters = (36, 37, 46, 47)
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        some(flag == "R").alias("f_absent"), some(flag == "A").alias("p_endo"), some(q > 30).alias("p_fillings"), some(F.col("l_tax") > 0.06).alias("f_crowns"), some(F.col("l_discount") > 0.08).alias("f_implants"),
        some(q < 8).alias("f_close"), *(F.max(F.when(fdi == f, q)).alias(f"q{f}") for f in voters), F.max("l_tax").alias("tax"), F.min("l_linenumber").alias("first"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus", "o_totalprice")
    none = lambda kind: F.lit(None).cast(kind)
    answers = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(f"q{f}").isNotNull(), F.struct(F.lit(f).alias("k"), F.when(F.col(f"q{f}") > 25, " Lingual").otherwise("buccal").alias("v"))) for f in voters))))
    price = F.col("o_totalprice")
    cases = lines.join(orders, "case_id").select(
        "*", answers.alias("p_canal"), F.when(F.col("o_orderstatus") == "P", "excluded").alias("f_maxilla"), F.when(F.col("o_orderstatus") == "F", " Excluded").alias("f_condyles"),
        F.when(price > 200_000, F.array(F.lit("mandible"))).when(price > 100_000, F.array().cast("array<string>")).alias("f_bridge_arches"),
        F.when(F.col("first") == 1, F.create_map(F.lit(38), F.lit("Partially_Erupted"))).otherwise(F.create_map(F.lit(48), F.lit("absent"))).alias("p_eruption"),
        F.array(F.struct(F.lit(38).alias("fdi"), F.lit("fully_erupted").alias("state"), F.when((F.col("tax") > 0.05) & (F.col("first") > 1), "Mesial").otherwise("normal").alias("orientation"))).alias("p_slots"),
    ).select("*", F.explode(F.array(F.lit("mandible"), F.lit("maxilla"))).alias("arch"))
    lower = F.col("arch") == "mandible"
    canal = F.when(lower, F.struct(F.lit("buccal").alias("location"), F.array(F.lit(31)).alias("adjacent")))
    given = cases.select(
        "*", none("array<int>").alias("absent"), none("array<int>").alias("present"), none("array<int>").alias("unassessable"), F.lit("scatter").alias("pattern"), F.array().cast("array<struct<tooth:int,impacted:string,source:string>>").alias("impacted"),
        F.array().cast("array<int>").alias("endodontic"), F.array().cast("array<int>").alias("fillings"), F.when(lower, F.array(F.lit(31), F.lit(47))).otherwise(F.array().cast("array<int>")).alias("crown"),
        F.when(lower, F.array(F.struct(F.lit(36).alias("fdi"), F.lit("well").alias("status"), F.lit(True).alias("crown")))).alias("implants"), none("boolean").alias("bridge"),
        canal.alias("canal_right"), canal.alias("canal_left"), none("boolean").alias("atrophy"), F.when(lower, "fully_included").alias("condyle_right"), F.when(lower, "fully_included").alias("condyle_left"),
        F.array(F.struct(F.lit(36).alias("tooth"), F.lit("caries").alias("finding"))).alias("findings"))
    return arch_rules.apply(given)


# --- gates over several sources

@query("""WITH v AS (SELECT l_orderkey AS case_id, l_linenumber AS place, CASE WHEN l_quantity > 25 THEN 'agree' WHEN l_quantity > 5 THEN 'deny' ELSE 'abstain' END AS a,
   CASE WHEN l_returnflag = 'A' THEN 'agree' WHEN l_returnflag = 'N' THEN 'deny' ELSE 'abstain' END AS b, CASE WHEN l_tax < 0.02 THEN 'abstain' WHEN l_tax < 0.05 THEN 'agree' ELSE 'deny' END AS c FROM lineitem),
 u AS (SELECT case_id, place, unnest([a, b, c]) AS vote FROM v), n AS (SELECT case_id, place, count(*) FILTER (vote = 'agree') AS n_agree, count(*) FILTER (vote = 'deny') AS n_deny FROM u GROUP BY ALL)
 SELECT case_id, place::INT AS place, n_agree, n_deny, n_agree > 0 AND n_agree > n_deny AS kept, n_agree > 0 AND n_agree <= n_deny AS dropped FROM n""")
def cross_source_gate(spark, sf_dir):
    """A finding's verdicts from a flag, an enum and a ladder of findings that hide one another, counted by position."""
    q, tax = F.col("l_quantity"), F.col("l_tax")
    flag = verdicts.bool_verdict(F.when(q > 25, True).when(q > 5, False))
    enum = verdicts.enum_verdict(F.col("l_returnflag"), "A", ("R",))
    hidden = verdicts.ranked_verdict(F.when(tax < 0.02, "post").when(tax < 0.05, "crown").otherwise("filling"), "crown", ("post", "crown", "filling"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("int").alias("place"), F.explode(F.array(flag, enum, hidden)).alias("verdict"))
    return votes.reconcile(rows, ["case_id", "place"])


# --- scores of every kind of field

@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS lang, list(DISTINCT l_suppkey % 9) FILTER (l_quantity > 20) AS cl, list(DISTINCT l_suppkey % 9) FILTER (l_tax > 0.03) AS tl, max(l_quantity) > 40 AS cf, CASE WHEN max(l_tax) <> 0.05 THEN max(l_tax) > 0.06 END AS tf, ' ' || max(l_linestatus) AS ct, lower(min(l_linestatus)) AS tt FROM lineitem GROUP BY ALL)
 SELECT lang, kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(scored)::BIGINT AS scored, sum(ok)::BIGINT AS right FROM (
  SELECT lang, 'bool' AS kind, (cf AND tf)::INT AS tp, (cf AND NOT tf)::INT AS fp, (NOT cf AND tf)::INT AS fn, 0 AS scored, 0 AS ok FROM r WHERE tf IS NOT NULL
  UNION ALL SELECT lang, 'list', len(list_intersect(cl, tl)), len(cl) - len(list_intersect(cl, tl)), len(tl) - len(list_intersect(cl, tl)), 0, 0 FROM r WHERE cl IS NOT NULL AND tl IS NOT NULL
  UNION ALL SELECT lang, 'enum', 0, 0, 0, 1, (lower(trim(ct)) = tt)::INT FROM r
  UNION ALL SELECT lang, 'map', 0, 0, 0, CASE WHEN cl IS NULL THEN 0 ELSE len(list_intersect(cl, tl)) END, CASE WHEN cl IS NULL THEN 0 ELSE len(list_filter(list_intersect(cl, tl), lambda x: x < 5)) END FROM r WHERE cl IS NOT NULL AND tl IS NOT NULL) GROUP BY ALL HAVING sum(tp + fp + fn + scored) > 0""")
def score_kinds(spark, sf_dir):
    """Flags, lists, maps and enums of each order and return flag, scored by the rule of their kind."""
    g = F.col("l_suppkey") % 9
    r = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("lang")).agg(
        F.collect_set(F.when(F.col("l_quantity") > 20, g)).alias("cl"), F.collect_set(F.when(F.col("l_tax") > 0.03, g)).alias("tl"), (F.max("l_quantity") > 40).alias("cf"), F.max("l_tax").alias("tax"), F.max("l_linestatus").alias("hi"), F.min("l_linestatus").alias("lo"))
    filled = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: x.cast("string")))
    # maps whose values agree, but for case and blanks, on keys below 5
    as_map = lambda c, value: F.when(F.size(c) > 0, F.map_from_entries(F.transform(c, lambda x: F.struct(x.cast("string"), value(x)))))
    rows = r.select("lang", F.explode(F.array(*map(F.lit, ("bool", "list", "map", "enum")))).alias("kind"), F.col("cf").alias("claimed_flag"), F.when(F.col("tax") != 0.05, F.col("tax") > 0.06).alias("true_flag"), filled("cl").alias("claimed_list"), filled("tl").alias("true_list"),
        as_map("cl", lambda x: F.lit(" Yes")).alias("claimed_map"), as_map("tl", lambda x: F.when(x < 5, "yes").otherwise("no")).alias("true_map"), F.concat(F.lit(" "), "hi").alias("claimed_text"), F.lower("lo").alias("true_text"))
    return metrics.score_kinds(rows, ["lang"])


@query("""SELECT l_returnflag, round(coalesce(avg(l_discount), 0), 6) AS bleu_mean, round(coalesce(stddev_samp(l_discount), 0), 6) AS bleu_sd, CASE WHEN l_returnflag <> 'A' THEN round(avg(l_tax), 6) END AS f1_mean, CASE WHEN l_returnflag <> 'A' THEN round(stddev_samp(l_tax), 6) END AS f1_sd FROM lineitem GROUP BY l_returnflag""")
def case_statistics(spark, sf_dir):
    """Means and deviations; the clinical metric is null where no case has it."""
    rows = _read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").alias("bleu"), F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("f1"))
    return metrics.case_stats(rows, ["l_returnflag"], ("bleu",), ("f1",))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def top_actions(spark, sf_dir):
    """The ten most frequent, a top-k report."""
    return metrics.action_counts(_read(spark, sf_dir, "part"), "p_type").limit(10)


@query("""SELECT lang, reason, count(*) AS n, count(DISTINCT substr(source, 1, 1)) AS n_prefixes, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS n_positive FROM (
  SELECT d.lang, d.source, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'no_gt_block' WHEN n_chars < 100 THEN 'no_image' WHEN n_chars > 8000 THEN 'prose' WHEN quality = 0 THEN 'gated' WHEN toxic = 1 THEN 'null' ELSE 'supervised' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY ALL""")
def mask_crosstab(spark, sf_dir):
    """Rows dropped and fields masked by reason, the drop reasons first and then the order for arches."""
    labels = _read(spark, sf_dir, "labels").withColumn("has", F.lit(True))
    rows = _read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source").join(labels, "doc_id", "left")
    never = F.lit(False)
    checks = [("no_gt_block", F.col("has").isNull()), ("no_image", F.col("n_chars") < 100), *training.arch_checks(never, F.col("n_chars") > 8000, never, F.col("quality") == 0, F.col("toxic") == 1)]
    return training.mask_crosstab(rows, ["lang"], F.coalesce(training.mask_reason(checks), F.lit("supervised")), F.col("toxic") == 1, F.substring("source", 1, 1))


# --- curves

_PATH = "PARTITION BY user_id ORDER BY event_id"


@query(f"""WITH p AS (SELECT *, lag(value) OVER w AS y0, lead(value) OVER w AS y1, lag(event_id) OVER w AS x0, lead(event_id) OVER w AS x1 FROM events WINDOW w AS ({_PATH})),
 a AS (SELECT user_id, event_id, abs((event_id - x0) * (y1 - y0) - (x1 - x0) * (value - y0)) AS area, sqrt(pow(event_id - x0, 2) + pow(value - y0, 2)) * sqrt(pow(x1 - event_id, 2) + pow(y1 - value, 2)) * sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS sides FROM p)
 SELECT user_id, count(*) FILTER (area > 0) AS n, round(min(sides / (2 * area)) FILTER (area > 0), 4) AS tightest FROM a GROUP BY user_id""")
def curve_radius(spark, sf_dir):
    rows = series.curvature(_read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_id", "value")
    return rows.groupBy("user_id").agg(F.count("radius").alias("n"), F.round(F.min("radius"), 4).alias("tightest"))


# --- audits of reports

_CLAIMS_SQL = f"""WITH t AS (SELECT l_orderkey AS case_id, {FDI_SQL} AS fdi, CASE WHEN l_linenumber = 7 THEN 'maxilla' ELSE 'mandible' END AS arch, * FROM lineitem),
 c AS (SELECT case_id, arch, CASE l_returnflag WHEN 'A' THEN 'crowns' WHEN 'N' THEN 'teeth_present' ELSE 'teeth_absent' END AS field, fdi FROM t
   UNION SELECT case_id, arch, 'teeth_present', fdi FROM t WHERE l_returnflag = 'R' AND l_linestatus = 'F'
   UNION SELECT case_id, arch, CASE WHEN l_quantity > 40 THEN 'canal_right.adjacent_teeth' ELSE 'canal_left.adjacent_teeth' END, fdi FROM t WHERE l_quantity > 30),
 n AS (SELECT case_id, fdi, bool_or(l_tax < 0.06 OR (l_returnflag = 'R' AND l_discount > 0.05) OR l_quantity > 35) AS named, bool_or(l_quantity > 35) AS contact, bool_or(l_returnflag = 'R' AND l_discount > 0.05) AS gone FROM t GROUP BY ALL),
 s AS (SELECT case_id, arch, fdi, bool_or(l_extendedprice > 60000) AS masked FROM t GROUP BY ALL),
 m AS (SELECT * FROM c JOIN n USING (case_id, fdi) JOIN s USING (case_id, arch, fdi)),
 a AS (SELECT * FROM m WHERE field = 'teeth_absent'),
 f AS (SELECT 'laterality' AS screen, 'ERROR' AS level, masked FROM m WHERE arch = 'mandible' AND (field = 'canal_right.adjacent_teeth' AND fdi < 40 OR field = 'canal_left.adjacent_teeth' AND fdi > 40)
   UNION ALL SELECT 'laterality', 'ERROR', masked FROM m WHERE arch = 'maxilla'
   UNION ALL SELECT 'not_in_text', CASE WHEN field LIKE 'teeth%' THEN 'NOTE' ELSE 'ERROR' END, masked FROM m WHERE NOT named
   UNION ALL SELECT 'canal_adjacency', 'ERROR', masked FROM m WHERE arch = 'mandible' AND field LIKE 'canal%' AND NOT contact
   UNION ALL SELECT 'contradiction', CASE WHEN a.gone THEN 'NOTE' ELSE 'ERROR' END, false FROM a JOIN c USING (case_id, arch, fdi) WHERE c.field = 'teeth_present'
   UNION ALL SELECT 'contradiction', 'NOTE', false FROM a JOIN c USING (case_id, arch, fdi) WHERE c.field = 'crowns')
"""


def _claims_and_reports(spark, sf_dir):
    q, flag, fdi = F.col("l_quantity"), F.col("l_returnflag"), F.col("fdi")
    t = _read(spark, sf_dir, "lineitem").withColumns({"case_id": F.col("l_orderkey"), "fdi": _fdi(), "arch": F.when(F.col("l_linenumber") == 7, "maxilla").otherwise("mandible")})
    fields = F.array(F.when(flag == "A", "crowns").when(flag == "N", "teeth_present").otherwise("teeth_absent"), F.when((flag == "R") & (F.col("l_linestatus") == "F"), "teeth_present"), F.when(q > 40, "canal_right.adjacent_teeth").when(q > 30, "canal_left.adjacent_teeth"))
    claims = t.select("case_id", "arch", F.explode(F.array_compact(fields)).alias("field"), "fdi").distinct()
    number = F.concat((fdi / 10).cast("int"), F.lit("."), fdi % 10)  # written 4.8
    told = F.array_compact(F.array(F.when(F.col("l_tax") < 0.06, F.concat(F.lit("Tooth "), number, F.lit(" is noted."))), F.when((flag == "R") & (F.col("l_discount") > 0.05), F.concat(F.lit("Tooth "), fdi, F.lit(" is missing."))), F.when(q > 35, F.concat(F.lit("Close relationship with the root of tooth "), fdi, F.lit(".")))))
    reports = t.groupBy("case_id").agg(F.array_join(F.flatten(F.collect_list(told)), " ").alias("text"))
    masked = claims.join(t.filter("l_extendedprice > 60000").select("case_id", "arch", "fdi"), ["case_id", "arch", "fdi"], "left_semi")
    return claims, reports, masked


@query(_CLAIMS_SQL + "SELECT screen, CASE WHEN masked THEN 'NOTE' ELSE level END AS level, count(*) AS n FROM f GROUP BY ALL")
def report_screens(spark, sf_dir):
    """All screens over the claims of an order, whose report names some of its teeth."""
    claims, reports, masked = _claims_and_reports(spark, sf_dir)
    return report_audit.findings(claims, reports, masked).groupBy("screen", "level").agg(F.count("*").alias("n"))


@query(_CLAIMS_SQL + """, r AS (SELECT DISTINCT case_id, arch, fdi, CASE WHEN arch = 'mandible' AND field LIKE 'canal%' THEN CASE WHEN fdi > 40 THEN 'canal_right.adjacent_teeth' ELSE 'canal_left.adjacent_teeth' END ELSE field END AS field, contact FROM m WHERE NOT masked)
 SELECT arch, field, count(*) AS n, sum(fdi)::BIGINT AS total FROM r WHERE field NOT LIKE 'canal%' OR contact GROUP BY ALL""")
def report_repairs(spark, sf_dir):
    """The same claims with sides put right, unsupported contacts and unresolved claims gone."""
    claims, reports, masked = _claims_and_reports(spark, sf_dir)
    fixed = report_audit.fix_unsupported(report_audit.fix_laterality(report_audit.mask_unresolved(claims, masked)), reports)
    return fixed.groupBy("arch", "field").agg(F.count("*").alias("n"), F.sum("fdi").alias("total"))


# --- ranges that reports state: a line tells of the teeth from its own to another one's

_RANGE_SENTENCES = [  # the sentence, and what its ranges are about; by a line's part
    ("Teeth from {a} to {b} are present in the arch.", "teeth_present"), ("Elements {a} until {b} are visible, {a} to 31 absent.", "teeth_present"), ("Prosthetic bridge {a}-{b} is presented.", None),
    ("Prosthetic crowns of teeth {a} through {b}.", "crowns"), ("Teeth {a} – {b} endodontically treated.", "endodontic"), ("Caries of {a} to {b}; missing teeth {a} to {b} are visible.", "caries"),
    ("Composite fillings of decayed teeth {a}—{b}, extractions from 18 to 28.", "fillings"),
]
_RANGES_SQL = f"""WITH o AS (SELECT * FROM (VALUES {', '.join(f"('{arch}', {p}, {i})" for arch, order in SWEEP.items() for i, p in enumerate(order))}) v(arch, p, i)),
 t AS (SELECT l_orderkey AS case_id, CASE WHEN l_orderkey % 2 = 0 THEN 'maxilla' ELSE 'mandible' END AS arch, ({FDI_SQL} - CASE WHEN l_orderkey % 2 = 0 THEN 20 ELSE 0 END)::INT AS a,
   ((CASE WHEN (l_orderkey % 2 = 0) <> (l_discount = 0.05) THEN 0 ELSE 20 END) + (CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 20 END) + 1 + (l_partkey // 2) % 8)::INT AS b, * FROM lineitem),
 k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{f}')" for i, (_, f) in enumerate(_RANGE_SENTENCES) if f)}, (6, 'caries')) v(mode, field)),
 s AS (SELECT DISTINCT case_id, field, z.p AS fdi FROM t JOIN k ON mode = (l_partkey // 16) % 7 JOIN o x ON x.p = a JOIN o y ON y.p = b AND y.arch = x.arch JOIN o z ON z.arch = x.arch AND z.i BETWEEN least(x.i, y.i) AND greatest(x.i, y.i))
"""


def _range_reports(spark, sf_dir):
    upper, part, flag = F.col("l_orderkey") % 2 == 0, F.col("l_partkey"), F.col("l_returnflag")
    other = F.when(upper != (F.col("l_discount") == 0.05), 0).otherwise(20) + F.when(part % 2 == 0, 10).otherwise(20) + 1 + F.floor(part / 2) % 8
    t = _read(spark, sf_dir, "lineitem").select("*", F.col("l_orderkey").alias("case_id"), F.when(upper, "maxilla").otherwise("mandible").alias("arch"), (_fdi() - F.when(upper, 20).otherwise(0)).alias("fdi"), other.cast("int").alias("other"))
    sentence = F.coalesce(*(F.when(F.floor(part / 16) % len(_RANGE_SENTENCES) == i, F.replace(F.replace(F.lit(words), F.lit("{a}"), F.col("fdi").cast("string")), F.lit("{b}"), F.col("other").cast("string"))) for i, (words, _) in enumerate(_RANGE_SENTENCES)))
    reports = t.groupBy("case_id").agg(F.array_join(F.collect_list(sentence), " ").alias("text"))
    claims = t.select("case_id", "arch", F.when(flag == "N", "teeth_present").when(flag == "R", "teeth_absent").otherwise("crowns").alias("field"), "fdi")
    unresolved = t.filter("l_quantity > 40").select("case_id", "arch", F.lit("presence").alias("field"), "fdi")
    return claims, reports, unresolved


@query(_RANGES_SQL + "SELECT field, fdi, count(*) AS n FROM s GROUP BY ALL")
def stated_ranges(spark, sf_dir):
    """Positions inside ranges, by what the sentences are about: presence and four kinds of findings."""
    return report_audit.stated_ranges(_range_reports(spark, sf_dir)[1]).groupBy("field", "fdi").agg(F.count("*").alias("n"))


@query(_RANGES_SQL + """, w AS (SELECT case_id, x.arch, s.fdi FROM s JOIN (SELECT DISTINCT case_id, arch FROM t) x USING (case_id) JOIN o ON o.p = s.fdi AND o.arch = x.arch WHERE field = 'teeth_present'),
 l AS (SELECT w.*, EXISTS (FROM t WHERE t.case_id = w.case_id AND t.a = w.fdi AND l_quantity > 40) AS masked, EXISTS (FROM t WHERE t.case_id = w.case_id AND t.a = w.fdi AND l_returnflag = 'R') AS gone
   FROM w WHERE NOT EXISTS (FROM t WHERE t.case_id = w.case_id AND t.a = w.fdi AND l_returnflag = 'N'))
 SELECT arch, fdi, count(*) FILTER (NOT masked) AS n_errors, count(*) FILTER (masked) AS n_notes, count(*) FILTER (NOT masked AND NOT gone) AS n_added FROM l GROUP BY ALL""")
def range_screens(spark, sf_dir):
    """Positions that a range of presence sweeps and no claim holds, and those the repair adds."""
    claims, reports, unresolved = _range_reports(spark, sf_dir)
    found = report_audit.findings(claims, reports, unresolved).filter("screen = 'arch_range'").select("case_id", "arch", "fdi", "level", F.lit(0).alias("added"))
    fixed = report_audit.fix_arch_range(claims.select("*"), reports, unresolved).join(claims, report_audit.KEYS, "left_anti").select("case_id", "arch", "fdi", F.lit("").alias("level"), F.lit(1).alias("added"))
    counts = [F.count_if(F.col("level") == level).alias(name) for level, name in ((audit.ERROR, "n_errors"), (audit.NOTE, "n_notes"))]
    return found.unionByName(fixed).groupBy("arch", "fdi").agg(*counts, F.sum("added").alias("n_added"))


@query(f"""WITH t AS (SELECT l_orderkey, {FDI_SQL} AS fdi FROM lineitem), o AS (SELECT * FROM (VALUES {', '.join(f'({f}, {i})' for i, f in enumerate([*range(48, 40, -1), *range(31, 39)]))}) v(p, i)),
 e AS (SELECT l_orderkey, min(i) AS a, max(i) AS b FROM t JOIN o ON fdi = p GROUP BY l_orderkey) SELECT l_orderkey, count(*) AS n, sum(p)::BIGINT AS total FROM e JOIN o ON i BETWEEN a AND b GROUP BY l_orderkey""")
def ranges_named(spark, sf_dir):
    """A sentence with the ends of an order's positions along the arch, and the positions between them."""
    place = F.array_position(F.array(*map(F.lit, [*range(48, 40, -1), *range(31, 39)])), _fdi())
    ends = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by(_fdi(), place).alias("a"), F.max_by(_fdi(), place).alias("b"))
    said = F.concat(F.lit("Teeth from "), "a", F.lit(" to "), "b", F.lit(" are present."))
    return ends.select("l_orderkey", F.explode(text.named_positions(said)).alias("p")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("p").alias("total"))


# --- reports expanded

_REPORTS_SQL = f"""WITH t AS (SELECT l_orderkey AS case_id, {FDI_SQL} AS fdi, * FROM lineitem),
 c AS (SELECT case_id, coalesce(list(DISTINCT fdi) FILTER (l_returnflag = 'A'), []) AS p, coalesce(list(DISTINCT fdi) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(DISTINCT fdi) FILTER (l_quantity > 45), []) AS endo, coalesce(list(DISTINCT fdi) FILTER (l_tax > 0.07), []) AS post,
   coalesce(list(DISTINCT fdi) FILTER (l_quantity < 3), []) AS imp, max(l_discount) > 0.09 AS stated FROM t GROUP BY case_id),
 m AS (SELECT *, list_distinct(list_concat(endo, post)) AS said FROM c),
 g AS (SELECT *, list_filter(list_distinct(list_concat(a, imp)), lambda x: NOT list_contains(said, x)) AS gone0 FROM m),
 h AS (SELECT *, list_filter(list_distinct(list_concat(p, said)), lambda x: NOT list_contains(gone0, x)) AS there0, list_filter([48, 47, 46, 45, 44, 43, 42, 41, 31, 32, 33, 34, 35, 36, 37, 38], lambda x: true) AS every FROM g),
 r AS (SELECT *, list_filter(every, lambda x: NOT list_contains(gone0, x) AND NOT list_contains(there0, x)) AS rest FROM h),
 u AS (SELECT *, CASE WHEN len(a) > 0 AND len(p) = 0 THEN list_concat(there0, rest) ELSE there0 END AS there, CASE WHEN len(p) > 0 AND len(a) = 0 THEN list_concat(gone0, rest) ELSE gone0 END AS gone FROM r)
"""


def _reports(spark, sf_dir):
    fdi, flag, q = _fdi(), F.col("l_returnflag"), F.col("l_quantity")
    some = lambda c: F.collect_set(F.when(c, fdi)).cast("array<int>")
    none = F.lit(None)
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        some(flag == "A").alias("teeth_present"), some(flag == "R").alias("teeth_absent"), some(q > 45).alias("endodontic"), some(F.col("l_tax") > 0.07).alias("post_and_core"), some(q < 3).alias("implants"), (F.max("l_discount") > 0.09).alias("atrophy_stated"))
    return rows.select("*", F.lit("mandible").alias("arch"), *(none.cast("array<int>").alias(n) for n in ("crowns", "fillings", "caries", "root_remnants")), none.cast("boolean").alias("edentulous"))


@query(_REPORTS_SQL + """, o AS (SELECT case_id, there, gone, stated, len(every) - len(list_distinct(there)) - len(list_distinct(gone)) AS unstated, unnest(every) AS f, unnest(range(1, 17)) AS i FROM u),
 x AS (SELECT *, i - row_number() OVER (PARTITION BY case_id ORDER BY i) AS grp FROM o WHERE list_contains(gone, f)), y AS (SELECT case_id, max(n) AS run FROM (SELECT case_id, grp, count(*) AS n FROM x GROUP BY ALL) GROUP BY case_id)
 SELECT DISTINCT o.case_id, 'mandible' AS arch, len(there) AS n_present, len(gone) AS n_absent, unstated AS n_unstated, stated OR coalesce(run, 0) >= 3 AS atrophy, coalesce(run, 0) AS longest_run FROM o LEFT JOIN y ON o.case_id = y.case_id""")
def arch_expansion(spark, sf_dir):
    return expansion.arch_facts(_reports(spark, sf_dir))


@query(_REPORTS_SQL + """, e AS (SELECT case_id, unnest(there) AS fdi, true AS present, endo, post FROM u UNION ALL SELECT case_id, unnest(gone), false, endo, post FROM u),
 k AS (SELECT case_id, present, list_contains(endo, fdi) OR list_contains(post, fdi) AS e, list_contains(post, fdi) AS p FROM e)
 SELECT case_id, present, count(*) AS n, count(*) FILTER (e) AS n_endo, count(*) FILTER (p) AS n_post, count(*) FILTER (NOT present AND NOT e) AS n_silent FROM k GROUP BY ALL""")
def tooth_expansion(spark, sf_dir):
    """The rows of each case's teeth, summed up: absent ones are silent on what is not claimed of them."""
    rows = expansion.tooth_rows(_reports(spark, sf_dir))
    return rows.groupBy("case_id", "present").agg(F.count("*").alias("n"), F.count_if("with_endo").alias("n_endo"), F.count_if("with_post").alias("n_post"), F.count_if(F.col("with_endo").isNull()).alias("n_silent"))


@query(_REPORTS_SQL + """SELECT kind, count(*) AS n, sum(fdi)::BIGINT AS total FROM (
  SELECT 'present_and_absent' AS kind, unnest(list_intersect(p, a)) AS fdi FROM c UNION ALL SELECT 'endodontic_at_absent', unnest(list_intersect(endo, a)) FROM c
  UNION ALL SELECT 'post_and_core_at_absent', unnest(list_intersect(post, a)) FROM c UNION ALL SELECT 'implant_at_present', unnest(list_intersect(imp, p)) FROM c) GROUP BY kind""")
def expansion_conflicts(spark, sf_dir):
    return expansion.conflicts(_reports(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("fdi").alias("total"))


@query(f"""WITH t AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber < 4 THEN 10 + l_linenumber ELSE 30 + l_linenumber END AS fdi, * FROM lineitem),
 c AS (SELECT case_id, list(DISTINCT fdi) FILTER (l_returnflag = 'A') AS p, list(DISTINCT fdi) FILTER (l_returnflag = 'R') AS a, sum(l_quantity) * 8 AS bone, count(*) FILTER (l_tax = 0.08) AS upper FROM t GROUP BY case_id),
 s AS (SELECT *, bone < 500 AS out, bone < 500 AND upper = 0 AS strip FROM c)
 SELECT case_id, CASE WHEN out THEN 'excluded' ELSE 'partial' END AS f_maxilla, len(CASE WHEN strip THEN list_filter(coalesce(p, []), lambda x: x > 30) ELSE coalesce(p, []) END) AS n_present, len(CASE WHEN strip THEN list_filter(coalesce(a, []), lambda x: x > 30) ELSE coalesce(a, []) END) AS n_absent,
  (CASE WHEN strip THEN len(list_filter(list_concat(coalesce(p, []), coalesce(a, [])), lambda x: x < 30)) ELSE 0 END)::BIGINT AS removed FROM s""")
def facts_audit(spark, sf_dir):
    """Cases with too little upper bone lose the maxilla; quantities stand for bone, full tax for labelled upper teeth."""
    fdi = F.when(F.col("l_linenumber") < 4, 10).otherwise(30) + F.col("l_linenumber")
    some = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, fdi)).cast("array<int>")
    facts = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(some("A").alias("teeth_present"), some("R").alias("teeth_absent"), (F.sum("l_quantity") * 8).alias("bone_mm3"), F.count_if(F.col("l_tax") == 0.08).alias("n_upper"))
    done = expansion.audited_facts(facts.withColumns({"f_maxilla": F.lit("partial"), "implants": F.array().cast("array<int>")}))
    return done.select("case_id", "f_maxilla", F.size("teeth_present").cast("long").alias("n_present"), F.size("teeth_absent").cast("long").alias("n_absent"), "removed")


# --- scalars on every row of a table

@query("""SELECT p_partkey, lower(trim(p_brand)) NOT IN ('normal', 'none') AND p_brand <> '' AS meaningful, 'A' || p_partkey AS case_id, CASE WHEN p_size > 25 THEN 'r' || p_size END AS reader, 'size' AS fact FROM part""")
def name_parts(spark, sf_dir):
    """Case and reader from a file's name, a fact without its position, and whether a value says anything."""
    name = F.concat(F.lit("A"), "p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit("_r"), "p_size")).otherwise(""), F.lit(".txt"))
    fact = F.concat(F.lit("tooth_"), F.lit(30) + F.col("p_size") % 8, F.lit("_size"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.is_meaningful(F.col("p_brand")).alias("meaningful"), text.case_of(name).alias("case_id"), text.reader_of(name).alias("reader"), text.short_fact(fact).alias("fact"))


@query("SELECT p_partkey, p_brand AS brand, p_size AS size, p_type AS kind FROM part")
def loose_objects(spark, sf_dir):
    """Objects written without quotes, read back."""
    said = F.concat(F.lit("{brand: "), "p_brand", F.lit(", 'size': "), "p_size", F.lit(', kind="'), "p_type", F.lit('"}'))
    got = _read(spark, sf_dir, "part").select("p_partkey", repair.loose_object(said).alias("o"))
    return got.select("p_partkey", F.col("o.brand").alias("brand"), F.col("o.size").cast("int").alias("size"), F.col("o.kind").alias("kind"))


@query("SELECT p_partkey, p_size::VARCHAR AS size, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'small' END AS word, CASE WHEN p_size > 25 THEN 'repaired' WHEN p_size > 10 THEN NULL ELSE 'unreadable' END AS note FROM part")
def coerced_notes(spark, sf_dir):
    size = F.col("p_size")
    word = repair.coerce_noted(F.when(size > 25, "Large").when(size > 10, "small").otherwise("huge"), "enum:small|large -- the size")
    return _read(spark, sf_dir, "part").select("p_partkey", repair.coerce_noted(size.cast("string"), "int")["value"].alias("size"), word["value"].alias("word"), word["note"].alias("note"))


@query("""SELECT c_custkey, '{"name": ' || '"' || c_name || '"' || ', "balance": ' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'null' END || '}' AS text, length(c_name) + 2 AS name_chars, 4 AS balance_chars FROM customer""")
def target_spans(spark, sf_dir):
    """Targets written in a fixed order; each value's characters are found again by its span."""
    fields = [("name", F.concat(F.lit('"'), "c_name", F.lit('"'))), ("balance", F.when(F.col("c_acctbal") > 0, F.lit("true")))]
    made = _read(spark, sf_dir, "customer").select("c_custkey", repair.with_spans(fields).alias("t"))
    cut = lambda i: F.substring(F.col("t.text"), F.col("t.spans")[i]["begin"] + 1, F.col("t.spans")[i]["end"] - F.col("t.spans")[i]["begin"])
    return made.select("c_custkey", "t.text", F.char_length(cut(0)).alias("name_chars"), F.char_length(cut(1)).alias("balance_chars"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '48' WHEN 1 THEN '34,35' WHEN 2 THEN '33,43' ELSE '' END AS lower, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '16,17' END AS upper FROM orders""")
def positional_phrases(spark, sf_dir):
    """Teeth named by their place in the mouth."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "The lower right third molar is impacted.").when(k == 1, "Left mandibular premolars are worn.").when(k == 2, "Both lower canines.").otherwise("First and second molars of the upper right side.")
    return _read(spark, sf_dir, "orders").select("o_orderkey", *(F.array_join(F.transform(positional.positions_meant(said, arch), lambda x: x.cast("string")), ",").alias(name) for name, arch in (("lower", "mandible"), ("upper", "maxilla"))))


@query("SELECT o_orderkey, CASE WHEN n_perm = 0 THEN CASE WHEN n_prim = 0 THEN 'edentulous' ELSE 'primary' END WHEN n_prim > 2 AND n_un > 2 THEN 'mixed' ELSE 'permanent' END AS dentition, CASE WHEN bone >= 500 OR n_perm > 3 THEN true ELSE false END AS imaged FROM (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'N') AS n_perm, count(*) FILTER (l_quantity > 20) AS n_prim, count(*) FILTER (l_tax > 0.03) AS n_un, sum(l_quantity) * 4 AS bone FROM lineitem GROUP BY l_orderkey)")
def dentition_and_coverage(spark, sf_dir):
    c = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "N").alias("n"), F.count_if(F.col("l_quantity") > 20).alias("p"), F.count_if(F.col("l_tax") > 0.03).alias("u"), (F.sum("l_quantity") * 4).alias("bone"))
    return c.select("o_orderkey", verdicts.dentition(F.col("p"), F.col("u"), F.col("n")).alias("dentition"), volumes.coverage(F.col("bone"), F.col("n") > 3, F.lit(None).cast("boolean")).alias("imaged"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """Tumbling windows, as the streaming operator counts them; an engine extension."""
    found = incremental.windowed(_read(spark, sf_dir, "events"), "ts", "1 day", "1 hour", ["event_type"])
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


# --- plans of questions

@query("""WITH c AS (SELECT l_orderkey AS call, l_partkey + 7 AS fact, CASE WHEN l_linenumber < 5 THEN ['Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23'] ELSE ['Brand#31', 'Brand#33', 'Brand#44', 'Brand#55'] END AS images FROM lineitem)
 SELECT error, count(*) AS n, sum(fact)::BIGINT AS total FROM (
  SELECT DISTINCT fact, 'unknown' AS error FROM c WHERE fact NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT fact, 'duplicate' FROM c GROUP BY fact HAVING count(*) > 1
  UNION ALL SELECT p_partkey, 'unplaced' FROM part WHERE p_partkey NOT IN (SELECT fact FROM c)
  UNION ALL SELECT DISTINCT fact, 'image_mismatch' FROM c JOIN part ON fact = p_partkey WHERE NOT list_contains(images, p_brand)) GROUP BY error""")
def plan_errors(spark, sf_dir):
    """Lines as a plan over parts: what it asks that is unknown, asked twice, not asked, or not shown."""
    some = lambda *b: F.array(*map(F.lit, b))
    images = F.when(F.col("l_linenumber") < 5, some("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23")).otherwise(some("Brand#31", "Brand#33", "Brand#44", "Brand#55"))
    plan = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), (F.col("l_partkey") + 7).alias("fact"), images.alias("images"))
    found = calls.plan_errors(plan, _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact"), F.col("p_brand").alias("image")))
    return found.groupBy("error").agg(F.count("*").alias("n"), F.sum("fact").alias("total"))


@query("""WITH asked AS (SELECT o_orderkey, unnest(range(1, 8)) AS k FROM orders)
 SELECT o_orderkey AS case_id, coalesce(array_to_string(list_sort(list('p' || l_linenumber || l_returnflag) FILTER (l_returnflag IS NOT NULL)), ','), '') AS paths, count(*) FILTER (l_returnflag IS NULL) AS n_missing
 FROM asked LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = k GROUP BY o_orderkey""")
def calls_with_images(spark, sf_dir):
    """Each order asks for seven images; lines stand for those there are."""
    plan = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit("q").alias("call"), F.array(*(F.lit(str(k)) for k in range(1, 8))).alias("images"))
    images = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("string").alias("image_key"), F.concat(F.lit("p"), "l_linenumber", "l_returnflag").alias("path"))
    return calls.with_images(plan, images).select("case_id", F.array_join("paths", ",").alias("paths"), "n_missing")


@query("""SELECT field, count(*) AS n FROM (SELECT 'status' AS field, CASE o_orderstatus WHEN 'F' THEN ' Normal' WHEN 'O' THEN 'open' END AS v FROM orders UNION ALL SELECT 'priority', CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_orderpriority LIKE '5%' THEN 'NONE' ELSE '' END FROM orders) WHERE v IS NOT NULL AND lower(trim(v)) NOT IN ('', 'normal', 'none') GROUP BY field""")
def abnormal_answers(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", " Normal").when(F.col("o_orderstatus") == "O", "open").alias("status"), F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderpriority").startswith("5"), "NONE").otherwise("").alias("priority"))
    return calls.abnormal(rows, ["o_orderkey"], ["status", "priority"]).groupBy("field").agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, array_to_string(list_sort(coalesce(list(DISTINCT {FDI_SQL}) FILTER (l_returnflag <> 'N'), [])), ',') AS covered,
  array_to_string(list_sort(list_filter(coalesce(list(DISTINCT {FDI_SQL}) FILTER (l_returnflag = 'R'), []), lambda x: NOT list_contains(coalesce(list(DISTINCT {FDI_SQL}) FILTER (l_quantity > 40), []), x))), ',') AS toothless FROM lineitem GROUP BY l_orderkey""")
def coverage_sets(spark, sf_dir):
    """Positions with an answer, and missing ones without a remnant."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", _fdi().alias("fdi"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("answer"), "l_returnflag", "l_quantity")
    covered = calls.coverage_sets(rows, ["l_orderkey"], "fdi", "answer")
    lists = rows.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("fdi"))).alias("gone"), F.collect_set(F.when(F.col("l_quantity") > 40, F.col("fdi"))).alias("roots"))
    met = covered.join(lists, "l_orderkey").withColumn("toothless", F.array_sort(calls.toothless(F.col("gone"), F.col("roots"))))
    return met.select("l_orderkey", *_joined("covered", "toothless"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS found, event_id % 3 = 0 OR user_id % 4 = 1 AS asked FROM events")
def path_walk(spark, sf_dir):
    """A path with a side, and whether a fact's scope takes in a position."""
    scope = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return _read(spark, sf_dir, "events").select("event_id", calls.dig(F.col("props"), "{side}", "k").alias("found"), calls.applicable(scope, (F.col("user_id") % 4).cast("int")).alias("asked"))
