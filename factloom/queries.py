"""The operators bound to the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import repair, text, verdicts
from .operators import audit, metrics, rules, series, training, volumes, votes
from .plans import dims, report
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


TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
_ABBREVIATION = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}_])([A-Za-z])\.([A-Za-z]\.|\s*[0-9])', '\1\2' || chr(1) || '\3', 'g')"
_GUARDED = r"regexp_replace({0}, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g')"
for _ in range(6):  # without look-ahead a chain of letters takes a pass for each
    _GUARDED = _ABBREVIATION.replace("{0}", _GUARDED)
SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(GUARDED, '([.;:])\s+', '\1' || chr(2), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')".replace("GUARDED", _GUARDED)


# --- scalar functions

@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)")
def tokenize_counts(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES_SQL.format('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(f) AS BIGINT) AS n_found FROM (SELECT doc_id, list_filter({SENTENCES_SQL.format('text')}, lambda s: regexp_matches(s, 'the|les|die') AND NOT (regexp_matches(s, 'of|des') AND NOT regexp_matches(s, 'license|License'))) AS f FROM documents) WHERE len(f) > 0")
def keyword_findings(spark, sf_dir):
    found = text.matching(text.sentences(F.col("text")), "the|les|die", "of|des", "license|License")
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_found")).filter("n_found > 0")


@query(r"""SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS positions FROM (
  SELECT doc_id, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: CAST(x[1] AS VARCHAR)) AS list_distinct_ordered FROM (
    SELECT doc_id, list_transform(regexp_extract_all(text, '\b([1-4]\.?[1-8])\b', 1), lambda s: CAST(replace(s, '.', '') AS INT)) AS l FROM documents)) WHERE len(list_distinct_ordered) > 0""")
def positions_in_text(spark, sf_dir):
    p = text.positions_in(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(p, lambda x: x.cast("string")), ",").alias("positions")).filter("positions <> ''")


@query("""SELECT p_partkey, v AS raw, CASE WHEN v = 'economy' OR v = 'small' OR v = 'medium' OR v = 'promo' OR v = 'standard' OR v = 'large' THEN v
  ELSE (SELECT CASE WHEN count(*) = 1 AND v <> '' THEN min(a) END FROM (VALUES ('economy'), ('small'), ('medium'), ('promo'), ('standard'), ('large')) t(a) WHERE starts_with(a, v) OR starts_with(v, a)) END AS repaired
  FROM (SELECT p_partkey, lower(substr(p_type, 1, CAST(p_partkey % 7 AS INT))) AS v FROM part)""")
def enum_repair(spark, sf_dir):
    v = text.enum_separators(F.substring("p_type", F.lit(1), (F.col("p_partkey") % 7).cast("int")))
    rows = _read(spark, sf_dir, "part").select("p_partkey", v.alias("raw"))
    return rows.select("p_partkey", "raw", text.enum_by_prefix(F.col("raw"), ["economy", "small", "medium", "promo", "standard", "large"]).alias("repaired"))


@query("""SELECT event_id, CASE WHEN event_id % 6 IN (3, 4, 5) THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k FROM events""")
def json_repair(spark, sf_dir):
    """Whole, fenced and cut records are read; those cut in a string, going on with a comma, or no objects are not."""
    n = F.col("event_id") % 6
    kinds = [F.col("props"), F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), F.regexp_replace("props", r"\}\s*$", ""), F.lit('{"k": "cut'), F.concat(F.col("props"), F.lit(', "b": 2}')), F.lit("12")]
    mangled = F.coalesce(*(F.when(n == i, x) for i, x in enumerate(kinds)))
    rows = _read(spark, sf_dir, "events").select("event_id", mangled.alias("m"))
    return rows.select("event_id", F.get_json_object(repair.parse(F.col("m")), "$.k").cast("int").alias("k"))


@query("""SELECT event_id, user_id, event_type, 'k' AS field, CAST(json_extract(props, '$.k') AS INT) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def claim_long(spark, sf_dir):
    parsed = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.explode(F.from_json("props", "map<string,int>")).alias("field", "value"))
    return parsed.filter("field = 'k' AND value IS NOT NULL")


# --- votes and consensus

def _claims(spark, sf_dir):
    v = F.col("value")
    return _read(spark, sf_dir, "events").select("user_id", "event_type", votes.verdict(F.when(v > 60, True).when(v < 20, False)).alias("verdict"))


_VOTES_SQL = """SELECT user_id, event_type, n_agree, n_deny, n_agree > 0 AND {0} AS kept, n_agree > 0 AND NOT ({0}) AS dropped FROM (
  SELECT user_id, event_type, count(*) FILTER (value > 60) AS n_agree, count(*) FILTER (value < 20) AS n_deny FROM events GROUP BY ALL)"""


@query(_VOTES_SQL.format("n_deny = 0"))
def vote_unanimous(spark, sf_dir):
    return votes.reconcile(_claims(spark, sf_dir), ["user_id", "event_type"], rule="unanimous")


@query(_VOTES_SQL.format("n_agree > n_deny"))
def vote_majority(spark, sf_dir):
    return votes.reconcile(_claims(spark, sf_dir), ["user_id", "event_type"])


@query("""SELECT l_orderkey, n_present, n_absent, CASE WHEN n_present + n_absent > 0 THEN n_present >= n_absent END AS present FROM (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_present, count(*) FILTER (l_returnflag = 'N') AS n_absent FROM lineitem GROUP BY l_orderkey)""")
def consensus_presence(spark, sf_dir):
    return votes.presence(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_returnflag") == "N")


_MAJORITY_SQL = """WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS seen FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, l_returnflag DESC) AS k, sum(n) OVER (PARTITION BY l_orderkey) AS total FROM c) """


@query(_MAJORITY_SQL + "SELECT l_orderkey, l_returnflag AS majority FROM r WHERE k = 1")
def majority_first_seen(spark, sf_dir):
    found = votes.majority_first_seen(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")
    return found.select("l_orderkey", "majority")


@query(_MAJORITY_SQL + "SELECT l_orderkey, round(n / total, 6) AS agreement FROM r WHERE k = 1")
def agreement_ratio(spark, sf_dir):
    found = votes.majority_first_seen(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber")
    return found.select("l_orderkey", F.round("agreement", 6).alias("agreement"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers FROM lineitem GROUP BY l_orderkey")
def union_lists(spark, sf_dir):
    found = votes.union_lists(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")
    return found.select("l_orderkey", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("""SELECT l_suppkey, CASE WHEN a > b THEN 'A' WHEN b > a THEN 'R' END AS side FROM (
  SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY l_suppkey)""")
def side_majority(spark, sf_dir):
    return votes.side_majority(_read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "A", "R")


@query("""SELECT c_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE c_mktsegment END AS status, count(o_orderkey) AS n_orders
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment""")
def source_override(spark, sf_dir):
    """Facts override where they agree, else what was there stays; no facts change nothing."""
    facts = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"), F.count("*").alias("n"))
    joined = _read(spark, sf_dir, "customer").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("c_mktsegment")).alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (value < 5) > 0 THEN false WHEN count(*) FILTER (value > 100) > 0 THEN true END AS answer FROM events GROUP BY user_id""")
def any_false_wins(spark, sf_dir):
    v = F.col("value")
    rows = _read(spark, sf_dir, "events").select("user_id", F.when(v < 5, False).when(v > 100, True).alias("a"))
    return rows.groupBy("user_id").agg(votes.any_false_wins("a").alias("answer"))


@query("""SELECT o_custkey, arg_min(o_orderstatus, (o_orderpriority, o_orderkey)) AS picked FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")
def priority_pick(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").withColumn("p", F.struct("o_orderpriority", "o_orderkey"))
    return votes.priority_pick(rows, ["o_custkey"], "o_orderstatus", "p", unspecified="P")


_FIRST_SQL = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts {0}, event_id {0}) AS k FROM events) WHERE k = 1"


@query(_FIRST_SQL.format(""))
def dedupe_first(spark, sf_dir):
    return votes.first_of(_read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query(_FIRST_SQL.format("DESC"))
def dedupe_last(spark, sf_dir):
    from .sources import readers

    rows = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("o"))
    return readers.latest(rows, ["user_id", "event_type"], "o").select("event_id", "user_id", "event_type")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem), b AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_type END AS v FROM part), x AS (SELECT p_partkey AS k, p_type AS v FROM part JOIN a ON p_partkey = a.k)
 SELECT coalesce(x.k, b.k) AS p_partkey, CASE WHEN x.v IS NOT DISTINCT FROM b.v THEN x.v END AS v, x.v IS DISTINCT FROM b.v AS differs FROM x FULL JOIN b ON x.k = b.k""")
def null_disagreement(spark, sf_dir):
    """One reading has the parts that were ordered, the other all parts, without the type of small ones."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    ordered = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    a = part.join(ordered, "p_partkey", "left_semi").select("p_partkey", F.col("p_type").alias("v"))
    b = part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("v"))
    return votes.null_disagreement(a, b, ["p_partkey"], "v")


@query("""SELECT user_id, CASE WHEN n = 0 THEN 'unknown' WHEN sets = 0 THEN 'none' WHEN fulls = 5 THEN 'complete' WHEN sets = 1 THEN 'single' WHEN fulls >= 1 THEN 'partial' ELSE 'scatter' END AS pattern FROM (
  SELECT user_id, sum(n) AS n, count(*) FILTER (hot > 0) AS sets, count(*) FILTER (hot >= 5) AS fulls FROM (
    SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 60) AS hot FROM events GROUP BY ALL) GROUP BY user_id)""")
def pattern_ladder(spark, sf_dir):
    per = _read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("hot"))
    c = per.groupBy("user_id").agg(F.sum("n").alias("n"), F.count_if(F.col("hot") > 0).alias("s"), F.count_if(F.col("hot") >= 5).alias("f"))
    return c.select("user_id", votes.quadrant_pattern(c, F.col("s"), F.col("f"), F.col("n"), F.lit(5)).alias("pattern"))


# --- metrics

_PRED = "SELECT d.doc_id, d.lang FROM documents d WHERE d.n_chars > 1500"
_TRUTH = "SELECT d.doc_id, d.lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1"
_PR = """SELECT {0} sum(c * t)::BIGINT AS tp, sum(c * (1 - t))::BIGINT AS fp, sum((1 - c) * t)::BIGINT AS fn,
  round(CASE WHEN sum(c) = 0 THEN 0 ELSE sum(c * t) / sum(c) END, 6) AS precision, round(CASE WHEN sum(t) = 0 THEN 0 ELSE sum(c * t) / sum(t) END, 6) AS recall,
  round(CASE WHEN sum(c) + sum(t) = 0 THEN 0 ELSE 2 * sum(c * t) / (sum(c) + sum(t)) END, 6) AS f1
  FROM (SELECT doc_id, lang, max(c) AS c, max(t) AS t FROM (SELECT *, 1 AS c, 0 AS t FROM (""" + _PRED + ") UNION ALL SELECT *, 0, 1 FROM (" + _TRUTH + ")) GROUP BY ALL) GROUP BY {1}"


def _sets(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    good = _read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return docs.filter("n_chars > 1500").select("doc_id", "lang"), docs.join(good, "doc_id").select("doc_id", "lang")


@query(_PR.format("lang,", "lang"))
def set_pr(spark, sf_dir):
    return metrics.score_sets(*_sets(spark, sf_dir), ["doc_id", "lang"], ["lang"])


@query("SELECT coalesce(lang, 'ALL') AS lang, tp, fp, fn, round(tp / (tp + fp), 6) AS precision FROM (" + _PR.format("lang,", "ROLLUP (lang)").replace("round(CASE", "round(CASE") + ")")
def rollup_by_prefix(spark, sf_dir):
    """The per-group table and its ALL row in one pass."""
    per = metrics.score_sets(*_sets(spark, sf_dir), ["doc_id", "lang"], ["lang"])
    r = per.rollup("lang").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return r.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "tp", "fp", "fn", F.round(metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"))


@query("""SELECT field, tp, fp, fn FROM (SELECT field, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM (
  SELECT 'quality' AS field, n_chars > 1000 AS p, quality = 1 AS t FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'toxic', n_chars > 5000, toxic = 1 FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'never', false, CASE WHEN toxic IS NOT NULL THEN false END FROM documents LEFT JOIN labels USING (doc_id)) WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY field) WHERE tp + fp + fn > 0""")
def field_survey(spark, sf_dir):
    both = _read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    fields = F.array(*(F.struct(F.lit(n).alias("field"), p.alias("p"), t.alias("t")) for n, p, t in (
        ("quality", F.col("n_chars") > 1000, F.col("quality") == 1), ("toxic", F.col("n_chars") > 5000, F.col("toxic") == 1),
        ("never", F.lit(False), F.when(F.col("toxic").isNotNull(), F.lit(False))))))
    return metrics.survey(both.select(F.inline(fields)), "field", "p", "t")


_PAIRS_SQL = """p AS (SELECT d.doc_id, d.lang, {0} AS c, {1} AS r FROM documents d JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark) b ON (d.doc_id % b.n = b.k OR (d.doc_id + 1) % b.n = b.k))""".format(TOKENS_SQL.format("d.text"), TOKENS_SQL.format("b.text"))


def _bleu_sql(by: str, corpus: bool) -> str:
    parts, counts = [], []
    for n in range(1, 5):
        gram = f"list_transform(range(1, greatest(len({{0}}) - {n - 1}, 0) + 1), lambda i: array_to_string({{0}}[i:i + {n - 1}], chr(31)))"
        parts.append(f"c{n} AS (SELECT doc_id, lang, g, count(*) AS c FROM (SELECT doc_id, lang, unnest({gram.format('c')}) AS g FROM one) GROUP BY ALL), r{n} AS (SELECT doc_id, g, max(c) AS m FROM (SELECT doc_id, r, g, count(*) AS c FROM (SELECT doc_id, r, unnest({gram.format('r')}) AS g FROM (SELECT DISTINCT doc_id, r FROM p)) GROUP BY ALL) GROUP BY ALL), h{n} AS (SELECT {by}, sum(least(c, m)) AS h FROM c{n} JOIN r{n} USING (doc_id, g) GROUP BY {by})")
        counts.append(f"ln(CASE WHEN coalesce(h{n}.h, 0) = 0 THEN 0.1 ELSE h{n}.h END / greatest(s.d{n}, 1))")
    joins = " ".join(f"LEFT JOIN h{n} ON s.{by} = h{n}.{by}" for n in range(1, 5))
    dens = ", ".join(f"sum(greatest(len(c) - {n - 1}, 0)) AS d{n}" for n in range(1, 5))
    return f"""WITH {_PAIRS_SQL}, one AS (SELECT doc_id, lang, any_value(c) AS c, arg_min(len(r), (abs(len(r) - len(c)), len(r))) AS rl FROM p GROUP BY doc_id, lang), {', '.join(parts)},
 s AS (SELECT {by}, sum(len(c)) AS cl, sum(rl) AS rl, {dens} FROM one GROUP BY {by})
 SELECT s.{by}, round(CASE WHEN coalesce(h1.h, 0) = 0 THEN 0 ELSE CASE WHEN cl > s.rl THEN 1 ELSE exp(1 - s.rl / cl) END * exp(({' + '.join(counts)}) / 4) END, 6) AS bleu FROM s {joins}"""


def _with_references(spark, sf_dir):
    """Each document with two passages, a fixed pairing by ids: (doc_id, lang, c, r1, r2), token arrays of whole texts."""
    bench = _read(spark, sf_dir, "benchmark")
    n = bench.count()
    order = bench.select("item_id").withColumn("g", F.floor(F.col("item_id") / 1000))
    # numbered by item_id: a running count of groups of ids, and a rank inside each
    sizes = order.groupBy("g").agg(F.count("*").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("item_id"))
    items = bench.withColumn("g", F.floor(F.col("item_id") / 1000)).withColumn("rank", rank).join(sizes, "g").select((F.col("base") + F.col("rank") - 1).alias("k"), text.tokens(F.col("text")).alias("r"))
    side = (lambda d: F.broadcast(d)) if n <= 10_000 else (lambda d: d)
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", text.tokens(F.col("text")).alias("c"), (F.col("doc_id") % n).alias("k1"), ((F.col("doc_id") + 1) % n).alias("k2"))
    one, two = items.select(F.col("k").alias("k1"), F.col("r").alias("r1")), items.select(F.col("k").alias("k2"), F.col("r").alias("r2"))
    return docs.join(side(one), "k1").join(side(two), "k2").select("doc_id", "lang", "c", "r1", "r2")


@query(_bleu_sql("lang", True))
def bleu4_corpus(spark, sf_dir):
    rows = _with_references(spark, sf_dir).select("lang", "c", F.array("r1", "r2").alias("rs"))
    return metrics.bleu_of(rows, ["lang"], "c", "rs")


@query(_bleu_sql("doc_id", False))
def bleu4_case(spark, sf_dir):
    rows = _with_references(spark, sf_dir).select("doc_id", "c", F.array("r1", "r2").alias("rs"))
    return metrics.bleu_of(rows, ["doc_id"], "c", "rs")


_METEOR_SQL = f"""WITH {_PAIRS_SQL}, q AS (SELECT *, row_number() OVER () AS id FROM p),
 a AS (SELECT id, i, t, row_number() OVER (PARTITION BY id, t ORDER BY i) AS k FROM (SELECT id, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS t FROM q)),
 b AS (SELECT id, j, t, row_number() OVER (PARTITION BY id, t ORDER BY j) AS k FROM (SELECT id, unnest(range(1, len(r) + 1)) AS j, unnest(r) AS t FROM q)),
 m AS (SELECT id, i, j, CASE WHEN i = lag(i) OVER w + 1 AND j = lag(j) OVER w + 1 THEN 0 ELSE 1 END AS new FROM a JOIN b USING (id, t, k) WINDOW w AS (PARTITION BY id ORDER BY i)),
 s AS (SELECT id, count(*) AS m, sum(new) AS ch FROM m GROUP BY id),
 e AS (SELECT q.*, CASE WHEN len(c) = 0 AND len(r) = 0 THEN 1.0 WHEN len(c) = 0 OR len(r) = 0 OR m IS NULL THEN 0.0 ELSE 10 * (m / len(c)) * (m / len(r)) / (m / len(r) + 9 * (m / len(c))) * (1 - 0.5 * pow(ch / m, 3)) END AS meteor FROM q LEFT JOIN s USING (id))
 """


@query(_METEOR_SQL + "SELECT doc_id, max(round(meteor, 6)) AS meteor FROM e GROUP BY doc_id")
def meteor_lite(spark, sf_dir):
    """The best of a document's references."""
    rows = _with_references(spark, sf_dir)
    first, second = (metrics.meteor_lite(rows, ["doc_id"], "c", r) for r in ("r1", "r2"))
    return first.unionAll(second).groupBy("doc_id").agg(F.max("meteor").alias("meteor"))


@query("""SELECT event_type, round(p, 6) AS mean_p, round(sd, 6) AS sd_p, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS clinical,
  round(0.8 * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END + 0.2 * (b + m) / 2, 6) AS final FROM (
  SELECT event_type, avg(value / 500) AS p, coalesce(stddev_samp(value / 500), 0) AS sd, avg(event_id % 10 / 10) AS r, avg(event_id % 7 / 7) AS b, avg(event_id % 3 / 3) AS m FROM events GROUP BY event_type)""")
def score_aggregate(spark, sf_dir):
    """The harmonic mean is that of the means, not the mean of cases' scores."""
    e = F.col("event_id")
    rows = _read(spark, sf_dir, "events").select("event_type", (F.col("value") / 500).alias("p"), (e % 10 / 10).alias("r"), (e % 7 / 7).alias("b"), (e % 3 / 3).alias("m"))
    mean, sd = metrics.mean_sd("p")
    a = rows.groupBy("event_type").agg(mean.alias("p"), sd.alias("sd"), F.avg("r").alias("r"), F.avg("b").alias("b"), F.avg("m").alias("m"))
    c = metrics.harmonic(F.col("p"), F.col("r"))
    return a.select("event_type", F.round("p", 6).alias("mean_p"), F.round("sd", 6).alias("sd_p"), F.round(c, 6).alias("clinical"), F.round(metrics.final_score(c, F.col("b"), F.col("m")), 6).alias("final"))


@query("SELECT event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY event_type")
def phase_rollup(spark, sf_dir):
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(us(F.min("ts")).alias("first_us"), us(F.max("ts")).alias("last_us"), F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


# --- series

@query("""SELECT user_id, max(n) AS longest_run FROM (SELECT user_id, count(*) AS n FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events)) GROUP BY user_id, g) GROUP BY user_id""")
def gaps_islands(spark, sf_dir):
    days = _read(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d"))
    return series.longest_run(days, ["user_id"], "d")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS n, min(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
 k AS (SELECT l_orderkey, list({'n': n, 'q': q} ORDER BY n) AS p FROM a GROUP BY l_orderkey),
 e AS (SELECT l_orderkey, i AS n, len(p) AS c, list_filter(p, lambda x: x.n < i) AS l, list_filter(p, lambda x: x.n = i) AS m, list_filter(p, lambda x: x.n > i) AS r FROM (SELECT *, unnest(range(1, 9)) AS i FROM k))
 SELECT l_orderkey, n, round(CASE WHEN len(m) > 0 THEN m[1].q WHEN c < 2 THEN NULL
   WHEN len(l) > 0 AND len(r) > 0 THEN l[-1].q + (r[1].q - l[-1].q) * (n - l[-1].n) / (r[1].n - l[-1].n)
   WHEN len(r) = 0 THEN l[-1].q + (l[-1].q - l[-2].q) / (l[-1].n - l[-2].n) * (n - l[-1].n)
   ELSE r[1].q + (r[2].q - r[1].q) / (r[2].n - r[1].n) * (n - r[1].n) END, 6) AS filled FROM e""")
def interp_missing(spark, sf_dir):
    """Eight places of an order; those of returned lines and beyond its last one are missing."""
    given = _read(spark, sf_dir, "lineitem").filter("l_returnflag <> 'A'").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("q"))
    slots = given.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("n", "q"))).alias("m")).select("l_orderkey", F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(i.alias("n"), F.try_element_at("m", i).alias("q")))).alias("s")).select("l_orderkey", "s.n", "s.q")
    return series.interpolate(slots, ["l_orderkey"], "n", "q").select("l_orderkey", F.col("n").cast("long").alias("n"), F.round("filled", 6).alias("filled"))


_ORDERED = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"SELECT user_id, round(max(arc), 4) AS arc FROM (SELECT user_id, sum(s) OVER ({_ORDERED} ROWS UNBOUNDED PRECEDING) AS arc FROM (SELECT *, coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow(event_id - lag(event_id) OVER w, 2)), 0) AS s FROM events WINDOW w AS ({_ORDERED}))) GROUP BY user_id")
def arc_length(spark, sf_dir):
    curve = series.arc_length(_read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", "value")
    return curve.groupBy("user_id").agg(F.round(F.max("arc"), 4).alias("arc"))


@query(f"SELECT event_id, round(avg(value) OVER ({_ORDERED} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def curvature_smooth(spark, sf_dir):
    return series.smoothed(_read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 2).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH s AS (SELECT *, abs(value - lag(value) OVER w) AS p, abs(lead(value) OVER w - value) AS n FROM events WINDOW w AS ({_ORDERED})), m AS (SELECT user_id, median(p) AS m FROM s GROUP BY user_id)
 SELECT user_id, count(*) FILTER (p IS NOT NULL AND n IS NOT NULL AND least(p, n) > 4 * m OR p IS NULL AND n > 4 * m OR n IS NULL AND p > 4 * m) AS n_isolated FROM s JOIN m USING (user_id) GROUP BY user_id""")
def isolated_points(spark, sf_dir):
    rows = series.isolated(_read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rows.groupBy("user_id").agg(F.count_if("isolated").alias("n_isolated"))


@query("SELECT l_orderkey, unnest(range(a, b + 1)) AS n FROM (SELECT l_orderkey, min(l_linenumber)::BIGINT AS a, max(l_linenumber)::BIGINT AS b FROM lineitem GROUP BY l_orderkey)")
def range_expand(spark, sf_dir):
    ends = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("long").alias("a"), F.max("l_linenumber").cast("long").alias("b"))
    return series.expand_range(ends, F.col("a"), F.col("b"), "n").select("l_orderkey", "n")


# --- joins that keep or drop

@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def anti_gate(spark, sf_dir):
    bad = _read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_suppkey")
    return _read(spark, sf_dir, "lineitem").join(bad, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(documents.text, b.text))")
def semi_support(spark, sf_dir):
    """Documents that hold a passage as it is."""
    items = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    from .operators.containment import containing

    return containing(_read(spark, sf_dir, "documents"), items, "doc_id", "text", "text")


# --- training sets

@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_evidence' WHEN n_chars > 8000 THEN 'prose' WHEN n_chars < 100 THEN 'refused' WHEN lang = 'es' THEN 'unstated' WHEN quality = 0 THEN 'null' WHEN toxic = 1 THEN 'gated' END AS reason FROM documents LEFT JOIN labels l USING (doc_id)""".replace("SELECT doc_id,", "SELECT documents.doc_id AS doc_id,", 1))
def mask_reason(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").withColumn("has", F.lit(True))
    rows = _read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(labels, "doc_id", "left")
    checks = training.position_checks(F.col("has").isNull(), F.col("n_chars") > 8000, F.col("n_chars") < 100, F.col("lang") == "es", F.col("quality") == 0, F.col("toxic") == 1)
    return rows.select("doc_id", training.mask_reason(checks).alias("reason"))


@query("""WITH r AS (SELECT l.doc_id, toxic, lang, row_number() OVER (PARTITION BY lang, toxic ORDER BY md5('7|' || l.doc_id), l.doc_id) AS k, sum(toxic) OVER (PARTITION BY lang) AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
 SELECT doc_id, lang, toxic FROM r WHERE n > 0 AND (toxic = 1 OR k <= floor(6.0 * n))""")
def neg_cap(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return training.negative_cap(rows, ["lang"], F.col("toxic") == 1, "doc_id", 6.0, "7").select("doc_id", "lang", "toxic")


_HOLDOUT = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('11|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 20"


@query(_HOLDOUT)
def stratified_holdout(spark, sf_dir):
    return training.holdout(_read(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 20, "11")


@query(f"SELECT count(*) AS n_leaks FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HOLDOUT}))) WHERE doc_id IN (SELECT doc_id FROM ({_HOLDOUT}))")
def leak_guard(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang")
    held = training.holdout(docs, ["lang"], "doc_id", 20, "11")
    return training.leaks(training.without(docs, held, "doc_id"), held, "doc_id")


@query("SELECT substr(source, 1, 1) AS prefix, count(*) AS n FROM documents GROUP BY ALL")
def composition(spark, sf_dir):
    return training.composition(_read(spark, sf_dir, "documents"), "source")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY l_returnflag")
def weighted_loss(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(training.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("weighted"))


# --- volumes

@query("SELECT l_suppkey, l_linenumber, count(*) AS n_voxels, round(count(*) * 0.3, 6) AS volume FROM lineitem WHERE l_linenumber <> 0 GROUP BY ALL")
def label_histogram(spark, sf_dir):
    return volumes.histogram(_read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", 0.3)


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice::DOUBLE, 0.01) AS a, quantile_cont(l_extendedprice::DOUBLE, 0.999) AS t, count(*) AS n FROM lineitem),
 b AS (SELECT l_extendedprice::DOUBLE AS v, l_extendedprice > a + 0.1 * (t - a) AS fg, n FROM lineitem, e), c AS (SELECT *, count(*) FILTER (fg) OVER () < 0.02 * n AS few FROM b)
 SELECT round(quantile_cont(v, 0.01), 6) AS low, round(quantile_cont(v, 0.995), 6) AS high FROM c WHERE fg OR few""")
def percentile_window(spark, sf_dir):
    return volumes.percentile_window(_read(spark, sf_dir, "lineitem"), "l_extendedprice")


_CEILING_SQL = """WITH x AS (SELECT l_suppkey AS l, l_extendedprice::DOUBLE AS v, {0} AS bone FROM lineitem), p AS (SELECT l, count(*) AS n, quantile_cont(v, 0.98) AS p FROM x WHERE NOT bone GROUP BY l),
 b AS (SELECT CASE WHEN count(*) >= 200 THEN quantile_cont(v, 0.99) END AS p99 FROM x WHERE bone), w AS (SELECT quantile_cont(v, 0.999) AS hi FROM x),
 t AS (SELECT sum(n) AS teeth, count(*) FILTER (n >= 50) AS k, median(p) FILTER (n >= 50) AS m, min(p) FILTER (n >= 50) AS low FROM p),
 s AS (SELECT *, CASE WHEN teeth >= 200 AND k >= 4 THEN 1.15 * m WHEN teeth >= 200 AND k > 0 THEN 1.15 * low END AS peak FROM t, b, w)
 SELECT round(CASE WHEN peak IS NOT NULL THEN CASE WHEN p99 > 0 THEN least(peak, 2.5 * p99) ELSE peak END WHEN p99 IS NOT NULL THEN 1.6 * p99 ELSE hi END, 6) AS ceiling, k AS n_labels FROM s"""


@query(_CEILING_SQL.format("l_quantity < 10 AND l_extendedprice < 15000"))
def robust_ceiling(spark, sf_dir):
    """Suppliers as teeth; small cheap lines as bone, whose cap holds."""
    return volumes.robust_ceiling(_read(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", bone=(F.col("l_quantity") < 10) & (F.col("l_extendedprice") < 15000))


@query(_CEILING_SQL.format("false").replace("l_suppkey AS l", "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS l"))
def robust_ceiling_few(spark, sf_dir):
    """Three labels: the least peak, with its headroom."""
    return volumes.robust_ceiling(_read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query("""WITH e AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS l, i, avg(x) AS c FROM e GROUP BY ALL),
 d AS (SELECT vec_id, l, sum((x - c) * (x - c)) AS d FROM e JOIN c USING (i) GROUP BY ALL)
 SELECT vec_id, l AS nearest, round(d, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, l) AS k FROM d) WHERE k = 1""")
def nearest_centroid(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    found = volumes.nearest(rows, "vec_id", "v", volumes.centroids(rows, "label", "v"), "label")
    return found.select("vec_id", "nearest", F.round("d2", 6).alias("d2"))


# --- audits, rules, reports, streams

@query("""SELECT screen, level, count(*) AS n FROM (
  SELECT 'discount_range' AS screen, 'ERROR' AS level FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05
  UNION ALL SELECT 'large_quantity', CASE WHEN l_returnflag = 'R' THEN 'NOTE' ELSE 'ERROR' END FROM lineitem WHERE l_quantity > 45
  UNION ALL SELECT 'missing_order', 'ERROR' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT 'cheap_order', 'NOTE' FROM orders WHERE o_totalprice < 2000) GROUP BY ALL""")
def audit_screens(spark, sf_dir):
    lines, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    found = audit.findings([
        audit.screen(lines, "discount_range", audit.ERROR, (F.col("l_discount") < 0) | (F.col("l_discount") > 0.05), "l_orderkey", F.lit("outside 0 to 0.05")),
        audit.screen(lines, "large_quantity", audit.ERROR, F.col("l_quantity") > 45, "l_orderkey", F.lit("over 45"), masked=F.col("l_returnflag") == "R"),
        audit.orphans(lines, orders.filter("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey", "missing_order"),
        audit.screen(orders, "cheap_order", audit.NOTE, F.col("o_totalprice") < 2000, "o_orderkey", F.lit("under 2000")),
    ])
    return found.groupBy("screen", "level").agg(F.count("*").alias("n"))


def _summaries(spark, sf_dir):
    """Orders as cases: line numbers stand for positions 31 to 37, flags for findings, the customer's record for facts."""
    li = _read(spark, sf_dir, "lineitem")
    at = lambda flag: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == flag, 30 + F.col("l_linenumber")))).cast("array<int>")
    cases = li.groupBy("l_orderkey").agg(at("A").alias("endodontic"), at("N").alias("fillings"), at("R").alias("f_absent"), F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"))
    none = F.lit(None)
    return cases.select(
        F.col("l_orderkey").alias("case_id"), F.array().cast("array<int>").alias("absent"), "f_absent", F.lit("complete").alias("f_maxilla"), F.array(F.lit(31), F.lit(38)).alias("impacted"), "endodontic", "fillings",
        none.cast("array<int>").alias("s_endodontic"), none.cast("array<int>").alias("s_fillings"), F.array().cast("array<struct<fdi:int,crown:boolean>>").alias("implants"), none.cast("array<int>").alias("f_implants"),
        F.array().cast("array<int>").alias("bridges"), none.cast("array<int>").alias("f_bridges"), F.array("lo", "hi").alias("canal_votes"), none.cast("string").alias("canal"), F.lit(False).alias("atrophy"),
        F.lit("fully_included").alias("condyle"), F.when(F.col("case_id") % 5 == 0, "excluded").alias("f_condyles") if "case_id" in cases.columns else F.when(F.col("l_orderkey") % 5 == 0, "excluded").alias("f_condyles"),
        F.lit("complete").alias("level"), F.lit("scatter").alias("pattern"),
    )


_JOIN_SQL = "CASE len({0}) WHEN 1 THEN {0}[1]::VARCHAR WHEN 2 THEN {0}[1] || ' and ' || {0}[2] ELSE array_to_string({0}[1:len({0}) - 1], ', ') || ', and ' || {0}[len({0})] END"
_RULES_SQL = """WITH c AS (SELECT l_orderkey AS case_id, list_sort(list_distinct(list(30 + l_linenumber) FILTER (l_returnflag = 'R'))) AS r, list_sort(list_distinct(list(30 + l_linenumber) FILTER (l_returnflag = 'A'))) AS a, list_sort(list_distinct(list(30 + l_linenumber) FILTER (l_returnflag = 'N'))) AS n, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY l_orderkey),
 g AS (SELECT case_id, coalesce(r, []) AS absent, list_filter([31, 38], lambda x: NOT list_contains(coalesce(r, []), x)) AS impacted, list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(r, []), x)) AS endodontic, list_filter(coalesce(n, []), lambda x: NOT list_contains(coalesce(r, []), x)) AS fillings,
   CASE WHEN lo = hi THEN lo ELSE 'lingual' END AS canal, CASE WHEN case_id % 5 = 0 THEN 'not_included' ELSE 'fully_included' END AS condyle FROM c) """


@query(_RULES_SQL + "SELECT case_id, array_to_string(absent, ',') AS absent, array_to_string(list_filter(impacted, lambda x: x IN (18, 28, 38, 48)), ',') AS impacted, array_to_string(endodontic, ',') AS endodontic, array_to_string(fillings, ',') AS fillings, canal, condyle FROM g")
def rule_chain(spark, sf_dir):
    done = rules.apply(_summaries(spark, sf_dir))
    lists = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("absent", "impacted", "endodontic", "fillings")]
    return done.select("case_id", *lists, "canal", "condyle")


@query(_RULES_SQL + f"""SELECT case_id, concat_ws(' ', 'Mandible is completely included in the scan volume.',
  'Right mandibular canal with a regular course, predominantly ' || canal || '.',
  CASE WHEN len(absent) > 0 THEN 'Absence of ' || CASE WHEN len(absent) = 1 THEN 'tooth ' ELSE 'teeth ' END || {_JOIN_SQL.format('absent')} || '.' END, CASE WHEN NOT list_contains(absent, 38) THEN 'Tooth 38 is impacted.' END,
  CASE WHEN len(endodontic) > 0 THEN 'Endodontic treatment involving teeth ' || {_JOIN_SQL.format('endodontic')} || '.' END,
  CASE WHEN len(fillings) > 0 THEN 'Conservative composite restoration' || CASE WHEN len(fillings) = 1 THEN ' on tooth ' ELSE 's on teeth ' END || {_JOIN_SQL.format('fillings')} || '.' END,
  CASE WHEN condyle = 'not_included' THEN 'Condyles not included in the scan volume.' ELSE 'Condyles included in the scan volume.' END) AS report FROM g""")
def report_render(spark, sf_dir):
    return report.mandible(rules.apply(_summaries(spark, sf_dir)))


@query("""WITH c AS (SELECT l_orderkey, list_distinct(list(30 + l_linenumber)) AS a FROM lineitem GROUP BY l_orderkey)
 SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'unknown' WHEN len(a) = 8 THEN 'quadrant_edentulous_one' WHEN len(a) < 2 OR list_max(a) - list_min(a) + 1 = len(a) THEN 'consecutive_run' ELSE 'scatter' END AS pattern FROM c""")
def absent_pattern(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(30 + F.col("l_linenumber")).alias("a"))
    return rows.select("l_orderkey", verdicts.absent_pattern("mandible", F.col("a").cast("array<int>"), F.col("l_orderkey") % 11 != 0).alias("pattern"))


@query("""WITH c AS (SELECT l_orderkey, coalesce(list(DISTINCT 30 + l_linenumber) FILTER (l_returnflag = 'A'), []) AS p, coalesce(list(DISTINCT 30 + l_linenumber) FILTER (l_returnflag = 'R'), []) AS a, coalesce(list(DISTINCT 30 + l_linenumber) FILTER (l_quantity > 45), []) AS m FROM lineitem GROUP BY l_orderkey),
 s AS (SELECT l_orderkey, len(p) > 0 AS hp, len(a) > 0 AS ha, list_filter(a, lambda x: NOT list_contains(m, x)) AS gone, list_distinct(list_concat(p, m)) AS t FROM c),
 u AS (SELECT *, list_filter(t, lambda x: NOT list_contains(gone, x)) AS there FROM s)
 SELECT l_orderkey, len(there) + CASE WHEN ha AND NOT hp THEN 16 - len(there) - len(gone) ELSE 0 END AS n_present, len(gone) + CASE WHEN hp AND NOT ha THEN 16 - len(there) - len(gone) ELSE 0 END AS n_absent, CASE WHEN ha = hp THEN 16 - len(there) - len(gone) ELSE 0 END AS n_unstated FROM u""")
def presence_resolution(spark, sf_dir):
    at = 30 + F.col("l_linenumber")
    lists = lambda c: F.collect_set(F.when(c, at)).cast("array<int>")
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lists(F.col("l_returnflag") == "A").alias("p"), lists(F.col("l_returnflag") == "R").alias("a"), lists(F.col("l_quantity") > 45).alias("m"))
    none = F.lit(None)
    found = rows.select("l_orderkey", verdicts.presence("mandible", F.col("p"), F.col("a"), F.col("m"), none.cast("array<int>"), none.cast("boolean"), none.cast("string")).alias("s"))
    return found.select("l_orderkey", *(F.size(f"s.{k}").cast("long").alias(f"n_{k}") for k in ("present", "absent", "unstated")))


@query("SELECT user_id, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def incremental_append(spark, sf_dir):
    """A run in two parts, of which the second must not repeat the first, rolled up: the same as one batch."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    keys = ["user_id", "event_type"]
    first = events.filter("event_id % 3 = 0")
    done = first.select("event_id")
    from .sources.readers import pending

    rest = pending(events, done, "event_id")
    parts = incremental.partial_counts(first, keys, "value").unionByName(incremental.partial_counts(rest, keys, "value"))
    return incremental.rolled_up(parts, keys)


@query("SELECT fdi, arch, fdi // 10 AS quadrant, fdi % 10 = 8 AS wisdom FROM (SELECT 10 * q + p AS fdi, CASE WHEN q < 3 THEN 'maxilla' ELSE 'mandible' END AS arch FROM (SELECT unnest([1, 2, 3, 4]) AS q), (SELECT unnest(range(1, 9)) AS p))".replace("SELECT fdi,", "SELECT fdi::INT AS fdi,", 1).replace("fdi // 10 AS", "(fdi // 10)::INT AS", 1))
def position_dimension(spark, sf_dir):
    return dims.positions(spark).select("fdi", "arch", "quadrant", "wisdom")
