"""Operators on written-out cases: nulls, ties, empty groups, orders of rules."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import repair, text, verdicts
from factloom.operators import audit, metrics, rules, series, training, volumes, votes
from factloom.plans import dims, report
from factloom.sources import readers
from factloom.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_votes_keep_three_answers_apart(spark):
    rows = [(1, True), (1, False), (2, True), (2, None), (3, None), (4, True), (4, True), (4, False), (5, False)]
    v = frame(spark, rows, "k int, a boolean").select("k", votes.verdict(F.col("a")).alias("verdict"))
    by = lambda rule: {r.k: (r.kept, r.dropped) for r in votes.reconcile(v, ["k"], rule=rule).collect()}
    assert by("unanimous") == {1: (False, True), 2: (True, False), 3: (False, False), 4: (False, True), 5: (False, False)}
    assert by("majority") == {1: (False, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, False)}


def test_majorities(spark):
    rows = frame(spark, [(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, None, 1), (2, "c", 2), (3, None, 1)], "k int, v string, o int")
    assert {r.k: (r.majority, r.agreement) for r in votes.majority_first_seen(rows, ["k"], "v", "o").collect()} == {1: ("b", 0.5), 2: ("c", 1.0)}
    sides = votes.side_majority(frame(spark, [(1, "l"), (1, "b"), (2, "l"), (3, None)], "k int, s string"), ["k"], "s", "l", "b")
    assert {r.k: r.side for r in sides.collect()} == {1: None, 2: "l", 3: None}
    p = votes.presence(frame(spark, [(1, "p"), (1, "a"), (2, "a"), (3, None)], "k int, s string"), ["k"], F.col("s") == "p", F.col("s") == "a")
    assert {r.k: r.present for r in p.collect()} == {1: True, 2: False, 3: None}
    f = frame(spark, [(1, True), (1, False), (2, True), (2, None), (3, None)], "k int, a boolean").groupBy("k").agg(votes.any_false_wins("a").alias("a"), votes.unanimous_or("a", False).alias("u"))
    assert {r.k: r.a for r in f.collect()} == {1: False, 2: True, 3: None}


def test_null_disagreement(spark):
    a, b = frame(spark, [(1, "x"), (2, "y"), (3, None)], "k int, v string"), frame(spark, [(1, "x"), (2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {r.k: (r.v, r.differs) for r in votes.null_disagreement(a, b, ["k"], "v").collect()} == {1: ("x", False), 2: (None, True), 3: (None, False), 4: (None, True)}


def test_scores(spark):
    claims = [(i,) for i in range(197)] + [(1000 + i,) for i in range(58)]
    truth = [(i,) for i in range(197)] + [(2000 + i,) for i in range(35)]
    s = metrics.score_sets(frame(spark, claims, "k int").withColumn("g", F.lit("x")), frame(spark, truth, "k int").withColumn("g", F.lit("x")), ["k", "g"], ["g"]).head()
    assert (s.tp, s.fp, s.fn, round(s.precision, 2), round(s.recall, 2)) == (197, 58, 35, 0.77, 0.85)
    both = frame(spark, [("a", True, True), ("a", None, True), ("b", False, False), ("c", False, True)], "f string, p boolean, t boolean")
    assert {r.f: (r.tp, r.fp, r.fn) for r in metrics.survey(both, "f", "p", "t").collect()} == {"a": (1, 0, 0), "c": (0, 0, 1)}
    mean, sd = metrics.mean_sd("x")
    for values, want in (([None], (0.0, 0.0)), ([5.0], (5.0, 0.0)), ([1.0, 3.0, None], (2.0, 2**0.5))):
        got = frame(spark, [(v,) for v in values], "x double").agg(mean, sd).first()
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9


def plain_bleu(pairs):
    from collections import Counter
    from math import exp, log

    hits, total, c_len, r_len = [0] * 4, [0] * 4, 0, 0
    for c, refs in pairs:
        c_len += len(c)
        r_len += min((abs(len(r) - len(c)), len(r)) for r in refs)[1]
        for n in range(4):
            grams = lambda t: Counter(tuple(t[i : i + n + 1]) for i in range(len(t) - n))
            most = Counter()
            for r in refs:
                most |= grams(r)
            hits[n] += sum((grams(c) & most).values())
            total[n] += max(0, len(c) - n)
    if not hits[0]:
        return 0.0
    return (1.0 if c_len > r_len else exp(1 - r_len / c_len)) * exp(sum(log((h or 0.1) / max(1, t)) for h, t in zip(hits, total)) / 4)


def test_bleu_and_meteor(spark):
    cases = [("a b c d e".split(), ["a b c d f".split(), "a b".split()]), ("x y".split(), ["x y z".split()]), ("q".split(), ["a a".split()])]
    rows = [("all", i, c, r) for i, (c, refs) in enumerate(cases) for r in refs]
    got = metrics.bleu(frame(spark, rows, "g string, k int, c array<string>, r array<string>"), ["g"], "k", "c", "r").head().bleu
    assert abs(got - plain_bleu(cases)) < 1e-6
    m = metrics.meteor_lite(frame(spark, [(1, [], []), (2, ["a"], []), (3, ["a", "b"], ["a", "b"]), (4, ["b", "a", "a"], ["a", "b"])], "k int, c array<string>, r array<string>"), ["k"], "c", "r")
    got = {r.k: r.meteor for r in m.collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and abs(got[3] - (1 - 0.5 / 8)) < 1e-6 and abs(got[4] - 10 * (2 / 3) / (1 + 9 * 2 / 3) * 0.5) < 1e-6


def test_series(spark):
    rows = frame(spark, [(1, x) for x in (1, 2, 3, 3, 7, 8)] + [(2, 5)], "k int, x int")
    assert {r.k: r.longest_run for r in series.longest_run(rows, ["k"], "x").collect()} == {1: 3, 2: 1}
    holes = frame(spark, [(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])] + [(2, 0, None)], "k int, i int, v double")
    assert [r.filled for r in series.interpolate(holes, ["k"], "i", "v").orderBy("k", "i").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0, None]  # beyond the ends on the line of the two nearest
    ends = frame(spark, [(1, i, v) for i, v in enumerate([None, None, 3.0, 4.0, None])] + [(2, i, v) for i, v in enumerate([None, 7.0])], "k int, i int, v double")
    assert [r.filled for r in series.interpolate(ends, ["k"], "i", "v").orderBy("k", "i").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0, None, 7.0]
    line = frame(spark, [(1, i, float(x), 0.0) for i, x in enumerate([0, 1, 2, 3, 50, 5, 6, 7])], "k int, i int, x double, y double")
    assert sorted(r.x for r in series.without_outliers(line, ["k"], ["i"], "x", "y").collect()) == [0, 1, 2, 3, 5, 6, 7]
    bent = frame(spark, [(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 4.0)], "k int, i int, x double, y double")
    assert [(r.s, r.x, r.y) for r in series.resampled(bent, ["k"], ["i"], "x", "y", 2.0).orderBy("s").collect()] == [(0.0, 0.0, 0.0), (2.0, 2.0, 0.0), (4.0, 3.0, 1.0), (6.0, 3.0, 3.0)]
    assert [r.radius for r in series.curvature(bent, ["k"], ["i"], "x", "y").orderBy("i").collect()] == [None, 2.5, None]
    assert one(spark, series.is_consecutive(F.array(F.lit(3), F.lit(1), F.lit(2)))) and not one(spark, series.is_consecutive(F.array(F.lit(3), F.lit(1))))


def test_training(spark):
    rows = frame(spark, [(i, "a" if i < 50 else "b", i in (3, 4)) for i in range(60)], "id int, g string, pos boolean")
    kept = training.negative_cap(rows, ["g"], F.col("pos"), "id", 2.5, "s").groupBy("g", "pos").count().collect()
    assert {(r.g, r.pos): r["count"] for r in kept} == {("a", True): 2, ("a", False): 5}
    held = training.holdout(rows, ["g"], "id", 15, "s")
    assert {r.g: r["count"] for r in held.groupBy("g").count().collect()} == {"a": 15, "b": 10}
    assert training.leaks(training.without(rows, held, "id"), held, "id").head().n_leaks == 0
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, training.mask_reason(training.position_checks(f, f, n, f, t, t))) == "null"
    assert one(spark, training.mask_reason(training.arch_checks(f, f, f, t, t))) == "gated"
    assert one(spark, training.mask_reason(training.arch_checks(f, f, f, f, f))) is None


def test_text(spark):
    assert one(spark, text.join_list(F.array(*map(F.lit, (34, 36, 47))))) == "34, 36, and 47"
    assert [one(spark, text.join_list(F.array(*map(F.lit, x)))) for x in ((1,), (1, 2))] == ["1", "1 and 2"]
    assert one(spark, text.sentences(F.lit("e.d. 48 is here. Tooth 4.8; fine:  yes"))) == ["e.d. 48 is here.", "Tooth 4.8;", "fine:", "yes"]
    assert one(spark, text.sentences(F.lit("type B. Next e.g. this. a.b.c. 5 and x. y"))) == ["type B.", "Next e.g.", "this.", "a.b.c. 5 and x.", "y"]
    assert [one(spark, text.is_meaningful(F.lit(x).cast("string"))) for x in (" Normal ", "", "lesion", None, "WELL")] == [False, False, True, False, False]
    assert one(spark, text.named_positions(F.lit("teeth 1.7 to 1.4, 42-32 and 55; 18 until 48, tooth 3.6"))) == [14, 15, 16, 17, 18, 31, 32, 36, 41, 42, 48, 55]
    values = F.array(*map(F.lit, ("48", " 31", "x", "18", "31", "4")))
    assert one(spark, text.position_list(values, "mandible")) == [48, 31] and one(spark, text.position_list(values, "mandible", True)) == [31, 48]
    assert [one(spark, text.without_label(F.lit(x), "Mandible")) for x in ("mandible : ok", "Mandible:", "other")] == ["ok", "Mandible:", "other"]
    assert one(spark, text.short_fact(F.lit("tooth_36_eruption_state"))) == "eruption_state"
    assert one(spark, text.positions_in(F.lit("48, 4.8 and 1.1, 149"))) == [48, 11]
    assert [one(spark, text.enum_by_prefix(F.lit(v), ["partial", "complete", "part_time"])) for v in ("partial", "comp", "part", "", "completely")] == ["partial", "complete", None, None, "complete"]
    names = frame(spark, [("A007.txt",), ("A007_1.txt",), ("weird-name.txt",), ("A007_doctor1.txt",)], "n string")
    assert [(r[0], r[1]) for r in names.select(text.case_of(F.col("n")), text.reader_of(F.col("n"))).collect()] == [("A007", None), ("A007", "1"), ("weird-name", None), ("A007", "doctor1")]
    assert readers.newest_version(["run_v6.9", "run_v6.10", "other"], "run") == "run_v6.10"


def test_repair(spark):
    assert repair.repair('```json\n{"a": 1}\n```') == '{"a": 1}' == repair.repair('so: {"a": 1} and more') == repair.repair('{"a": 1')
    assert [repair.repair(x) for x in (None, "", "none", '{"a": 1,', '{"a": "cu', '{"a": [1}', '{"a": 1}, "b": 2}', "12")] == [None] * 8
    odd = frame(spark, [(x,) for x in ('{"a":1} tail', '{"a":1}, "b":2}', "12", ' {"a":1}\n', '{"a":1}, {"b":2}', '{"a":[1,{"b":2', "[1]")], "t string")
    assert [r[0] for r in odd.select(repair.parse(F.col("t"))).collect()] == ['{"a": 1}', None, None, ' {"a":1}\n', None, '{"a": [1, {"b": 2}]}', None]
    assert repair.loose_pairs("{state: fully_erupted, 'note': \"a, b\", teeth: [1, 2], more text}") == {"state": "fully_erupted", "note": "a, b", "teeth": "[1, 2], more text"}
    assert repair.loose_pairs("eruption state partial, eruption none", ("eruption", "eruption state")) == {"eruption state": "partial", "eruption": "none"}
    assert [one(spark, repair.outermost(F.lit(x))) for x in ('a {"x":{"y":1}} b', "none", "{broken")] == ['{"x":{"y":1}}', "{}", "{}"]
    spans = one(spark, repair.with_spans([("a", F.lit("1")), ("bé", F.lit('"x"')), ("c", F.lit(None).cast("string"))]))
    assert spans.text == '{"a": 1, "b\\u00e9": "x", "c": null}' and [spans.text[x.begin : x.end] for x in spans.spans] == ["1", '"x"', "null"]
    noted = frame(spark, [("fully erupted",), ("partial",), ("zzz",), (None,)], "v string").select(repair.coerce_noted(F.col("v"), "enum:fully_erupted|partially").alias("c"))
    assert [(r.c.value, r.c.note) for r in noted.collect()] == [("fully_erupted", "repaired"), ("partially", "repaired"), (None, "unreadable"), (None, None)]
    df = frame(spark, [('{"a": 1}',), ('{"a": 2',), (None,)], "t string")
    assert [r[0] for r in df.select(F.get_json_object(repair.parse(F.col("t")), "$.a")).collect()] == ["1", "2", None]
    keys = frame(spark, [("quality",), ("qualty",), ("zzz",), (None,)], "k string")
    assert [r[0] for r in keys.select(repair.closest_key(["quality", "lesion"])(F.col("k"))).collect()] == ["quality", "quality", None, None]
    assert repair.compile_spec("list[int] -- positions") == "array<int>" and repair.enum_values("enum:a|b -- x") == ["a", "b"]
    with pytest.raises(ValueError):
        repair.compile_spec("date")
    got = frame(spark, [("yes", "7", "[11, 12.5, x]", "Comp")], "b string, i string, l string, e string").select(repair.coerce(F.col("b"), "bool"), repair.coerce(F.col("i"), "int"), repair.coerce(F.col("l"), "list[int]"), repair.coerce(F.col("e"), "enum:complete|none")).first()
    assert tuple(got) == (True, 7, [11], "complete")


def summary(spark, **changes):
    base = dict(case_id="A1", absent=[31], f_absent=None, f_maxilla=None, impacted=[38, 35], endodontic=[36, 37], fillings=[34], s_endodontic=None, s_fillings=None, implants=[(36, True)], f_implants=None, bridges=[1], f_bridges=None, canal_votes=None, canal=None, atrophy=None, condyle="fully_included", f_condyles=None, level="partial", pattern="scatter")
    schema = "case_id string, absent array<int>, f_absent array<int>, f_maxilla string, impacted array<int>, endodontic array<int>, fillings array<int>, s_endodontic array<int>, s_fillings array<int>, implants array<struct<fdi:int,crown:boolean>>, f_implants array<int>, bridges array<int>, f_bridges array<int>, canal_votes array<string>, canal string, atrophy boolean, condyle string, f_condyles string, level string, pattern string"
    return spark.createDataFrame([tuple((base | changes).values())], schema)


def test_rules(spark):
    silent = rules.apply(summary(spark)).head()
    assert silent.absent == [31] and silent.impacted == [38] and [tuple(i) for i in silent.implants] == [(36, True)] and silent.bridges == [1] and silent.canal is None
    told = rules.apply(summary(spark, f_absent=[36, 11, 36], f_maxilla="excluded", f_implants=[36, 46], f_bridges=[], canal_votes=["buccal", None, "buccal"], f_condyles="excluded")).head()
    assert told.absent == [36] and told.endodontic == [37] and told.bridges == [] and told.canal == "buccal" and told.condyle == "not_included"
    assert [tuple(i) for i in told.implants] == [(36, True), (46, None)]
    assert rules.apply(summary(spark, f_implants=[])).head().implants and rules.apply(summary(spark, canal_votes=["lingual", "buccal"])).head().canal == "lingual"
    off = rules.apply(summary(spark, f_absent=[36]), rules.configured({"rules": {"gate": False}})).head()
    assert off.endodontic == [36, 37]
    with pytest.raises(KeyError):
        rules.configured({"gates": True})
    with pytest.raises(TypeError):
        rules.configured({"gate": "yes"})
    assert [one(spark, rules.maxilla_scope(F.lit(a).cast("string"), F.lit(b).cast("boolean"), F.lit(c).cast("string"))) for a, b, c in (("excluded", True, None), (None, True, "not_included"), (None, None, None))] == ["none", "complete", "partial"]


def test_report(spark):
    got = report.mandible(rules.apply(summary(spark, endodontic=[], fillings=[34, 35, 36], canal_votes=["lingual"]))).head().report
    assert got == "Mandible is partially included in the scan volume. Right mandibular canal with a regular course, predominantly lingual. Absence of tooth 31. Tooth 38 is impacted. Conservative composite restorations on teeth 34, 35, and 36. Condyles included in the scan volume."
    assert one(spark, report.scope("maxilla", F.lit("none"))) == "Maxilla is not included in the scan volume and not assessable."
    gone = report.mandible(rules.apply(summary(spark, f_absent=[*range(31, 39), *range(41, 49)]))).head().report
    assert gone.startswith("Mandible is partially included in the scan volume. Complete mandibular edentulism. Marked atrophy of the alveolar processes.")
    for half in (range(31, 39), range(41, 49)):  # one quadrant is half of the mandible
        some = rules.apply(summary(spark, f_absent=list(half)))
        assert "edentulism" not in report.mandible(some).head().report and not some.head().atrophy
    assert rules.apply(summary(spark, f_absent=[*range(11, 19), *range(21, 29)])).select("atrophy", "atrophy_maxilla").head() == (False, True)


def test_dimensions(spark):
    assert dims.positions(spark).count() == 32 and dims.between(46, 43) == [46, 45, 44, 43] and dims.between(42, 32) == [42, 41, 31, 32] and dims.between(18, 48) == []


def test_audit(spark):
    rows = frame(spark, [(1, 5, False), (2, 50, False), (3, 60, True)], "id int, v int, m boolean")
    found = audit.findings([audit.screen(rows, "high", audit.ERROR, F.col("v") > 40, "id", F.lit("high"), masked=F.col("m")), audit.orphans(rows, rows.limit(2), "id", "id", "orphan", audit.NOTE)])
    assert {r.key for r in audit.error_cases(found).collect()} == {"2"}
    with pytest.raises(ValueError):
        audit.gate(found)
    audit.gate(found.filter("level = 'NOTE'"))


def test_volumes(spark):
    few = frame(spark, [(1, float(i)) for i in range(60)] + [(2, 1.0)], "l int, v double")
    assert volumes.robust_ceiling(few, "l", "v").head().n_labels == 1
    assert volumes.percentile_window(few.limit(0), "v", 0.1, 0.9).head().low is None
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 2.5), [1e6]])
    many = spark.createDataFrame([(float(v),) for v in values], "v double")
    for bins, bound in ((4096, 1_000_000), (7, 20)):  # bins cut again
        assert volumes.exact_percentiles(many, "v", [0, 0.013, 0.5, 0.98, 1], bins, bound) == pytest.approx(np.percentile(values, [0, 1.3, 50, 98, 100]).tolist(), rel=1e-12)
    labelled = [(t, float(v)) for t in range(3) for v in rng.normal(100 + t, 1, 80)]
    three = frame(spark, labelled, "l int, v double")
    low = min(np.percentile([v for t, v in labelled if t == k], 98) for k in range(3))
    assert volumes.robust_ceiling(three, "l", "v").head().ceiling == pytest.approx(1.15 * low, abs=1e-5)  # headroom with few labels too
    bone = frame(spark, [(None, 10.0)] * 300, "l int, v double")
    assert volumes.robust_ceiling(three.unionAll(bone), "l", "v", bone=F.col("l").isNull()).head().ceiling == 25.0
    assert volumes.robust_ceiling(bone, "l", "v", bone=F.col("l").isNull()).head().ceiling == 16.0
    assert one(spark, volumes.superior_axis(tuple(map(F.lit, (0, 5, 1))), tuple(map(F.lit, (0, 1, 9))))) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for name in ("A1.txt", "A1_2.txt", "B2_1.txt", "B2_2.txt"):
        (tmp_path / "r" / name).write_text(f"text of {name}")
    found = readers.reports(spark, str(tmp_path / "r"))
    assert {(r.case_id, r.reader) for r in readers.reference_reports(found).collect()} == {("A1", None), ("B2", "1"), ("B2", "2")}
    assert {(r.case_id, r.reader) for r in readers.first_reader(found).collect()} == {("A1", None), ("B2", "1")}
    (tmp_path / "l.jsonl").write_text('{"k": "a", "n": 1}\n\nbroken\n{"k": "a", "n": 2}\n')
    lines = readers.json_lines(spark, str(tmp_path / "l.jsonl"), "k string, n int")
    assert [tuple(r) for r in readers.latest(lines, ["k"], "n").collect()] == [("a", 2)]
    (tmp_path / "cases.txt").write_text("A1\n# no\n\n B2 # yes\n")
    assert [r.case_id for r in readers.case_list(spark, str(tmp_path / "cases.txt")).collect()] == ["A1", "B2"]
    at = readers.new_run(lines, str(tmp_path / "out"), "1")
    assert spark.read.parquet(at).count() == 2
    assert readers.pending(found, frame(spark, [("A1",)], "case_id string"), "case_id").count() == 2
    readers.per_case(frame(spark, [("A1", 1)], "case_id string, n int"), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).head().value == '{"n":1}'
    with pytest.raises(ValueError):
        readers.pinned(spark, str(tmp_path / "cases.txt"), "00")
    images = tmp_path / "img"
    images.mkdir()
    (images / "A1_panoramic.png").write_bytes(b"x")
    (images / "note.txt").write_bytes(b"x")
    assert [(r.case_id, r.image_key) for r in readers.images(spark, str(images)).collect()] == [("A1", "panoramic")]
    parts = [frame(spark, [("A1", "a", "1"), ("A1", "b", "1")], "case_id string, key string, value string"), frame(spark, [("A1", "b", "2")], "case_id string, key string, value string")]
    assert readers.sidecars(parts).head().entries == {"a": "1", "b": "2"}
    old = frame(spark, [("A1", "x"), ("B2", "y")], "case_id string, t string")
    assert [r.case_id for r in readers.changed(frame(spark, [("A1", "x"), ("B2", "z")], "case_id string, t string"), old, ["case_id"], "t").collect()] == ["B2"]


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(i, f"u{i % 3}", float(i), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, k string, v double, ts timestamp")
    source, out = str(tmp_path / "src"), str(tmp_path / "out")
    sink = incremental.append_partials(out, ["k"], "v")
    for part in (df.filter("id < 20"), df.filter("id >= 20")):  # a second call takes only what is new
        part.coalesce(1).write.mode("append").parquet(source)
        incremental.catch_up(spark, source, df.schema, str(tmp_path / "cp"), sink)
    got = incremental.rolled_up(spark.read.parquet(out), ["k"])
    assert {(r.k, r.n, r.cents) for r in got.collect()} == {(r.k, r.n, r.cents) for r in incremental.partial_counts(df, ["k"], "v").collect()}
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = incremental.windowed(stream, "ts", "10 minutes", "5 minutes", ["k"]).writeStream.outputMode("complete").format("memory").queryName("w").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 30


def ints(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")


def test_ladders(spark):
    s = lambda x: F.lit(x).cast("string")
    b = lambda x: F.lit(x).cast("boolean")
    rank = ("absent", "impacted", "filling", "caries")
    assert [one(spark, verdicts.ranked_verdict(s(v), "filling", rank)) for v in ("filling", "impacted", "caries", "normal", None, "unreadable")] == ["agree", "abstain", "deny", "deny", "abstain", "abstain"]
    assert [one(spark, verdicts.enum_verdict(s(v), "a", ("skip",))) for v in ("a", "b", "skip", "", None)] == ["agree", "deny", "abstain", "abstain", "abstain"]
    assert [one(spark, verdicts.bool_verdict(b(v))) for v in (True, False, None)] == ["agree", "deny", "abstain"]
    assert [one(spark, verdicts.exclusive_verdict(s(v), "caries", ("normal", "filling"))) for v in ("caries", "filling", "impacted", None)] == ["agree", "deny", "abstain", "abstain"]
    assert [one(spark, verdicts.first_flag([(b(x), "post"), (b(y), "crown")])) for x, y in ((True, True), (None, True), (False, None), (None, None))] == ["post", "crown", "none", None]
    cases = [((), "none"), (range(31, 39), "quadrant_edentulous_one"), ((*range(31, 39), 41), "quadrant_edentulous_one_plus_partial"), ((*range(31, 39), *range(41, 49)), "quadrant_edentulous_both"), ((*range(32, 39), *range(42, 49)), "nearly_edentulous"), ((34, 35), "consecutive_run"), ((34, 36), "scatter"), ((11,), "none")]
    for positions, want in cases:
        assert one(spark, verdicts.absent_pattern("mandible", ints(*positions), F.lit(True))) == want
    assert one(spark, verdicts.absent_pattern("mandible", ints(34), F.lit(False))) == "unknown"
    assert [one(spark, verdicts.dentition(*map(F.lit, c))) for c in ((0, 0, 0), (3, 0, 0), (3, 3, 4), (2, 3, 4))] == ["edentulous", "primary", "mixed", "permanent"]


def test_presence_of_positions(spark):
    none, silent = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    read = lambda p, a, m, i, e=silent, c=none: one(spark, verdicts.presence("mandible", ints(*p), ints(*a), ints(*m), ints(*i), e, c))
    got = read((31, 33), (32, 36, 37), (36,), (46,), c=F.lit("absent"))
    assert got.absent == [46, 32, 37] and 36 in got.present and len(got.present) == 13 and got.unstated == []
    assert len(read((31,), (), (), ()).absent) == 15 and len(read((31,), (32,), (), ()).unstated) == 14
    assert len(read((), (), (), (), F.lit(True)).absent) == 16 and read((), (), (33,), (), F.lit(True)).present == [33]
    assert one(spark, verdicts.longest_missing_run("mandible", ints(41, 31, 32, 45))) == 3 and one(spark, verdicts.atrophic("mandible", ints(41, 31), silent)) is False
    assert one(spark, verdicts.pontics(ints(44, 45, 46), ints(44), ints(45), ints(44, 46), ints(47))) == [45, 47]
    assert one(spark, verdicts.stated(F.lit(False), F.lit(True))) is None and one(spark, verdicts.stated(F.lit(True), F.lit(True))) is True


def test_more_sentences(spark):
    entries = F.array(*(F.struct(F.lit(f).cast("int").alias("fdi"), F.lit(c).alias("crown"), F.lit(s).cast("string").alias("status")) for f, c, s in ((45, True, "well"), (46, False, None), (47, True, "well"), (None, True, None))))
    assert one(spark, report.implants(entries)) == "Endosseous implants in position 45, 47, restored with an implant-supported crown, with radiographically well osseointegration. Endosseous implant in position 46."
    assert one(spark, report.bridge(F.lit(None).cast("int"), F.lit(3), ints(), ints(), ints())) == "Prosthetic bridge exists."
    assert one(spark, report.bridge(F.lit(44), F.lit(47), ints(44), ints(47), ints(45, 46))) == "Fixed prosthetic bridge from 44 to 47, with anchor abutment teeth on 44, and an implant in the 47 region, and pontics in the 45 and 46 regions."
    t, f = F.lit(True), F.lit(False)
    say = lambda r, l, rn, ln: one(spark, report.sinuses(verdicts.sinus_status(F.lit(r).cast("string"), F.lit(l).cast("string"), rn, ln), F.lit(r).cast("string"), F.lit(l).cast("string"), rn, ln))  # noqa: E731, E741
    assert say("fully_included", "partially_included", t, t) == "Maxillary sinuses are partially included in the acquisition volume, normally aerated."
    assert say(None, "not_included", t, t) == "Maxillary sinuses: not included in the acquisition volume and not assessable."
    assert say("fully_included", "fully_included", f, t) == "Maxillary sinuses are included in the acquisition volume. The maxillary sinus shows mild mucosal thickening on the right side."
    assert say("fully_included", None, t, t) == "Right maxillary sinus is included in the acquisition volume, normally aerated; the left maxillary sinus is not included in the acquisition volume and not assessable."
    assert one(spark, report.wisdom(F.lit("mixed"), ints(38, 48), ints(18))) == "Teeth 38 and 48 are unerupted. Tooth 18 is partially erupted." and one(spark, report.wisdom(F.lit("permanent"), ints(38), ints())) is None


def test_dimensions_beyond_their_bound(spark):
    from factloom.operators.containment import containing

    docs, items = frame(spark, [(1, "say abc"), (2, "xyz"), (3, None)], "id int, t string"), frame(spark, [("abc",), ("xy",), ("say",), (None,), ("",)], "p string")
    for bound in (100, 1):
        assert sorted(r.id for r in containing(docs, items, "id", "t", "p", bound).collect()) == [1, 2]
    centres = frame(spark, [(i, [float(i), 0.0]) for i in range(6)], "label int, centre array<double>")
    rows = frame(spark, [(1, [4.2, 0.0]), (2, [0.5, 1.0])], "id int, v array<double>")
    for bound in (100, 2):
        assert {r.id: r.nearest for r in volumes.nearest(rows, "id", "v", centres, "label", bound).collect()} == {1: 4, 2: 0}
