"""Surveys, nested documents, clean readings, tiles, table functions and stateful streams on written-out and random cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import tables, text
from factloom.operators import axes, nested, sanitise, tiles
from factloom.streaming import stateful


def shape(rnd, depth=0):
    kind = rnd.choice(["null", "num", "str", "bool"] + ["obj", "arr"] * (depth < 4))
    if kind == "obj":
        return {rnd.choice(["a", "b", 'q"t', "é", "a b"]): shape(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    if kind == "arr":
        return [shape(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {"null": None, "num": rnd.choice([0, -7, 12345678901, 2.5]), "str": rnd.choice(["", 'say "x"', "{}", "line\nbreak"]), "bool": rnd.random() < 0.5}[kind]


def leaves(x, path=()):
    if isinstance(x, dict) and x:
        return {k: v for n, y in x.items() for k, v in leaves(y, (*path, n)).items()}
    if isinstance(x, list) and x:
        return {k: v for i, y in enumerate(x) for k, v in leaves(y, (*path, i)).items()}
    return {path: x}


def documents(spark, rows):
    return spark.createDataFrame([(i, None if d is ... else json.dumps(d)) for i, d in rows], "id int, t string").select("id", F.parse_json("t").alias("d"))


def test_documents_walk_and_come_back(spark):
    rnd = random.Random(1)
    given = [(i, shape(rnd)) for i in range(60)] + [(100, {}), (101, []), (102, None), (103, ...)]
    walked = nested.walked(documents(spark, given), "id", "d")
    got = {}
    for r in walked.collect():
        got.setdefault(r.id, {})[tuple(s.name if s.name is not None else s["at"] for s in r.path)] = json.loads(r.value)
    assert got == {i: leaves(d) for i, d in given if d is not ...}
    back = {r.id: json.loads(r.document) for r in nested.rebuilt(walked, "id").collect()}
    assert back == {i: d for i, d in given if d is not ...}
    assert nested.rebuilt(nested.walked(documents(spark, given).limit(0), "id", "d"), "id").collect() == []


def test_two_readings_meet(spark):
    a = [(1, {"x": 1, "y": [1, 2], "z": {"k": None}}), (2, {"only": True})]
    b = [(1, {"x": 1, "y": [1, 3, 4], "z": 5}), (3, [1])]
    found = {(r.id, r.p): (r.agreed, r.differs) for r in nested.met(documents(spark, a), documents(spark, b), "id", "d").withColumn("p", nested.path_text(F.col("path"))).collect()}
    assert found == {
        (1, "x"): ("1", False), (1, "y[0]"): ("1", False), (1, "y[1]"): (None, True), (1, "y[2]"): (None, True), (1, "z.k"): (None, True), (1, "z"): (None, True), (2, "only"): (None, True), (3, "[0]"): (None, True),
    }
    back = {r.id: json.loads(r.document) for r in nested.agreed_documents(documents(spark, a), documents(spark, b), "id", "d").collect()}
    assert back == {1: {"x": 1, "y": [1, None, None], "z": {"k": None}}, 2: {"only": None}, 3: [None]}


def test_documents_are_not_kept_level_by_level(spark, monkeypatch):
    """Every level of every document was written out: nested_agreed took the disk on 1 GB."""
    kept = []
    monkeypatch.setattr(nested, "settled", lambda df: kept.append(df) or df)
    odd = {"a\\n": [1], "a\n": {"b\\": None}, "a\\\\n": [[]], "a": {}, "a b": [{"": "x"}, {".": 2}, {"[1": 3}] + [0] * 9, "": 1}
    given, other = [(1, odd), (2, [odd])], [(1, {**odd, "a": 1}), (2, [odd, 5])]
    walked = nested.walked(documents(spark, given), "id", "d")
    assert {r.id: json.loads(r.document) for r in nested.rebuilt(walked, "id").collect()} == dict(given)
    met = nested.met(documents(spark, given), documents(spark, other), "id", "d")
    paths = lambda df: {(r.id, tuple(s.name if s.name is not None else s["at"] for s in r.path)) for r in df.collect()}
    assert paths(met) == {(i, p) for i, d in given + other for p in leaves(d)} >= paths(walked)
    assert {r.id: json.loads(r.document) for r in nested.agreed_documents(documents(spark, given), documents(spark, other), "id", "d").collect()} == {1: {**odd, "a": None}, 2: [odd, None]}
    assert len(kept) == 0
    deep = [(1, [[[[[[[[[{"x": [1]}]]]]]]]]])]
    assert {r.id: json.loads(r.document) for r in nested.rebuilt(nested.walked(documents(spark, deep), "id", "d"), "id").collect()} == dict(deep) and len(kept) == 2


def test_axis_survey(spark):
    rows = [(c, "findings", "absent", "set", "arch", i, s, None) for c, s, items in ((1, "truth", "48 47"), (1, "prediction", "47 46"), (2, "summary", "11")) for i in items.split()]
    rows += [(1, "findings", "caries", "set", "arch", "11", "prediction", None)]
    rows += [(c, "prosthetics", "bridges", "flag", None, None, s, v) for c, s, v in ((1, "truth", "true"), (1, "prediction", "true"), (2, "truth", "false"), (2, "prediction", None), (2, "summary", "true"), (3, "prediction", "false"))]
    rows += [(1, "anatomy", "course", "value", u, None, s, v) for u, s, v in (("left", "truth", "high"), ("left", "prediction", "low"), ("right", "truth", "low"), ("right", "prediction", "low"), ("up", "prediction", "low"), ("down", "truth", "low"))]
    df = spark.createDataFrame(rows, "case_id int, section string, axis string, kind string, unit string, item string, source string, value string")
    got = {(r.axis or r.section, r.source): (r.n, r.tp, r.fp, r.fn, r.tn, r.scored, r.right, r.shown) for r in axes.axis_survey(df).collect()}
    assert got["absent", "prediction"] == (2, 1, 1, 1, 0, 0, 0, "0.50/0.50") and got["absent", "summary"] == (2, 0, 1, 2, 0, 0, 0, "0.00/0.00")
    assert got["caries", "prediction"] == (0, 0, 1, 0, 0, 0, 0, "  -  ")
    assert got["bridges", "prediction"] == (1, 1, 0, 0, 2, 0, 0, "1.00/1.00") and got["bridges", "summary"] == (1, 0, 1, 1, 1, 0, 0, "0.00/0.00")
    assert got["course", "prediction"] == (3, 0, 0, 0, 0, 2, 1, "0.50") and got["course", "summary"] == (3, 0, 0, 0, 0, 0, 0, "  -  ")
    assert got["findings", "prediction"] == (2, 1, 2, 1, 0, 0, 0, "0.33/0.50")


def test_readings_and_their_counts(spark):
    maps = [(1, "mandible", {"48": "Implant ", " 36": "capped", "18": "crown", "x": "crown", "4.8": "none", "39": "none", "31": None}), (1, "maxilla", {"11": "whatever"}), (2, "mandible", None), (2, "elsewhere", {"11": "crown"})]
    rows, seen = sanitise.arch_readings(spark.createDataFrame(maps, "id int, arch string, r map<string,string>"), ["id"], "arch", "r", ["implant", "crown", "none"], {"capped": "crown"}, "odd")
    assert sorted(map(tuple, rows.collect())) == [(1, "mandible", 31, "unreadable"), (1, "mandible", 36, "crown"), (1, "mandible", 48, "implant"), (1, "maxilla", 11, "unreadable")]
    assert seen.get == {"read": 9, "malformed": 3, "stray": 2, "unreadable": 2}
    facts = spark.createDataFrame([(1, "out", 5.0, "kept"), (2, None, 6.0, "kept")], "id int, scope string, bone double, other string")
    left, upper = sanitise.without_excluded(facts, rows, ["id"], F.col("scope") == "out", ["bone"])
    assert sorted(map(tuple, left.collect())) == [(1, "out", None, "kept"), (2, None, 6.0, "kept")] and {r.fdi for r in upper.collect()} == {31, 36, 48}
    twice = rows.unionByName(rows.withColumn("answer", F.lit("none")))
    once = sanitise.normalised(twice, ["id"])
    assert {(r.fdi, r.answer) for r in once.collect()} == {(31, "none"), (36, "crown"), (48, "implant"), (11, "none")}
    change = lambda df: {r.side: r.n for r in sanitise.changed_by(df, lambda r: sanitise.normalised(r, ["id"])).collect()}
    assert change(once) == {"gone": 0, "new": 0} and change(twice) == {"gone": 4, "new": 0}


def test_blended_tiles(spark):
    rnd = random.Random(2)
    given = [(rnd.choice("uv"), rnd.randrange(20), rnd.choice("abc"), rnd.random()) for _ in range(80)]
    weights = tiles.gaussian(5)
    assert weights[2] == 1.0 and weights == weights[::-1]
    got = {(r.u, r.at): (r.label, r.score) for r in tiles.blended_argmax(spark.createDataFrame(given, "u string, s int, label string, x double"), ["u"], "s", "label", "x", weights).collect()}
    sums = {}
    for u, s, label, x in given:
        for i, w in enumerate(weights):
            a = sums.setdefault((u, s + i), {}).setdefault(label, [0.0, 0.0])
            a[0] += x * w
            a[1] += w
    for k, by in sums.items():
        best = min(by, key=lambda c: (-round(by[c][0] / by[c][1], 9), c))
        assert got[k] == (best, pytest.approx(by[best][0] / by[best][1]))
    assert len(got) == len(sums)


def test_table_functions(spark):
    tables.register(spark)
    said = ["Tooth 4.8 is here. See e.d. 34; and e.g. this: done. ", "  ", None, "No end", "A.b. x. y", "17 to 27 and 3.4-37. Also 48 until 45."]
    df = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    rows = spark.sql("SELECT id, place, sentence FROM {df}, LATERAL sentence_rows(t)", df=df).collect()
    for r in df.select("id", text.sentences(F.col("t")).alias("s")).collect():
        assert [x.sentence for x in sorted(rows, key=lambda x: x.place) if x.id == r.id] == (r.s or [])
    found = spark.sql("SELECT id, first, last FROM {df}, LATERAL range_rows(t)", df=df).collect()
    assert sorted((r.first, r.last) for r in found) == [(17, 27), (34, 37), (48, 45)]


def test_state_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(3)
    every = spark.createDataFrame([(i, rnd.randrange(1_000_000), rnd.randrange(4), rnd.choice("xy"), float(rnd.randrange(100))) for i in range(60)], "event_id long, s long, user_id long, event_type string, value double")
    events = every.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    source, rows = str(tmp_path / "in"), events.collect()
    for part in (0, 1, 2, None):  # the last run finds nothing new
        if part is not None:
            events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        stateful.rolling(spark, source, events.schema, str(tmp_path / "state"), str(tmp_path / "out"))
    got = {r.user_id: (r.n, r.cents, r.last_id, r.last_type, r.n_late) for r in stateful.latest(spark, str(tmp_path / "out")).collect()}
    for u in range(4):
        own = [r for r in rows if r.user_id == u]
        top = max(own, key=lambda r: (r.ts, r.event_id))
        late = sum(any(o.event_id % 3 < r.event_id % 3 and o.ts > r.ts for o in own) for r in own)
        assert got[u] == (len(own), sum(int(r.value * 100) for r in own), top.event_id, top.event_type, late)
    assert len(got) == 4
