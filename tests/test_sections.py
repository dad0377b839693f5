"""Blocks of sections on facts that show each rule."""

from pyspark.sql import functions as F

from factloom.operators import sections

SINUS = "struct<scope:string,mucosa_state:string,sinus_content:string,intrasinusal_teeth:array<int>>"


def test_scopes(spark):
    rows = [("fully_included", "fully_included"), ("fully_included", None), ("not_included", "fully_included"), (None, " "), ("partially_included", "odd"), ("odd", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r string, l string")
    m = sections.mandible_scope(F.col("r"), F.col("l"))
    got = [tuple(r) for r in df.select(m["level"], sections.condyles(F.col("r"), F.col("l")), sections.consistent(F.lit("fully_included"), [F.col("r"), F.col("l")])).collect()]
    assert got == [
        ("complete", "included", "fully_included"), ("complete", "included", "fully_included"), ("partial", "not_included", "partially_included"),
        ("partial", "unknown", "fully_included"), ("partial", "included", "partially_included"), ("partial", "unknown", "partially_included"),
    ]
    levels = spark.createDataFrame([("fully_included",), ("not_included",), ("included",), (None,)], "s string").select(sections.scope_level(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["complete", "none", "partial", "partial"]


def test_sinuses(spark):
    normal, thick, out = (None, None, None, None), ("fully_included", "thickened", "air", [17, 16]), ("not_included", None, None, [26])
    df = spark.createDataFrame([(0, normal, normal), (1, thick, normal), (2, thick, out), (3, None, None), (4, None, normal), (5, out, out)], f"i int, r {SINUS}, l {SINUS}")
    group, roots = sections.sinus_group(F.col("r"), F.col("l")), sections.intrasinusal(F.col("r"), F.col("l"))
    got = {r[0]: tuple(r)[1:] for r in df.select("i", group["status"], group["scope_right"], group["source"], roots["teeth"], roots["state_negative"]).collect()}
    assert got == {
        0: ("all_normal", "unknown", None, [], True), 1: ("mixed", "fully_included", None, [16, 17], False), 2: ("right_only", "fully_included", None, [16, 17, 26], False),
        3: ("none_included", "not_included", "inferred_from_missing_fact", [], True), 4: ("all_normal", "unknown", None, [], True), 5: ("none_included", "not_included", None, [26], False),
    }


def test_remnants(spark):
    rows = [("A", "mandible", 31, True, "severe", True), ("A", "mandible", 32, True, "none", None), ("A", "mandible", 33, None, None, True), ("A", "mandible", 34, False, None, False), ("B", "maxilla", 11, None, None, None)]
    df = spark.createDataFrame(rows, "case_id string, arch string, fdi int, is_remnant boolean, bone_loss string, absent boolean")
    got = {r.case_id: (r.remnants and [tuple(x) for x in r.remnants], r.toothless) for r in sections.remnants(df.unionByName(df)).collect()}
    assert got == {"A": ([(31, True), (32, False)], [33]), "B": (None, [])}
    assert sections.remnants(df.limit(0)).count() == 0
