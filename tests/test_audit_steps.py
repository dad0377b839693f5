"""Ranges of several clauses read in one go, and sentences that name no tooth left early."""

from pyspark.sql import functions as F

from factloom.functions import positional, text

PRESENT, CROWNS, GONE = "(?i)are present", "(?i)crown", "(?i)absen"


def test_clauses_share_one_reading(spark):
    said = ["Teeth from 4.8 to 46 are present, 31 to 33 absent. Crowns of 11 – 13; crowns 24 to 34.", "Bridge 33-35-36 are present.", None, "19 to 21 are present."]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    both = df.select("i", text.swept_by(F.col("s"), [PRESENT, CROWNS], GONE).alias("x")).orderBy("i").collect()
    assert [r.x for r in both] == [[[46, 47, 48], [11, 12, 13]], [[], []], [[], []], [[], []]]
    one = df.select("i", text.swept_positions(F.col("s"), PRESENT, GONE).alias("x")).orderBy("i").collect()
    assert [r.x for r in one] == [r.x[0] for r in both]


def test_every_word_for_a_tooth_is_looked_at(spark):
    said = ["The BICUSPIDS on the left.", "Third left tooth, 3rd element.", "Upper right wisdom", "Close to the root of tooth 34.", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    rows = df.select("i", positional._names_teeth(F.col("s")).alias("n"), positional.kinds_named(F.col("s")).alias("k"), positional.positions_meant(F.col("s"), "maxilla").alias("p")).orderBy("i").collect()
    assert [r.n for r in rows] == [True, True, True, False, None]
    assert [bool(r.k) for r in rows[:4]] == [True, True, True, False] and rows[3].p == []
