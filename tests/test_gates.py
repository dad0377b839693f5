"""Gates between sources on positions that show each rule."""

from pyspark.sql import functions as F

from factloom.operators import gates

FIELDS = "overview string, absent boolean, detected string, eruption string, is_remnant boolean, with_caries boolean, with_endo boolean, with_post_and_core boolean, with_full_crown boolean, with_fillings boolean, periapical boolean, filling_quality string, bone_lesion boolean, impacted boolean, orientation string, near_canal boolean, canal_location string"
ON = gates.Gates(cross_validate=True, impaction=True, endodontic=True, fillings=True)


def readings(spark, rows):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    made = [("A", "mandible", fdi, *(said.get(n) for n in names)) for fdi, said in rows.items()]
    return spark.createDataFrame(made, f"case_id string, arch string, fdi int, {FIELDS}")


def lines(df):
    return {(r.fdi, r.finding): (r.kept, r.dropped, r.detail) for r in df.collect()}


def test_positions(spark):
    df = readings(spark, {
        31: {"with_caries": True, "overview": "normal"}, 32: {"with_caries": True, "with_post_and_core": True}, 33: {"with_caries": True, "overview": "root_canal_treatment"}, 34: {"with_caries": True, "is_remnant": True},
        35: {"with_endo": True, "overview": "post_and_core", "filling_quality": "good"}, 36: {"with_endo": True, "overview": "filling", "filling_quality": "good", "periapical": True}, 37: {"with_full_crown": True, "overview": "filling"},
        38: {"impacted": True, "orientation": "mesial", "overview": "normal"}, 48: {"impacted": True, "orientation": "normal", "overview": "impacted", "absent": True}, 45: {"overview": "impacted"}, 44: {"impacted": True}, 43: {"with_full_crown": True, "overview": "post_and_core"}, 42: {},
    })
    off, on = lines(gates.tooth_gates(df)), lines(gates.tooth_gates(df, ON))
    assert off[31, "caries"] == (True, True, None) and on[31, "caries"] == (False, True, None)
    assert on[32, "caries"] == (False, True, None) and on[33, "caries"] == (True, False, None) and (34, "caries") not in on
    assert on[35, "root_canal_treatment"] == (True, False, "good") and on[36, "root_canal_treatment"] == (False, True, None) and on[36, "periapical_lesion"] == (True, False, None)
    assert off[36, "root_canal_treatment"] == (True, True, "good")
    assert (37, "fillings") not in on and on[37, "crown"] == (True, False, None)
    assert on[38, "impacted"] == (False, True, "mesial") and off[38, "impacted"] == (True, True, "mesial")  # a tie is no majority
    assert on[48, "impacted"] == (True, True, "unspecified") and lines(gates.tooth_gates(df, gates.Gates(absent_is_not_impacted=True)))[48, "impacted"] == (False, True, "unspecified")
    assert on[45, "impacted"] == (True, False, "unspecified") and (44, "impacted") not in on
    assert on[43, "post_and_core"] == (True, False, None) and (43, "crown") not in on  # a post under a crown is a post
    assert not any(fdi == 42 for fdi, _ in off) and gates.tooth_gates(df.limit(0)).count() == 0
    silent = lines(gates.tooth_gates(df, gates.Gates(cross_validate=True, caries=False)))
    assert silent[31, "caries"] == (True, False, None)


def test_arches_and_sides(spark):
    df = readings(spark, {36: {"near_canal": False, "canal_location": "buccal"}, 37: {"near_canal": True, "canal_location": "lingual"}, 38: {"absent": True}, 46: {"canal_location": "buccal", "bone_lesion": True, "detected": "yes", "overview": "absent"}, 31: {"overview": "caries"}})
    canals = spark.createDataFrame([("A", "left", ["36", " 38 ", "x", "11"], "lingual"), ("A", "right", None, "regular"), ("B", "left", [], None)], "case_id string, side string, adjacent array<string>, location string")
    told = {(r.case_id, r.fdi): (r.kept, r.dropped) for r in gates.canal_contacts(canals, df, gates.Gates(cross_validate=True)).collect()}
    assert told == {("A", 36): (False, True), ("A", 37): (False, True)}  # 38 is claimed, but absent
    where = {(r.case_id, r.side): (r.location, r.source, r.other) for r in gates.canal_locations(canals, df).collect()}
    assert where == {("A", "left"): ("lingual", "3d_render", None), ("A", "right"): ("buccal", "composite", None), ("B", "left"): (None, None, None)}
    entries = spark.createDataFrame([("A", "mandible", 46, "x"), ("A", "mandible", 31, "y"), ("A", "mandible", None, "z"), ("A", "maxilla", 31, "w")], "case_id string, arch string, fdi int, note string")
    seen = {r.note: (r.evidence, r.kept) for r in gates.implants(entries, df, gates.Gates(cross_validate=True)).collect()}
    assert seen == {"x": ("segmented_tooth", False), "y": ("panoramic=caries", False), "z": (None, True), "w": (None, True)}
    facts = spark.createDataFrame([("A", "mandible", True, "radiopaque", " near 46 "), ("B", "mandible", True, "radiopaque", None), ("C", "mandible", True, "odd", None), ("D", "mandible", None, "radiopaque", None)], "case_id string, arch string, present boolean, type string, location string")
    bone = {r.case_id: (r.present, r.type, r.location, r.confirmed) for r in gates.bone(facts, df, gates.Gates(cross_validate=True)).collect()}
    assert bone == {"A": (True, "radiopaque", "near 46", True), "B": (True, None, None, False), "C": (True, None, None, None), "D": (False, None, None, None)}
    assert gates.bone(facts, df).filter(F.col("case_id") == "B").first().type == "radiopaque"
