"""Arch rules, positional phrases, report audits and scores of all kinds on written-out cases."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import positional
from factloom.operators import arch_rules, expansion, metrics, report_audit
from factloom.plans.dims import SWEEP

SUMMARY = "case_id string, arch string, absent array<int>, present array<int>, unassessable array<int>, pattern string, impacted array<struct<tooth:int,impacted:string,source:string>>, endodontic array<int>, fillings array<int>, crown array<int>, implants array<struct<fdi:int,status:string,crown:boolean>>, bridge boolean, canal_right struct<location:string,adjacent:array<int>>, canal_left struct<location:string,adjacent:array<int>>, atrophy boolean, condyle_right string, condyle_left string, findings array<struct<tooth:int,finding:string>>, f_absent array<int>, f_maxilla string, f_condyles string, f_crowns array<int>, f_implants array<int>, f_bridge_arches array<string>, f_close array<int>, p_endo array<int>, p_fillings array<int>, p_eruption map<int,string>, p_slots array<struct<fdi:int,state:string,orientation:string>>, p_canal map<int,string>"


def row(arch="mandible", **changes):
    base = dict(case_id="A1", arch=arch, absent=[31], present=None, unassessable=None, pattern="scatter", impacted=[], endodontic=[36], fillings=[], crown=[31, 47], implants=[(36, "well", True)], bridge=True, canal_right=("buccal", [47]), canal_left=("buccal", []), atrophy=None, condyle_right="fully_included", condyle_left=None, findings=[(36, "caries"), (41, "caries")], f_absent=None, f_maxilla=None, f_condyles=None, f_crowns=None, f_implants=None, f_bridge_arches=None, f_close=None, p_endo=None, p_fillings=None, p_eruption=None, p_slots=None, p_canal=None)
    return tuple((base | changes).values())


def one(spark, off=(), **changes):
    return arch_rules.apply(spark.createDataFrame([row(**changes)], SUMMARY), off).head()


def test_null_sources_change_nothing(spark):
    r = one(spark)
    assert (r.absent, r.present, r.endodontic, r.crown, r.bridge, r.atrophy, r.condyle_right) == ([31], None, [36], [31, 47], True, None, "fully_included")
    assert [i.fdi for i in r.implants] == [36] and [f.tooth for f in r.findings] == [36, 41]


def test_absent_positions_and_the_gate(spark):
    r = one(spark, f_absent=[36, 18, 55, 41], p_endo=[36, 37, 17], p_fillings=[46], f_crowns=[36, 45, 11])
    assert r.absent == [36, 41] and len(r.present) == 14
    assert (r.endodontic, r.fillings, r.crown) == ([37], [46], [45]) and r.findings == []
    assert [i.fdi for i in r.implants] == [36]  # exempt
    free = one(spark, off=("absent",), f_absent=[36], p_endo=[36])
    assert free.absent == [31] and free.endodontic == [36]
    upper = one(spark, arch="maxilla", f_absent=[11, 36], f_maxilla=" Excluded", p_endo=[11])
    assert upper.pattern == "unassessable" and len(upper.unassessable) == 16 and upper.present is None and upper.absent is None and upper.endodontic == [11]


@pytest.mark.parametrize("eruption, slots, want", [
    ({38: "Partially_Erupted"}, [(38, "fully_erupted", "normal")], [(38, "unspecified", "composite_eruption")]),
    ({38: "absent"}, [(38, "complete_bony_inclusion", "mesial")], []),
    (None, [(38, "fully_erupted", "Mesial"), (48, "complete_bony_inclusion", None)], [(38, "mesial", "3d_render"), (48, "unspecified", "3d_render")]),
    ({48: "fully_erupted"}, [(48, "complete_bony_inclusion", "normal")], []),
    (None, None, []),
])
def test_impaction(spark, eruption, slots, want):
    assert [tuple(i) for i in one(spark, p_eruption=eruption, p_slots=slots).impacted] == want


def test_the_other_rules(spark):
    r = one(spark, f_implants=[36, 46, 14], f_bridge_arches=["maxilla"], f_close=[48, 38, 47, 18], p_canal={46: "Lingual", 47: "buccal", 36: " buccal"}, f_condyles="excluded")
    assert [(i.fdi, i.status, i.crown) for i in r.implants] == [(36, "well", True), (46, None, None)]
    assert r.bridge is False and (r.canal_right.location, r.canal_right.adjacent) == ("lingual", [47, 48]) and (r.canal_left.location, r.canal_left.adjacent) == ("buccal", [38])
    assert r.condyle_right == "not_included" and r.condyle_left is None
    assert one(spark, f_bridge_arches=[]).bridge is False and one(spark, f_implants=[]).implants[0].fdi == 36
    assert one(spark, f_absent=SWEEP["mandible"]).atrophy is True and one(spark, f_absent=list(range(31, 39))).atrophy is None
    assert one(spark, atrophy=False).atrophy is True  # an entry at all says that a region is there


def test_positional_phrases(spark):
    said = {
        "the upper right third molar": {"maxilla": [18], "mandible": []}, "wisdom teeth of the 3rd quadrant": {"maxilla": [], "mandible": [38]}, "first and second molars on the left": {"maxilla": [26, 27], "mandible": [36, 37]},
        "both lower canines": {"maxilla": [], "mandible": [33, 43]}, "incisors": {"maxilla": [11, 12, 21, 22], "mandible": [31, 32, 41, 42]}, "second premolar, right and left mandibular": {"maxilla": [], "mandible": [35, 45]},
        "the fifth tooth of quadrant IV": {"maxilla": [], "mandible": [45]}, "nothing here": {"maxilla": [], "mandible": []},
    }
    df = spark.createDataFrame([(k,) for k in said], "t string").select("t", *(positional.positions_meant(F.col("t"), a).alias(a) for a in ("maxilla", "mandible")))
    assert {r.t: {"maxilla": r.maxilla, "mandible": r.mandible} for r in df.collect()} == said


def test_report_screens_and_repairs(spark):
    claims = spark.createDataFrame([
        ("A", "maxilla", "teeth_present", 16), ("A", "maxilla", "teeth_absent", 16), ("A", "maxilla", "sinus_right.intrasinusal_teeth", 26), ("A", "maxilla", "crowns", 46), ("A", "maxilla", "crowns", 14),
        ("A", "mandible", "canal_right.adjacent_teeth", 48), ("A", "mandible", "canal_right.adjacent_teeth", 38), ("A", "mandible", "canal_left.adjacent_teeth", 38), ("A", "mandible", "primary_teeth", 75), ("B", "mandible", "crowns", 36),
    ], "case_id string, arch string, field string, fdi int")
    reports = spark.createDataFrame([("A", "Teeth 17 to 14 are present. Tooth 1.6 is missing; crown on 14. The lower right third molar is in close relationship with the canal. Tooth 26 reaches the sinus."), ("B", None)], "case_id string, text string")
    found = {(r.field, r.fdi, r.screen, r.level) for r in report_audit.findings(claims, reports).collect()}
    assert found == {
        ("sinus_right.intrasinusal_teeth", 26, "laterality", "ERROR"), ("crowns", 46, "laterality", "ERROR"), ("crowns", 46, "not_in_text", "ERROR"), ("canal_right.adjacent_teeth", 48, "not_in_text", "NOTE"),
        ("canal_right.adjacent_teeth", 38, "laterality", "ERROR"), ("canal_right.adjacent_teeth", 38, "not_in_text", "ERROR"), ("canal_right.adjacent_teeth", 38, "canal_adjacency", "ERROR"), ("canal_left.adjacent_teeth", 38, "not_in_text", "ERROR"),
        ("canal_left.adjacent_teeth", 38, "canal_adjacency", "ERROR"), ("primary_teeth", 75, "not_in_text", "NOTE"), ("presence", 16, "contradiction", "NOTE"), ("crowns", 36, "not_in_text", "ERROR"),
        ("presence", 17, "arch_range", "ERROR"), ("presence", 15, "arch_range", "ERROR"), ("presence", 14, "arch_range", "ERROR"),
    }
    masked = spark.createDataFrame([("B", "mandible", "crowns", 36), ("A", "maxilla", "presence", 17)], claims.schema)
    levels = {(r.field, r.fdi): r.level for r in report_audit.findings(claims, reports, masked).collect()}
    assert levels["crowns", 36] == levels["presence", 17] == "NOTE"
    sided = report_audit.fix_laterality(claims)
    assert {(r.field, r.fdi) for r in sided.collect()} >= {("sinus_left.intrasinusal_teeth", 26), ("canal_left.adjacent_teeth", 38)} and sided.count() == 9
    kept = {(r.field, r.fdi) for r in report_audit.fix_unsupported(sided, reports).collect()}
    assert ("canal_left.adjacent_teeth", 38) not in kept and ("canal_right.adjacent_teeth", 48) in kept and ("crowns", 46) in kept
    added = {r.fdi for r in report_audit.fix_arch_range(claims, reports, masked).join(claims, report_audit.KEYS, "left_anti").collect()}
    assert added == {15, 14}
    assert report_audit.mask_unresolved(claims, spark.createDataFrame([("A", "maxilla", "presence", 16)], claims.schema)).count() == 8
    assert report_audit.findings(claims.limit(0), reports).count() == 0


def test_ranges_of_presence_and_of_findings(spark):
    texts = {
        "Prosthetic bridge 33-34-35-36 is presented.": {}, "Teeth from 34 to 37 in the arch.": {"teeth_present": {34, 35, 36, 37}}, "Teeth 3.4 UNTIL 3.6 are visible, 37 to 38 absent.": {"teeth_present": {34, 35, 36}},
        "Teeth 12 – 21 are present; missing teeth 41 to 42 are visible.": {"teeth_present": {12, 11, 21}}, "Crowns from 17 to 15. Root canal fillings of 46—45.": {"crowns": {17, 16, 15}, "endodontic": {46, 45}, "fillings": {46, 45}},
        "Teeth 38 to 28 are present.": {}, "": {}, None: {},
    }
    reports = spark.createDataFrame(list(enumerate(texts)), "case_id int, text string")
    got: dict = {}
    for r in report_audit.stated_ranges(reports).collect():
        got.setdefault(r.case_id, {}).setdefault(r.field, set()).add(r.fdi)
    assert [got.get(i, {}) for i in range(len(texts))] == list(texts.values())


def test_item_keys(spark):
    items = [{"fdi": "36", "note": "x"}, {"span_start": "37", "span_end": "35"}, {"span_start": "35", "span_end": "37"}, {"b": "2", "a": "1"}, {"position": "p"}]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in items], "m map<string,string>").select(metrics.item_key(F.col("m"))).collect()]
    assert got == ["36", "35-37", "35-37", "a=1|b=2", "p"]


def test_expansion(spark):
    rows = spark.createDataFrame([("A", "mandible", [36, 37], [31, 36], [37], [31], None, None, None, [46], [31], None, None)], "case_id string, arch string, teeth_present array<int>, teeth_absent array<int>, endodontic array<int>, post_and_core array<int>, crowns array<int>, fillings array<int>, caries array<int>, implants array<int>, root_remnants array<int>, edentulous boolean, atrophy_stated boolean")
    found = {(r.kind, r.fdi) for r in expansion.conflicts(rows).collect()}
    assert found == {("present_and_absent", 36), ("post_and_core_at_absent", 31), ("root_remnants_at_absent", 31)}
    teeth = {r.fdi: r for r in expansion.tooth_rows(rows).collect()}
    assert teeth[31].present and teeth[31].with_endo and teeth[31].is_remnant  # a finding outranks the stated absence
    assert teeth[46].present is False and teeth[46].with_endo is None and teeth[37].with_caries is False
