"""Claims about positions held against the report they were read from: six screens, and the repairs that follow them.

Claims are rows (case_id, arch, field, fdi); a report is one row (case_id, text).  What a report says is worked out once for
each case, as arrays of positions, and met by one join with the claims of each arch, gathered in one aggregation (an arch has no more
claims than fields times positions); every screen is an expression on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.positional import positions_meant
from ..functions.text import named_positions, numbers_named, sentences, swept_by, swept_positions
from ..plans.dims import PRIMARY, SWEEP
from .audit import ERROR, NOTE

# fixed values: what fields hold, and words that state an absence, a contact, a sinus, a presence
SIDES = {"canal_right.adjacent_teeth": 4, "canal_left.adjacent_teeth": 3, "sinus_right.intrasinusal_teeth": 1, "sinus_left.intrasinusal_teeth": 2}
OTHER_SIDE = {"canal_right.adjacent_teeth": "canal_left.adjacent_teeth", "canal_left.adjacent_teeth": "canal_right.adjacent_teeth", "sinus_right.intrasinusal_teeth": "sinus_left.intrasinusal_teeth", "sinus_left.intrasinusal_teeth": "sinus_right.intrasinusal_teeth"}
DERIVED = ("teeth_present", "teeth_absent", "primary_teeth", "unerupted", "uncertain_teeth", "bridges")
FINDINGS = ("post_and_core", "crowns", "fillings", "caries", "root_fractures", "periapical_lesions")
ABSENCE = "(?i)absen|missing|edentul|extract|agenes|avuls"
CONTACT = "(?i)close relationship|relationship with|contiguity|continuity|continuous with|in contact|in relation|proximity|adjacen|contact with|abut|impinge|encroach|intimate"
SINUS = "(?i)sinus"
PRESENCE = "(?i)in the arch|are present|present in the arch|are visible|complete dentition"
FINDING_CLAUSES = {
    "crowns": "(?i)crown|prosthe|capsul|bridge|rehabilitat", "endodontic": "(?i)endodont|root canal|endocanal",
    "fillings": "(?i)filling|restorat|conservative|composite|amalgam", "caries": "(?i)cari|decay",
}
KEYS = ["case_id", "arch", "field", "fdi"]


def said(reports: DataFrame) -> DataFrame:
    """(case_id, named, contact, sinus, gone, swept): positions a report names, in which kind of sentence, and in ranges of presence."""
    parts = F.col("_s")
    of = lambda words: F.filter(parts, lambda s: s.rlike(words))

    def meant(chosen: Column, arches: tuple[str, ...]) -> Column:
        return F.array_distinct(F.flatten(F.transform(chosen, lambda s: F.concat(numbers_named(s), *(positions_meant(s, a) for a in arches)))))

    split = reports.select("case_id", "text", F.explode(F.array(sentences(F.col("text")))).alias("_s"))  # worked out once
    return split.select(
        "case_id",
        named_positions(F.col("text")).alias("named"),
        meant(of(CONTACT), ("mandible",)).alias("contact"),
        meant(of(SINUS), ("maxilla",)).alias("sinus"),
        meant(of(ABSENCE), ("mandible", "maxilla")).alias("gone"),
        swept_positions(F.col("text"), PRESENCE, ABSENCE).alias("swept"),
    )


def stated_ranges(reports: DataFrame) -> DataFrame:
    """(case_id, field, fdi): positions inside the ranges a report states for presence and for each kind of finding."""
    clauses = {"teeth_present": PRESENCE} | FINDING_CLAUSES
    fields = F.array(*map(F.lit, clauses))
    each = reports.select("case_id", F.posexplode(swept_by(F.col("text"), list(clauses.values()), ABSENCE)).alias("k", "fdis"))
    return each.select("case_id", F.get(fields, F.col("k")).alias("field"), F.explode("fdis").alias("fdi"))


def _has(array: str, fdi: Column) -> Column:
    return F.coalesce(F.array_contains(array, fdi), F.lit(False))


def _legal(fdi: Column) -> Column:
    in_arch = [(F.col("arch") == a) & fdi.isin(*SWEEP[a], *PRIMARY[a]) for a in SWEEP]
    return in_arch[0] | in_arch[1] | fdi.isin(*(p for own in PRIMARY.values() for p in own))


def _side(field: Column) -> Column:
    return F.coalesce(*(F.when(field == f, F.lit(q)) for f, q in SIDES.items()))


def _supported(field: Column, fdi: Column) -> Column:
    return F.when(field.startswith("canal"), _has("contact", fdi)).when(field.startswith("sinus"), _has("sinus", fdi))


def _finding(field: Column, fdi: Column, screen: str, level: Column) -> Column:
    return F.struct(field.alias("field"), fdi.alias("fdi"), F.lit(screen).alias("screen"), level.alias("level"))


def _of_claim(field: Column, fdi: Column) -> Column:
    """The findings of one claim, nulls where a screen passes it."""
    error, side, lower = F.lit(ERROR), _side(field), F.col("arch") == "mandible"
    derived = F.substring_index(field, ".", 1).isin(*DERIVED) | F.coalesce(_supported(field, fdi), F.lit(False))
    return F.array(
        F.when(side.isNotNull() & (lower == (side > 2)) & (F.floor(fdi / 10) != side), _finding(field, fdi, "laterality", error)),
        F.when(~_legal(fdi), _finding(field, fdi, "laterality", error)),  # a tooth of the other arch
        F.when(~_has("named", fdi), _finding(field, fdi, "not_in_text", F.when(derived, NOTE).otherwise(ERROR))),
        F.when(lower & field.startswith("canal") & ~_has("contact", fdi), _finding(field, fdi, "canal_adjacency", error)),
        F.when(~lower & field.startswith("sinus") & ~_has("sinus", fdi), _finding(field, fdi, "intrasinusal", error)),
        F.when(field.isin(*FINDINGS) & _has("_absent", fdi), _finding(field, fdi, "contradiction", F.lit(NOTE))),  # of a tooth called absent
    )


def findings(claims: DataFrame, reports: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(case_id, arch, field, fdi, screen, level) of all screens; a claim that is masked as unresolved is a note.

    Canals are looked at in the lower arch alone, sinuses in the upper one.  Positions inside a stated range of presence that no
    claim calls present are errors; ranges of findings are stated by ``stated_ranges`` but not screened, since a bridge's range
    holds positions without a crown.  Repeated claims count once; a case without a report has one that says nothing.
    """
    rows = claims.select(*KEYS, F.lit(False).alias("_m"))
    if masked is not None:
        rows = rows.unionByName(masked.select(*KEYS, F.lit(True).alias("_m")))
    claim = F.struct("field", "fdi")
    per = rows.groupBy("case_id", "arch").agg(F.collect_set(F.when(~F.col("_m"), claim)).alias("_claims"), F.collect_set(F.when(F.col("_m"), claim)).alias("_masked"))
    met = per.filter(F.size("_claims") > 0).join(said(reports), "case_id", "left")
    of = lambda name: F.transform(F.filter("_claims", lambda c: c["field"] == name), lambda c: c["fdi"])
    stated = met.withColumns({"_present": of("teeth_present"), "_absent": of("teeth_absent")})
    pair, own = F.lit("presence"), _of_arch_positions()
    # what a case says of one position: both present and absent, or nothing where its range of presence holds it
    of_arch = F.concat(
        F.transform(F.array_intersect("_present", "_absent"), lambda x: _finding(pair, x, "contradiction", F.when(_has("gone", x), NOTE).otherwise(ERROR))),
        F.transform(F.array_except(F.array_intersect(F.coalesce("swept", F.array().cast("array<int>")), own), "_present"), lambda x: _finding(pair, x, "arch_range", F.lit(ERROR))),
    )
    # a row for each claim and, as null, one for the arch: plain columns, no function over arrays of claims
    each = stated.withColumn("_c", F.explode(F.concat("_claims", F.array(F.lit(None).cast(dict(met.dtypes)["_claims"][6:-1])))))
    found = each.select("case_id", "arch", "_masked", F.explode(F.when(F.col("_c").isNull(), of_arch).otherwise(_of_claim(F.col("_c.field"), F.col("_c.fdi")))).alias("f")).filter("f IS NOT NULL")
    hidden = F.col("f.field").isNotNull() & F.col("f.fdi").isNotNull() & F.array_contains("_masked", F.struct(F.col("f.field"), F.col("f.fdi")))
    return found.select("case_id", "arch", "f.field", "f.fdi", "f.screen", F.when(hidden, NOTE).otherwise(F.col("f.level")).alias("level"))


def _of_arch_positions() -> Column:
    return F.when(F.col("arch") == "maxilla", F.array(*map(F.lit, SWEEP["maxilla"]))).otherwise(F.array(*map(F.lit, SWEEP["mandible"])))


def _of_own_arch() -> Column:
    return F.when(F.col("arch") == "maxilla", F.col("fdi").isin(*SWEEP["maxilla"])).otherwise(F.col("fdi").isin(*SWEEP["mandible"]))


def fix_laterality(claims: DataFrame) -> DataFrame:
    """Claims on the wrong side move to the other one, where they count once; positions of another arch are left for review."""
    side = _side(F.col("field"))
    wrong = side.isNotNull() & (F.floor(F.col("fdi") / 10) != side) & _of_own_arch()
    other = F.coalesce(*(F.when(F.col("field") == f, F.lit(o)) for f, o in OTHER_SIDE.items()))
    return claims.withColumn("field", F.when(wrong, other).otherwise(F.col("field"))).dropDuplicates(KEYS)


def fix_unsupported(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Contacts with a canal or a sinus that no sentence states go."""
    met = claims.join(said(reports).select("case_id", "contact", "sinus"), "case_id", "left")
    return met.filter(F.coalesce(_supported(F.col("field"), F.col("fdi")), F.lit(True))).select(claims.columns)


def fix_arch_range(claims: DataFrame, reports: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """Positions inside a stated range of present teeth are added, unless they are called absent or unresolved."""
    arches = claims.select("case_id", "arch").distinct()
    swept = reports.select("case_id", F.explode(swept_positions(F.col("text"), PRESENCE, ABSENCE)).alias("fdi")).join(arches, "case_id").filter(_of_own_arch())
    stands = claims.filter("field IN ('teeth_present', 'teeth_absent')").select("case_id", "arch", "fdi")
    if unresolved is not None:
        stands = stands.unionByName(unresolved.filter("field = 'presence'").select("case_id", "arch", "fdi"))
    added = swept.join(stands, ["case_id", "arch", "fdi"], "left_anti").select("case_id", "arch", F.lit("teeth_present").alias("field"), "fdi")
    return claims.select(*KEYS).unionByName(added)


def mask_unresolved(claims: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The claims without those that are unresolved; an unresolved presence takes both readings with it."""
    flat = unresolved.select(*KEYS)
    both = [flat.filter("field = 'presence'").withColumn("field", F.lit(f)) for f in ("teeth_present", "teeth_absent")]
    gone = flat.filter("field <> 'presence'").unionByName(both[0]).unionByName(both[1]).distinct()
    return claims.join(gone, KEYS, "left_anti")
