"""Report sentences as columns: each is null when there is nothing to say; a report joins what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_list, plural
from .dims import SWEEP

LEVEL = (("complete", "completely"), ("none", "not"))


def scope(arch: str, level: Column) -> Column:
    """Fixed wording: "{Arch} is completely | not | partially included in the scan volume."; no maxilla is said to be not assessable."""
    word = F.when(level == "complete", "completely").when(level == "none", "not").otherwise("partially")
    plain = F.concat(F.lit(f"{arch.capitalize()} is "), word, F.lit(" included in the scan volume."))
    return F.when(level == "none", "Maxilla is not included in the scan volume and not assessable.").otherwise(plain) if arch == "maxilla" else plain


def about(lead: str, items: Column, tail: str = ".", word: str = "tooth", many: str = "teeth") -> Column:
    """"{lead} tooth 38." / "{lead} teeth 38 and 48."; null without items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(lead), F.when(F.size(items) == 1, word).otherwise(many), F.lit(" "), join_list(items), F.lit(tail)))


def preamble(dentition: Column) -> Column:
    return F.when(dentition == "mixed", "Pediatric patient with incomplete eruption of the permanent teeth.").when(dentition == "primary", "Full primary dentition, permanent teeth unerupted.")


def absent(pattern: Column, items: Column, atrophy: Column, ends: tuple[int, int]) -> Column:
    some = F.concat(F.lit("Absence of "), F.when(F.size(items) == 1, "tooth ").otherwise("teeth "), join_list(items), F.when(atrophy, ", with associated bone atrophy").otherwise(""), F.lit("."))
    return F.when(pattern == "none", f"Teeth from {ends[0]} to {ends[1]} are present in the arch.").when(pattern.isin("unknown", "unassessable") | (F.size(items) == 0), None).otherwise(some)


def edentulism(arch: str, all_absent: Column, marked: Column) -> Column:
    adj = {"mandible": "mandibular", "maxilla": "maxillary"}[arch]
    return F.when(all_absent, F.concat(F.lit(f"Complete {adj} edentulism."), F.when(marked, " Marked atrophy of the alveolar processes.").otherwise("")))


def canal(side: str, location: Column, near: Column) -> Column:
    close = F.when(F.size(near) > 0, F.concat(F.lit(", with close relationship with the "), F.when(F.size(near) == 1, "root of tooth ").otherwise("roots of teeth "), join_list(near))).otherwise("")
    return F.when(location.isNotNull(), F.concat(F.lit(f"{side.capitalize()} mandibular canal with a regular course, predominantly "), location, close, F.lit(".")))


def impacted(items: Column) -> Column:
    one, many = F.concat(F.lit("Tooth "), join_list(items), F.lit(" is impacted.")), F.concat(F.lit("Teeth "), join_list(items), F.lit(" are impacted."))
    return F.when(F.size(items) == 1, one).when(F.size(items) > 1, many)


def primary(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("Still present are the deciduous teeth "), join_list(items), F.lit(".")))


def endodontic(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("Endodontic treatment involving teeth "), join_list(items), F.lit(".")))


def fillings(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit("Conservative composite "), plural("restoration", items), F.when(F.size(items) == 1, " on tooth ").otherwise(" on teeth "), join_list(items), F.lit(".")))


def bone(present: Column) -> Column:
    return F.when(~present, "No definite osteolytic or osteocondensing lesions.")


def condyles(scopes: Column) -> Column:
    """Any excluded one excludes both; silent only if all are unknown."""
    known = F.filter(scopes, lambda s: s.isNotNull() & (s != "unknown"))
    return F.when(F.exists(known, lambda s: s == "not_included"), "Condyles not included in the scan volume.").when(F.size(known) > 0, "Condyles included in the scan volume.")


def wisdom(dentition: Column, unerupted: Column, partial: Column) -> Column:
    """Eruption of wisdom teeth, in mixed dentitions only; one sentence for each state."""
    lead = lambda items: F.concat(F.when(F.size(items) == 1, "Tooth ").otherwise("Teeth "), join_list(items), F.when(F.size(items) == 1, " is ").otherwise(" are "))
    parts = [F.when(F.size(items) > 0, F.concat(lead(items), F.lit(f"{word}."))) for items, word in ((unerupted, "unerupted"), (partial, "partially erupted"))]
    return F.when((dentition == "mixed") & (F.size(unerupted) + F.size(partial) > 0), assembled(*parts))


def implants(entries: Column) -> Column:
    """One sentence for each set of clauses, in order of its first implant; entries: array of (fdi, crown, status)."""
    clause = lambda e: F.concat(
        F.when(e["crown"], ", restored with an implant-supported crown").otherwise(""),
        F.when(e["status"] == "poor", ", with signs of peri-implant bone resorption").when(e["status"] == "well", ", with radiographically well osseointegration").otherwise(""),
    )
    placed = F.filter(entries, lambda e: e["fdi"].isNotNull())
    kinds = F.array_distinct(F.transform(placed, clause))

    def sentence(kind: Column) -> Column:
        own = F.transform(F.filter(placed, lambda e: clause(e) == kind), lambda e: e["fdi"].cast("string"))
        return F.concat(F.when(F.size(own) == 1, "Endosseous implant in position ").otherwise("Endosseous implants in position "), F.array_join(own, ", "), kind, F.lit("."))

    return F.when(F.size(placed) > 0, F.array_join(F.transform(kinds, sentence), " "))


def bridge(start: Column, end: Column, abutments: Column, implants_: Column, pontics: Column) -> Column:
    """A bridge without a span only exists; one with a span tells what carries it."""
    some = lambda items, one, many: F.when(F.size(items) > 0, F.concat(F.when(F.size(items) == 1, f"{one} in the ").otherwise(f"{many} in the "), join_list(items), F.when(F.size(items) == 1, " region").otherwise(" regions")))
    anchors = F.when(F.size(abutments) > 0, F.concat(F.lit("anchor abutment teeth on "), join_list(abutments)))
    carried = F.concat_ws(", and ", anchors, some(implants_, "an implant", "implants"), some(pontics, "a pontic", "pontics"))
    whole = F.concat(F.lit("Fixed prosthetic bridge from "), start.cast("string"), F.lit(" to "), end.cast("string"), F.when(carried != "", F.concat(F.lit(", with "), carried)).otherwise(""), F.lit("."))
    return F.when(start.isNull() | end.isNull(), "Prosthetic bridge exists.").otherwise(whole)


def sinuses(status: Column, right: Column, left: Column, right_normal: Column, left_normal: Column) -> Column:
    """Both sinuses: scope is always told, normal content with it, thickening in a sentence of its own."""
    inside = "in the acquisition volume"
    known = lambda s: s.isin("fully_included", "partially_included")
    word = lambda s: F.when(s == "fully_included", "included").when(s == "partially_included", "partially included")
    any_known = known(F.coalesce(right, F.lit(""))) | known(F.coalesce(left, F.lit("")))
    partly = (F.coalesce(right, F.lit("")) == "partially_included") | (F.coalesce(left, F.lit("")) == "partially_included")
    scope_ = F.when(any_known, F.concat(F.lit("Maxillary sinuses are "), F.when(partly, "partially included").otherwise("included"), F.lit(f" {inside}")))
    normal = F.coalesce(F.concat(scope_, F.lit(", normally aerated.")), F.lit("The maxillary sinuses appear normally pneumatized and clear, with no evidence of mucosal thickening or signs of sinusopathy."))
    thick = F.when(~right_normal & ~left_normal, "The maxillary sinuses show bilateral mucosal thickening.").when(~right_normal, "The maxillary sinus shows mild mucosal thickening on the right side.").when(~left_normal, "The maxillary sinus shows mild mucosal thickening on the left side.")

    def one(side: str, other: str, own: Column, fine: Column) -> Column:
        lead = F.concat_ws(" ", F.lit(f"{side.capitalize()} maxillary sinus"), F.concat(F.lit("is "), word(own), F.lit(f" {inside}")))
        out = F.lit(f"; the {other} maxillary sinus is not included {inside} and not assessable.")
        return F.when(fine, F.concat(lead, F.lit(", normally aerated"), out)).otherwise(F.concat(lead, out, F.lit(f" The {side} maxillary sinus shows mild mucosal thickening.")))

    return (
        F.when(status == "none_included", "Maxillary sinuses: not included in the acquisition volume and not assessable.").when(status == "all_normal", normal)
        .when(status == "mixed", assembled(F.concat(scope_, F.lit(".")), thick)).when(status == "right_only", one("right", "left", right, right_normal)).when(status == "left_only", one("left", "right", left, left_normal))
    )


def assembled(*parts: Column) -> Column:
    """The sentences there are, in order, with a blank between."""
    return F.concat_ws(" ", F.array_compact(F.array(*parts)))


def mandible(df: DataFrame) -> DataFrame:
    """(case_id, report) of summaries with the columns the rule engine leaves."""
    lower = F.filter(F.coalesce("absent", F.array().cast("array<int>")), lambda x: x > 30)
    gone = F.size(F.array_except(F.array(*map(F.lit, SWEEP["mandible"])), lower)) == 0
    parts = (
        scope("mandible", F.col("level")), edentulism("mandible", gone, F.coalesce("atrophy", F.lit(False))),
        canal("right", F.col("canal"), F.array().cast("array<int>")), F.when(~gone, absent(F.col("pattern"), lower, F.col("atrophy"), (48, 38))),
        impacted(F.col("impacted")), endodontic(F.col("endodontic")), fillings(F.col("fillings")), condyles(F.array("condyle")),
    )
    return df.select("case_id", assembled(*parts).alias("report"))


def lower_arch(df: DataFrame, level: Column, dentition: Column, primary_teeth: Column, bone_lesion: Column) -> DataFrame:
    """(case_id, report) of the mandible rows that the arch rules leave: all its sentences, in order."""
    gone = F.size(F.coalesce("absent", F.array().cast("array<int>"))) == 16
    atrophic = F.coalesce("atrophy", F.lit(False))
    side = lambda s: canal(s, F.col(f"canal_{s}")["location"], F.coalesce(F.col(f"canal_{s}")["adjacent"], F.array().cast("array<int>")))
    held = lambda state: F.transform(F.filter("wisdom", lambda w: w["state"] == state), lambda w: w["tooth"])
    parts = (
        scope("mandible", level), edentulism("mandible", gone, atrophic), side("right"), side("left"), F.when(~gone, absent(F.col("pattern"), F.col("absent"), atrophic, (48, 38))), primary(primary_teeth),
        impacted(F.transform("impacted", lambda i: i["tooth"])), wisdom(dentition, held("unerupted"), held("partially_erupted")) if "wisdom" in df.columns else F.lit(None), endodontic(F.col("endodontic")), fillings(F.col("fillings")),
        implants(F.col("implants")), F.when(F.col("bridge"), "Prosthetic bridge exists."), bone(bone_lesion), condyles(F.array("condyle_right", "condyle_left")),
    )
    return df.filter("arch = 'mandible'").select("case_id", assembled(*parts).alias("report"))


def maxilla(df: DataFrame) -> DataFrame:
    """(case_id, report) of upper-arch summaries; out of the volume, the scope is all there is to say."""
    parts = (
        scope("maxilla", F.col("level")), absent(F.col("pattern"), F.col("absent"), F.col("atrophy"), (18, 28)), impacted(F.col("impacted")), endodontic(F.col("endodontic")), fillings(F.col("fillings")),
        implants(F.col("implants")), sinuses(F.col("sinus_status"), F.col("sinus_right"), F.col("sinus_left"), F.col("right_normal"), F.col("left_normal")),
    )
    return df.select("case_id", F.when(F.col("level") == "none", parts[0]).otherwise(assembled(*parts)).alias("report"))
