"""Blocks of an arch's section of a summary: what is in the volume, sinuses, bone, remnants.

A fact is a struct, null if it was never answered; so is a field.  Blocks are structs, null where there is nothing to report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_meaningful
from ..functions.verdicts import sinus_status

# fixed values: how much of a structure the volume holds
FULL, PART, OUT = "fully_included", "partially_included", "not_included"


def _said(scope: Column) -> Column:
    return F.when(F.trim(scope) != "", F.trim(scope))


def scope_level(included: Column) -> Column:
    """``complete``, ``none``, and the weakest claim, ``partial``, for any other answer or none."""
    return F.when(included == FULL, "complete").when(included == OUT, "none").otherwise("partial")


def mandible_scope(right: Column, left: Column) -> Column:
    """From the condyles, the part of the lower arch that volumes cut off: whole if all that are answered are, else partial."""
    known = F.filter(F.array(right, left), lambda s: F.coalesce(F.trim(s) != "", F.lit(False)))
    whole = (F.size(known) > 0) & F.forall(known, lambda s: s == FULL)
    included = F.when(whole, FULL).otherwise(PART)
    return F.struct(scope_level(included).alias("level"), included.alias("included"), F.lit("derived_from_condyles").alias("source"))


def maxilla_scope(included: Column, source: Column) -> Column:
    return F.struct(scope_level(included).alias("level"), included.alias("included"), _said(source).alias("source"))


def consistent(included: Column, parts: list[Column]) -> Column:
    """A whole arch is partial once any part of it that was answered is not whole; nothing else changes."""
    told = F.array_compact(F.array(*(_said(p) for p in parts)))
    return F.when((included == FULL) & F.exists(told, lambda s: s != FULL), PART).otherwise(included)


def condyles(right: Column, left: Column) -> Column:
    """One answer for both: out if either is out, ``unknown`` if none is answered in words that are known."""
    folded = F.array_compact(F.array(*(F.when(_said(s).isin(FULL, PART, "included"), "included").when(_said(s) == OUT, OUT) for s in (right, left))))
    return F.when(F.size(folded) == 0, "unknown").when(F.array_contains(folded, OUT), OUT).otherwise("included")


def sinus(fact: Column) -> Column:
    mucosa, content = F.coalesce(fact["mucosa_state"], F.lit("normal")), F.coalesce(fact["sinus_content"], F.lit("air"))
    return F.struct(mucosa.alias("mucosa_state"), content.alias("sinus_content"), ((mucosa == "normal") & (content == "air")).alias("normal"))


def sinus_group(right: Column, left: Column) -> Column:
    """Scopes of both sides, always stated; contents of those in scope.  A side that was not answered counts as in scope, a pair
    without any fact as out of it."""
    nothing = right.isNull() & left.isNull()
    scopes = [F.when(nothing, OUT).otherwise(F.coalesce(_said(f["scope"]), F.lit("unknown"))) for f in (right, left)]
    sides = [sinus(f) for f in (right, left)]
    status = sinus_status(*scopes, *(s["normal"] for s in sides))
    return F.struct(
        scopes[0].alias("scope_right"), scopes[1].alias("scope_left"), F.when(nothing, "inferred_from_missing_fact").alias("source"), status.alias("status"),
        F.when(scopes[0] != OUT, sides[0]).alias("right"), F.when(scopes[1] != OUT, sides[1]).alias("left"),
    )


def intrasinusal(right: Column, left: Column) -> Column:
    """Roots inside either sinus; that there are none is stated as well."""
    none = F.array().cast("array<int>")
    teeth = F.array_sort(F.array_union(F.coalesce(right["intrasinusal_teeth"], none), F.coalesce(left["intrasinusal_teeth"], none)))
    return F.struct(teeth.alias("teeth"), (F.size(teeth) == 0).alias("state_negative"))


def ridge(fact: Column) -> Column:
    """Atrophy of an edentulous region, if there is one and the answer was given; an intact ridge is an answer too."""
    return F.when(F.coalesce(fact["present"], F.lit(False)) & fact["atrophy"].isNotNull(), F.struct(fact["atrophy"].alias("atrophy"), F.when(fact["fully_edentulous"], True).alias("fully_edentulous")))


def resorption(fact: Column) -> Column:
    extent = fact["extent"]
    return F.when(extent != "none", F.struct(extent.alias("extent"), F.when(is_meaningful(fact["pattern"]), F.array(fact["pattern"])).alias("pattern")))


def remnants(readings: DataFrame) -> DataFrame:
    """(case_id, arch, remnants, toothless): roots left in the bone with the loss around them, and absent positions without one.

    ``readings`` is (case_id, arch, fdi, is_remnant, bone_loss, absent), a row for each position; an arch has sixteen.
    """
    left, gone = F.coalesce("is_remnant", F.lit(False)), F.coalesce("absent", F.lit(False))
    entry = F.struct("fdi", F.coalesce(~F.col("bone_loss").isin("", "none"), F.lit(False)).alias("resorbed"))
    per = readings.groupBy("case_id", "arch").agg(F.array_sort(F.collect_set(F.when(left, entry))).alias("_r"), F.array_sort(F.collect_set(F.when(gone & ~left, F.col("fdi")))).alias("toothless"))
    return per.select("case_id", "arch", F.when(F.size("_r") > 0, F.col("_r")).alias("remnants"), "toothless")
