"""Arch summaries rewritten by the sources that know better: one row for each case and arch, null sources change nothing.

Columns of a summary: ``absent``, ``endodontic``, ``fillings``, ``crown`` (positions), ``present``, ``unassessable``, ``pattern``,
``impacted`` (tooth, impacted, source), ``implants`` (fdi, status, crown), ``bridge``, ``canal_right``/``canal_left`` (location,
adjacent), ``atrophy``, ``condyle_right``/``condyle_left``, ``findings`` (tooth, finding).  Sources: ``f_`` columns hold a case's
mask facts, ``p_`` columns a model's answers.  Rules run in the order of ``CHAIN``; the gate on absent positions comes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dims import SWEEP, WISDOM

# fixed values: eruption states that make a wisdom tooth impacted, and the teeth whose answers vote on a canal
UNERUPTED = ("complete_bony_inclusion", "partially_erupted")
CANAL_TEETH = {"right": (46, 47, 48), "left": (36, 37, 38)}
CANAL_PRIOR = "lingual"
NONE = "array<int>"


def _list(positions) -> Column:
    return F.array(*map(F.lit, positions)).cast(NONE)


def _of_arch(for_arch: Callable[[str], Column]) -> Column:
    """The column of the row's own arch."""
    return F.when(F.col("arch") == "maxilla", for_arch("maxilla")).otherwise(for_arch("mandible"))


def arch_positions() -> Column:
    return _of_arch(lambda a: _list(SWEEP[a]))


def _ascending(c: Column) -> Column:
    return F.array_sort(F.array_intersect(c, arch_positions()))


def excluded() -> Column:
    return F.coalesce(F.lower(F.trim("f_maxilla")) == "excluded", F.lit(False))


def mask_absent() -> Column:
    """The mask's missing positions of the arch; an upper arch outside the volume has none."""
    return F.when((F.col("arch") == "maxilla") & excluded(), F.array().cast(NONE)).otherwise(_ascending(F.coalesce("f_absent", F.array().cast(NONE))))


def absent(df: DataFrame) -> DataFrame:
    """Missing and present positions are the mask's; an arch outside the volume can be told neither way."""
    out = (F.col("arch") == "maxilla") & excluded()
    given = F.col("f_absent").isNotNull()
    return df.withColumns({
        "present": F.when(~given, F.col("present")).when(~out, F.array_except(arch_positions(), mask_absent())),
        "unassessable": F.when(given & out, F.array_sort(arch_positions())),
        "pattern": F.when(given & out, "unassessable").otherwise(F.col("pattern")),
        "absent": F.when(~given, F.col("absent")).when(~out, mask_absent()),
    })


def impaction(df: DataFrame) -> DataFrame:
    """Wisdom teeth: the detail view's eruption state before the overview's, the orientation from the overview.

    A state of inclusion or an orientation off the normal makes a claim; a tooth that is absent makes none.
    """
    norm = lambda c: F.lower(F.trim(c))
    slots = _of_arch(lambda a: _list(sorted(f for f in WISDOM.values() if f in SWEEP[a])))

    def claim(fdi: Column) -> Column:
        slot = F.get(F.filter("p_slots", lambda s: s["fdi"] == fdi), F.lit(0))
        detail, tilt = norm(F.try_element_at("p_eruption", fdi)), norm(slot["orientation"])
        state = F.coalesce(F.when(detail != "", detail), norm(slot["state"]))
        tilted = F.coalesce((tilt != "") & (tilt != "normal"), F.lit(False))
        made = F.coalesce(state != "absent", F.lit(True)) & (F.coalesce(state.isin(*UNERUPTED), F.lit(False)) | tilted)
        return F.when(made, F.struct(fdi.alias("tooth"), F.when(tilted, tilt).otherwise("unspecified").alias("impacted"), F.when(F.coalesce(detail, F.lit("")) != "", "composite_eruption").otherwise("3d_render").alias("source")))

    return df.withColumn("impacted", F.array_compact(F.transform(slots, claim)))


def endodontic(df: DataFrame) -> DataFrame:
    return df.withColumn("endodontic", F.when(F.col("p_endo").isNotNull(), _ascending(F.col("p_endo"))).otherwise(F.col("endodontic")))


def restorations(df: DataFrame) -> DataFrame:
    """Fillings are the detail view's; crowns the mask's, if it has any anywhere."""
    some = F.size(F.coalesce("f_crowns", F.array().cast(NONE))) > 0
    return df.withColumns({
        "fillings": F.when(F.col("p_fillings").isNotNull(), _ascending(F.col("p_fillings"))).otherwise(F.col("fillings")),
        "crown": F.when(some, _ascending(F.col("f_crowns"))).otherwise(F.col("crown")),
    })


def implants(df: DataFrame) -> DataFrame:
    """The mask's positions with what was said about them; a mask without any changes nothing."""
    mask = F.filter(F.coalesce("f_implants", F.array().cast(NONE)), lambda x: x.isNotNull())
    said = lambda x: F.get(F.filter("implants", lambda i: i["fdi"] == x), F.lit(0))
    placed = F.transform(_ascending(mask), lambda x: F.struct(x.alias("fdi"), said(x)["status"].alias("status"), said(x)["crown"].alias("crown")))
    return df.withColumn("implants", F.when(F.size(mask) > 0, placed).otherwise(F.col("implants")))


def bridges(df: DataFrame) -> DataFrame:
    """Arches that were audited for bridges have one or none; arches that never were keep their claim."""
    return df.withColumn("bridge", F.when(F.col("f_bridge_arches").isNotNull(), F.array_contains("f_bridge_arches", F.col("arch"))).otherwise(F.col("bridge")))


def canals(df: DataFrame) -> DataFrame:
    """Close teeth are the mask's, by side; the location is what all answers of the side agree on, else the prior."""
    for side, quadrant in (("right", 4), ("left", 3)):
        entry = F.col(f"canal_{side}")
        close = F.array_sort(F.filter(F.coalesce("f_close", F.array().cast(NONE)), lambda x: F.floor(x / 10) == quadrant))
        answers = F.array(*(F.lower(F.trim(F.try_element_at("p_canal", F.lit(f)))) for f in CANAL_TEETH[side]))
        votes = F.array_distinct(F.filter(answers, lambda v: v.isin("lingual", "buccal")))
        location = F.when(F.size(votes) == 1, F.get(votes, F.lit(0))).otherwise(CANAL_PRIOR)
        df = df.withColumn(f"canal_{side}", F.when(entry.isNotNull() & (F.col("arch") == "mandible"), F.struct(location.alias("location"), close.alias("adjacent"))).otherwise(entry))
    return df


def atrophy(df: DataFrame) -> DataFrame:
    """Stated, or all sixteen positions of the arch are missing."""
    return df.withColumn("atrophy", F.when(F.col("atrophy").isNotNull() | (F.size(F.array_except(arch_positions(), mask_absent())) == 0), F.lit(True)))


def condyles(df: DataFrame) -> DataFrame:
    """A volume without condyles, or without the maxilla, shows neither; nothing brings them in."""
    out = excluded() | F.coalesce(F.lower(F.trim("f_condyles")) == "excluded", F.lit(False))
    return df.withColumns({c: F.when(out & F.col(c).isNotNull(), "not_included").otherwise(F.col(c)) for c in ("condyle_right", "condyle_left")})


def gate(df: DataFrame) -> DataFrame:
    """Nothing is claimed of a tooth that the mask does not have; implants, bridges, remnants, impaction and bone are exempt."""
    gone = mask_absent()
    there = lambda c: F.filter(c, lambda x: ~F.array_contains(gone, x))
    return df.withColumns({c: there(c) for c in ("endodontic", "fillings", "crown")} | {"findings": F.filter("findings", lambda t: ~F.array_contains(gone, t["tooth"]))})


CHAIN: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = (
    ("absent", absent), ("impaction", impaction), ("endodontic", endodontic), ("restorations", restorations), ("implants", implants),
    ("bridges", bridges), ("canals", canals), ("atrophy", atrophy), ("condyles", condyles), ("gate", gate),
)


def apply(df: DataFrame, off: tuple[str, ...] = ()) -> DataFrame:
    """All rules but those switched off; without the rule of absent positions there is no gate."""
    for name, rule in CHAIN:
        if name not in off and not (name == "gate" and "absent" in off):
            df = rule(df)
    return df
