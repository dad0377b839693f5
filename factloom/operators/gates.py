"""Gates between sources: a finding that one reading of a position claims is held against the others before it is reported.

``readings`` has a row for each position, (case_id, arch, fdi) and what its sources say, null where a source is silent: ``overview``
(the arch view's one finding of the position), ``absent``, ``detected``, ``eruption``, ``is_remnant``, ``with_caries``, ``with_endo``,
``with_post_and_core``, ``with_full_crown``, ``with_fillings``, ``periapical``, ``filling_quality``, ``bone_lesion``, ``impacted`` and
``orientation`` (wisdom slots), ``near_canal`` and ``canal_location`` (lower molars).  A position's votes stand on its own row, so
these gates shuffle nothing; facts of an arch or a side meet the positions by a join on the case.

A dropped claim is always told, and is kept as well where its gate is off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_meaningful
from ..functions.verdicts import bool_verdict, enum_verdict, exclusive_verdict, first_flag, ranked_verdict
from ..plans.dims import WISDOM
from .votes import ABSTAIN, AGREE, DENY

# fixed values: the arch view's findings, foremost first; answers that rule caries out; states of a tooth that is there
OVERVIEW = ("impacted", "post_and_core", "root_canal_treatment", "filling", "caries")
NO_CARIES = ("normal", "filling")
RESTORED = ("fillings", "crown", "post_and_core")
PRESENT_STATES = ("complete_bony_inclusion", "partially_erupted", "fully_erupted", "not_erupted")
LESIONS = ("radiopaque", "radiolucent")
CANAL_PLACES = {"right": (44, 45, 46, 47, 48), "left": (34, 35, 36, 37, 38)}
CANAL_MOLARS = (36, 37, 38, 46, 47, 48)


@dataclass(frozen=True)
class Gates:
    """``cross_validate`` is the master switch of all gates but that of caries; the others tell which findings it governs."""

    cross_validate: bool = False
    caries: bool = True
    impaction: bool = False
    endodontic: bool = False
    fillings: bool = False
    post_and_core: bool = True
    canals: bool = True
    implants: bool = True
    bone: bool = True
    prefer_detail_location: bool = True
    absent_is_not_impacted: bool = False

    def on(self, name: str) -> bool:
        return self.cross_validate and getattr(self, name)


def settled(votes: list[Column], gate: bool, rule: str = "unanimous") -> tuple[Column, Column]:
    """(kept, dropped) of one claim from its sources' votes; without a vote for it there is no claim."""
    count = lambda v: sum((F.when(x == v, 1).otherwise(0) for x in votes), F.lit(0))
    agree, deny = count(AGREE), count(DENY)
    stands = deny == 0 if rule == "unanimous" else agree > deny
    return (agree > 0) & (stands | F.lit(not gate)), (agree > 0) & ~stands


def restoration() -> Column:
    """A position's restorations as one answer: a post before a crown before a filling; ``none`` only if something was answered."""
    return first_flag([(F.col("with_post_and_core"), "post_and_core"), (F.col("with_full_crown"), "crown"), (F.col("with_fillings"), "fillings")])


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _line(finding: str, kept: Column, dropped: Column, detail: Column | None = None, sources: Column | None = None) -> Column:
    return F.struct(
        F.lit(finding).alias("finding"), kept.alias("kept"), dropped.alias("dropped"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"), (F.array().cast("array<string>") if sources is None else sources).alias("sources"),
    )


def caries(gates: Gates) -> Column:
    """Three sources, and any that denies decides: caries and a restoration exclude each other.

    With the gate off nothing is dropped; a remnant has no crown to decay, nor has a tooth that is not there.
    """
    asked = ~_yes("absent") & ~_yes("is_remnant")
    own = F.when(restoration().isin(*RESTORED), DENY).otherwise(ABSTAIN)
    # the gate removes only under the master switch, what it would remove is told under its own
    kept, dropped = settled([bool_verdict(F.col("with_caries")), exclusive_verdict(F.col("overview"), "caries", NO_CARIES), own], gates.on("caries"))
    return _line("caries", asked & kept, asked & dropped & F.lit(gates.caries))


def impaction(gates: Gates) -> Column:
    """The wisdom view and the arch view, by majority; the arch view's silence on other teeth denies nothing.

    The direction is the wisdom view's tilt; the arch view knows none.
    """
    wisdom = F.col("fdi").isin(*WISDOM.values())
    view = F.when(wisdom, bool_verdict(F.col("impacted"))).otherwise(ABSTAIN)
    arch = F.when(wisdom | (F.col("overview") == "impacted"), ranked_verdict(F.col("overview"), "impacted", OVERVIEW)).otherwise(ABSTAIN)
    kept, dropped = settled([view, arch], gates.on("impaction"), "majority")
    gone = kept & _yes("absent")
    stays = kept & ~gone if gates.absent_is_not_impacted else kept
    tilt = F.when((view == AGREE) & is_meaningful(F.col("orientation")), F.col("orientation")).otherwise("unspecified")
    sources = F.array_compact(F.array(F.when(view == AGREE, "3d_render"), F.when(arch == AGREE, "panoramic")))
    return _line("impacted", stays, dropped | gone, tilt, sources)


def endodontic(gates: Gates) -> tuple[Column, Column]:
    """Root fillings of two sources with their quality; a lesion at the apex has one source and stands by itself."""
    there = ~_yes("absent")
    kept, dropped = settled([bool_verdict(F.col("with_endo")), ranked_verdict(F.col("overview"), "root_canal_treatment", OVERVIEW)], gates.on("endodontic"))
    quality = F.when(kept & ~F.col("filling_quality").isin("", "none"), F.col("filling_quality"))
    return _line("root_canal_treatment", there & kept, there & dropped, quality), _line("periapical_lesion", there & _yes("periapical"), F.lit(False))


def restorations(gates: Gates) -> tuple[Column, ...]:
    """Crowns have one source.  A crowned tooth takes no part in the vote on fillings, and a tooth with a post is no crown."""
    there, own = ~_yes("absent"), restoration()
    crowned = F.coalesce(own == "crown", F.lit(False))
    post, no_post = settled([enum_verdict(own, "post_and_core", ("crown",)), ranked_verdict(F.col("overview"), "post_and_core", OVERVIEW)], gates.on("post_and_core"))
    fill, no_fill = settled([enum_verdict(own, "fillings", ("crown",)), ranked_verdict(F.col("overview"), "filling", OVERVIEW)], gates.on("fillings"))
    return (
        _line("crown", there & crowned & ~post, F.lit(False)), _line("post_and_core", there & post, there & no_post),
        _line("fillings", there & ~crowned & fill, there & ~crowned & no_fill),
    )


def tooth_gates(readings: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """(case_id, arch, fdi, finding, kept, dropped, detail, sources) of all findings of positions that somebody claims."""
    lines = F.array(caries(gates), impaction(gates), *endodontic(gates), *restorations(gates))
    worked = readings.select("case_id", "arch", "fdi", lines.alias("_lines"))  # a column of its own: parts that lines share are worked out once
    return worked.select("case_id", "arch", "fdi", F.inline(F.filter("_lines", lambda x: x["kept"] | x["dropped"])))


def canal_contacts(canals: DataFrame, readings: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """(case_id, side, fdi, kept, dropped) of contacts with a canal; ``canals`` is (case_id, side, adjacent, location).

    The view of the whole arch answers for all places of a side once it gives a list, an empty one too; the detail view answers
    by position.  A tooth that is not there touches nothing, which is no drop.
    """
    places = F.when(F.col("side") == "right", F.array(*map(F.lit, CANAL_PLACES["right"]))).when(F.col("side") == "left", F.array(*map(F.lit, CANAL_PLACES["left"])))
    named = F.transform(F.filter("adjacent", lambda x: x.rlike(r"^\s*[+-]?[0-9]{1,9}\s*$")), lambda x: F.trim(x).cast("int"))
    each = canals.select("case_id", "side", F.explode(places).alias("fdi"), named.alias("_named"))
    met = each.join(readings.select("case_id", "fdi", "near_canal", "absent"), ["case_id", "fdi"], "left")
    whole = F.when(F.col("_named").isNull(), ABSTAIN).when(F.array_contains("_named", F.col("fdi")), AGREE).otherwise(DENY)
    kept, dropped = settled([whole, bool_verdict(F.col("near_canal"))], gates.on("canals"))
    return met.select("case_id", "side", "fdi", (kept & ~_yes("absent")).alias("kept"), dropped.alias("dropped")).filter("kept OR dropped")


def canal_locations(canals: DataFrame, readings: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """(case_id, side, location, source, other): where a canal runs; the molars' majority before the arch's answer, or after it.

    Molars that tie have no opinion.  ``other`` is the answer not taken, where both speak and differ.
    """
    sides = F.when(F.floor(F.col("fdi") / 10) == 4, "right").otherwise("left")
    said = readings.filter(F.col("fdi").isin(*CANAL_MOLARS)).groupBy("case_id", sides.alias("side")).agg(*(F.count_if(F.col("canal_location") == w).alias(f"_{w}") for w in ("lingual", "buccal")))
    met = canals.join(said, ["case_id", "side"], "left")
    arch = F.when(F.col("location").isin("lingual", "buccal"), F.col("location"))
    molars = F.when(F.col("_lingual") > F.col("_buccal"), "lingual").when(F.col("_buccal") > F.col("_lingual"), "buccal")
    first, second = (molars, arch) if gates.prefer_detail_location else (arch, molars)
    names = ("composite", "3d_render") if gates.prefer_detail_location else ("3d_render", "composite")
    source = F.when(first.isNotNull(), names[0]).when(second.isNotNull(), names[1])
    return met.select("case_id", "side", F.coalesce(first, second).alias("location"), source.alias("source"), F.when(first != second, second).alias("other"))


def implants(entries: DataFrame, readings: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """``entries`` (case_id, arch, fdi, ...) with ``evidence`` of a tooth at the implant's place, ``kept`` and ``dropped``.

    The mask's tooth is foremost, then an eruption state, then any finding of the same arch's view.  An implant without a position
    contradicts nothing.
    """
    there = readings.select(F.col("case_id"), F.col("fdi"), F.col("arch").alias("_arch"), F.col("detected").alias("_detected"), F.col("eruption").alias("_eruption"), F.col("overview").alias("_overview"))
    seen = F.when(F.col("_arch") == F.col("arch"), F.col("_overview"))
    evidence = (
        F.when(F.col("_detected") == "yes", "segmented_tooth").when(F.col("_eruption").isin(*PRESENT_STATES), "composite_erupted")
        .when(~seen.isin("absent", "unreadable"), F.concat(F.lit("panoramic="), seen))
    )
    met = entries.join(there, ["case_id", "fdi"], "left").withColumn("evidence", evidence)
    return met.select(*entries.columns, "evidence", (F.col("evidence").isNull() | F.lit(not gates.on("implants"))).alias("kept"), F.col("evidence").isNotNull().alias("dropped"))


def bone(facts: DataFrame, readings: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """(case_id, arch, present, type, location, confirmed) of an arch's claim of a lesion; ``facts`` is (case_id, arch, present, type, location).

    Any position of the arch confirms it.  A claim that is not confirmed under the gate, or of no known type, stays ``present``
    without a type, so that nothing is reported, least of all that there is no lesion.
    """
    any_tooth = readings.groupBy("case_id", "arch").agg(F.max(_yes("bone_lesion")).alias("_any"))
    claimed, known = _yes("present"), F.coalesce(F.col("type").isin(*LESIONS), F.lit(False))
    confirmed = _yes("_any")
    told = claimed & known & (confirmed | F.lit(not gates.on("bone")))
    return facts.join(any_tooth, ["case_id", "arch"], "left").select(
        "case_id", "arch", claimed.alias("present"), F.when(told, F.col("type")).alias("type"),
        F.when(told & is_meaningful(F.col("location")), F.trim("location")).alias("location"), F.when(claimed & known, confirmed).alias("confirmed"),
    )
