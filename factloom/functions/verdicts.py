"""Ladders of conditions over one case or position, as columns.  Null stands for "not answered" throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.votes import ABSTAIN, AGREE, DENY
from ..plans.dims import SWEEP, WISDOM

EMPTY = "array<int>"


def bool_verdict(answer: Column) -> Column:
    return F.coalesce(F.when(answer, AGREE), F.when(~answer, DENY), F.lit(ABSTAIN))


def enum_verdict(value: Column, target: str, skip: tuple[str, ...] = ()) -> Column:
    """The target agrees, any other answer denies; no answer and answers that cannot be compared abstain."""
    silent = value.isNull() | value.isin("", *skip)
    return F.when(silent, ABSTAIN).when(value == target, AGREE).otherwise(DENY)


def ranked_verdict(value: Column, target: str, priority: tuple[str, ...], silent: tuple[str, ...] = ("absent", "unreadable")) -> Column:
    """For enums that report only the foremost finding: an answer ranked before the target hides it, so it abstains."""
    if target not in priority:
        return F.lit(ABSTAIN)
    hides = priority[: priority.index(target)]
    return F.when(value.isNull() | value.isin(*silent, *hides), ABSTAIN).when(value == target, AGREE).otherwise(DENY)


def exclusive_verdict(value: Column, target: str, excluding: tuple[str, ...]) -> Column:
    """For findings that exclude each other: only answers known to rule the target out deny it."""
    return F.when(value == target, AGREE).when(value.isin(*excluding), DENY).otherwise(ABSTAIN)


def first_flag(flags: list[tuple[Column, str]]) -> Column:
    """The name of the first true flag; ``none`` if something was answered, null if nothing was."""
    named = F.coalesce(*(F.when(c, name) for c, name in flags))
    answered = F.coalesce(*(c for c, _ in flags)).isNotNull()
    return F.coalesce(named, F.when(answered, "none"))


def arch_positions(arch: str) -> Column:
    return F.array(*map(F.lit, SWEEP[arch]))


def absent_pattern(arch: str, absent: Column, assessable: Column) -> Column:
    """Which shape the missing positions of an arch have; the first that fits."""
    order = SWEEP[arch]
    missing = F.array_intersect(F.coalesce(absent, F.array().cast(EMPTY)), arch_positions(arch))
    n = F.size(missing)
    side = lambda q: F.size(F.array_intersect(missing, F.array(*(F.lit(p) for p in order if p // 10 == q))))
    sides = [side(q) for q in dict.fromkeys(p // 10 for p in order)]
    full = [s == len(order) // 2 for s in sides]
    consecutive = (n < 2) | (F.array_max(missing) - F.array_min(missing) + 1 == n)
    return (
        F.when(~assessable, "unknown").when(n == 0, "none").when(full[0] & full[1], "quadrant_edentulous_both")
        .when((full[0] | full[1]) & (F.least(*sides) == 0), "quadrant_edentulous_one").when(full[0] | full[1], "quadrant_edentulous_one_plus_partial")
        .when(n >= len(order) - 3, "nearly_edentulous").when(consecutive, "consecutive_run").otherwise("scatter")
    )


def dentition(primary: Column, unerupted: Column, present: Column) -> Column:
    """From counts: deciduous teeth, permanent ones not fully erupted, permanent ones there (wisdom teeth not counted)."""
    return F.when(present == 0, F.when(primary == 0, "edentulous").otherwise("primary")).when((primary > 2) & (unerupted > 2), "mixed").otherwise("permanent")


def not_wisdom(fdi: Column) -> Column:
    return ~fdi.isin(*WISDOM.values())


def presence(arch: str, present: Column, absent: Column, mentioned: Column, implants: Column, edentulous: Column, enumerated: Column) -> Column:
    """(present, absent, unstated) of an arch's positions from a report's lists.

    A finding at a position outranks a stated absence or implant, and these outrank the list of present teeth.  A list the
    report enumerates is complete, so it settles what is left; with both or neither enumerated the rest stays unstated.  A
    report that calls the arch edentulous is believed if nothing stands against it.
    """
    every, empty = arch_positions(arch), F.array().cast(EMPTY)
    lists = {k: F.coalesce(v, empty) for k, v in (("p", present), ("a", absent), ("m", mentioned), ("i", implants))}
    gone = F.array_except(F.array_union(lists["a"], lists["i"]), lists["m"])
    there = F.array_except(F.array_union(lists["p"], lists["m"]), gone)
    bare = F.coalesce(edentulous, F.lit(False)) & (F.size(there) == 0)
    gone = F.when(bare, every).otherwise(gone)
    said = F.array_union(there, gone)
    rest = F.array_except(every, said)
    given = [F.size(lists["p"]) > 0, F.size(lists["a"]) > 0]
    counted = F.coalesce(enumerated, F.when(given[0] & given[1], "both").when(given[0], "present").when(given[1], "absent").otherwise("neither"))
    in_order = lambda c: F.array_intersect(every, c)
    return F.struct(
        in_order(F.when(counted == "absent", F.array_union(there, rest)).otherwise(there)).alias("present"),
        in_order(F.when(counted == "present", F.array_union(gone, rest)).otherwise(gone)).alias("absent"),
        F.when(counted.isin("present", "absent"), empty).otherwise(rest).alias("unstated"),
    )


def longest_missing_run(arch: str, absent: Column) -> Column:
    """The longest run of missing positions along an arch."""
    runs = F.aggregate(
        F.transform(arch_positions(arch), lambda x: F.array_contains(absent, x)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, gone: F.struct(F.when(gone, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(gone, s["now"] + 1).otherwise(0)).alias("most")),
        lambda s: s["most"],
    )
    return runs


def atrophic(arch: str, absent: Column, stated: Column, run: int = 3) -> Column:
    """Atrophy: stated, or a run of missing positions."""
    return F.coalesce(stated, F.lit(False)) | (longest_missing_run(arch, absent) >= run)


def pontics(span: Column, abutments: Column, absent: Column, present: Column, named: Column) -> Column:
    """Missing positions of a span that carry no abutment, and those named that are not there."""
    return F.array_union(F.array_intersect(F.array_except(span, abutments), absent), F.array_except(named, present))


def stated(value: Column, is_absent: Column) -> Column:
    """A false answer about a tooth that is not there says nothing."""
    return F.when(is_absent & ~value, F.lit(None).cast("boolean")).otherwise(value)


def sinus_status(right: Column, left: Column, right_normal: Column, left_normal: Column) -> Column:
    """The pair's state from both sides' scopes (``not_included`` or null: out) and findings."""
    r, l = F.coalesce(right, F.lit("not_included")) != "not_included", F.coalesce(left, F.lit("not_included")) != "not_included"
    return F.when(~r & ~l, "none_included").when(r & ~l, "right_only").when(~r & l, "left_only").when(right_normal & left_normal, "all_normal").otherwise("mixed")
