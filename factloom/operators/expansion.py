"""What a report says of an arch, expanded: facts of the arch, a row for each tooth it tells about, and what contradicts itself.

Input rows: ``case_id``, ``arch``, lists of positions ``teeth_present``, ``teeth_absent``, ``endodontic``, ``post_and_core``, ``crowns``,
``fillings``, ``caries``, ``implants``, ``root_remnants``, and ``edentulous``, ``atrophy_stated`` (booleans that may be null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts

FINDINGS = ("endodontic", "post_and_core", "crowns", "fillings", "caries", "root_remnants")
NONE = "array<int>"


def _of_arch(fn) -> Column:
    return F.when(F.col("arch") == "maxilla", fn("maxilla")).otherwise(fn("mandible"))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(NONE))


def presence(rows: DataFrame) -> DataFrame:
    """The rows with ``s``: present, absent and unstated positions of the arch."""
    mentioned = F.array_distinct(F.concat(*map(_list, FINDINGS)))
    none = F.lit(None).cast("string")
    return rows.withColumn("s", _of_arch(lambda a: verdicts.presence(a, F.col("teeth_present"), F.col("teeth_absent"), mentioned, F.col("implants"), F.col("edentulous"), none)))


def arch_facts(rows: DataFrame) -> DataFrame:
    """(case_id, arch, n_present, n_absent, n_unstated, atrophy, longest_run): atrophy is stated, or follows from a run of three missing."""
    told = presence(rows)
    gone = F.col("s.absent")
    run = _of_arch(lambda a: verdicts.longest_missing_run(a, gone))
    counts = [F.size(f"s.{k}").cast("long").alias(f"n_{k}") for k in ("present", "absent", "unstated")]
    atrophy = _of_arch(lambda a: verdicts.atrophic(a, gone, F.col("atrophy_stated"))) | (F.size(gone) == 16)
    return told.select("case_id", "arch", *counts, atrophy.alias("atrophy"), run.cast("long").alias("longest_run"))


def tooth_rows(rows: DataFrame) -> DataFrame:
    """(case_id, arch, fdi, present, with_endo, with_post, with_crown, with_filling, with_caries, is_remnant) of the positions a
    report tells about.  A post implies a root treatment; of an absent tooth a finding that is not claimed says nothing: null."""
    told = presence(rows)
    flags = {"with_endo": ("endodontic", "post_and_core"), "with_post": ("post_and_core",), "with_crown": ("crowns",), "with_filling": ("fillings",), "with_caries": ("caries",), "is_remnant": ("root_remnants",)}
    there = told.select("*", F.explode(F.concat(F.transform("s.present", lambda x: F.struct(x.alias("fdi"), F.lit(True).alias("present"))), F.transform("s.absent", lambda x: F.struct(x.alias("fdi"), F.lit(False).alias("present"))))).alias("t"))
    fdi, gone = F.col("t.fdi"), ~F.col("t.present")

    def flag(lists: tuple[str, ...]) -> Column:
        claimed = F.lit(False)
        for name in lists:
            claimed = claimed | F.array_contains(_list(name), fdi)
        return verdicts.stated(claimed, gone)

    return there.select("case_id", "arch", fdi.alias("fdi"), F.col("t.present").alias("present"), *(flag(v).alias(k) for k, v in flags.items()))


def conflicts(rows: DataFrame) -> DataFrame:
    """(case_id, arch, kind, fdi): positions called both present and absent, findings and implants where teeth are called absent or present."""
    both = F.array_intersect(_list("teeth_present"), _list("teeth_absent"))
    found = [F.struct(F.lit("present_and_absent").alias("kind"), both.alias("at"))]
    found += [F.struct(F.lit(f"{n}_at_absent").alias("kind"), F.array_intersect(_list(n), _list("teeth_absent")).alias("at")) for n in FINDINGS]
    found.append(F.struct(F.lit("implant_at_present").alias("kind"), F.array_intersect(_list("implants"), _list("teeth_present")).alias("at")))
    long = rows.select("case_id", "arch", F.inline(F.array(*found)))
    return long.select("case_id", "arch", "kind", F.explode("at").alias("fdi"))


def audited_facts(facts: DataFrame, bone: str = "bone_mm3", upper: str = "n_upper", least: float = 500.0, lists: tuple[str, ...] = ("teeth_present", "teeth_absent", "implants")) -> DataFrame:
    """Facts of volumes whose upper bone is under ``least`` mm3: the maxilla is outside, and if no upper tooth is labelled either, the
    upper positions leave all lists, which ``removed`` counts.  Nothing is ever added."""
    out = F.col(bone) < least
    strip = out & (F.col(upper) == 0)
    lower = lambda n: F.filter(n, lambda x: x > 30)
    removed = sum((F.when(strip, F.size(_list(n)) - F.size(lower(_list(n)))).otherwise(0) for n in lists), F.lit(0))
    return facts.withColumns({"f_maxilla": F.when(out, "excluded").otherwise(F.col("f_maxilla")), "removed": removed.cast("long")} | {n: F.when(strip, lower(n)).otherwise(F.col(n)) for n in lists})
