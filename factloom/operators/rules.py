"""The rule engine: ordered rewrites of a summary by facts, switched by a configuration that is passed, never global.

Every rule is a function (frame, config) -> frame over one row per case; null facts make a rule a no-op, and the gate on
absent positions runs last.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dims import SWEEP


@dataclass(frozen=True)
class RuleConfig:
    absent: bool = True
    impaction: bool = True
    endodontic: bool = True
    fillings: bool = True
    implants: bool = True
    bridges: bool = True
    canals: bool = True
    atrophy: bool = True
    condyle: bool = True
    gate: bool = True
    canal_prior: str = "lingual"
    vote_rule: str = "majority"
    wisdom: tuple[int, ...] = field(default=(18, 28, 38, 48))


def flatten(doc: Mapping, at: str = "") -> dict:
    out: dict = {}
    for k, v in doc.items():
        name = f"{at}.{k}" if at else k
        out |= flatten(v, name) if isinstance(v, Mapping) else {name: v}
    return out


def configured(*sources: Mapping) -> RuleConfig:
    """Defaults, overridden by each source in turn (nested keys are dotted).  Unknown keys and wrong types are errors."""
    config = RuleConfig()
    known = {f.name: type(getattr(config, f.name)) for f in fields(RuleConfig)}
    for source in sources:
        for key, value in flatten(source).items():
            name = key.removeprefix("rules.")
            if name not in known:
                raise KeyError(f"unknown rule {key!r}")
            if type(value) is list:
                value = tuple(value)
            if type(value) is not known[name]:
                raise TypeError(f"{key}: {known[name].__name__} is asked for, {value!r} is given")
            config = replace(config, **{name: value})
    return config


def read_config(path: str) -> RuleConfig:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return configured(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML configurations need PyYAML; give JSON") from e
    return configured(yaml.safe_load(text) or {})


def _facts(known: Column, new: Column, old: Column) -> Column:
    """The facts' list where there are facts, else what is there."""
    return F.when(known, new).otherwise(old)


def absent(df: DataFrame, c: RuleConfig) -> DataFrame:
    own = F.when(F.col("f_maxilla") == "excluded", F.filter("f_absent", lambda x: x >= 30)).otherwise(F.col("f_absent"))
    return df.withColumn("absent", _facts(F.col("f_absent").isNotNull(), F.array_sort(F.array_distinct(own)), F.col("absent")))


def impaction(df: DataFrame, c: RuleConfig) -> DataFrame:
    return df.withColumn("impacted", F.filter("impacted", lambda x: x.isin(*c.wisdom)))


def endodontic(df: DataFrame, c: RuleConfig) -> DataFrame:
    return df.withColumn("endodontic", _facts(F.col("s_endodontic").isNotNull(), F.col("s_endodontic"), F.col("endodontic")))


def fillings(df: DataFrame, c: RuleConfig) -> DataFrame:
    return df.withColumn("fillings", _facts(F.col("s_fillings").isNotNull(), F.col("s_fillings"), F.col("fillings")))


def implants(df: DataFrame, c: RuleConfig) -> DataFrame:
    """Positions of the mask with what was said about them; an empty mask changes nothing."""
    said = lambda x: F.get(F.filter("implants", lambda i: i["fdi"] == x), F.lit(0))
    carried = F.transform("f_implants", lambda x: F.struct(x.alias("fdi"), said(x)["crown"].alias("crown")))
    return df.withColumn("implants", _facts(F.size(F.coalesce("f_implants", F.array().cast("array<int>"))) > 0, carried, F.col("implants")))


def bridges(df: DataFrame, c: RuleConfig) -> DataFrame:
    """A list that was never audited (null) changes nothing; an audited empty one empties the claims."""
    return df.withColumn("bridges", _facts(F.col("f_bridges").isNotNull(), F.col("f_bridges"), F.col("bridges")))


def canals(df: DataFrame, c: RuleConfig) -> DataFrame:
    votes = F.array_distinct(F.filter("canal_votes", lambda v: v.isNotNull()))
    agreed = F.when(F.size(votes) == 1, F.get(votes, F.lit(0))).otherwise(F.lit(c.canal_prior))
    return df.withColumn("canal", F.when(F.col("canal_votes").isNotNull(), agreed).otherwise(F.col("canal")))


def atrophy(df: DataFrame, c: RuleConfig) -> DataFrame:
    """An arch without any of its sixteen positions is atrophic: ``atrophy`` for the mandible, which keeps what was stated, and
    ``atrophy_maxilla``."""
    gone = F.coalesce("absent", F.array().cast("array<int>"))
    bare = {arch: F.size(F.array_except(F.array(*map(F.lit, order)), gone)) == 0 for arch, order in SWEEP.items()}
    return df.withColumns({"atrophy": F.coalesce("atrophy", F.lit(False)) | bare["mandible"], "atrophy_maxilla": bare["maxilla"]})


def condyle(df: DataFrame, c: RuleConfig) -> DataFrame:
    return df.withColumn("condyle", F.when(F.col("f_condyles") == "excluded", "not_included").otherwise(F.col("condyle")))


def gate(df: DataFrame, c: RuleConfig) -> DataFrame:
    """No finding survives at an absent position."""
    present = lambda name: F.filter(name, lambda x: ~F.array_contains(F.coalesce("absent", F.array().cast("array<int>")), x))
    return df.withColumns({n: present(n) for n in ("endodontic", "fillings", "impacted")})


#: the order matters: the gate sees what all rules have done
CHAIN: tuple[tuple[str, Callable[[DataFrame, RuleConfig], DataFrame]], ...] = (
    ("absent", absent), ("impaction", impaction), ("endodontic", endodontic), ("fillings", fillings), ("implants", implants),
    ("bridges", bridges), ("canals", canals), ("atrophy", atrophy), ("condyle", condyle), ("gate", gate),
)


def apply(df: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    for name, rule in CHAIN:
        if getattr(config, name):
            df = rule(df, config)
    return df


def maxilla_scope(facts: Column, mask: Column, model: Column) -> Column:
    """Facts override, then the mask, and the model only if both are silent; anything but full and none is partial."""
    said = F.coalesce(F.when(facts == "excluded", "not_included").when(facts == "partial", "partial"), F.when(mask, "fully_included"), model)
    return F.when(said == "fully_included", "complete").when(said == "not_included", "none").otherwise("partial")
