"""Teeth that a sentence names by their place in the mouth ("upper right third molar") instead of by number.

Two small dimensions hold what there is, teeth by place in a quadrant and quadrants by arch and side; patterns are made from their
words, and a sentence keeps the rows it speaks of.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words of the language
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"]
ROMAN = ["I", "II", "III", "IV"]
NOUNS = {"incisor": ["incisor"], "canine": ["canine", "cuspid"], "premolar": ["premolar", "bicuspid"], "molar": ["molar"]}
TEETH = [(1, "central", "incisor"), (2, "lateral", "incisor"), (3, "", "canine"), (4, "first", "premolar"), (5, "second", "premolar"), (6, "first", "molar"), (7, "second", "molar"), (8, "third", "molar")]
OWN_NAMES = {8: "wisdom"}
ARCH_WORDS = {"maxilla": "maxill|upper", "mandible": "mandib|lower"}
SIDE_WORDS = {"right": r"\bright\b", "left": r"\bleft\b"}
BOTH_SIDES = "bilat|both|ipsilateral|contralateral"
QUADRANTS = [(1, "maxilla", "right"), (2, "maxilla", "left"), (3, "mandible", "left"), (4, "mandible", "right")]
COUNTED = r"tooth|element|dental element|e\.?d\.?"


def _nth(n: int) -> str:
    """The ordinal in letters and in figures."""
    return f"{ORDINALS[n - 1]}|{n}{ {1: 'st', 2: 'nd', 3: 'rd'}.get(n, 'th')}"


def _says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def _those(pairs: list[tuple[Column, Column | int]]) -> Column:
    """The values whose condition holds; patterns stay literals, which are compiled once."""
    return F.array_compact(F.array(*(F.when(holds, value if isinstance(value, Column) else F.lit(value)) for holds, value in pairs)))


def _whole_name(qualifier: str, noun: str, place: int) -> str:
    """Pattern of a tooth's name with its qualifier, or of a name of its own; one without either matches nothing."""
    names = [f"{qualifier} {w}" for w in NOUNS[noun] if qualifier] + [w for p, w in OWN_NAMES.items() if p == place]
    return "|".join(names) or "(?!)"


def _listed(text: Column) -> Column:
    """Places of teeth that share a noun: "first and second molars"."""
    few = "|".join(_nth(n) for n in (1, 2, 3))
    nouns = {w: kind for kind in ("molar", "premolar") for w in NOUNS[kind]}
    phrase = rf"(?i)(?:(?:{few})\b[\s,]*(?:and\s+)?){{2,3}}(?:{'|'.join(sorted(nouns))})s?"
    before = {kind: min(place for place, _, noun in TEETH if noun == kind) - 1 for kind in ("molar", "premolar")}
    shift = lambda p: F.coalesce(*(F.when(_says(p, rf"(?<![a-z]){w}s?$"), F.lit(before[kind])) for w, kind in nouns.items()))
    own = lambda p: _those([(_says(p, rf"\b(?:{_nth(n)})\b"), n + shift(p)) for n in (1, 2, 3)])
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(phrase), F.lit(0)), own))


def kinds_named(text: Column) -> Column:
    """Places in a quadrant (1 to 8) of the tooth kinds a sentence names: by whole name, by bare noun if no tooth of that noun has
    its whole name there, by a shared noun, or by count ("fourth tooth")."""
    spoken = []
    for noun, words in NOUNS.items():
        own = [(place, _whole_name(qualifier, noun, place)) for place, qualifier, n in TEETH if n == noun]
        bare = _says(text, rf"\b(?:{'|'.join(words)})s?\b") & ~_says(text, "|".join(f"(?:{name})" for _, name in own))
        spoken += [(_says(text, name) | bare, place) for place, name in own]
    counted = [(_says(text, rf"\b(?:{_nth(n)})\s+(?:{COUNTED})"), n) for n in range(1, 9)]
    return F.array_distinct(F.concat(_those(spoken), _listed(text), _those(counted)))


def quadrants_named(text: Column, arch: str) -> Column:
    """The arch's quadrants a sentence means: those it names as quadrants, else those that its words for arch and side leave."""
    both = _says(text, BOTH_SIDES) | (_says(text, SIDE_WORDS["right"]) & _says(text, SIDE_WORDS["left"]))
    called, left = [], []
    for n, own_arch, side in QUADRANTS:
        other_arch, other_side = next(w for a, w in ARCH_WORDS.items() if a != own_arch), next(w for s, w in SIDE_WORDS.items() if s != side)
        called.append((_says(text, rf"\b(?:{_nth(n)}|{ROMAN[n - 1]})\s+quadrant|quadrant\s+(?:{n}|{ROMAN[n - 1]})\b"), n))
        left.append((~_says(text, other_arch) & (both | ~_says(text, other_side)), n))
    meant = F.when(F.size(_those(called)) > 0, _those(called)).otherwise(_those(left))
    return F.array_intersect(meant, F.array(*(F.lit(n) for n, own_arch, _ in QUADRANTS if own_arch == arch)))


def _names_teeth(text: Column) -> Column:
    """Whether a sentence can name a kind at all: every pattern of ``kinds_named`` needs one of these words."""
    nouns = [w for words in NOUNS.values() for w in words] + list(OWN_NAMES.values())
    counts = "|".join(_nth(n) for n in range(1, 9))
    return _says(text, rf"{'|'.join(nouns)}|(?:{counts})\s+(?:{COUNTED})")


def positions_meant(text: Column, arch: str) -> Column:
    """Every kind a sentence names in every quadrant it means, as positions in ascending order."""
    found = F.array(F.struct(quadrants_named(text, arch).alias("q"), kinds_named(text).alias("k")))  # worked out once a sentence
    each = F.transform(found, lambda s: F.flatten(F.transform(s["q"], lambda q: F.transform(s["k"], lambda t: q * 10 + t))))
    return F.when(~_names_teeth(text), F.array().cast("array<int>")).otherwise(F.array_sort(each[0]))  # most sentences name none
