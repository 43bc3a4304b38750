"""Stock phrases: literal and regex hits, their density score, and the pattern file."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import find_literals, word_echoes
from .text import let, rx

# What is scanned for when no pattern file can be read.
FALLBACK_LITERALS = ("couldn't help but", "a wave of", "steeled himself", "steeled herself", "eyes widened", "let out a breath", "palpable tension", "mysterious stranger")
FALLBACK_REGEXES = (r"\b(\w+)(?:\s+\1){2,}\b",)

# The regex half of the standard pattern file.
STANDARD_REGEXES = (
    r"\b(\w+)(?:\s+\1){2,}\b",
    r"\.{4,}",
    r"\.{3}[^.]{0,40}\.{3}",
    r"!{3,}",
    r"\b(?:eyes|gaze|voice|heart|soul|spirit|mind)\s+of\s+(?:steel|fire|ice|stone|gold|iron|darkness|light)\b",
    r"\b(?:exclaimed|proclaimed|declared|announced|stated|remarked|opined|mused|quipped|retorted|interjected|gasped|breathed|murmured|muttered|whispered|hissed|growled|snarled|barked|bellowed|thundered|purred|cooed|crooned)\b",
    r"(?:^|\n|[.!?]\s+)(\w+)\b[^.!?]*[.!?]\s+\1\b[^.!?]*[.!?]\s+\1\b",
    r"\b(?:slowly|gently|softly|quietly|carefully|suddenly|quickly)\s+(?:reached|moved|walked|turned|looked|whispered|spoke|opened|closed|touched|pulled|pushed)\b",
    r"\btasted\s+(?:like|of)\s+\w+\s+and\s+",
    r"(?:Not|No)\s+\w+[^.!?\n]{0,60}[.!?,;:\u2014\u2014]\s*(?:not|Not|No|no)\s+\w+",
)


@dataclass(frozen=True)
class PatternSet:
    """literals may repeat; each entry counts."""

    literals: tuple[str, ...] = FALLBACK_LITERALS
    regexes: tuple[str, ...] = FALLBACK_REGEXES


# The literal half, one a line, repeated ones included.
STANDARD_LITERALS = tuple((Path(__file__).parent / "literals.txt").read_text(encoding="utf-8").rstrip("\n").split("\n"))
STANDARD = PatternSet(STANDARD_LITERALS, STANDARD_REGEXES)


def compiles(pattern: str) -> bool:
    """Whether Java's regex compiler, which is what scans, takes a pattern. Without a running JVM Python's stands in for it."""
    from pyspark import SparkContext

    if not isinstance(pattern, str):
        return False
    jvm = SparkContext._active_spark_context and SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(f"(?dUi){pattern}") if jvm else re.compile(pattern)
    except Exception:  # noqa: BLE001 - whatever the compiler objects to
        return False
    return True


def load_patterns(path: str) -> PatternSet:
    """A YAML file with literal_strings and regex_patterns; the fallback if it can't be read, is no such file or has neither."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
        lists = [data.get(k) or [] for k in ("literal_strings", "regex_patterns")]
        if not all(isinstance(x, list) and all(isinstance(s, str) for s in x) for x in lists):
            raise TypeError("lists of strings are wanted")
        found = PatternSet(*map(tuple, lists))
    except Exception:  # noqa: BLE001 - any failure means the fallback
        return PatternSet()
    return found if found.literals or found.regexes else PatternSet()


def override(patterns: PatternSet, literals=None, regexes=None, legacy=None) -> PatternSet:
    """legacy replaces the literals and drops the regexes unless regexes are given too."""
    if legacy is not None:
        return PatternSet(tuple(legacy), tuple(regexes or ()))
    return PatternSet(tuple(patterns.literals if literals is None else literals), tuple(patterns.regexes if regexes is None else regexes))


#: Literals of which one stands in every match of a standard regex: what has none of them isn't scanned.
NEAR = {
    STANDARD_REGEXES[1]: ("....",),
    STANDARD_REGEXES[2]: ("...",),
    STANDARD_REGEXES[3]: ("!!!",),
    STANDARD_REGEXES[4]: ("steel", "fire", "ice", "stone", "gold", "iron", "darkness", "light"),
    STANDARD_REGEXES[5]: tuple(STANDARD_REGEXES[5].split("(?:")[1].split(")")[0].split("|")),
    STANDARD_REGEXES[7]: tuple(STANDARD_REGEXES[7].split("(?:")[1].split(")")[0].split("|")),
    STANDARD_REGEXES[8]: ("tasted",),
    STANDARD_REGEXES[9]: ("no",),
}


#: Regexes with back-references, and what of ``word_echoes`` a text with a match has.
ECHO = {STANDARD_REGEXES[0]: "thrice", STANDARD_REGEXES[6]: "starts"}


def _hits(low: Column, text: Column, patterns: PatternSet, seen: Column, place: dict[str, int]) -> Column:
    """array of (pattern, n), n > 0, literals first, in the patterns' order; a literal listed twice is one entry for each. seen: which of
    the literals in place the text has, and its echoes."""
    found = seen["literals"]
    none = F.array().cast("array<struct<pattern:string,n:bigint>>")
    has = lambda strings: F.arrays_overlap(found, F.array(*[F.lit(place[s]) for s in strings]))
    literal = [(s, s.lower()) for s in patterns.literals if s]
    first = none
    if literal:
        every = F.array(*[F.struct(F.lit(s).alias("pattern"), F.lit(x).alias("low"), F.lit(place[x]).alias("k")) for s, x in literal])
        here = F.filter(every, lambda p: F.array_contains(found, p["k"]))
        first = F.transform(here, lambda p: F.struct(p["pattern"].alias("pattern"), ((F.length(low) - F.length(F.replace(low, p["low"], F.lit("")))) / F.length(p["low"])).cast("long").alias("n")))
        first = F.when(F.size(found) > 0, F.filter(first, lambda x: x["n"] > 0)).otherwise(none)
    entries = []
    for p in patterns.regexes:
        n = F.regexp_count(text, rx(p, "i"))
        on = has(NEAR[p]) if p in NEAR else seen["echoes"][ECHO[p]] if p in ECHO else F.lit(True)
        entries.append(F.struct(F.lit(p).alias("pattern"), F.when(on, n).otherwise(0).cast("long").alias("n")))
    second = F.filter(F.array(*entries), lambda x: x["n"] > 0) if entries else none
    return F.concat(first, second)


def lazy(text: Column, patterns: PatternSet = STANDARD) -> Column:
    """lazy_score, has_lazy_text, lazy_pattern_count, lazy_patterns_found. A regex that doesn't compile is passed over (Java's dialect: named
    groups and flags in the middle of a pattern that only Python knows don't)."""
    text = F.coalesce(text, F.lit(""))
    patterns = PatternSet(patterns.literals, tuple(p for p in patterns.regexes if compiles(p)))
    looked_for = [s.lower() for s in patterns.literals if s] + [s for p in patterns.regexes for s in NEAR.get(p, ())]
    place = {s: k for k, s in enumerate(dict.fromkeys(looked_for))}
    found = find_literals(F.lower(text), tuple(place)) if place else F.array().cast("array<int>")

    def of(hits: Column, n_words: Column) -> Column:
        n = F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        excess = F.greatest(F.lit(0.0), n / (F.greatest(n_words, F.lit(1)) / 100.0) - 0.3)
        return F.struct((1.0 - 1.0 / (1.0 + excess / 2.0)).alias("lazy_score"), (n > 0).alias("has_lazy_text"), n.alias("lazy_pattern_count"), hits.alias("lazy_patterns_found"))

    seen = F.struct(found.alias("literals"), word_echoes(text).alias("echoes"))
    return let(seen, lambda x: let(let(F.lower(text), lambda low: _hits(low, text, patterns, x, place)), lambda hits: of(hits, x["echoes"]["words"])))
