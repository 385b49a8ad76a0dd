"""Scalar expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A text is numeric if it matches this; guards ``try_cast`` against forms such as ``12d``.
NUMERIC = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"

# Number words as they occur in contract text.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}


def safe_double(text: Column) -> Column:
    """The double a numeric literal denotes, null for anything else."""
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def money(text: Column) -> Column:
    """"$200,000" and "1.5%" as numbers: currency signs, grouping commas and a trailing % are dropped."""
    return safe_double(F.regexp_replace(F.trim(text), r"^[$€£]\s*|,(?=[0-9]{3})|\s*%$", ""))


def word_number(text: Column) -> Column:
    """"twelve" as 12; digits as their number; null for other words."""
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    return F.coalesce(F.get(F.array(F.element_at(words, F.lower(F.trim(text)))), F.lit(0)).cast("double"), safe_double(text))


def mentions_none(text: Column, anti_keywords: list[str]) -> Column:
    """False if the text holds any of the words that speak against it."""
    found = F.lit(False)
    for word in anti_keywords:
        found = found | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(word.lower()))
    return ~found


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; the denominator has 1e-9 added, so a zero vector gives 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def prevalence_tier(share: Column) -> Column:
    """expected from .8 on, common from .5, occasional from .2, else rare."""
    return F.when(share >= 0.8, "expected").when(share >= 0.5, "common").when(share >= 0.2, "occasional").otherwise("rare")


# The order of severities, most severe first.
SEVERITY_RANK = {"blocker": 0, "approval_required": 1, "warn": 2, "info": 3, "pass": 4, "na": 5}


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY_RANK))
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def truncated_id(*parts: Column) -> Column:
    """A stable identifier from what the row is about, in place of a random one."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)
