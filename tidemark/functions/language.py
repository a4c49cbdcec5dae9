"""Which posts an English-only model can assess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thai, CJK, kana, hangul, Cyrillic and its supplement, Arabic, Hebrew, Devanagari.
RANGES = r"\u0E00-\u0E7F\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF\u0400-\u04FF\u0500-\u052F\u0600-\u06FF\u0590-\u05FF\u0900-\u097F"
MIN_NONLATIN = 5
MIN_ASSESSABLE = 5


def primary_tag(tag: Column) -> Column:
    return F.lower(F.element_at(F.split(tag, "-"), 1))


def languages(langs: Column) -> Column:
    return F.transform(F.coalesce(langs, F.array().cast("array<string>")), primary_tag)


def nonlatin_dominant(text: Column) -> Column:
    """Five letters of those scripts at least, and more of them than ASCII letters."""
    nonlatin = F.regexp_count(text, F.lit(f"[[{RANGES}]&&\\p{{IsAlphabetic}}]"))
    return (nonlatin >= MIN_NONLATIN) & (nonlatin > F.regexp_count(text, F.lit("[A-Za-z]")))


def assessable(text: Column, langs: Column) -> Column:
    """No language but English declared, and not dominated by another script."""
    return F.forall(languages(langs), lambda x: x == "en") & ~nonlatin_dominant(text)


def pair_assessable(a: Column, b: Column) -> Column:
    return ~nonlatin_dominant(a) & ~nonlatin_dominant(b)


def coverage(assessable_n: Column, unassessable_n: Column) -> Column:
    return (
        F.when(assessable_n >= MIN_ASSESSABLE, "Score")
        .when((unassessable_n >= 1) & (unassessable_n >= assessable_n), "NotAssessed")
        .otherwise("InsufficientData")
    )
