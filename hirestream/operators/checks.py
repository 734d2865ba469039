"""Contract checks on generated text (Q6-Q10), as boolean columns.

Word handling is Unicode-aware in both directions: words are whitespace runs
with non-letter/digit characters removed, so the checks behave the same on
multilingual text.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

# --- fixed values ------------------------------------------------------------
BULLET_FORBIDDEN = ["responsible for", "duties included", "team player", "passionate"]
LETTER_FORBIDDEN = ["dynamic", "passionate", "results-driven", "go-getter", "team player",
                    "extensive experience", "wide range"]
SUMMARY_FORBIDDEN = ["dynamic", "passionate", "results-driven", "go-getter"]
BULLET_WORDS, MAX_BULLETS = (16, 28), 6
LETTER_WORDS, SUMMARY_WORDS = (220, 280), (60, 90)
# Our own reading of "no first-person pronouns".
FIRST_PERSON = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves"]
NUMBER_PATTERN = r"\d+(?:[.,]\d+)*%?"
# -----------------------------------------------------------------------------


def words(c: Column) -> Column:
    """Lower-case words: whitespace runs with non-letters/digits removed, blanks dropped."""
    raw = F.split(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+")
    return F.filter(F.transform(raw, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")


def bullet_lines(c: Column) -> Column:
    return F.filter(F.transform(tx.split_lines(c), lambda x: tx.pytrim(x)), lambda x: x != "")


def has_forbidden(c: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))


def has_first_person(c: Column) -> Column:
    pron = F.array(*[F.lit(p) for p in FIRST_PERSON])
    return F.exists(words(c), lambda w: F.array_contains(pron, w))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER_PATTERN), 0))


def numbers_preserved(original: Column, rewrite: Column) -> Column:
    return F.size(F.array_except(numbers(original), numbers(rewrite))) == 0


def rewrite_checks(original: Column, rewrite: Column) -> Column:
    """Q6: bullet rewrite contract."""
    ob, rb = bullet_lines(original), bullet_lines(rewrite)
    lo, hi = BULLET_WORDS
    return F.struct(
        (F.size(rb) == F.least(F.size(ob), F.lit(MAX_BULLETS))).alias("bullet_count_ok"),
        F.forall(rb, lambda b: F.size(words(b)).between(lo, hi)).alias("word_range_ok"),
        numbers_preserved(original, rewrite).alias("numbers_ok"),
        (~has_forbidden(rewrite, BULLET_FORBIDDEN)).alias("no_forbidden"),
        (~has_first_person(rewrite)).alias("no_first_person"))


def letter_checks(letter: Column, role: Column, company: Column) -> Column:
    """Q8: cover-letter contract."""
    n = F.size(words(letter))
    low = F.lower(F.coalesce(letter, F.lit("")))
    return F.struct(n.between(*LETTER_WORDS).alias("length_ok"),
                    F.contains(low, F.lower(role)).alias("names_role"),
                    F.contains(low, F.lower(company)).alias("names_company"),
                    (~has_forbidden(letter, LETTER_FORBIDDEN)).alias("no_forbidden"))


def summary_checks(summary: Column) -> Column:
    """Q10: summary contract."""
    return F.struct(F.size(words(summary)).between(*SUMMARY_WORDS).alias("length_ok"),
                    (~has_forbidden(summary, SUMMARY_FORBIDDEN)).alias("no_forbidden"),
                    (~has_first_person(summary)).alias("no_first_person"))


def grounding_violations(items: Column, candidate_text: Column) -> Column:
    """Q9: listed items that do not occur (case-insensitive) in the candidate text."""
    hay = F.lower(F.coalesce(candidate_text, F.lit("")))
    return F.filter(items, lambda x: ~F.contains(hay, F.lower(x)))
