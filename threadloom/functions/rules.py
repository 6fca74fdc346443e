"""Keyword labelling rules as Spark columns: no Python runs per row."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.constants import (
    CATEGORY_KEYWORDS,
    DEFAULT_CATEGORY,
    HIGH_FLOOR,
    MEDIUM_FLOOR,
    SHOUTED_WORD,
    URGENCY_KEYWORDS,
)


def whole_words(phrases) -> str:
    """Pattern for any phrase as whole words, earlier phrases tried first.

    Phrases are grouped by first letter and a look at that letter comes first,
    so most places in a text are passed over at once. Only phrases with the
    same first letter can begin at one place, so the order among those is all
    that counts, and it is kept.
    """
    by_letter: dict[str, list[str]] = {}
    for phrase in phrases:
        by_letter.setdefault(phrase[0], []).append(re.escape(phrase[1:]).replace(r"\ ", " "))
    groups = "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in by_letter.items())
    return rf"(?U)(?=[{''.join(by_letter)}])\b(?:{groups})\b"


def plain_lower(text: Column) -> Column:
    """Lower case, with typographic apostrophes made straight."""
    return F.translate(F.lower(text), "’‘", "''")


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def category_scores(lowered: Column) -> dict[str, Column]:
    """Hits per category in text that ``plain_lower`` has gone over."""
    return {name: hits(lowered, whole_words(words)) for name, words in CATEGORY_KEYWORDS.items()}


def pick_category(scores: dict[str, Column]) -> Column:
    """Highest score wins, the earlier category on a tie, the default at zero."""
    best = F.greatest(*scores.values())
    choice = F.when(best.isNull() | (best == 0), DEFAULT_CATEGORY)
    for name, score in scores.items():
        choice = choice.when(score == best, name)
    return choice


def urgency_score(text: Column, lowered: Column, phrases=URGENCY_KEYWORDS) -> Column:
    """Urgency phrases in lower case; exclamation marks and shouted words as written."""
    return (
        hits(lowered, whole_words(phrases))
        + (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit(""))))
        + hits(text, "(?U)(?=[A-Z])" + SHOUTED_WORD)
    )


def priority_of(score: Column) -> Column:
    return F.when(score >= HIGH_FLOOR, "High").when(score >= MEDIUM_FLOOR, "Medium").otherwise("Low")
