"""Expectation predicates: does an answer meet its probe?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import strip

MATCH_KINDS = (
    "equal",
    "stripped_equal",
    "lower_contains_any",
    "contains",
    "starts_or_contains_any",
    "not_closing",
    "keyword_anywhere",
    "stripped_starts",
    "contains_any",
    "docstring",
)


def docstring_ok(text: Column) -> Column:
    """More than five characters after stripping, and no lower-case letter five times in a row."""
    return (F.length(strip(text)) > 5) & ~text.rlike(r"([a-z])\1{4}")


def match_columns(predicted: Column, acceptable: Column, prompt: Column) -> dict[str, Column]:
    """One boolean per match kind. ``acceptable`` is an array; its first item is *the* answer."""
    first = F.get(acceptable, F.lit(0))
    stripped = strip(predicted)
    closing = F.array(F.lit("}"), F.lit(")"), F.lit("]"))
    return {
        "equal": predicted == first,
        "stripped_equal": stripped == first,
        "lower_contains_any": F.exists(acceptable, lambda a: F.contains(F.lower(predicted), a)),
        "contains": F.contains(predicted, first),
        "starts_or_contains_any": F.exists(
            acceptable, lambda a: F.startswith(stripped, a) | F.contains(stripped, a)
        ),
        "not_closing": (stripped != "") & ~F.array_contains(closing, stripped),
        "keyword_anywhere": F.exists(
            acceptable, lambda a: F.contains(F.concat(prompt, predicted), a)
        ),
        "stripped_starts": F.startswith(stripped, first),
        "contains_any": F.exists(acceptable, lambda a: F.contains(stripped, a)),
        "docstring": docstring_ok(predicted),
    }


def matches(kind: Column, predicted: Column, acceptable: Column, prompt: Column) -> Column:
    """The predicate named by ``kind``; null for an unknown kind."""
    chosen = F.lit(None).cast("boolean")
    for name, test in match_columns(predicted, acceptable, prompt).items():
        chosen = F.when(kind == name, test).otherwise(chosen)
    return chosen
