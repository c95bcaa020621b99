"""Ordered rule cascades: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cascade(rules: list[tuple[Column, str]], default: str) -> Column:
    """One CASE: labels in order of their rules; a rule that is null doesn't hold."""
    out = None
    for holds, label in rules:
        out = F.when(F.coalesce(holds, F.lit(False)), label) if out is None else out.when(F.coalesce(holds, F.lit(False)), label)
    return F.lit(default) if out is None else out.otherwise(default)


def any_word(folded: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands in the folded text as a whole word."""
    return F.concat(F.lit(" "), folded, F.lit(" ")).rlike(" (?:" + "|".join(words) + ") ")


def first_word(folded: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in the list's order, that stands in the folded text; null if none."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    return F.coalesce(*[F.when(padded.contains(f" {w} "), F.lit(w)) for w in words])


def term_pattern(term: str) -> str:
    """The pattern by which a lexicon term is met in lower-case text: with a dot anywhere, else as bounded words, a hyphen also as a blank."""
    quoted = "".join(c if c.isalnum() or c in " -" else "\\" + c for c in term.lower())
    if "." in term:
        return quoted
    body = quoted.replace("-", r"[- \t\n]").replace(" ", r"[ \t\n]+")
    return rf"(?:^|[^\p{{L}}\p{{N}}]){body}(?:$|[^\p{{L}}\p{{N}}])"


def matches_term(text: Column, term: str) -> Column:
    return F.lower(text).rlike(term_pattern(term))


def first_term(text: Column, terms: list[str]) -> Column:
    """The first term of the list that stands in the text; null if none."""
    return F.coalesce(*[F.when(matches_term(text, t), F.lit(t)) for t in terms])
