"""Ids that depend on content alone, never on order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def told_apart(*parts: Column) -> Column:
    """The parts as one text from which they can be told: each behind its length, a null as a dash."""
    return F.concat(*[F.coalesce(F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts])


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """``prefix_`` and the start of the SHA-256 of the parts; null parts count as empty."""
    text = told_apart(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, length))


def row_digest(*columns: Column) -> Column:
    """The digest of a row; the same for the same values, null told from empty."""
    return F.sha2(told_apart(*columns), 256)


def identifier(x: Column) -> Column:
    """Whether a text can serve as an id: not empty, of letters, digits and ``._:-`` alone."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]*$"), F.lit(False))


def sha1(x: Column) -> Column:
    return F.sha1(x)


def upper_sha256(x: Column) -> Column:
    return F.upper(F.sha2(x, 256))
