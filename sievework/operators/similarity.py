"""Set and order similarity of lists, joined through shared elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the shorter list's."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))).cast("double"))


def order_similarity(a: Column, b: Column) -> Column:
    """The longest common subsequence over the common elements, for lists without repeats.

    The places in ``b`` of the common elements, in the order of ``a``, are a permutation; its longest increasing run is kept as
    the tails of patience sorting, so a list of n costs n steps of a scan over at most n tails.
    """
    places = F.filter(F.transform(a, lambda x: F.array_position(b, x)), lambda p: p > 0)
    empty = F.array().cast("array<bigint>")
    tails = F.aggregate(places, empty, lambda t, p: F.concat(F.filter(t, lambda v: v < p), F.array(p), F.slice(F.filter(t, lambda v: v >= p), 2, 1_000_000)))
    return F.try_divide(F.size(tails).cast("double"), F.size(places).cast("double"))


def set_pairs(sets: DataFrame, owner: str, element: str) -> DataFrame:
    """``a, b, common, size_a, size_b`` of owners with a common element, by an equi-join on the elements."""
    s = sets.where(F.col(element).isNotNull()).select(F.col(owner).alias("o"), F.col(element).alias("e")).distinct()
    sizes = s.groupBy("o").agg(F.count("*").alias("size"))
    pairs = s.alias("x").join(s.alias("y"), F.expr("x.e = y.e AND x.o < y.o")).groupBy(F.col("x.o").alias("a"), F.col("y.o").alias("b")).agg(F.count("*").alias("common"))
    return pairs.join(sizes.select(F.col("o").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("o").alias("b"), F.col("size").alias("size_b")), "b")
