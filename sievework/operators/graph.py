"""Connected components and similarity edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import written


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of an edge ``a, b``: the smallest id each reaches.

    Large-star and small-star steps: every node links its larger neighbours to the least one, then its smaller ones. Paths halve
    each round, edges stay as many as they were, and the rounds go on until no edge changes. Ids may be of any ordered type. Self-loops keep single nodes; null ends and
    repeated edges are dropped.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
    e = written(e.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        e = written(small, "edges")
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == before:
            break
        before = now
    return nodes.join(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
