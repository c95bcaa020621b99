"""Sequential deduplication by several keys, where only kept rows own their keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.graph import components
from sievework.session import written

#: After so many rounds, what is open hangs together in chains: groups of up to ``SCANNED`` marks are then scanned in order, each in one task.
ROUNDS, SCANNED = 8, 100_000


def keep_in_order(rows: DataFrame, order: str, keys: list[str], rounds: int = ROUNDS, scanned: int = SCANNED) -> DataFrame:
    """``rows`` with ``kept``: a row is kept if no earlier kept row has one of its keys.

    The result of a scan in the unique ``order``, found in rounds without one: a row that comes first among the open rows of
    each of its keys is kept, and open rows that share a key with it are rejected. Null keys bind nothing. Rounds go on until no row is open;
    long chains, which would take a round a link, are scanned as groups of bounded size, and only larger groups go on in rounds.
    """
    marks = written(rows.select(order, F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), F.col(k))) for k in keys])).alias("k")).where("k IS NOT NULL"), "marks")
    bare = rows.select(order).join(marks.select(order), order, "left_anti")
    open_marks, kept = marks, bare
    done = 0
    while not open_marks.isEmpty():
        if done == rounds:
            found, open_marks = _scanned(open_marks, order, scanned)
            kept = kept.unionByName(found)
            done += 1
            continue
        done += 1
        first = open_marks.groupBy("k").agg(F.min(order).alias("first"))
        state = open_marks.join(first, "k")
        new = written(state.groupBy(order).agg(F.bool_and(F.col("first") == F.col(order)).alias("all")).where("all").select(order), "kept")
        taken = open_marks.join(new, order, "left_semi").select("k").distinct()
        gone = open_marks.join(taken, "k", "left_semi").select(order).distinct()
        open_marks = written(open_marks.join(gone, order, "left_anti"), "marks")
        kept = kept.unionByName(new)
    return rows.join(kept.distinct().withColumn("kept", F.lit(True)), order, "left").fillna(False, ["kept"])


def _scanned(marks: DataFrame, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows of the groups of at most ``most`` marks, marks of the larger groups): rows that share keys, also by way of others, are a group."""
    star = marks.join(marks.groupBy("k").agg(F.min(order).alias("low")), "k").select(F.col(order).alias("a"), F.col("low").alias("b"))
    group = components(star).withColumnRenamed("id", order)
    m = marks.join(group, order)
    size = m.groupBy("component").agg(F.count("*").alias("n"))
    m = written(m.join(size, "component"), "groups")

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        owned, kept = set(), []
        for at, ks in g.sort_values(order).groupby(order, sort=True)["k"]:
            if owned.isdisjoint(ks):
                owned.update(ks)
                kept.append(at)
        return pd.DataFrame({order: kept})

    kept = m.where(F.col("n") <= most).select("component", order, "k").groupBy("component").applyInPandas(scan, marks.select(order).schema)
    return written(kept, "kept"), written(m.where(F.col("n") > most).select(order, "k"), "marks")
