"""Contracts and checks of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.ids import row_digest


def contract(df: DataFrame, name: str, key: str, required: list[str]) -> DataFrame:
    """One row: rows, repeated keys and missing values of a table."""
    missing: list[Column] = [F.count_if(F.col(c).isNull()).alias("missing_" + c) for c in required]
    per_key = df.groupBy(key).agg(F.count("*").alias("n"), *missing)
    total = [F.sum("missing_" + c).alias("m_" + c) for c in required]
    one = per_key.agg(F.sum("n").alias("rows"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("repeated_keys"), *total)
    return one.select(F.lit(name).alias("table_name"), F.coalesce("rows", F.lit(0)).alias("rows"), "repeated_keys", F.coalesce(sum((F.col("m_" + c) for c in required), F.lit(0)), F.lit(0)).alias("missing_values"))


def dangling(refs: DataFrame, owner: str, ids: str, targets: DataFrame, target_id: str) -> DataFrame:
    """``owner, ref`` of every referenced id that no target has."""
    return refs.select(owner, F.explode(ids).alias("ref")).distinct().join(targets.select(F.col(target_id).alias("ref")), "ref", "left_anti")


def digest(df: DataFrame, name: str) -> DataFrame:
    """An order-free digest of a table: rows, and the sums of two halves of the row digests, so that a change of any row changes both."""
    d = df.select(row_digest(*[F.col(c) for c in sorted(df.columns)]).alias("d"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("d", at, 14), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return d.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), part(1).alias("low_sum"), part(33).alias("high_sum"))


def outside_domain(df: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """``key, column`` of rows whose value isn't one of those allowed; null is none."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(key, column)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
