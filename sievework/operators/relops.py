"""Relational operators composed of joins, aggregations and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import written

#: Values that a dimension of a grid may have.
GRID_SIDE = 10_000
#: Tables of at most so many rows are sent to every executor; callers count before they ask.
SMALL_ROWS, SMALL_BYTES = 100_000, 32_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it is small in rows and bytes when looked at, else as it is."""
    seen = df.limit(SMALL_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if seen[0] <= SMALL_ROWS and seen[1] <= SMALL_BYTES else df


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order, by aggregation: rows combine before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def duplicates_flagged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every row with ``copy_no`` (1 for the first) and ``is_copy``."""
    return running(df, keys, order, [F.lit(1).alias("copy_no")]).withColumn("is_copy", F.col("copy_no") > 1)


def running(df: DataFrame, keys: list[str], order: list[Column], values: list[Column]) -> DataFrame:
    """``df`` with each of ``values`` (named columns) summed from the first row of its key to this one, by a total order.

    Rows are range-partitioned by key and order, so a key of very many rows lies in several parts side by side. Sums run within each part of a key; what the parts
    before it hold is added from a table of one row for each key and part. No task holds more of a key than its part.
    """
    names = df.select(*values).columns
    parts = df.select("*", *values).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "parts")
    held = parts.groupBy(*keys, "_part").agg(*[F.sum(n).alias("_in_" + n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a key
    before = held.select(*keys, "_part", *[F.coalesce(F.sum("_in_" + n).over(earlier), F.lit(0)).alias("_before_" + n) for n in names])
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.select("*", *[F.sum(n).over(within).alias("_sum_" + n) for n in names])
    same = [F.col("x." + k).eqNullSafe(F.col("y." + k)) for k in [*keys, "_part"]]
    out = out.alias("x").join(before.alias("y"), reduce(lambda a, b: a & b, same))
    return out.select(*[F.col("x." + c) for c in df.columns], *[(F.col("_sum_" + n) + F.col("_before_" + n)).alias(n) for n in names])


def last_writer(facts: DataFrame, content: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Left join on a composite key, where of several rows of a key the last by ``order`` counts."""
    last = content.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
    return facts.join(last, keys, "left")


def modal_value(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """The most frequent value of each key; ties go to the shorter, then the smaller one. Two aggregations, no window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max("n").alias(alias + "_count"), F.min_by(value, F.struct((-F.col("n")).alias("n"), F.length(value), value)).alias(alias))


def set_rollup(df: DataFrame, keys: list[str], sets: list[str], sums: list[str] = []) -> DataFrame:  # noqa: B006
    """Row count, sums and the sorted distinct values of each set column, joined by " | "."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " | ").alias(c + "_set")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in sums], *[joined(c) for c in sets])


def coverage_grid(facts: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, count: Column, alias: str) -> DataFrame:
    """Every pair of two dimensions with its count, 0 where there is none. Their product is the result, so both must be small: a larger one fails."""
    few = [d.select(k).distinct() for d, k in ((left, left_key), (right, right_key))]
    for d in few:
        if d.limit(GRID_SIDE + 1).count() > GRID_SIDE:
            raise ValueError(f"a dimension of more than {GRID_SIDE} values")
    grid = few[0].crossJoin(F.broadcast(few[1]))
    counts = facts.groupBy(left_key, right_key).agg(count.alias(alias))
    return grid.join(counts, [left_key, right_key], "left").fillna(0, [alias])


def full_compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join of two rankings: both values, the delta and the kind of change."""
    o, n = old.select(key, F.col(value).alias("old_" + value)), new.select(key, F.col(value).alias("new_" + value))
    a, b = F.col("old_" + value), F.col("new_" + value)
    kind = F.when(a.isNull(), "ENTERED").when(b.isNull(), "EXITED").when(a == b, "UNCHANGED").when(b < a, "UP").otherwise("DOWN")
    return o.join(n, key, "full").withColumn("delta", a - b).withColumn("change", kind)


def shared_values(df: DataFrame, owner: str, value: str, least: int = 2) -> DataFrame:
    """Values held by several owners, with the owners' number."""
    pairs = df.where(F.col(value).isNotNull()).select(owner, value).distinct()
    return pairs.groupBy(value).agg(F.count("*").alias("owners"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner")).where(F.col("owners") >= least)


def fallback_join(facts: DataFrame, targets: DataFrame, target_id: str, keys: list[str]) -> DataFrame:
    """Each fact with the target of its first key that names exactly one target, and which key that was.

    Both sides carry the key columns. Keys that name several targets match nothing, so no join multiplies rows.
    """
    out, hit, how = facts, F.lit(None), F.lit(None)
    for k in keys:
        one = targets.where(F.coalesce(F.col(k), F.lit("")) != "").groupBy(k).agg(F.min(target_id).alias("_lo"), F.max(target_id).alias("_hi")).where("_lo = _hi").select(k, F.col("_lo").alias("_by_" + k))
        out = out.join(one, k, "left")
        hit, how = F.coalesce(hit, F.col("_by_" + k)), F.coalesce(how, F.when(F.col("_by_" + k).isNotNull(), F.lit(k)))
    return out.withColumn("target", hit).withColumn("matched_by", F.coalesce(how, F.lit("none"))).drop(*["_by_" + k for k in keys])


def checked_join(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Inner join that fails the job on a fact without its dimension row."""
    marked = facts.join(dimension.withColumn("_there", F.lit(True)), key, "left")
    ok = F.assert_true(F.col("_there"), F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return marked.withColumn("_ok", ok).where(F.col("_ok").isNull()).drop("_there", "_ok")


def prefix_pairs(names: DataFrame, key: str, least: int) -> DataFrame:
    """``short, long`` of distinct keys of at least ``least`` characters, one the start of the other, by an equi-join on prefixes."""
    k = names.select(F.col(key).alias("long")).where(F.length("long") >= least).distinct()
    starts = k.select("long", F.explode(F.sequence(F.lit(least), F.length("long"))).alias("n")).select("long", F.substring("long", F.lit(1), F.col("n")).alias("short")).where("short != long")
    return starts.join(k.select(F.col("long").alias("short")), "short")


def ranked(df: DataFrame, order: list[Column], top: int, rank: str = "rank") -> DataFrame:
    """The first ``top`` rows by a total order, numbered. The limit comes first, so the window sees ``top`` rows."""
    first = df.orderBy(*order).limit(top)
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps ``n`` rows a group before the shuffle (WindowGroupLimit)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def fan_out(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Each row once for each distinct alias of its key."""
    return rows.join(aliases.select(key, "alias").distinct(), key)
