"""Queries of ledgers and streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import relops
from sievework.plans.registry import query
from sievework.session import shared_path, table
from sievework.streaming import ledger

_LAST = """
SELECT user_id, count(*) AS events, count_if(event_type = 'error') AS errors, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY 1"""


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    # the table may be one file or a folder of files; a stream takes the folder and a pattern
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if _is_file(spark, f"{d}/events.parquet") else "*.parquet").parquet(d if _is_file(spark, f"{d}/events.parquet") else f"{d}/events.parquet")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query(_LAST)
def ledger_last_state(spark: SparkSession, d: str) -> DataFrame:
    return ledger.last_states(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
SELECT user_id, min(ts) AS at, arg_min(event_id, struct_pack(t := ts, i := event_id)) AS event FROM (
    SELECT user_id, ts, event_id, sum((value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent > 50000 GROUP BY 1""")
def budget_violations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return ledger.over_budget(e, "user_id", ["ts", "event_id"], "cents", 50000)


@query("""
SELECT q.query_id, q.plan_seq, coalesce(n, 0) AS results, CASE WHEN n IS NULL THEN 'PENDING' WHEN scored = n THEN 'COMPLETED' ELSE 'PARTIAL' END AS state, length(q.query_text) <= 400 AS length_ok
FROM query_plan q LEFT JOIN (SELECT query_id, count(*) AS n, count(tavily_score) AS scored FROM search_results GROUP BY 1) USING (query_id)""")
def plan_states(spark: SparkSession, d: str) -> DataFrame:
    """Plan against results: the state each operation has reached."""
    r = table(spark, d, "search_results").groupBy("query_id").agg(F.count("*").alias("n"), F.count("tavily_score").alias("scored"))
    s = table(spark, d, "query_plan").join(r, "query_id", "left")
    state = F.when(F.col("n").isNull(), "PENDING").when(F.col("scored") == F.col("n"), "COMPLETED").otherwise("PARTIAL")
    return s.select("query_id", "plan_seq", F.coalesce("n", F.lit(0)).alias("results"), state.alias("state"), (F.length("query_text") <= 400).alias("length_ok"))


@query("""
WITH b AS (SELECT q.plan_seq, count(*) AS n, count_if(r.is_duplicate) AS dup FROM search_results r JOIN query_plan q USING (query_id) GROUP BY 1),
w AS (SELECT plan_seq, sum(dup) OVER x AS dups, sum(n) OVER x AS rows FROM b WINDOW x AS (ORDER BY plan_seq ROWS 2 PRECEDING))
SELECT plan_seq, dups::BIGINT AS dups, rows::BIGINT AS rows, dups > 0.05 * rows AS would_stop, plan_seq >= (SELECT coalesce(min(plan_seq), 2147483647) FROM w WHERE dups > 0.05 * rows) AS stopped FROM w""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The share of duplicates over the last three steps of the plan against a threshold, and whether a step before has stopped the run."""
    from pyspark.sql import Window

    b = table(spark, d, "search_results").join(relops.small(table(spark, d, "query_plan").select("query_id", "plan_seq")), "query_id").groupBy("plan_seq").agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("dup"))
    w = Window.partitionBy(F.lit(1)).orderBy("plan_seq").rowsBetween(-2, 0)
    s = b.select("plan_seq", F.sum("dup").over(w).alias("dups"), F.sum("n").over(w).alias("rows")).withColumn("would_stop", F.col("dups") > 0.05 * F.col("rows"))
    first = F.min(F.when(F.col("would_stop"), F.col("plan_seq"))).over(Window.partitionBy(F.lit(1)))  # one row a step of the plan
    return s.withColumn("stopped", F.coalesce(F.col("plan_seq") >= first, F.lit(False)))


@query(_LAST)
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger kept by a stateful stream, drained; the last update of each key stands."""
    path = shared_path(spark, "ledger")
    with ledger.rocksdb(spark):
        ledger.drained_updates(ledger.live_states(_stream(spark, d)), path)
    u = spark.read.parquet(path)
    return u.groupBy("user_id").agg(*[F.max_by(c, F.col("batch")).alias(c) for c in ("events", "errors", "last_type", "last_ts")])


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of the stream that the watermark has closed."""
    path = shared_path(spark, "windows")
    ledger.drained(ledger.windowed_counts(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))), path)
    return spark.read.parquet(path).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))
