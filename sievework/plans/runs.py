"""Queries of runs: operation states, resuming, invariants of what was run, deduplication that goes on from earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.ids import told_apart
from sievework.functions.numbers import truthy
from sievework.operators import relops
from sievework.plans.registry import query
from sievework.session import table
from sievework.streaming import ledger


@query("""
WITH f AS (SELECT user_id, min(struct_pack(t := ts, i := event_id)) AS done FROM events WHERE event_type = 'purchase' GROUP BY 1),
e AS (SELECT x.* FROM events x LEFT JOIN f USING (user_id) WHERE done IS NULL OR struct_pack(t := ts, i := event_id) <= done),
s AS (SELECT user_id, count(*) AS attempts, count_if(event_type = 'error') AS failures, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last FROM e GROUP BY 1)
SELECT user_id, attempts, failures, CASE WHEN last = 'purchase' THEN 'COMPLETED' WHEN failures > 1 THEN 'FAILED' WHEN last = 'error' THEN 'PENDING_RETRY' ELSE 'ATTEMPT_RESERVED' END AS state FROM s""")
def operation_states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's operation: done with a purchase, failed after more than one error before it."""
    return ledger.operation_states(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "error", "purchase")


#: A run's log is what came in within this time; what came later isn't in its checkpoint.
LATE_S = 86_400


def _checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """``query_id, result_count`` as a run had it when it stopped."""
    lag = F.unix_seconds(F.date_trunc("second", "ingested_at").cast("timestamp")) - F.unix_seconds(F.date_trunc("second", "retrieved_at").cast("timestamp"))
    return table(spark, d, "search_results").where("query_id IS NOT NULL").where(lag <= LATE_S).groupBy("query_id").agg(F.count("*").alias("result_count"))


_CHECKPOINT = f"SELECT query_id, count(*) AS result_count FROM search_results WHERE query_id IS NOT NULL AND date_diff('second', retrieved_at, ingested_at) <= {LATE_S} GROUP BY 1"


@query(f"""
WITH c AS ({_CHECKPOINT}), r AS (SELECT query_id, count(*) AS raw FROM search_results GROUP BY 1)
SELECT q.query_id, q.plan_seq, coalesce(raw, 0) AS raw_rows, coalesce(result_count, 0) AS checkpoint_rows, CASE WHEN result_count IS NULL THEN 'RUN' WHEN result_count = raw THEN 'SKIP' ELSE 'MERGE' END AS action
FROM query_plan q LEFT JOIN c USING (query_id) LEFT JOIN r USING (query_id)""")
def resume_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed run does with each planned query: skip what is complete, merge what has rows the checkpoint doesn't know, run the rest."""
    raw = table(spark, d, "search_results").groupBy("query_id").agg(F.count("*").alias("raw"))
    p = table(spark, d, "query_plan").select("query_id", "plan_seq").join(_checkpoint(spark, d), "query_id", "left").join(raw, "query_id", "left")
    action = F.when(F.col("result_count").isNull(), "RUN").when(F.col("result_count") == F.col("raw"), "SKIP").otherwise("MERGE")
    return p.select("query_id", "plan_seq", F.coalesce("raw", F.lit(0)).alias("raw_rows"), F.coalesce("result_count", F.lit(0)).alias("checkpoint_rows"), action.alias("action"))


def invariants(plan: DataFrame, raw: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """``invariant, violations``: raw rows of no planned query, raw rows of a query the checkpoint doesn't have, counts that differ, checkpoint entries without plan."""
    r = raw.groupBy("query_id").agg(F.count("*").alias("raw"))
    all_three = plan.select("query_id", F.lit(True).alias("planned")).join(r, "query_id", "full").join(checkpoint, "query_id", "full")
    planned = F.coalesce("planned", F.lit(False))
    one = all_three.agg(F.coalesce(F.sum(F.when(~planned, F.col("raw"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col("result_count").isNull(), F.col("raw"))), F.lit(0)).alias("b"),
                        F.count_if(F.col("result_count") != F.coalesce("raw", F.lit(0))).alias("c"), F.count_if(~planned & F.col("result_count").isNotNull()).alias("e"))
    names = (("raw_rows_without_plan", "a"), ("raw_rows_without_checkpoint", "b"), ("counts_that_differ", "c"), ("checkpoints_without_plan", "e"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(c).cast("bigint").alias("violations")) for n, c in names])))


@query(f"""
WITH c AS ({_CHECKPOINT}), r AS (SELECT query_id, count(*) AS raw FROM search_results GROUP BY 1)
SELECT 'raw_rows_without_plan' AS invariant, count(*) AS violations FROM search_results s WHERE NOT EXISTS (SELECT 1 FROM query_plan q WHERE q.query_id = s.query_id)
UNION ALL SELECT 'raw_rows_without_checkpoint', count(*) FROM search_results s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = s.query_id)
UNION ALL SELECT 'counts_that_differ', count(*) FROM c LEFT JOIN r USING (query_id) WHERE result_count <> coalesce(raw, 0)
UNION ALL SELECT 'checkpoints_without_plan', count(*) FROM c WHERE query_id NOT IN (SELECT query_id FROM query_plan)""")
def resume_invariants(spark: SparkSession, d: str) -> DataFrame:
    return invariants(table(spark, d, "query_plan"), table(spark, d, "search_results").select("query_id"), _checkpoint(spark, d))


#: Steps of the plan that earlier runs have done.
EARLIER = 24


@query(f"""
WITH r AS (SELECT result_row_id, duplicate_key, plan_seq, is_duplicate FROM search_results JOIN query_plan USING (query_id) WHERE duplicate_key IS NOT NULL),
k AS (SELECT DISTINCT duplicate_key FROM r WHERE plan_seq <= {EARLIER} AND NOT is_duplicate), n AS (SELECT * FROM r WHERE plan_seq > {EARLIER}),
f AS (SELECT duplicate_key, arg_min(result_row_id, struct_pack(p := plan_seq, i := result_row_id)) AS first FROM n GROUP BY 1)
SELECT n.result_row_id, n.duplicate_key, CASE WHEN k.duplicate_key IS NOT NULL THEN 'SEEN_BEFORE' WHEN n.result_row_id = f.first THEN 'KEPT' ELSE 'REPEATED' END AS state FROM n JOIN f USING (duplicate_key) LEFT JOIN k ON k.duplicate_key = n.duplicate_key""")
def dedup_from_kept(spark: SparkSession, d: str) -> DataFrame:
    """Deduplication of later steps seeded with the keys that earlier runs kept."""
    plan = relops.small(table(spark, d, "query_plan").select("query_id", "plan_seq"))
    r = table(spark, d, "search_results").where("duplicate_key IS NOT NULL").select("query_id", "result_row_id", "duplicate_key", "is_duplicate").join(plan, "query_id")
    kept = r.where(f"plan_seq <= {EARLIER} AND NOT is_duplicate").select("duplicate_key").distinct().withColumn("seen", F.lit(True))
    new = r.where(f"plan_seq > {EARLIER}").select("result_row_id", "duplicate_key", "plan_seq")
    first = new.groupBy("duplicate_key").agg(F.min_by("result_row_id", F.struct("plan_seq", "result_row_id")).alias("first"))
    j = new.join(first, "duplicate_key").join(kept, "duplicate_key", "left")
    return j.select("result_row_id", "duplicate_key", F.when(F.col("seen"), "SEEN_BEFORE").when(F.col("result_row_id") == F.col("first"), "KEPT").otherwise("REPEATED").alias("state"))


_HASH = "sha256(length(query_id) || ':' || query_id || length({t}) || ':' || {t})"


@query(f"""
WITH r AS (SELECT DISTINCT query_id, query_text FROM search_results WHERE query_id IS NOT NULL AND query_text IS NOT NULL), p AS (SELECT query_id, {_HASH.format(t='query_text')} AS planned FROM query_plan)
SELECT r.query_id, planned, {_HASH.format(t='query_text')} AS ran, planned IS NULL OR planned <> {_HASH.format(t='query_text')} AS tampered FROM r LEFT JOIN p USING (query_id)""")
def plan_tampering(spark: SparkSession, d: str) -> DataFrame:
    """Queries as they ran against the plan, by hashes."""
    h = lambda: F.sha2(told_apart(F.col("query_id"), F.col("query_text")), 256)
    ran = table(spark, d, "search_results").where("query_id IS NOT NULL AND query_text IS NOT NULL").select("query_id", h().alias("ran")).distinct()
    plan = table(spark, d, "query_plan").select("query_id", h().alias("planned"))
    return ran.join(plan, "query_id", "left").select("query_id", "planned", "ran", (F.col("planned").isNull() | (F.col("planned") != F.col("ran"))).alias("tampered"))


@query("""
WITH l AS (SELECT query_id, canonical_url, arg_max(content, struct_pack(t := ingested_at, i := result_row_id)) AS content FROM search_results WHERE canonical_url IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2)
SELECT s.result_row_id, sha256(l.content) AS content_h, coalesce(lower(trim(mojibake)) IN ('1', 'true', 'yes', 'y'), false) AS flagged FROM (SELECT *, is_duplicate::VARCHAR AS mojibake FROM search_results) s LEFT JOIN l USING (query_id, canonical_url)""")
def last_content(spark: SparkSession, d: str) -> DataFrame:
    """Each capture with the content that was last seen of its query and address: a join on two keys where the last writer counts."""
    r = table(spark, d, "search_results")
    known = r.where("canonical_url IS NOT NULL AND query_id IS NOT NULL").select("query_id", "canonical_url", "content", "ingested_at", F.col("result_row_id").alias("i"))
    out = relops.last_writer(r.select("result_row_id", "query_id", "canonical_url", "is_duplicate"), known, ["query_id", "canonical_url"], [F.col("ingested_at"), F.col("i")], "content")
    return out.select("result_row_id", F.sha2("content", 256).alias("content_h"), truthy(F.col("is_duplicate").cast("string")).alias("flagged"))
