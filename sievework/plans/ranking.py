"""Queries of windows, scores, ranks and top-k. Weights are generic parameters of the score builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators import relops
from sievework.plans.registry import query
from sievework.session import table

# Points by source level, in the ranking of harvested names and in that of cleaned candidates.
HARVEST_POINTS = {"A": 5, "B": 4, "C": 3, "D": 1, "E": 0}
HYGIENE_POINTS = {"A": 25, "B": 20, "C": 12, "D": 5, "E": 0}


def level_points(level: Column, points: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in points.items()], F.lit(0))


def points_sql(level: str, points: dict[str, int]) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in points.items()) + " ELSE 0 END"


def capped_two_level(m: DataFrame, entity: str, group: str, weight: Column, cap: int, alias: str) -> DataFrame:
    """The best weight in each group, summed over an entity's groups and capped."""
    return m.groupBy(entity, group).agg(F.max(weight).alias("_w")).groupBy(entity).agg(F.least(F.lit(cap), F.sum("_w")).alias(alias))


def says_year(year: int) -> str:
    return f"(^|[^0-9A-Za-z_]){year}($|[^0-9A-Za-z_])"


_SCORED = f"""
WITH m AS (SELECT normalized_name AS entity, raw_name, domain, region_code, lang, {points_sql('source_level', HARVEST_POINTS)} AS w, coalesce(url, '') || ' ' || coalesce(context, '') AS said
    FROM raw_brand_mentions WHERE classification = 'IPTV_SERVICE_CANDIDATE' AND normalized_name <> ''),
q AS (SELECT entity, least(25, sum(w)) AS quality_points FROM (SELECT entity, domain, max(w) AS w FROM m GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT entity, arg_min(raw_name, struct_pack(n := -n, l := length(raw_name), r := raw_name)) AS canonical_name FROM (SELECT entity, raw_name, count(*) AS n FROM m WHERE raw_name IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT entity, count(DISTINCT domain) AS domains, count(*) AS mentions, least(50, 10 * count(DISTINCT domain)) AS domain_points,
    CASE WHEN bool_or(regexp_matches(said, '{says_year(2026)}')) THEN 15 WHEN bool_or(regexp_matches(said, '{says_year(2025)}')) THEN 10 ELSE 5 END AS recency_points,
    least(10, round_even(count(DISTINCT region_code) * 2.5::DOUBLE + count(DISTINCT lang) * 2.5::DOUBLE, 0))::BIGINT AS diversity_points FROM m GROUP BY 1)
SELECT entity, coalesce(canonical_name, entity) AS canonical_name, domains, mentions, domain_points::BIGINT AS domain_points, quality_points::BIGINT AS quality_points, recency_points::BIGINT AS recency_points, diversity_points,
    least(100, domain_points + quality_points + recency_points + diversity_points)::BIGINT AS score FROM s JOIN q USING (entity) LEFT JOIN v USING (entity)"""
_ORDER = "score DESC, domains DESC, mentions DESC, lower(canonical_name), entity"


def best_first() -> list[Column]:
    return [F.desc("score"), F.desc("domains"), F.desc("mentions"), F.lower("canonical_name"), F.asc("entity")]


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Entities with the points of their score: distinct domains, best level by domain, the latest year that is named, regions and languages."""
    m = table(spark, d, "raw_brand_mentions").where("classification = 'IPTV_SERVICE_CANDIDATE' AND normalized_name != ''").withColumnRenamed("normalized_name", "entity")
    quality = capped_two_level(m, "entity", "domain", level_points(F.col("source_level"), HARVEST_POINTS), 25, "quality_points")
    said = F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("context", F.lit("")))
    s = m.groupBy("entity").agg(F.count_distinct("domain").alias("domains"), F.count_distinct("region_code").alias("regions"), F.count_distinct("lang").alias("langs"), F.count("*").alias("mentions"),
                                F.bool_or(said.rlike(says_year(2026))).alias("y26"), F.bool_or(said.rlike(says_year(2025))).alias("y25"))
    name = relops.modal_value(m, ["entity"], "raw_name", "canonical_name")
    points = s.select("entity", "domains", "mentions", F.least(F.lit(50), 10 * F.col("domains")).alias("domain_points"), F.when(F.col("y26"), 15).when(F.col("y25"), 10).otherwise(5).cast("bigint").alias("recency_points"),
                      F.least(F.lit(10), F.bround(F.col("regions") * 2.5 + F.col("langs") * 2.5)).cast("bigint").alias("diversity_points"))
    out = points.join(quality, "entity").join(name.select("entity", "canonical_name"), "entity", "left")
    total = F.col("domain_points") + F.col("quality_points") + F.col("recency_points") + F.col("diversity_points")
    return out.select("entity", F.coalesce("canonical_name", "entity").alias("canonical_name"), "domains", "mentions", "domain_points", F.col("quality_points").cast("bigint").alias("quality_points"), "recency_points", "diversity_points",
                      F.least(F.lit(100), total).cast("bigint").alias("score"))


@query(f"""
SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, * FROM ({_SCORED}) ORDER BY rank LIMIT 50""")
def harvest_ranking_top50(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: entities by capped points for domains, best levels, recency and diversity."""
    return relops.ranked(scored(spark, d), best_first(), 50)


@query(f"""
WITH s AS ({_SCORED}), top AS (SELECT max(domains) AS md, max(mentions) AS mm FROM s)
SELECT entity, round_even(60.0::DOUBLE * domains / md + 40.0::DOUBLE * mentions / mm, 6) AS diagnostic FROM s CROSS JOIN top""")
def diagnostic_score(spark: SparkSession, d: str) -> DataFrame:
    """Components as shares of their maximum, weighted; the maxima are one row, joined to all."""
    s = scored(spark, d)
    top = s.agg(F.max("domains").alias("md"), F.max("mentions").alias("mm"))
    return s.crossJoin(F.broadcast(top)).select("entity", F.bround(60.0 * F.col("domains") / F.col("md") + 40.0 * F.col("mentions") / F.col("mm"), 6).alias("diagnostic"))


@query("""
SELECT brand_id, canonical_brand, round_even(source_count + 2 * len(coalesce(domains, [])) + 1.5 * len(coalesce(platforms, [])) + 0.5::DOUBLE * least(len(coalesce(evidence_urls, [])), 25), 2)::DOUBLE AS recurrence,
    CASE WHEN source_count >= 6 AND len(coalesce(domains, [])) >= 3 AND len(coalesce(platforms, [])) >= 2 THEN 'HIGH' WHEN (source_count >= 3 AND len(coalesce(domains, [])) >= 2) OR (len(coalesce(evidence_urls, [])) >= 3 AND len(coalesce(domains, [])) >= 2) THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM brand_accumulators""")
def recurrence_score(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    b = table(spark, d, "brand_accumulators").withColumns({"nd": n("domains"), "np": n("platforms"), "nu": n("evidence_urls")})
    score = F.col("source_count") + 2 * F.col("nd") + 1.5 * F.col("np") + 0.5 * F.least("nu", F.lit(25))
    conf = F.when((F.col("source_count") >= 6) & (F.col("nd") >= 3) & (F.col("np") >= 2), "HIGH").when(((F.col("source_count") >= 3) & (F.col("nd") >= 2)) | ((F.col("nu") >= 3) & (F.col("nd") >= 2)), "MEDIUM").otherwise("LOW")
    return b.select("brand_id", "canonical_brand", F.bround(score, 2).alias("recurrence"), conf.alias("confidence"))


@query("""
SELECT result_row_id, row_number() OVER (PARTITION BY result_id ORDER BY retrieved_at, result_row_id) AS copy_no, row_number() OVER (PARTITION BY result_id ORDER BY retrieved_at, result_row_id) > 1 AS is_copy FROM search_results WHERE result_id IS NOT NULL""")
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").where("result_id IS NOT NULL").select("result_row_id", "result_id", "retrieved_at")
    return relops.duplicates_flagged(r, ["result_id"], [F.col("retrieved_at"), F.col("result_row_id")]).select("result_row_id", "copy_no", "is_copy")


@query("""
SELECT result_id, arg_min(result_row_id, struct_pack(t := retrieved_at, i := result_row_id)) AS result_row_id, min(retrieved_at) AS retrieved_at FROM search_results WHERE result_id IS NOT NULL GROUP BY 1""")
def dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").where("result_id IS NOT NULL").select("result_id", "result_row_id", "retrieved_at")
    return relops.first_per_key(r, ["result_id"], [F.col("retrieved_at"), F.col("result_row_id")])


@query("""
SELECT result_row_id, duplicate_key, count(*) OVER (PARTITION BY duplicate_key) AS group_size FROM search_results WHERE duplicate_key IS NOT NULL""")
def dup_group_size(spark: SparkSession, d: str) -> DataFrame:
    """Group sizes by aggregation and join, so a hot group isn't buffered by a window."""
    r = table(spark, d, "search_results").where("duplicate_key IS NOT NULL").select("result_row_id", "duplicate_key")
    return r.join(r.groupBy("duplicate_key").agg(F.count("*").alias("group_size")), "duplicate_key")


@query("""
SELECT canonical_hostname, result_row_id, place FROM (SELECT canonical_hostname, result_row_id, row_number() OVER (PARTITION BY canonical_hostname ORDER BY tavily_score DESC NULLS LAST, result_row_id) AS place FROM search_results WHERE canonical_hostname IS NOT NULL) WHERE place <= 3""")
def top_pages_per_host(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").where("canonical_hostname IS NOT NULL").select("canonical_hostname", "result_row_id", "tavily_score")
    return relops.top_per_group(r, ["canonical_hostname"], [F.desc_nulls_last("tavily_score"), F.col("result_row_id")], 3).drop("tavily_score")


@query("""
WITH p AS (SELECT q.plan_seq, r.canonical_hostname AS h FROM search_results r JOIN query_plan q USING (query_id) WHERE r.canonical_hostname IS NOT NULL),
f AS (SELECT h, min(plan_seq) AS plan_seq FROM p GROUP BY 1), n AS (SELECT plan_seq, count(*) AS fresh FROM f GROUP BY 1), a AS (SELECT plan_seq, count(DISTINCT h) AS hosts FROM p GROUP BY 1)
SELECT plan_seq, hosts, coalesce(fresh, 0) AS fresh, sum(coalesce(fresh, 0)) OVER (ORDER BY plan_seq)::BIGINT AS seen, (sum(coalesce(fresh, 0)) OVER (ORDER BY plan_seq ROWS 2 PRECEDING))::BIGINT AS fresh_last_3
FROM a LEFT JOIN n USING (plan_seq)""")
def running_novelty(spark: SparkSession, d: str) -> DataFrame:
    """New hosts by step of the plan, running and over the last three steps. The windows run over the plan's steps only."""
    p = table(spark, d, "search_results").where("canonical_hostname IS NOT NULL").join(relops.small(table(spark, d, "query_plan").select("query_id", "plan_seq")), "query_id").groupBy("plan_seq", F.col("canonical_hostname").alias("h")).agg(F.lit(1).alias("x"))
    a = p.groupBy("plan_seq").agg(F.count("*").alias("hosts"))
    n = p.groupBy("h").agg(F.min("plan_seq").alias("plan_seq")).groupBy("plan_seq").agg(F.count("*").alias("fresh"))
    w = Window.partitionBy(F.lit(1)).orderBy("plan_seq")
    r = a.join(n, "plan_seq", "left").fillna(0, ["fresh"])
    return r.select("plan_seq", "hosts", "fresh", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"), F.sum("fresh").over(w.rowsBetween(-2, 0)).alias("fresh_last_3"))


@query("""
WITH c AS (SELECT domain, count(*) AS n, count(DISTINCT normalized_name) AS names FROM raw_brand_mentions WHERE domain IS NOT NULL AND source_level IN ('A', 'B', 'C') GROUP BY 1),
r AS (SELECT domain, names, row_number() OVER (ORDER BY names DESC, n DESC, domain) AS rank FROM c)
SELECT domain, names, rank, (rank - 1) // 20 AS batch FROM r WHERE rank <= 60""")
def selection_batches(spark: SparkSession, d: str) -> DataFrame:
    """The 60 best domains in batches of 20."""
    m = table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL AND source_level IN ('A', 'B', 'C')")
    c = m.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("normalized_name").alias("names"))
    return relops.ranked(c, [F.desc("names"), F.desc("n"), F.asc("domain")], 60).select("domain", "names", "rank", F.expr("(rank - 1) div 20").alias("batch"))
