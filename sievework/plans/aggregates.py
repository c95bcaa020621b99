"""Queries of aggregations: rollups, votes, matrices, grids, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.numbers import ratio
from sievework.operators import relops
from sievework.plans.registry import query
from sievework.session import table

LEVELS = ("A", "B", "C", "D", "E")


@query("""
SELECT normalized_name, count(*) AS rows, array_to_string(list_sort(list(DISTINCT region_code)), ' | ') AS region_code_set, array_to_string(list_sort(list(DISTINCT source_level)), ' | ') AS source_level_set
FROM (SELECT normalized_name, region_code, source_level FROM raw_brand_mentions WHERE normalized_name IS NOT NULL) GROUP BY 1""")
def set_rollup_entities(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "raw_brand_mentions").where("normalized_name IS NOT NULL")
    return relops.set_rollup(m, ["normalized_name"], ["region_code", "source_level"])


@query("""
WITH b AS (SELECT canonical_brand, source_count, original_rows, latest_published_date, unnest(CASE WHEN len(domains) > 0 THEN domains ELSE [NULL] END) AS dom, brand_id FROM brand_accumulators),
s AS (SELECT canonical_brand, sum(source_count)::BIGINT AS sources, sum(original_rows)::BIGINT AS merged_rows, max(nullif(latest_published_date, '')) AS latest, count(*) AS parts FROM brand_accumulators GROUP BY 1),
n AS (SELECT canonical_brand, count(DISTINCT dom) AS domains FROM b GROUP BY 1)
SELECT * FROM s JOIN n USING (canonical_brand)""")
def merged_brands(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one brand merged: sums, the latest date and the size of the union of its domains."""
    b = table(spark, d, "brand_accumulators")
    one = b.groupBy("canonical_brand").agg(F.sum("source_count").alias("sources"), F.sum("original_rows").alias("merged_rows"), F.max(F.when(F.col("latest_published_date") != "", F.col("latest_published_date"))).alias("latest"), F.count("*").alias("parts"))
    doms = b.select("canonical_brand", F.explode_outer("domains").alias("dom")).groupBy("canonical_brand").agg(F.count_distinct("dom").alias("domains"))
    return one.join(doms, "canonical_brand")


@query("""
SELECT normalized_name, arg_min(raw_name, struct_pack(n := -n, l := length(raw_name), r := raw_name)) AS raw_name, max(n) AS raw_name_count
FROM (SELECT normalized_name, raw_name, count(*) AS n FROM raw_brand_mentions WHERE normalized_name IS NOT NULL AND raw_name IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "raw_brand_mentions").where("normalized_name IS NOT NULL")
    return relops.modal_value(m, ["normalized_name"], "raw_name", "raw_name")


@query("""
SELECT domain, arg_min(region_code, struct_pack(n := -n, l := length(region_code), r := region_code)) AS region_code, max(n) AS region_code_count
FROM (SELECT domain, region_code, count(*) AS n FROM raw_brand_mentions WHERE domain IS NOT NULL AND region_code IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def modal_region(spark: SparkSession, d: str) -> DataFrame:
    return relops.modal_value(table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL"), ["domain"], "region_code", "region_code")


@query("""
SELECT normalized_name, domain, min(source_level) AS best_level, count(*) AS mentions, count(DISTINCT page_row_id) AS pages FROM raw_brand_mentions WHERE normalized_name IS NOT NULL AND domain IS NOT NULL GROUP BY 1, 2""")
def matrix_entity_domain(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "raw_brand_mentions").where("normalized_name IS NOT NULL AND domain IS NOT NULL")
    return m.groupBy("normalized_name", "domain").agg(F.min("source_level").alias("best_level"), F.count("*").alias("mentions"), F.count_distinct("page_row_id").alias("pages"))


@query("""
SELECT r.region_code, l.lang, count(m.mention_row_id) AS mentions FROM (SELECT DISTINCT region_code FROM query_plan) r CROSS JOIN (SELECT DISTINCT lang FROM query_plan) l
LEFT JOIN raw_brand_mentions m ON m.region_code = r.region_code AND m.lang = l.lang GROUP BY 1, 2""")
def coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_plan")
    return relops.coverage_grid(table(spark, d, "raw_brand_mentions"), q, q, "region_code", "lang", F.count("*"), "mentions")


@query("""
SELECT v.l AS source_level, count(m.mention_row_id) AS mentions, count(DISTINCT m.domain) AS domains FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) LEFT JOIN raw_brand_mentions m ON m.source_level = v.l GROUP BY 1""")
def quality_levels_dense(spark: SparkSession, d: str) -> DataFrame:
    """Every level with its numbers, also those that no row has."""
    levels = spark.createDataFrame([(x,) for x in LEVELS], "source_level string")
    m = table(spark, d, "raw_brand_mentions").groupBy("source_level").agg(F.count("*").alias("mentions"), F.count_distinct("domain").alias("domains"))
    return levels.join(m, "source_level", "left").fillna(0, ["mentions", "domains"])


@query("""
SELECT canonical_hostname, count(*) AS captures, count(DISTINCT canonical_url) AS pages, count(DISTINCT query_id) AS queries, count_if(is_duplicate) AS flagged,
    sum(round(tavily_score * 1000000)::BIGINT)::BIGINT // nullif(count(tavily_score), 0) AS mean_score_millionths, arg_max(query_id, struct_pack(s := coalesce(tavily_score, -1), i := -result_row_id)) AS best_query
FROM search_results WHERE canonical_hostname IS NOT NULL GROUP BY 1""")
def domain_productivity(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").where("canonical_hostname IS NOT NULL")
    return r.groupBy("canonical_hostname").agg(
        F.count("*").alias("captures"), F.count_distinct("canonical_url").alias("pages"), F.count_distinct("query_id").alias("queries"), F.count_if("is_duplicate").alias("flagged"),
        F.expr("sum(cast(round(tavily_score * 1000000) as bigint)) div nullif(count(tavily_score), 0)").alias("mean_score_millionths"), F.max_by("query_id", F.struct(F.coalesce("tavily_score", F.lit(-1.0)).alias("s"), (-F.col("result_row_id")).alias("i"))).alias("best_query"))


@query("""
SELECT domain, count(DISTINCT normalized_name) AS owners, min(normalized_name) AS first_owner, max(normalized_name) AS last_owner FROM raw_brand_mentions
WHERE domain IS NOT NULL AND normalized_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT normalized_name) >= 2""")
def shared_signals(spark: SparkSession, d: str) -> DataFrame:
    return relops.shared_values(table(spark, d, "raw_brand_mentions").where("normalized_name IS NOT NULL"), "normalized_name", "domain")


@query("""
SELECT classification, count_if(source_level = 'A') AS "A", count_if(source_level = 'B') AS "B", count_if(source_level = 'C') AS "C", count_if(source_level = 'D') AS "D", count_if(source_level = 'E') AS "E" FROM raw_brand_mentions GROUP BY 1""")
def class_by_level(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_brand_mentions").groupBy("classification").pivot("source_level", list(LEVELS)).count().fillna(0, list(LEVELS))


@query("""
WITH a AS (SELECT DISTINCT candidate_id, final_classification AS now FROM candidate_hygiene_audit), b AS (SELECT DISTINCT candidate_id, final_classification AS before FROM corrected_name_variants)
SELECT coalesce(before, 'ABSENT') AS before, coalesce(now, 'ABSENT') AS now, count(*) AS candidates FROM a FULL JOIN b USING (candidate_id) GROUP BY 1, 2""")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "candidate_hygiene_audit").select("candidate_id", F.col("final_classification").alias("now")).distinct()
    b = table(spark, d, "corrected_name_variants").select("candidate_id", F.col("final_classification").alias("before")).distinct()
    absent = lambda c: F.coalesce(c, F.lit("ABSENT")).alias(c)
    return a.join(b, "candidate_id", "full").groupBy(absent("before"), absent("now")).agg(F.count("*").alias("candidates"))


@query("""
SELECT 'kept' AS metric, count_if(NOT is_duplicate) AS numerator, count(*) AS denominator, round_even(count_if(NOT is_duplicate) / nullif(count(*), 0)::DOUBLE, 6) AS value FROM search_results
UNION ALL SELECT 'scored', count(tavily_score), count(*), round_even(count(tavily_score) / nullif(count(*), 0)::DOUBLE, 6) FROM search_results
UNION ALL SELECT 'negative_kept', count_if(tavily_score < 0 AND NOT is_duplicate), count_if(tavily_score < 0), round_even(count_if(tavily_score < 0 AND NOT is_duplicate) / nullif(count_if(tavily_score < 0), 0)::DOUBLE, 6) FROM search_results""")
def precision_noise(spark: SparkSession, d: str) -> DataFrame:
    """Rates with their parts; a rate over nothing is null. One scan for all."""
    r = table(spark, d, "search_results").agg(F.count_if(~F.col("is_duplicate")).alias("a"), F.count("tavily_score").alias("b"), F.count("*").alias("n"), F.count_if((F.col("tavily_score") < 0) & ~F.col("is_duplicate")).alias("c"), F.count_if(F.col("tavily_score") < 0).alias("z"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), x.cast("bigint").alias("numerator"), y.cast("bigint").alias("denominator")) for m, x, y in (("kept", F.col("a"), F.col("n")), ("scored", F.col("b"), F.col("n")), ("negative_kept", F.col("c"), F.col("z")))])
    return r.select(F.inline(rows)).withColumn("value", F.bround(ratio(F.col("numerator"), F.col("denominator")), 6))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


@query("""
SELECT coalesce(phase, '(all)') AS phase, coalesce(query_type, '(all)') AS query_type, count(*) AS captures, grouping(phase, query_type) AS level FROM search_results GROUP BY ROLLUP (phase, query_type)""")
def capture_totals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").rollup("phase", "query_type").agg(F.count("*").alias("captures"), F.grouping_id().alias("level"))
    return r.select(F.coalesce("phase", F.lit("(all)")).alias("phase"), F.coalesce("query_type", F.lit("(all)")).alias("query_type"), "captures", "level")


@query("""
WITH m AS (SELECT normalized_name AS entity, raw_name, mention_row_id, retrieved_at, CASE source_level WHEN 'A' THEN 25 WHEN 'B' THEN 20 WHEN 'C' THEN 12 WHEN 'D' THEN 5 ELSE 0 END AS w FROM raw_brand_mentions WHERE normalized_name IS NOT NULL AND raw_name IS NOT NULL),
v AS (SELECT entity, raw_name, count(*) AS n, sum(w) AS w FROM m GROUP BY 1, 2)
SELECT entity, (SELECT arg_min(raw_name, struct_pack(t := retrieved_at, i := mention_row_id)) FROM m x WHERE x.entity = v.entity) AS first_name,
    arg_min(raw_name, struct_pack(w := -w, n := -n, l := length(raw_name), r := raw_name)) AS weighted_name, max(w)::BIGINT AS weight, count(*) AS spellings FROM v GROUP BY 1""")
def display_name_votes(spark: SparkSession, d: str) -> DataFrame:
    """The name an entity is shown by: the one seen first, and the one with most points of its sources' levels."""
    from sievework.plans.ranking import HYGIENE_POINTS, level_points

    m = table(spark, d, "raw_brand_mentions").where("normalized_name IS NOT NULL AND raw_name IS NOT NULL").withColumnRenamed("normalized_name", "entity")
    first = m.groupBy("entity").agg(F.min_by("raw_name", F.struct("retrieved_at", "mention_row_id")).alias("first_name"))
    v = m.groupBy("entity", "raw_name").agg(F.count("*").alias("n"), F.sum(level_points(F.col("source_level"), HYGIENE_POINTS)).alias("w"))
    best = v.groupBy("entity").agg(F.min_by("raw_name", F.struct((-F.col("w")).alias("w"), (-F.col("n")).alias("n"), F.length("raw_name").alias("l"), "raw_name")).alias("weighted_name"), F.max("w").alias("weight"), F.count("*").alias("spellings"))
    return first.join(best, "entity").select("entity", "first_name", "weighted_name", "weight", "spellings")


@query("""
SELECT domain, arg_min(region_code, struct_pack(n := -n, r := region_code, l := lang)) AS region_code, arg_min(lang, struct_pack(n := -n, r := region_code, l := lang)) AS lang, max(n) AS mentions, sum(n)::BIGINT AS all_mentions
FROM (SELECT domain, region_code, lang, count(*) AS n FROM raw_brand_mentions WHERE domain IS NOT NULL AND region_code IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1""")
def modal_region_language(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent pair of region and language of each domain."""
    m = table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL AND region_code IS NOT NULL AND lang IS NOT NULL").groupBy("domain", "region_code", "lang").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "region_code", "lang")
    return m.groupBy("domain").agg(F.min_by("region_code", order).alias("region_code"), F.min_by("lang", order).alias("lang"), F.max("n").alias("mentions"), F.sum("n").alias("all_mentions"))
