"""Queries of joins, set operations and sequential deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import relops
from sievework.operators.rules import cascade
from sievework.operators.sequential import keep_in_order
from sievework.plans.registry import query
from sievework.plans.scalars import fold
from sievework.session import table

_T = f"SELECT DISTINCT brand_id, {fold('canonical_brand')} AS exact_key, replace({fold('canonical_brand')}, ' ', '') AS compact_key FROM brand_accumulators"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("canonical_brand")
    return table(spark, d, "brand_accumulators").select("brand_id", text.ascii_fold(b).alias("exact_key"), text.compact_key(b).alias("compact_key")).distinct()


@query(f"""
WITH t AS ({_T}),
e AS (SELECT exact_key, min(brand_id) AS id FROM t WHERE exact_key <> '' GROUP BY 1 HAVING count(DISTINCT brand_id) = 1),
k AS (SELECT compact_key, min(brand_id) AS id FROM t WHERE compact_key <> '' GROUP BY 1 HAVING count(DISTINCT brand_id) = 1),
m AS (SELECT mention_row_id, {fold('raw_name')} AS exact_key, replace({fold('raw_name')}, ' ', '') AS compact_key FROM raw_brand_mentions)
SELECT mention_row_id, coalesce(e.id, k.id) AS target, CASE WHEN e.id IS NOT NULL THEN 'exact_key' WHEN k.id IS NOT NULL THEN 'compact_key' ELSE 'none' END AS matched_by
FROM m LEFT JOIN e USING (exact_key) LEFT JOIN k USING (compact_key)""")
def fallback_join_unique(spark: SparkSession, d: str) -> DataFrame:
    """Mentions to brands by exact name, then by compact name, each only where it names one brand."""
    n = F.col("raw_name")
    m = table(spark, d, "raw_brand_mentions").select("mention_row_id", text.ascii_fold(n).alias("exact_key"), text.compact_key(n).alias("compact_key"))
    return relops.fallback_join(m, _targets(spark, d), "brand_id", ["exact_key", "compact_key"]).select("mention_row_id", "target", "matched_by")


@query(f"""
WITH h AS (SELECT DISTINCT {fold('canonical_brand')} AS k FROM brand_accumulators), c AS (SELECT DISTINCT replace(k, ' ', '') AS k FROM h),
v AS (SELECT DISTINCT array_to_string(list_sort(string_split(k, ' ')), ' ') AS k FROM h),
n AS (SELECT DISTINCT candidate_id, final_classification, {fold('original_name')} AS f FROM candidate_hygiene_audit)
SELECT n.candidate_id, CASE WHEN n.final_classification = 'EXCLUDED_GENERIC_TERM' THEN 'NOT_A_BRAND' WHEN h.k IS NOT NULL THEN 'EXACT' WHEN c.k IS NOT NULL THEN 'NORMALIZED' WHEN v.k IS NOT NULL THEN 'VARIANT' ELSE 'NEW' END AS novelty
FROM n LEFT JOIN h ON n.f = h.k AND n.f <> '' LEFT JOIN c ON replace(n.f, ' ', '') = c.k AND n.f <> '' LEFT JOIN v ON array_to_string(list_sort(string_split(n.f, ' ')), ' ') = v.k AND n.f <> ''""")
def novelty_classify(spark: SparkSession, d: str) -> DataFrame:
    """A priority join over three keys: the first index that knows a candidate decides."""
    h = table(spark, d, "brand_accumulators").select(text.ascii_fold(F.col("canonical_brand")).alias("k")).where("k != ''").distinct()
    index = lambda key, name: h.select(key.alias("_k")).distinct().withColumn(name, F.lit(True))
    n = table(spark, d, "candidate_hygiene_audit").select("candidate_id", "final_classification", text.ascii_fold(F.col("original_name")).alias("f")).distinct()
    by = lambda x: F.array_join(F.array_sort(F.split(x, " ")), " ")
    for key, name in ((lambda x: x, "exact"), (lambda x: F.replace(x, F.lit(" "), F.lit("")), "compact"), (by, "sorted")):
        n = n.join(index(key(F.col("k")), name), key(F.col("f")) == F.col("_k"), "left").drop("_k")
    novelty = cascade([(F.col("final_classification") == "EXCLUDED_GENERIC_TERM", "NOT_A_BRAND"), (F.col("exact"), "EXACT"), (F.col("compact"), "NORMALIZED"), (F.col("sorted"), "VARIANT")], "NEW")
    return n.select("candidate_id", novelty.alias("novelty"))


@query("""
WITH r AS (SELECT canonical_hostname AS host, count(*) AS n FROM search_results WHERE query_type = 'DISCOVERY' OR result_position <= 5 GROUP BY 1),
s AS (SELECT canonical_hostname AS host, count(*) AS n FROM search_results WHERE result_position > 5 GROUP BY 1)
SELECT host, r.n AS old_n, s.n AS new_n, r.n - s.n AS delta, CASE WHEN r.n IS NULL THEN 'ENTERED' WHEN s.n IS NULL THEN 'EXITED' WHEN r.n = s.n THEN 'UNCHANGED' WHEN s.n < r.n THEN 'UP' ELSE 'DOWN' END AS change
FROM (SELECT * FROM r WHERE host IS NOT NULL) r FULL JOIN (SELECT * FROM s WHERE host IS NOT NULL) s USING (host)""")
def full_compare_hosts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").where("canonical_hostname IS NOT NULL").withColumnRenamed("canonical_hostname", "host")
    top, rest = (r.where(w).groupBy("host").agg(F.count("*").alias("n")) for w in ("query_type = 'DISCOVERY' OR result_position <= 5", "result_position > 5"))
    return relops.full_compare(top, rest, "host", "n")


@query("""
SELECT result_row_id, q.region_code, q.lang, q.plan_seq, coalesce(q.included_in_metrics, false) AS counted FROM search_results r LEFT JOIN query_plan q USING (query_id)""")
def plan_lookup(spark: SparkSession, d: str) -> DataFrame:
    r, q = table(spark, d, "search_results").select("result_row_id", "query_id"), table(spark, d, "query_plan")
    return r.join(relops.small(q), "query_id", "left").select("result_row_id", "region_code", "lang", "plan_seq", F.coalesce("included_in_metrics", F.lit(False)).alias("counted"))


@query("""
SELECT result_row_id, query_id, q.plan_seq FROM search_results r JOIN query_plan q USING (query_id)""")
def checked_plan_join(spark: SparkSession, d: str) -> DataFrame:
    """An inner join that fails on a row whose query isn't planned."""
    r = table(spark, d, "search_results").where("query_id IS NOT NULL").select("result_row_id", "query_id")
    return relops.checked_join(r, table(spark, d, "query_plan").select("query_id", "plan_seq"), "query_id")


@query("""
SELECT DISTINCT domain FROM raw_brand_mentions WHERE domain IS NOT NULL AND domain NOT IN (SELECT canonical_hostname FROM search_results WHERE canonical_hostname IS NOT NULL)""")
def new_domains(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL").select("domain").distinct()
    return m.join(table(spark, d, "search_results").select(F.col("canonical_hostname").alias("domain")), "domain", "left_anti")


@query("""
SELECT result_row_id, length(raw_content) AS size FROM search_results WHERE result_row_id IN (SELECT page_row_id FROM raw_brand_mentions WHERE evidence_type IS NOT NULL AND source_level IN ('A', 'B'))""")
def evidence_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a mention of a good source: a semi join."""
    m = table(spark, d, "raw_brand_mentions").where("evidence_type IS NOT NULL AND source_level IN ('A', 'B')").select(F.col("page_row_id").alias("result_row_id"))
    return table(spark, d, "search_results").join(m, "result_row_id", "left_semi").select("result_row_id", F.length("raw_content").alias("size"))


@query(f"""
WITH a AS (SELECT DISTINCT canonical_brand, unnest(aliases) AS alias FROM brand_accumulators), f AS (SELECT DISTINCT canonical_brand, {fold('alias')} AS k FROM a)
SELECT DISTINCT mention_row_id, canonical_brand FROM (SELECT mention_row_id, {fold('raw_name')} AS k FROM raw_brand_mentions) JOIN f USING (k) WHERE k <> ''""")
def alias_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Each mention once for each brand that has its name for an alias."""
    a = table(spark, d, "brand_accumulators").select("canonical_brand", F.explode("aliases").alias("a")).select(F.col("canonical_brand").alias("alias"), text.ascii_fold(F.col("a")).alias("k"))
    m = table(spark, d, "raw_brand_mentions").select("mention_row_id", text.ascii_fold(F.col("raw_name")).alias("k")).where("k != ''")
    return relops.fan_out(m, a, "k").select("mention_row_id", F.col("alias").alias("canonical_brand")).distinct()


@query("""
WITH k AS (SELECT DISTINCT canonical_key AS k FROM candidate_hygiene_audit WHERE length(canonical_key) >= 6)
SELECT a.k AS short, b.k AS long FROM k a JOIN k b ON starts_with(b.k, a.k) AND a.k <> b.k""")
def prefix_homonyms(spark: SparkSession, d: str) -> DataFrame:
    return relops.prefix_pairs(table(spark, d, "candidate_hygiene_audit"), "canonical_key", 6).select("short", "long")


@query("""
SELECT kind, count(*) AS rows, count(DISTINCT host) AS hosts FROM (
    SELECT 'SEARCH' AS kind, canonical_hostname AS host FROM search_results UNION ALL SELECT 'MENTION', domain FROM raw_brand_mentions UNION ALL SELECT 'BRAND', unnest(domains) FROM brand_accumulators) GROUP BY 1""")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), e.alias("host")) for k, t, e in (("SEARCH", "search_results", F.col("canonical_hostname")), ("MENTION", "raw_brand_mentions", F.col("domain")), ("BRAND", "brand_accumulators", F.explode("domains")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("rows"), F.count_distinct("host").alias("hosts"))


@query("""
SELECT host, 'BOTH' AS side FROM (SELECT canonical_hostname AS host FROM search_results INTERSECT SELECT domain FROM raw_brand_mentions)
UNION ALL SELECT host, 'SEARCH' FROM (SELECT canonical_hostname AS host FROM search_results EXCEPT SELECT domain FROM raw_brand_mentions)
UNION ALL SELECT host, 'MENTION' FROM (SELECT domain AS host FROM raw_brand_mentions EXCEPT SELECT canonical_hostname FROM search_results)""")
def host_sets(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and both differences of two key sets in one pass over each."""
    a = table(spark, d, "search_results").select(F.col("canonical_hostname").alias("host")).distinct().withColumn("bit", F.lit(1))
    b = table(spark, d, "raw_brand_mentions").select(F.col("domain").alias("host")).distinct().withColumn("bit", F.lit(2))
    s = a.unionByName(b).groupBy("host").agg(F.sum("bit").alias("bits"))
    return s.select("host", F.when(F.col("bits") == 3, "BOTH").when(F.col("bits") == 1, "SEARCH").otherwise("MENTION").alias("side"))


@query()
def dedup_three_keys(spark: SparkSession, d: str) -> DataFrame:
    """Captures in the order of their rows; one is kept unless an earlier kept one has its address, title or content."""
    r = table(spark, d, "search_results").select("result_row_id", "canonical_url", text.compact_key(F.col("title")).alias("title_key"), F.sha2("content", 256).alias("content_key"))
    return keep_in_order(r, "result_row_id", ["canonical_url", "title_key", "content_key"]).select("result_row_id", "kept")
