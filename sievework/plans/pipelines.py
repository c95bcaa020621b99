"""Queries that put several operators together: mention search, grouping hierarchies, plans, selections, partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import relops
from sievework.operators.graph import components
from sievework.plans.ranking import _ORDER, _SCORED, best_first, scored
from sievework.plans.registry import query
from sievework.plans.scalars import fold
from sievework.session import shared_path, table


@query(f"""
WITH b AS (SELECT DISTINCT {fold('brand_name')} AS k FROM search_results), b2 AS (SELECT k, len(string_split(k, ' ')) AS n FROM b WHERE k <> ''), z AS (SELECT DISTINCT n FROM b2),
t AS (SELECT doc_id, list_filter(string_split({fold('text')}, ' '), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t CROSS JOIN z))
SELECT doc_id, k AS brand, count(*) AS mentions FROM g JOIN b2 USING (k) GROUP BY 1, 2""")
def mention_search(spark: SparkSession, d: str) -> DataFrame:
    """Which brands' names stand in which documents: an equi-join of word runs with the names, never names by documents. Runs have the lengths that names have, a handful."""
    names = table(spark, d, "search_results").select(text.ascii_fold(F.col("brand_name")).alias("brand")).where("brand != ''").distinct()
    lengths = names.agg(F.collect_set(F.size(F.split("brand", " "))).alias("lengths"))  # one row
    w = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")).crossJoin(F.broadcast(lengths))
    runs = F.flatten(F.transform("lengths", lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
    found = w.select("doc_id", F.explode(runs).alias("brand")).groupBy("doc_id", "brand").agg(F.count("*").alias("mentions"))
    return found.join(names, "brand").select("doc_id", "brand", "mentions")


@query("""
WITH n AS (SELECT result_row_id AS i, canonical_hostname AS h, CASE WHEN length(content) >= 80 THEN sha256(content) END AS c FROM search_results),
m AS (SELECT c FROM n WHERE c IS NOT NULL GROUP BY 1 HAVING count(DISTINCT h) > 1)
SELECT i AS result_row_id, CASE WHEN m.c IS NOT NULL THEN 'REPLICA' WHEN h IS NOT NULL THEN 'SAME_HOST' ELSE 'UNRESOLVED' END AS group_type,
    CASE WHEN m.c IS NOT NULL THEN m.c WHEN h IS NOT NULL THEN h ELSE 'row_' || i END AS group_key FROM n LEFT JOIN m USING (c)""")
def independence_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each capture by a hierarchy: a text on several hosts, else its host, else itself."""
    n = table(spark, d, "search_results").select("result_row_id", F.col("canonical_hostname").alias("h"), F.when(F.length("content") >= 80, F.sha2("content", 256)).alias("c"))
    m = n.where("c IS NOT NULL").groupBy("c").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("c", F.col("c").alias("replica"))
    j = n.join(m, "c", "left")
    kind = F.when(F.col("replica").isNotNull(), "REPLICA").when(F.col("h").isNotNull(), "SAME_HOST").otherwise("UNRESOLVED")
    return j.select("result_row_id", kind.alias("group_type"), F.coalesce("replica", "h", F.concat(F.lit("row_"), F.col("result_row_id").cast("string"))).alias("group_key"))


@query("""
SELECT user_id, min(ts) AS stopped_at FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, props::JSON ->> '$.k' ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') WHERE n = 2 GROUP BY 1""")
def repeated_errors(spark: SparkSession, d: str) -> DataFrame:
    """When each user met an error of the same signature for the second time."""
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").alias("signature"))
    two = relops.top_per_group(e, ["user_id", "signature"], [F.col("ts"), F.col("event_id")], 2)
    return two.where("place = 2").groupBy("user_id").agg(F.min("ts").alias("stopped_at"))


@query("""
SELECT query_id, '{"category":' || coalesce(to_json(category)::VARCHAR, 'null') || ',"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"plan_seq":' || coalesce(plan_seq::VARCHAR, 'null') || ',"region_code":' || coalesce(to_json(region_code)::VARCHAR, 'null') || '}' AS params FROM query_plan""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Parameters as JSON with sorted keys, so that equal parameters have equal texts."""
    return table(spark, d, "query_plan").select("query_id", F.to_json(F.struct("category", "lang", "plan_seq", "region_code"), {"ignoreNullFields": "false"}).alias("params"))


@query("""
SELECT canonical_hostname, count(*) AS captures, count_if(date_diff('second', retrieved_at, ingested_at) > 86400) AS late, max(date_diff('second', retrieved_at, ingested_at))::BIGINT AS worst_s
FROM search_results WHERE canonical_hostname IS NOT NULL GROUP BY 1""")
def ingest_lag(spark: SparkSession, d: str) -> DataFrame:
    """Captures that came in more than a day late, by host."""
    s = F.unix_seconds(F.date_trunc("second", "ingested_at").cast("timestamp")) - F.unix_seconds(F.date_trunc("second", "retrieved_at").cast("timestamp"))
    r = table(spark, d, "search_results").where("canonical_hostname IS NOT NULL").select("canonical_hostname", s.alias("lag"))
    return r.groupBy("canonical_hostname").agg(F.count("*").alias("captures"), F.count_if(F.col("lag") > 86400).alias("late"), F.max("lag").alias("worst_s"))


@query(f"""
WITH s AS (SELECT entity FROM ({_SCORED}) ORDER BY {_ORDER} LIMIT 50), c AS (SELECT DISTINCT category FROM query_plan)
SELECT entity, category, entity || ' ' || category AS query_text, length(entity || ' ' || category) <= 400 AS length_ok FROM s CROSS JOIN c""")
def plan_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best entities by each category of the plan. Both sides are small by definition: their product is the plan."""
    top = scored(spark, d).orderBy(*best_first()).limit(50).select("entity")
    both = top.crossJoin(relops.small(table(spark, d, "query_plan").select("category").distinct()))
    q = F.concat_ws(" ", "entity", "category")
    return both.select("entity", "category", q.alias("query_text"), (F.length(q) <= 400).alias("length_ok"))


@query(f"""
WITH s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS n FROM s WHERE domains >= 2)
SELECT CASE n WHEN 1 THEN 'PRIMARY' ELSE 'RESERVE' END AS pick, entity, score FROM r WHERE n <= 2""")
def primary_reserve(spark: SparkSession, d: str) -> DataFrame:
    two = relops.ranked(scored(spark, d).where("domains >= 2"), best_first(), 2)
    return two.select(F.when(F.col("rank") == 1, "PRIMARY").otherwise("RESERVE").alias("pick"), "entity", "score")


_STRIPPED = "regexp_replace(regexp_replace(replace(" + fold("raw_name") + ", ' ', ''), '^(?:iptv|tv)+', ''), '(?:iptv|tv)+$', '')"


@query(f"""
SELECT CASE WHEN length({_STRIPPED}) >= 4 THEN {_STRIPPED} ELSE replace({fold('raw_name')}, ' ', '') END AS stripped_key, count(*) AS mentions, count(DISTINCT raw_name) AS spellings FROM raw_brand_mentions GROUP BY 1""")
def stripped_keys(spark: SparkSession, d: str) -> DataFrame:
    """Compact names without any run of service words at either end, unless too little is left."""
    k = text.compact_key(F.col("raw_name"))
    s = F.regexp_replace(F.regexp_replace(k, "^(?:iptv|tv)+", ""), "(?:iptv|tv)+$", "")
    m = table(spark, d, "raw_brand_mentions").select(F.when(F.length(s) >= 4, s).otherwise(k).alias("stripped_key"), "raw_name")
    return m.groupBy("stripped_key").agg(F.count("*").alias("mentions"), F.count_distinct("raw_name").alias("spellings"))


@query("""
SELECT candidate_id, (SELECT count(*) FROM (SELECT unnest(regions) EXCEPT SELECT region_code FROM query_plan)) = 0 AS regions_planned, len(list_intersect(coalesce(source_levels, []), ['A', 'B'])) AS good_levels,
    coalesce(list_sort(list_distinct(source_levels)) = ['C'], false) AS only_c FROM (SELECT DISTINCT candidate_id, regions, source_levels FROM candidate_hygiene_audit)""")
def set_checks(spark: SparkSession, d: str) -> DataFrame:
    """Subset, intersection and equality of array sets; the plan's regions are one row."""
    planned = table(spark, d, "query_plan").agg(F.collect_set("region_code").alias("planned"))  # a few codes
    c = table(spark, d, "candidate_hygiene_audit").select("candidate_id", "regions", "source_levels").distinct().crossJoin(F.broadcast(planned))
    levels = F.coalesce("source_levels", F.array().cast("array<string>"))
    return c.select("candidate_id", (F.size(F.array_except(F.coalesce("regions", F.array().cast("array<string>")), "planned")) == 0).alias("regions_planned"),
                    F.size(F.array_intersect(levels, F.array(F.lit("A"), F.lit("B")))).alias("good_levels"), (F.array_sort(F.array_distinct(levels)) == F.array(F.lit("C"))).alias("only_c"))


@query("""
SELECT coalesce(final_classification, 'NONE') AS class, count(*) AS rows, count(DISTINCT candidate_id) AS candidates FROM candidate_hygiene_audit GROUP BY 1""")
def class_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Rows written into one folder a class and read back; the class comes from the folder, and a filter on it reads that folder only."""
    c = table(spark, d, "candidate_hygiene_audit").select("candidate_id", F.coalesce("final_classification", F.lit("NONE")).alias("class"))
    path = shared_path(spark, "classes")
    c.write.partitionBy("class").parquet(path)
    return spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("rows"), F.count_distinct("candidate_id").alias("candidates"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT canonical_brand AS b, d.dom FROM brand_accumulators, unnest(domains) d(dom)), x AS (SELECT DISTINCT p.b AS a, q.b AS c FROM e p JOIN e q USING (dom)),
r(b, l) AS (SELECT b, b FROM e UNION SELECT r.b, x.c FROM r JOIN x ON x.a = r.l), f AS (SELECT b, min(l) AS family FROM r GROUP BY 1)
SELECT family, count(*) AS brands FROM f GROUP BY 1""")
def brand_families(spark: SparkSession, d: str) -> DataFrame:
    """Brands tied through shared domains, and the sizes of these families."""
    e = table(spark, d, "brand_accumulators").select("canonical_brand", F.explode("domains").alias("dom")).distinct()
    star = e.join(e.groupBy("dom").agg(F.min("canonical_brand").alias("low")), "dom").select(F.col("canonical_brand").alias("a"), F.col("low").alias("b"))
    return components(star).groupBy(F.col("component").alias("family")).agg(F.count("*").alias("brands"))
