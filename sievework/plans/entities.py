"""Queries of entities against pages: recurrence by independent group, names inside addresses, named targets, platforms, families, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import numbers, text
from sievework.operators import quality, relops
from sievework.operators.graph import components
from sievework.plans import pipelines  # noqa: F401
from sievework.plans.aggregates import LEVELS
from sievework.plans.ranking import _ORDER, _SCORED, best_first, scored
from sievework.plans.registry import QUERIES, SQL, query
from sievework.plans.scalars import fold
from sievework.session import table


def group_weight(kind: Column, members: Column, mentioning: Column) -> Column:
    """What an entity's presence in a group of sources counts: half where the group is unknown, a quarter or half in replicas, half to three quarters on one host."""
    same_host = F.when(members <= 1, 0.5).otherwise(F.least(F.lit(0.75), 0.5 + 0.25 * mentioning / members))
    return F.when(kind == "UNRESOLVED", 0.5).when(kind == "REPLICA", F.when(mentioning <= 1, 0.25).otherwise(0.5)).when(kind == "SAME_HOST", same_host).otherwise(1.0)


@query(f"""
WITH g AS ({SQL['independence_groups']}), z AS (SELECT group_type, group_key, count(*) AS members FROM g GROUP BY 1, 2),
p AS (SELECT normalized_name AS entity, group_type, group_key, count(DISTINCT page_row_id) AS mentioning FROM raw_brand_mentions JOIN g ON page_row_id = result_row_id WHERE normalized_name <> '' GROUP BY 1, 2, 3)
SELECT entity, count(*) AS groups, round_even(sum(CASE group_type WHEN 'UNRESOLVED' THEN 0.5::DOUBLE WHEN 'REPLICA' THEN CASE WHEN mentioning <= 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END
    ELSE CASE WHEN members <= 1 THEN 0.5::DOUBLE ELSE least(0.75::DOUBLE, 0.5::DOUBLE + 0.25::DOUBLE * mentioning / members) END END), 6) AS recurrence FROM p JOIN z USING (group_type, group_key) GROUP BY 1""")
def group_recurrence(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's recurrence over independent groups of pages: a weight for each group, then their sum."""
    g = QUERIES["independence_groups"](spark, d)
    members = g.groupBy("group_type", "group_key").agg(F.count("*").alias("members"))
    m = table(spark, d, "raw_brand_mentions").where("normalized_name != ''").select(F.col("normalized_name").alias("entity"), F.col("page_row_id").alias("result_row_id"))
    p = m.join(g, "result_row_id").groupBy("entity", "group_type", "group_key").agg(F.count_distinct("result_row_id").alias("mentioning")).join(members, ["group_type", "group_key"])
    w = p.withColumn("w", group_weight(F.col("group_type"), F.col("members"), F.col("mentioning")))
    return w.groupBy("entity").agg(F.count("*").alias("groups"), numbers.rounded(F.sum("w")).alias("recurrence"))


IN_ADDRESS = r"(?:https?://)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:[/?#][^ \t\r\n)>]*)?"
_TIMES = "CASE WHEN length({b}) > 0 THEN (length({t}) - length(replace({t}, {b}, ''))) // length({b}) ELSE 0 END"
_BARE = fold(f"regexp_replace(coalesce(raw_content, ''), '{IN_ADDRESS}', ' ', 'g')")


@query(f"""
WITH r AS (SELECT result_row_id, {fold('brand_name')} AS b, {fold('raw_content')} AS whole, {_BARE} AS bare FROM search_results)
SELECT result_row_id, {_TIMES.format(b='b', t='whole')} AS everywhere, {_TIMES.format(b='b', t='bare')} AS outside_addresses FROM r""")
def mentions_outside_addresses(spark: SparkSession, d: str) -> DataFrame:
    """How often a page names its brand, with and without what stands inside addresses and host names."""
    bare = F.regexp_replace(F.coalesce("raw_content", F.lit("")), IN_ADDRESS, " ")
    b = F.col("brand_name")
    return table(spark, d, "search_results").select("result_row_id", text.occurrences(F.col("raw_content"), b).alias("everywhere"), text.occurrences(bare, b).alias("outside_addresses"))


@query(f"""
WITH r AS (SELECT result_row_id, {fold('brand_name')} AS b, {fold('query_text')} AS q, {fold('title')} AS t, {fold('content')} AS c, replace({fold('registrable_domain')}, ' ', '') AS d FROM search_results)
SELECT result_row_id, CASE WHEN b = '' THEN 'FALSE' WHEN contains(q, b) THEN 'ASKED' WHEN contains(t, b) OR contains(d, replace(b, ' ', '')) THEN 'TRUE' WHEN contains(c, b) THEN 'AMBIGUOUS_TEXT_ONLY' ELSE 'FALSE' END AS recovered FROM r""")
def named_targets(spark: SparkSession, d: str) -> DataFrame:
    """Whether a capture recovers its target: in title or domain, in text alone, or not; queries that hold the name prove nothing."""
    f = lambda c: text.ascii_fold(F.col(c))
    r = table(spark, d, "search_results").select("result_row_id", f("brand_name").alias("b"), f("query_text").alias("q"), f("title").alias("t"), f("content").alias("c"), text.compact_key(F.col("registrable_domain")).alias("d"))
    b = F.col("b")
    found = F.when(b == "", "FALSE").when(F.col("q").contains(b), "ASKED").when(F.col("t").contains(b) | F.col("d").contains(F.replace(b, F.lit(" "), F.lit(""))), "TRUE").when(F.col("c").contains(b), "AMBIGUOUS_TEXT_ONLY").otherwise("FALSE")
    return r.select("result_row_id", found.alias("recovered"))


def by_suffix(hosts: DataFrame, host: str, lexicon: DataFrame, suffix: str) -> DataFrame:
    """``hosts`` with the longest ``suffix`` of the lexicon that is the host or a domain above it: an equi-join on the host's own suffixes."""
    labels = F.split(host, r"\.")
    each = hosts.select(host).where(F.col(host).isNotNull()).distinct().select(host, F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias(suffix))
    best = each.join(lexicon.select(suffix).distinct(), suffix).groupBy(host).agg(F.max_by(suffix, F.length(suffix)).alias(suffix))
    return hosts.join(best, host, "left")


@query("""
WITH p AS (SELECT registrable_domain AS platform FROM search_results WHERE registrable_domain IS NOT NULL AND canonical_hostname IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canonical_hostname) >= 2),
h AS (SELECT domain, count(*) AS mentions FROM raw_brand_mentions WHERE domain IS NOT NULL GROUP BY 1)
SELECT domain, mentions, (SELECT arg_max(platform, length(platform)) FROM p WHERE domain = platform OR ends_with(domain, '.' || platform)) AS platform FROM h""")
def platform_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The platform of each mention's host: the registrable domain above it that serves several hosts."""
    r = table(spark, d, "search_results").where("registrable_domain IS NOT NULL AND canonical_hostname IS NOT NULL")
    platforms = r.groupBy(F.col("registrable_domain").alias("platform")).agg(F.count_distinct("canonical_hostname").alias("n")).where("n >= 2")
    h = table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("mentions"))
    return by_suffix(h, "domain", platforms, "platform").select("domain", "mentions", "platform")


@query(f"""
WITH e AS (SELECT * FROM ({_SCORED}) WHERE domains >= 2 AND score >= 60), p AS (SELECT * FROM e ORDER BY {_ORDER} LIMIT 50)
SELECT count(*) AS available, (SELECT count(*) FROM p) AS published, greatest(count(*) - 50, 0)::BIGINT AS truncated, (SELECT min(score) FROM p) AS least_score FROM e""")
def publication_cap(spark: SparkSession, d: str) -> DataFrame:
    """The published list: eligible entities only, at most 50, never filled up with others; and what was left out."""
    e = scored(spark, d).where("domains >= 2 AND score >= 60")
    p = e.orderBy(*best_first()).limit(50).agg(F.count("*").alias("published"), F.min("score").alias("least_score"))  # one row
    return e.agg(F.count("*").alias("available")).crossJoin(F.broadcast(p)).select("available", "published", F.greatest(F.col("available") - 50, F.lit(0)).alias("truncated"), "least_score")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT canonical_brand AS b, d.dom FROM brand_accumulators, unnest(domains) d(dom)), x AS (SELECT DISTINCT p.b AS a, q.b AS c FROM e p JOIN e q USING (dom)),
r(b, l) AS (SELECT b, b FROM e UNION SELECT r.b, x.c FROM r JOIN x ON x.a = r.l), f AS (SELECT b, min(l) AS family FROM r GROUP BY 1),
u AS (SELECT family, count(DISTINCT u.url) AS urls FROM f JOIN brand_accumulators a ON a.canonical_brand = f.b, unnest(evidence_urls) u(url) GROUP BY 1), dm AS (SELECT family, count(DISTINCT dom) AS domains FROM f JOIN e USING (b) GROUP BY 1),
s AS (SELECT family, sum(source_count)::BIGINT AS sources, count(DISTINCT b) AS brands FROM f JOIN brand_accumulators a ON a.canonical_brand = f.b GROUP BY 1)
SELECT row_number() OVER (ORDER BY sources DESC, coalesce(urls, 0) DESC, domains DESC, family) AS rank, family, brands, sources, coalesce(urls, 0) AS urls, domains FROM s JOIN dm USING (family) LEFT JOIN u USING (family) ORDER BY rank LIMIT 100""")
def family_rank(spark: SparkSession, d: str) -> DataFrame:
    """Families of brands that share domains, by sources, addresses and domains."""
    b = table(spark, d, "brand_accumulators")
    e = b.select("canonical_brand", F.explode("domains").alias("dom")).distinct()
    star = e.join(e.groupBy("dom").agg(F.min("canonical_brand").alias("low")), "dom").select(F.col("canonical_brand").alias("a"), F.col("low").alias("b"))
    f = components(star).select(F.col("id").alias("canonical_brand"), F.col("component").alias("family"))
    urls = b.select("canonical_brand", F.explode("evidence_urls").alias("url")).join(f, "canonical_brand").groupBy("family").agg(F.count_distinct("url").alias("urls"))
    doms = e.join(f, "canonical_brand").groupBy("family").agg(F.count_distinct("dom").alias("domains"))
    s = b.join(f, "canonical_brand").groupBy("family").agg(F.sum("source_count").alias("sources"), F.count_distinct("canonical_brand").alias("brands"))
    out = s.join(doms, "family").join(urls, "family", "left").fillna(0, ["urls"])
    return relops.ranked(out, [F.desc("sources"), F.desc("urls"), F.desc("domains"), F.asc("family")], 100).select("rank", "family", "brands", "sources", "urls", "domains")


_LEVEL_LIST = ", ".join(f"'{x}'" for x in LEVELS)


@query(f"""
SELECT 'raw_brand_mentions' AS table_name, coalesce(source_level, '(null)') AS value, count(*) AS rows FROM raw_brand_mentions WHERE coalesce(source_level IN ({_LEVEL_LIST}), false) = false GROUP BY 2
UNION ALL SELECT 'candidate_hygiene_audit', coalesce(max_source_level, '(null)'), count(*) FROM candidate_hygiene_audit WHERE coalesce(max_source_level IN ({_LEVEL_LIST}), false) = false GROUP BY 2""")
def values_outside_domain(spark: SparkSession, d: str) -> DataFrame:
    """Values of the source level that are none, with their rows."""
    out = None
    for t, key, column in (("raw_brand_mentions", "mention_row_id", "source_level"), ("candidate_hygiene_audit", "candidate_id", "max_source_level")):
        one = quality.outside_domain(table(spark, d, t), key, column, list(LEVELS)).groupBy(F.coalesce(column, F.lit("(null)")).alias("value")).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "value", "rows")
        out = one if out is None else out.unionByName(one)
    return out
