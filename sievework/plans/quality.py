"""Queries of contracts, closure, digests, and round trips through the formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import quality
from sievework.plans.registry import query
from sievework.session import shared_path, table
from sievework.sources import io

CHECKED = (("search_results", "result_row_id", ("result_id", "query_id")), ("raw_brand_mentions", "mention_row_id", ("raw_name", "page_row_id")), ("brand_accumulators", "brand_id", ("canonical_brand",)),
           ("candidate_hygiene_audit", "candidate_id", ("original_name",)), ("query_plan", "query_id", ("lang",)), ("documents", "doc_id", ("text",)))


@query("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, (SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys, ({' + '.join(f'count_if({c} IS NULL)' for c in cs)})::BIGINT AS missing_values FROM {t}" for t, k, cs in CHECKED))
def row_contracts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, k, cs in CHECKED:
        one = quality.contract(table(spark, d, t), t, k, list(cs))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 'candidate' AS kind, candidate_id AS owner, ref FROM (SELECT DISTINCT candidate_id, unnest(supporting_row_ids) AS ref FROM candidate_hygiene_audit) WHERE ref NOT IN (SELECT mention_row_id FROM raw_brand_mentions)
UNION ALL SELECT 'mention', mention_row_id::VARCHAR, ref FROM (SELECT DISTINCT mention_row_id, unnest(supporting_row_ids) AS ref FROM raw_brand_mentions) WHERE ref NOT IN (SELECT result_row_id FROM search_results)
UNION ALL SELECT 'page', mention_row_id::VARCHAR, page_row_id FROM raw_brand_mentions WHERE page_row_id IS NOT NULL AND page_row_id NOT IN (SELECT result_row_id FROM search_results)""")
def referential_closure(spark: SparkSession, d: str) -> DataFrame:
    m, r = table(spark, d, "raw_brand_mentions"), table(spark, d, "search_results")
    parts = (("candidate", table(spark, d, "candidate_hygiene_audit"), "candidate_id", "supporting_row_ids", m, "mention_row_id"), ("mention", m, "mention_row_id", "supporting_row_ids", r, "result_row_id"))
    out = None
    for kind, refs, owner, ids, to, to_id in parts:
        one = quality.dangling(refs, owner, ids, to, to_id).select(F.lit(kind).alias("kind"), F.col(owner).cast("string").alias("owner"), "ref")
        out = one if out is None else out.unionByName(one)
    page = m.select("mention_row_id", F.array("page_row_id").alias("p")).where("p[0] IS NOT NULL")
    return out.unionByName(quality.dangling(page, "mention_row_id", "p", r, "result_row_id").select(F.lit("page").alias("kind"), F.col("mention_row_id").cast("string").alias("owner"), "ref"))


_DIGEST = "sha256(" + " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("category", "included_in_metrics", "lang", "plan_seq", "query_id", "query_text", "region_code")) + ")"
_PART = "coalesce(sum(('0x' || substr(x, {}, 14))::BIGINT)::VARCHAR, '0')"


@query(f"""
SELECT 'query_plan' AS table_name, count(*) AS rows, {_PART.format(1)} AS low_sum, {_PART.format(33)} AS high_sum FROM (SELECT {_DIGEST} AS x FROM query_plan)""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest that doesn't depend on the order of rows or columns."""
    return quality.digest(table(spark, d, "query_plan"), "query_plan")


@query("SELECT query_id, plan_seq, region_code, lang, category, query_text, included_in_metrics FROM query_plan")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_plan")
    path = shared_path(spark, "csv")
    io.write_csv(q, path)
    return io.read_csv(spark, path, q.schema)


@query("SELECT * FROM raw_brand_mentions")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "raw_brand_mentions")
    path = shared_path(spark, "jsonl")
    io.write_jsonl(m, path)
    return io.read_jsonl(spark, path, m.schema).drop("_corrupt_record")


@query("SELECT brand_id, canonical_brand, source_count, latest_published_date, original_rows FROM brand_accumulators")
def xml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "brand_accumulators").select("brand_id", "canonical_brand", "source_count", "latest_published_date", "original_rows")
    path = shared_path(spark, "xml")
    io.write_xml(b, path, "brands", "brand")
    return io.read_xml(spark, path, "brand", b.schema)


@query("""
SELECT query_id, len(list(result_row_id)) AS results, min(result_row_id) AS first_row, max(result_position) AS last_position FROM search_results WHERE query_id IS NOT NULL GROUP BY 1""")
def envelope_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows packed into response envelopes of 50 results, written as JSON lines, and exploded again."""
    r = table(spark, d, "search_results").where("query_id IS NOT NULL").select("query_id", "result_row_id", "result_position", "original_url", "title")
    path = shared_path(spark, "envelopes")
    io.write_jsonl(io.pack_envelopes(r, "query_id", "result_row_id", 50), path)
    e = io.explode_envelopes(io.read_jsonl(spark, path, io.envelope_schema(r, "query_id", "result_row_id")), "query_id")
    return e.groupBy("query_id").agg(F.count("*").alias("results"), F.min("result_row_id").alias("first_row"), F.max("result_position").alias("last_position"))


@query("SELECT query_id, plan_seq, region_code, lang, category, query_text, included_in_metrics FROM query_plan")
def json_array_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The plan as one file that holds one array, as responses come, and read again. The plan is 48 rows."""
    q = table(spark, d, "query_plan")
    path = shared_path(spark, "array")
    q.agg(F.to_json(F.collect_list(F.struct(*q.columns)), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)
    return io.read_json_array(spark, path, q.schema)


@query("SELECT candidate_id, original_name, corrected_name, mention_count, page_count, domain_count FROM candidate_hygiene_audit WHERE original_name IS NOT NULL")
def xml_gz_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidate_hygiene_audit").where("original_name IS NOT NULL").select("candidate_id", "original_name", "corrected_name", "mention_count", "page_count", "domain_count")
    path = shared_path(spark, "xmlgz")
    io.write_xml(c, path, "candidates", "candidate", compress=True)
    return io.read_xml(spark, path, "candidate", c.schema)


@query("""
WITH f AS (SELECT string_agg(query_id || ' ' || plan_seq, chr(10) ORDER BY plan_seq) || chr(10) AS t FROM query_plan)
SELECT octet_length(encode(t))::BIGINT AS length, sha256(t) AS digest, 1::BIGINT AS files FROM f""")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of each data file of a written listing, and how many there are, as the executors read them."""
    path = shared_path(spark, "listing")
    table(spark, d, "query_plan").select(F.concat_ws(" ", "query_id", F.col("plan_seq").cast("string")).alias("value"), "plan_seq").coalesce(1).sortWithinPartitions("plan_seq").select("value").write.text(path)
    f = io.inspect_files(spark, path).where("name LIKE 'part-%.txt'")
    return f.groupBy("length", "digest").agg(F.count("*").alias("files"))


@query("""
SELECT result_row_id, trim(regexp_replace(coalesce(title, ''), '[ \t\n\r]+', ' ', 'g')) AS title, coalesce(canonical_url, '') AS canonical, CASE WHEN original_url IS NULL THEN 1 ELSE 2 END AS links, CASE WHEN original_url IS NULL THEN 0 ELSE 1 END AS elsewhere, trim('Imprint & ' || coalesce(canonical_hostname, '')) AS footer FROM search_results
WHERE NOT contains(coalesce(title, ''), '<') AND NOT contains(coalesce(original_url, ''), '#')""")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages set as HTML and parsed again: title, canonical address, links within and elsewhere, footer."""
    r = table(spark, d, "search_results").where("NOT contains(coalesce(title, ''), '<') AND NOT contains(coalesce(original_url, ''), '#')")
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;"))
    link = F.when(F.col("original_url").isNotNull(), F.concat(F.lit('<A class="x" href="'), "original_url", F.lit('">there</A>'))).otherwise("")
    html = F.concat(F.lit("<html><head><TITLE>\n"), safe(F.col("title")), F.lit("</TITLE><link rel='canonical' href='"), F.coalesce("canonical_url", F.lit("")), F.lit("'></head><body><a href='/home'>home</a>"), link,
                    F.lit("<footer id='f'><p>Imprint &amp;\n"), F.coalesce("canonical_hostname", F.lit("")), F.lit("</p></footer></body></html>"))
    p = io.parse_html("html")
    _, elsewhere = io.split_links(p["links"], F.lit("no.host"))
    return r.select("result_row_id", html.alias("html")).select("result_row_id", p["title"].alias("title"), p["canonical"].alias("canonical"), F.size(p["links"]).alias("links"), F.size(elsewhere).alias("elsewhere"), p["footer"].alias("footer"))
