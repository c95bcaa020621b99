"""Queries of the text, address, extraction and id functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import extract, ids, text, urls
from sievework.operators.rules import first_term
from sievework.plans.registry import query
from sievework.session import table

FOLD = r"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({}, '')), '[^\x00-\x7F]+', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "list_filter(string_split(" + FOLD + ", ' '), lambda t: t <> '')"
PARTS = "regexp_extract(coalesce({}, ''), '^(https?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', {}, 'i')"


def fold(x: str) -> str:
    return FOLD.format(x)


def part(x: str, n: int) -> str:
    return PARTS.format(x, n)


def host_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({part(x, 2)}), '^[^@]*@', ''), ':[0-9]+$', ''), '\.$|^www\.', ''), '^$', '')"


HOST_WWW = r"regexp_replace(regexp_replace(lower(" + part("original_url", 2) + r"), ':(80|443)$', ''), '\.$', '')"


@query(f"""
SELECT mention_row_id, trim(regexp_replace(coalesce(raw_name, ''), '[ \\t\\n\\r]+', ' ', 'g')) AS clean_name,
       {fold('raw_name')} AS folded, replace({fold('raw_name')}, ' ', '') AS compact,
       array_to_string(list_sort({TOKENS.format('raw_name')}), ' ') AS sorted_tokens
FROM raw_brand_mentions""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    m, n = table(spark, d, "raw_brand_mentions"), F.col("raw_name")
    return m.select("mention_row_id", text.clean_text(n).alias("clean_name"), text.ascii_fold(n).alias("folded"), text.compact_key(n).alias("compact"), text.sorted_token_key(n).alias("sorted_tokens"))


_KEPT = "array_to_string(list_filter(" + TOKENS.format("original_name") + ", lambda t: t NOT IN ('" + "', '".join(text.SERVICE_WORDS) + "')), ' ')"


@query(f"""
SELECT candidate_id, CASE WHEN {_KEPT} <> '' THEN {_KEPT} ELSE {fold('original_name')} END AS entity_key,
       regexp_replace(original_name, '([a-z])([A-Z])', '\\1 \\2', 'g') AS split_name, count(*) AS rows
FROM candidate_hygiene_audit GROUP BY ALL""")
def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("original_name")
    c = table(spark, d, "candidate_hygiene_audit").select("candidate_id", text.without_words(n).alias("entity_key"), text.camel_split(n).alias("split_name"))
    return c.groupBy("candidate_id", "entity_key", "split_name").agg(F.count("*").alias("rows"))


_BASE = f"lower({part('original_url', 1)}) || '://' || {HOST_WWW} || regexp_replace(regexp_replace({part('original_url', 3)}, '/+', '/', 'g'), '/$', '')"
_PARAMS = f"list_filter(string_split({part('original_url', 4)}, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|ref|aff)'))"


@query(f"""
SELECT result_row_id, CASE WHEN {part('original_url', 2)} = '' THEN ''
    WHEN len({_PARAMS}) > 0 THEN {_BASE} || '?' || array_to_string(list_sort({_PARAMS}), '&') ELSE {_BASE} END AS url
FROM search_results""")
def url_canonical_sorted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_results").select("result_row_id", urls.canonical_sorted(F.col("original_url")).alias("url"))


_OBASE = f"'https://' || {host_sql('original_url')} || regexp_replace({part('original_url', 3)}, '/$', '')"
_OPARAMS = f"list_filter(string_split({part('original_url', 4)}, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|msclkid|ref|source)='))"


@query(f"""
SELECT result_row_id, CASE WHEN {part('original_url', 2)} = '' THEN ''
    WHEN len({_OPARAMS}) > 0 THEN {_OBASE} || '?' || array_to_string({_OPARAMS}, '&') ELSE {_OBASE} END AS url,
    CASE WHEN {part('original_url', 2)} = '' THEN '' ELSE {host_sql('original_url')} || regexp_replace({part('original_url', 3)}, '/+$', '') END AS bare
FROM search_results""")
def url_canonical_ordered(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("original_url")
    return table(spark, d, "search_results").select("result_row_id", urls.canonical_ordered(u).alias("url"), urls.canonical_bare(u).alias("bare"))


def _registrable_sql(kind: str) -> str:
    """By labels, as the definition has it: three under a suffix of two labels, else two; addresses of numbers stay where the variant says so."""
    labels = "string_split(host, '.')"
    whole = f"len({labels}) <= 2" + (" OR regexp_matches(host, '^[0-9.]+$')" if kind == "probe" else "")
    suffixes = ", ".join(f"'{s}'" for s in urls.SUFFIXES[kind])
    return f"CASE WHEN {whole} THEN host WHEN array_to_string({labels}[-2:], '.') IN ({suffixes}) THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END"


_VARIANTS = ", ".join(f"{_registrable_sql(k)} AS {k}" for k in urls.SUFFIXES)


@query(f"""
WITH h AS (SELECT {host_sql('original_url')} AS host FROM search_results UNION ALL SELECT DISTINCT regexp_replace(domain, '[.]example$', '.co.uk') FROM raw_brand_mentions WHERE domain IS NOT NULL)
SELECT host, {_VARIANTS}, count(*) AS pages FROM h GROUP BY 1""")
def url_registrable(spark: SparkSession, d: str) -> DataFrame:
    """The registrable domain of each host in its three variants, also of hosts set under a suffix of two labels."""
    h = table(spark, d, "search_results").select(urls.host(F.col("original_url")).alias("host"))
    under = table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL").select(F.regexp_replace("domain", "[.]example$", ".co.uk").alias("host")).distinct()
    return h.unionAll(under).groupBy("host").agg(F.count("*").alias("pages")).select("host", *[urls.registrable(F.col("host"), k).alias(k) for k in urls.SUFFIXES], "pages")


@query(f"""
SELECT result_row_id, greatest(0, least(100, 45 + 12 * (contains(p, 'review')::INT + contains(p, 'best')::INT + contains(p, 'compared')::INT)
    - 30 * (contains(p, 'legal')::INT + contains(p, 'login')::INT + contains(p, 'privacy')::INT))) AS path_score
FROM (SELECT result_row_id, lower({part('original_url', 3)}) AS p FROM search_results)""")
def url_path_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_results").select("result_row_id", urls.path_score(F.col("original_url"), ("review", "best", "compared"), ("legal", "login", "privacy")).alias("path_score"))


@query("""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '([0-9]+[.,][0-9]{2}) ?(?:€|EUR|USD|GBP|crowns|credits)', 1)) AS prices,
    list_max(list_transform(regexp_extract_all(coalesce(text, ''), '([0-9]+[.,][0-9]{2}) ?(?:€|EUR|USD|GBP|crowns|credits)', 1), lambda p: replace(p, ',', '.')::DECIMAL(18,2)))::DOUBLE AS top_price,
    list_max(list_transform(regexp_extract_all(coalesce(text, ''), '(20[0-9]{2})', 1), lambda y: y::INT)) AS latest_year,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails
FROM documents""")
def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(extract.prices(t)).alias("prices"), F.array_max(extract.prices(t)).cast("double").alias("top_price"), extract.latest_year(t).alias("latest_year"), F.size(extract.all_of(t, extract.EMAIL)).alias("emails"))


_ADDRESS_FREE = fold("regexp_replace(coalesce(content, ''), 'https?://[^ \\t\\r\\n]+', ' ', 'g')")


@query(f"""
SELECT print, count(*) AS pages, count(DISTINCT canonical_hostname) AS hosts, min(result_row_id) AS first_row
FROM (SELECT result_row_id, canonical_hostname, CASE WHEN length(t) >= 80 THEN sha256(t) ELSE '' END AS print FROM (SELECT result_row_id, canonical_hostname, {_ADDRESS_FREE} AS t FROM search_results))
WHERE print <> '' GROUP BY print""")
def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").select("result_row_id", "canonical_hostname", text.fingerprint_text(F.col("content")).alias("t")).where(F.length("t") >= 80)
    return r.groupBy(F.sha2("t", 256).alias("print")).agg(F.count("*").alias("pages"), F.count_distinct("canonical_hostname").alias("hosts"), F.min("result_row_id").alias("first_row"))


@query("""
SELECT brand_id, 'brand_' || substr(sha256(length(coalesce(canonical_brand, '')) || ':' || coalesce(canonical_brand, '')), 1, 16) AS stable_brand,
    'row_' || substr(sha256(length(coalesce(brand_id, '')) || ':' || coalesce(brand_id, '') || length(coalesce(source_count::VARCHAR, '')) || ':' || coalesce(source_count::VARCHAR, '')), 1, 12) AS stable_row FROM brand_accumulators""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brand_accumulators").select("brand_id", ids.stable_id("brand", F.col("canonical_brand")).alias("stable_brand"), ids.stable_id("row", F.col("brand_id"), F.col("source_count"), length=12).alias("stable_row"))


@query(f"""
WITH r AS (SELECT result_row_id, coalesce(content, '') AS c, brand_name AS b, {fold('content')} AS fc, {fold('brand_name')} AS fb FROM search_results)
SELECT result_row_id, CASE WHEN length(fb) > 0 THEN (length(fc) - length(replace(fc, fb, ''))) // length(fb) ELSE 0 END AS mentions,
    CASE WHEN b IS NOT NULL AND instr(c, b) > 0 AND b <> '' THEN substr(c, greatest(instr(c, b) - 40, 1)::BIGINT, (instr(c, b) - greatest(instr(c, b) - 40, 1) + length(b) + 40)::BIGINT) END AS around FROM r""")
def mention_windows(spark: SparkSession, d: str) -> DataFrame:
    c, b = F.coalesce("content", F.lit("")), F.when(F.col("brand_name") != "", F.col("brand_name"))
    r = table(spark, d, "search_results")
    return r.select("result_row_id", text.occurrences(F.col("content"), F.col("brand_name")).alias("mentions"), text.window_around(c, b, 40).alias("around"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED]', 'g'), '\b(?:bearer\s+|api[_-]?key\s*[=:]\s*)[A-Za-z0-9._-]{8,}', '[REDACTED]', 'gi') AS safe_text,
    regexp_extract(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g')), '^([^.!?]*[.!?])', 1) AS opening FROM documents""")
def redaction_and_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("safe_text"), text.first_sentence(F.col("text")).alias("opening"))


@query("""
SELECT result_row_id, len(list_filter(l, lambda x: regexp_matches(x, '^(?:#+ |=+ )'))) AS headings, len(list_filter(l, lambda x: regexp_matches(x, '^(?:#+ )?[0-9]+[.)] '))) AS numbered,
    len(list_filter(l, lambda x: starts_with(x, '|'))) AS table_rows, len(l) AS lines
FROM (SELECT result_row_id, string_split(replace(coalesce(raw_content, ''), chr(13), ''), chr(10)) AS l FROM search_results)""")
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").select("result_row_id", extract.lines(F.col("raw_content")).alias("l"))
    n = lambda p: F.size(F.filter("l", lambda x: x.rlike(p)))
    return r.select("result_row_id", n(extract.HEADING).alias("headings"), n(extract.NUMBERED).alias("numbered"), F.size(F.filter("l", lambda x: x.startswith("|"))).alias("table_rows"), F.size("l").alias("lines"))


@query("""
SELECT result_row_id, (i - 1)::INT AS line_no, trim(regexp_extract(line, '^(?:#+ )?[0-9]+[.)] ([^–]+)', 1)) AS candidate
FROM (SELECT result_row_id, l, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT result_row_id, string_split(replace(raw_content, chr(13), ''), chr(10)) AS l FROM search_results WHERE raw_content IS NOT NULL))
WHERE regexp_matches(line, '^(?:#+ )?[0-9]+[.)] [^–]')""")
def candidate_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names at the head of numbered lines and headings, with their place."""
    r = table(spark, d, "search_results").where("raw_content IS NOT NULL").select("result_row_id", F.posexplode(extract.lines(F.col("raw_content"))).alias("line_no", "line"))
    return r.where(F.col("line").rlike(r"^(?:#+ )?[0-9]+[.)] [^–]")).select("result_row_id", "line_no", F.trim(F.regexp_extract("line", r"^(?:#+ )?[0-9]+[.)] ([^–]+)", 1)).alias("candidate"))


@query("""
SELECT event_type, (props::JSON ->> '$.k')::INT AS k, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))


@query("""
SELECT k AS field, count(*) AS rows, count(DISTINCT v) AS values FROM (SELECT unnest(map_keys(extracted_fields)) AS k, unnest(map_values(extracted_fields)) AS v FROM search_results) GROUP BY 1""")
def map_fields(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").select(F.explode("extracted_fields").alias("field", "v"))
    return r.groupBy("field").agg(F.count("*").alias("rows"), F.count_distinct("v").alias("values"))


@query("""
SELECT result_row_id, arg_max(role, struct_pack(c := confidence, r := role)) AS top_role, max(confidence) AS confidence, count(*) AS roles
FROM (SELECT result_row_id, unnest(role_candidates, recursive := true) FROM search_results) GROUP BY 1""")
def top_roles(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "search_results").select("result_row_id", F.inline("role_candidates"))
    return r.groupBy("result_row_id").agg(F.max_by("role", F.struct("confidence", "role")).alias("top_role"), F.max("confidence").alias("confidence"), F.count("*").alias("roles"))


TERMS = ["catch-up", "login loop", "price card", "refund", "reembolso", "remboursement"]


@query("""
SELECT doc_id, CASE WHEN regexp_matches(t, '(?:^|[^\\p{L}\\p{N}])catch[- \\t\\n]up(?:$|[^\\p{L}\\p{N}])') THEN 'catch-up' WHEN regexp_matches(t, '(?:^|[^\\p{L}\\p{N}])login[ \\t\\n]+loop(?:$|[^\\p{L}\\p{N}])') THEN 'login loop'
    WHEN regexp_matches(t, '(?:^|[^\\p{L}\\p{N}])price[ \\t\\n]+card(?:$|[^\\p{L}\\p{N}])') THEN 'price card' WHEN regexp_matches(t, '(?:^|[^\\p{L}\\p{N}])refund(?:$|[^\\p{L}\\p{N}])') THEN 'refund'
    WHEN regexp_matches(t, '(?:^|[^\\p{L}\\p{N}])reembolso(?:$|[^\\p{L}\\p{N}])') THEN 'reembolso' WHEN regexp_matches(t, '(?:^|[^\\p{L}\\p{N}])remboursement(?:$|[^\\p{L}\\p{N}])') THEN 'remboursement' END AS term
FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first term of an ordered lexicon in each document, as bounded words."""
    return table(spark, d, "documents").select("doc_id", first_term(F.col("text"), TERMS).alias("term"))


_LEAD = "regexp_replace(trim(regexp_replace(coalesce(context, ''), '[ \\t\\n\\r]+', ' ', 'g')), '^(?:[#>*|=-]+ *)*(?:[0-9]+[.)] *)?', '')"
_BARE = f"trim(regexp_replace(regexp_replace({_LEAD}, '\\*\\*|__|`', '', 'g'), '^(?:best overall|editor''?s choice|top pick): *', '', 'i'))"


@query(f"""
WITH x AS (SELECT mention_row_id, {_BARE} AS b FROM raw_brand_mentions), w AS (SELECT *, string_split(b, ' ') AS w FROM x), h AS (SELECT *, greatest(len(w) // 2, 1) AS h FROM w)
SELECT mention_row_id, trim(substr(CASE WHEN len(w) % 2 = 0 AND lower(array_to_string(w[1:h], ' ')) = lower(array_to_string(w[h + 1:2 * h], ' ')) THEN array_to_string(w[1:h], ' ') ELSE b END, 1, 100)) AS candidate FROM h""")
def clean_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_brand_mentions").select("mention_row_id", text.clean_candidate(F.col("context")).alias("candidate"))


_PROBE = r"regexp_extract(trim(coalesce(original_url, '')), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', {})"
_NET = f"regexp_replace(lower({_PROBE.format(2)}), '^[^@]*@', '')"
_PORTLESS = f"CASE lower({_PROBE.format(1)}) WHEN 'https' THEN regexp_replace({_NET}, ':443$', '') WHEN 'http' THEN regexp_replace({_NET}, ':80$', '') ELSE {_NET} END"
_ASKED = f"list_sort(list_filter(string_split({_PROBE.format(4)}, '&'), lambda x: x <> ''))"
_PILOT = f"list_sort(list_filter(string_split({part('original_url', 4)}, '&'), lambda x: x <> ''))"
_SLUG = "string_split(canonical_hostname, '.')"


@query(rf"""
WITH b AS (SELECT *, lower({_PROBE.format(1)}) || '://' || regexp_replace({_PORTLESS}, '\.$', '') || CASE WHEN {_PROBE.format(3)} = '' THEN '/' ELSE {_PROBE.format(3)} END AS probe,
    lower({part('original_url', 1)}) || '://' || lower({part('original_url', 2)}) || regexp_replace({part('original_url', 3)}, '/+$', '') AS pilot FROM search_results)
SELECT result_row_id, CASE WHEN {_PORTLESS} = '' THEN trim(coalesce(original_url, '')) WHEN len({_ASKED}) > 0 THEN probe || '?' || array_to_string({_ASKED}, '&') ELSE probe END AS probe_url,
    CASE WHEN {part('original_url', 2)} = '' THEN original_url WHEN len({_PILOT}) > 0 THEN pilot || '?' || array_to_string({_PILOT}, '&') ELSE pilot END AS pilot_url,
    regexp_replace(lower({_SLUG}[CASE WHEN len({_SLUG}) >= 3 AND {_SLUG}[-2] IN ('co', 'com', 'net', 'org') THEN -3 WHEN len({_SLUG}) >= 2 THEN -2 ELSE -1 END]), '[^a-z0-9]', '', 'g') AS slug,
    coalesce(canonical_hostname = registrable_domain OR ends_with(canonical_hostname, '.' || registrable_domain), false) AS within, coalesce(regexp_full_match(result_id, '[A-Za-z0-9][A-Za-z0-9._:-]*'), false) AS id_ok FROM b""")
def url_canonical_variants(spark: SparkSession, d: str) -> DataFrame:
    """Two more canonical forms, the slug of the host, whether it is within its registrable domain, and whether the result's id is one."""
    u, h = F.col("original_url"), F.col("canonical_hostname")
    return table(spark, d, "search_results").select("result_row_id", urls.canonical_probe(u).alias("probe_url"), urls.canonical_pilot(u).alias("pilot_url"), urls.domain_slug(h).alias("slug"),
                                                    urls.belongs_to(h, F.col("registrable_domain")).alias("within"), ids.identifier(F.col("result_id")).alias("id_ok"))


_PHONES = "list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(raw_content, ''), '" + extract.PHONE + "'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 16)))"
_LINKS = "list_transform(regexp_extract_all(coalesce(raw_content, ''), 'https?://[^ \t\r\n)>\"]+'), lambda u: regexp_replace(u, '[.,;]+$', ''))"
_HOSTS = "list_filter(list_transform(regexp_extract_all(coalesce(raw_content, ''), 'https?://[^ \t\r\n)>\"]+'), lambda u: regexp_replace(regexp_extract(lower(u), '^https?://([^/?#:]+)', 1), '^www\\.|\\.$', '')), lambda h: h <> '' AND h <> coalesce(canonical_hostname, ''))"


@query(f"""
SELECT result_row_id, len({_PHONES}) AS phones, array_to_string({_PHONES}, ' | ') AS phone_list, len(list_distinct({_LINKS})) AS addresses, array_to_string(list_sort(list_distinct({_HOSTS})), ' | ') AS linked_domains,
    len(regexp_extract_all(coalesce(raw_content, ''), '{extract.PRICE_AFTER}', 1)) AS prefixed_prices, sha1(coalesce(title, '')) AS title_sha1 FROM search_results""")
def contact_facts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("raw_content")
    return table(spark, d, "search_results").select("result_row_id", F.size(extract.phones(t)).alias("phones"), F.array_join(extract.phones(t), " | ").alias("phone_list"), F.size(extract.addresses(t)).alias("addresses"),
                                                    F.array_join(extract.linked_domains(t, F.col("canonical_hostname")), " | ").alias("linked_domains"), F.size(extract.prefixed_prices(t)).alias("prefixed_prices"), ids.sha1(F.coalesce("title", F.lit(""))).alias("title_sha1"))


#: Words a claim may be about, and months that stand for the list of places, parameters of the query.
CLAIMS = {"price": r"costs ([0-9]+[.][0-9]{2} [A-Za-z€]+)", "delay": r"within ([0-9]+ hours)", "channels": r"([0-9]+) channels"}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTHS_IN = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(' ' || coalesce(text, '') || ' ', '[^A-Za-z]{n}[^A-Za-z]') THEN '{n}' END" for n in MONTHS) + "], lambda x: x IS NOT NULL)"
_CLAIM = "CASE " + " ".join(f"WHEN regexp_extract(coalesce(text, ''), '{p}', 1) <> '' THEN '{k}: ' || regexp_extract(text, '{p}', 1)" for k, p in CLAIMS.items()) + " END"


@query(f"""
SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '{extract.COMPANY}', 1), '') AS company, CASE WHEN len({_MONTHS_IN}) > 3 THEN 'AMBIGUOUS' WHEN len({_MONTHS_IN}) > 0 THEN array_to_string({_MONTHS_IN}, ' | ') END AS listed, {_CLAIM} AS claim,
    coalesce(length(replace({fold('brand_name')}, ' ', '')) >= 4 AND contains(replace({fold(host_sql('canonical_url'))}, ' ', ''), replace({fold('brand_name')}, ' ', '')), false) AS host_names_brand FROM documents""")
def claims(spark: SparkSession, d: str) -> DataFrame:
    """Companies, listed words and the first claim of each document, and whether its host is named after its brand."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", extract.company(t).alias("company"), extract.places(t, MONTHS).alias("listed"), extract.first_claim(t, CLAIMS).alias("claim"), urls.names_brand(urls.host(F.col("canonical_url")), F.col("brand_name")).alias("host_names_brand"))
