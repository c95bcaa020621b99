"""Queries of composed scores: cleaned candidates with penalties, providers, diagnostic components, entity measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import numbers, text
from sievework.operators import relops
from sievework.plans.ranking import HYGIENE_POINTS, level_points, points_sql
from sievework.plans.registry import QUERIES, query
from sievework.plans.scalars import fold
from sievework.session import table

# Phrases of adverts, words that name no one, words of devices.
PROMOTIONAL = (
    "comece seu teste", "comece agora", "teste gratis", "testar gratis", "assine agora", "compre agora", "clique aqui", "escolha seu plano", "seu teste iptv", "teste iptv",
    "get started", "start your trial", "start free trial", "free trial", "buy now", "subscribe now", "sign up", "customer support", "customer service", "contact us", "best price",
    "view plans", "check for free trial", "try it free", "teste gratuito", "clique", "add your subscription", "comprar iptv", "escolha o provedor",
)
GENERIC = (
    "best", "premium", "live", "service", "services", "provider", "providers", "subscription", "subscriptions", "streaming", "smart", "digital", "global", "online", "official", "review", "reviews",
    "test", "teste", "gratis", "free", "trial", "price", "pricing", "plan", "plans", "support", "channel", "channels", "content", "device", "devices", "player", "app", "apps", "platform", "platforms",
    "lista", "ranking", "comparison", "melhor", "melhores", "mejor", "mejores", "servico", "servicos", "servicio", "servicios", "provedor", "provedores", "proveedor", "proveedores",
)
DEVICES = ("box", "firestick", "device", "player", " app")
_ANY = lambda words: "(" + "|".join(words) + ")"

_HYGIENE = f"""
WITH c AS (SELECT DISTINCT candidate_id, coalesce(nullif(canonical_key, ''), candidate_id) AS k, corrected_name AS name, domain_count AS dc, mention_count AS mc, supporting_row_ids AS ids
    FROM candidate_hygiene_audit WHERE final_classification = 'IPTV_SERVICE_CANDIDATE'),
n AS (SELECT k, arg_min(name, struct_pack(d := -dc, m := -mc, l := length(name), f := lower(name), r := name)) AS name FROM c WHERE name IS NOT NULL GROUP BY 1),
i AS (SELECT DISTINCT k, unnest(ids) AS id FROM c),
m AS (SELECT i.k, r.mention_row_id, page_row_id, domain, region_code, lang, source_level, coalesce(url, '') || ' ' || coalesce(context, '') AS said, {fold('context')} AS ctx FROM i JOIN raw_brand_mentions r ON r.mention_row_id = i.id),
s AS (SELECT k, count(*) AS mentions, count(DISTINCT page_row_id) AS pages, count(DISTINCT domain) AS domains, count(DISTINCT region_code) AS regions, count(DISTINCT lang) AS langs, min(source_level) AS best, max(source_level) AS worst,
    bool_or(contains(said, '2026')) AS y26, bool_or(contains(said, '2025')) AS y25, count_if(regexp_matches(ctx, '{_ANY(PROMOTIONAL)}')) AS promo, count_if(ctx <> '') AS told FROM m GROUP BY 1),
t AS (SELECT k, max(n) AS modal FROM (SELECT k, ctx, count(*) AS n FROM m WHERE ctx <> '' GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT k, name, {fold('name')} AS f, list_filter(string_split({fold('name')}, ' '), lambda x: x NOT IN ('iptv', 'tv', '')) AS core FROM n),
p AS (SELECT s.*, w.name, least(50, 10 * domains) + {points_sql('best', HYGIENE_POINTS)} + CASE WHEN y26 THEN 15 WHEN y25 THEN 10 ELSE 5 END + least(10, 3 * regions + 2 * langs) AS points,
    CASE WHEN mentions = 1 AND domains = 1 AND best = 'C' AND worst = 'C' THEN 20 ELSE 0 END + CASE WHEN len(core) > 0 AND len(list_filter(core, lambda x: x NOT IN ('{"', '".join(GENERIC)}'))) = 0 THEN 15 ELSE 0 END
    + CASE WHEN promo >= 0.5 * mentions THEN 10 ELSE 0 END + CASE WHEN regexp_matches(f, '{_ANY(DEVICES)}') THEN 10 ELSE 0 END + CASE WHEN told >= 3 AND domains >= 2 AND coalesce(modal, 0) >= 0.67 * told THEN 10 ELSE 0 END AS penalty
    FROM s JOIN w USING (k) LEFT JOIN t USING (k))
SELECT k AS entity, name, mentions, pages, domains, penalty::BIGINT AS penalty, greatest(0, least(100, points - penalty))::BIGINT AS score FROM p"""


@query(f"""
SELECT row_number() OVER (ORDER BY score DESC, domains DESC, pages DESC, mentions DESC, lower(name), entity) AS rank, * FROM ({_HYGIENE}) ORDER BY rank LIMIT 50""")
def hygiene_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned candidates by points less penalties: lone weak mentions, generic names, adverts, devices, contexts copied between domains."""
    c = table(spark, d, "candidate_hygiene_audit").where("final_classification = 'IPTV_SERVICE_CANDIDATE'")
    c = c.select("candidate_id", F.coalesce(F.when(F.col("canonical_key") != "", F.col("canonical_key")), "candidate_id").alias("entity"), F.col("corrected_name").alias("name"), "domain_count", "mention_count", "supporting_row_ids").distinct()
    order = F.struct((-F.col("domain_count")).alias("d"), (-F.col("mention_count")).alias("m"), F.length("name").alias("l"), F.lower("name").alias("f"), "name")
    names = c.where("name IS NOT NULL").groupBy("entity").agg(F.min_by("name", order).alias("name"))
    ids = c.select("entity", F.explode("supporting_row_ids").alias("mention_row_id")).distinct()
    m = ids.join(table(spark, d, "raw_brand_mentions"), "mention_row_id").select(
        "entity", "page_row_id", "domain", "region_code", "lang", "source_level", F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("context", F.lit(""))).alias("said"), text.ascii_fold(F.col("context")).alias("ctx"))
    s = m.groupBy("entity").agg(
        F.count("*").alias("mentions"), F.count_distinct("page_row_id").alias("pages"), F.count_distinct("domain").alias("domains"), F.count_distinct("region_code").alias("regions"), F.count_distinct("lang").alias("langs"),
        F.min("source_level").alias("best"), F.max("source_level").alias("worst"), F.bool_or(F.col("said").contains("2026")).alias("y26"), F.bool_or(F.col("said").contains("2025")).alias("y25"),
        F.count_if(F.col("ctx").rlike(_ANY(PROMOTIONAL))).alias("promo"), F.count_if(F.col("ctx") != "").alias("told"))
    modal = m.where("ctx != ''").groupBy("entity", "ctx").agg(F.count("*").alias("n")).groupBy("entity").agg(F.max("n").alias("modal"))
    s = s.join(names, "entity").join(modal, "entity", "left")
    core = F.filter(text.tokens(F.col("name")), lambda w: ~w.isin("iptv", "tv"))
    when = lambda c, n: F.when(c, n).otherwise(0)
    penalty = (when((F.col("mentions") == 1) & (F.col("domains") == 1) & (F.col("best") == "C") & (F.col("worst") == "C"), 20) + when((F.size(core) > 0) & F.forall(core, lambda w: w.isin(*GENERIC)), 15)
               + when(F.col("promo") >= 0.5 * F.col("mentions"), 10) + when(text.ascii_fold(F.col("name")).rlike(_ANY(DEVICES)), 10)
               + when((F.col("told") >= 3) & (F.col("domains") >= 2) & (F.coalesce("modal", F.lit(0)) >= 0.67 * F.col("told")), 10))
    points = F.least(F.lit(50), 10 * F.col("domains")) + level_points(F.col("best"), HYGIENE_POINTS) + F.when(F.col("y26"), 15).when(F.col("y25"), 10).otherwise(5) + F.least(F.lit(10), 3 * F.col("regions") + 2 * F.col("langs"))
    out = s.select("entity", "name", "mentions", "pages", "domains", penalty.cast("bigint").alias("penalty"), numbers.bounded(points - penalty).cast("bigint").alias("score"))
    return relops.ranked(out, [F.desc("score"), F.desc("domains"), F.desc("pages"), F.desc("mentions"), F.lower("name"), F.asc("entity")], 50)


@query("""
WITH b AS (SELECT canonical_brand, brand_id, source_count AS sc, len(coalesce(domains, [])) AS nd, len(coalesce(platforms, [])) AS np, len(coalesce(evidence_urls, [])) AS nu FROM brand_accumulators WHERE canonical_brand IS NOT NULL),
r AS (SELECT *, round_even(sc + 2 * nd + 1.5::DOUBLE * np + 0.5::DOUBLE * least(nu, 25), 2)::DOUBLE AS recurrence, CASE WHEN sc >= 6 AND nd >= 3 AND np >= 2 THEN 'HIGH' WHEN (sc >= 3 OR nu >= 3) AND nd >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY canonical_brand ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, recurrence DESC, nd DESC, np DESC, nu DESC, brand_id) AS n FROM r)
SELECT row_number() OVER (ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, recurrence DESC, nd DESC, np DESC, nu DESC, canonical_brand) AS rank, canonical_brand, brand_id, confidence, recurrence FROM f WHERE n = 1 ORDER BY rank LIMIT 50""")
def provider_top50(spark: SparkSession, d: str) -> DataFrame:
    """Brands by confidence, recurrence and breadth, one row a brand."""
    r = QUERIES["recurrence_score"](spark, d).where("canonical_brand IS NOT NULL")
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    sizes = table(spark, d, "brand_accumulators").select("brand_id", n("domains").alias("nd"), n("platforms").alias("np"), n("evidence_urls").alias("nu"))
    r = r.join(sizes, "brand_id").withColumn("place", F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2))
    by = [F.col("place"), -F.col("recurrence"), -F.col("nd"), -F.col("np"), -F.col("nu")]
    first = relops.first_per_key(r, ["canonical_brand"], [*by, F.col("brand_id")])
    return relops.ranked(first, [*by, F.col("canonical_brand")], 50).select("rank", "canonical_brand", "brand_id", "confidence", "recurrence")


# Weights of the diagnostic components, and of source levels.
COMPONENTS = {"independence": 30.0, "quality": 20.0, "diversity": 15.0, "contexts": 10.0, "languages": 5.0, "regions": 5.0, "aliases": 5.0, "provenance": 5.0}
LEVEL_WEIGHTS = {"A": 1.0, "B": 0.8, "C": 0.5, "D": 0.2, "E": 0.0}
#: Points that a rate of copies of 1 costs.
COPY_PENALTY = 15.0

_MEASURES = f"""
WITH m AS (SELECT normalized_name AS entity, * FROM raw_brand_mentions WHERE normalized_name <> ''),
q AS (SELECT entity, sum(w)::DOUBLE AS quality FROM (SELECT entity, domain, max(CASE source_level WHEN 'A' THEN 10 WHEN 'B' THEN 8 WHEN 'C' THEN 5 WHEN 'D' THEN 2 WHEN 'E' THEN 0 ELSE 2 END) AS w FROM m WHERE domain IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT entity, count(*) AS mentions, count(DISTINCT domain) AS independence, count(DISTINCT evidence_type) AS platforms, count(DISTINCT operation_id) AS contexts, count(DISTINCT lang) AS languages, count(DISTINCT region_code) AS regions,
    count(DISTINCT raw_name) AS aliases, count(DISTINCT page_row_id) AS pages, count_if(len(supporting_row_ids) > 0 AND context IS NOT NULL) / count(*)::DOUBLE AS provenance,
    1 - count(DISTINCT struct_pack(a := raw_name, b := page_row_id, c := context)) / count(*)::DOUBLE AS copies, count_if(source_level IN ('A', 'B')) AS good, min(retrieved_at) AS first_seen, max(retrieved_at) AS last_seen FROM m GROUP BY 1)
SELECT s.*, coalesce(quality, 0) / 10 AS quality, sqrt(coalesce(quality, 0) / 10 * platforms) AS diversity FROM s LEFT JOIN q USING (entity)"""


def measures(spark: SparkSession, d: str) -> DataFrame:
    """One aggregation of each entity's mentions, and the best level of each of its domains."""
    m = table(spark, d, "raw_brand_mentions").where("normalized_name != ''").withColumnRenamed("normalized_name", "entity")
    tenths = F.coalesce(*[F.when(F.col("source_level") == k, F.lit(round(10 * v))) for k, v in LEVEL_WEIGHTS.items()], F.lit(2))
    q = m.where("domain IS NOT NULL").groupBy("entity", "domain").agg(F.max(tenths).alias("w")).groupBy("entity").agg((F.sum("w") / 10).alias("quality"))
    n = F.count("*")
    s = m.groupBy("entity").agg(
        n.alias("mentions"), F.count_distinct("domain").alias("independence"), F.count_distinct("evidence_type").alias("platforms"), F.count_distinct("operation_id").alias("contexts"), F.count_distinct("lang").alias("languages"),
        F.count_distinct("region_code").alias("regions"), F.count_distinct("raw_name").alias("aliases"), F.count_distinct("page_row_id").alias("pages"), (F.count_if((F.size("supporting_row_ids") > 0) & F.col("context").isNotNull()) / n).alias("provenance"),
        (1 - F.count_distinct(F.struct("raw_name", "page_row_id", "context")) / n).alias("copies"), F.count_if(F.col("source_level").isin("A", "B")).alias("good"), F.min("retrieved_at").alias("first_seen"), F.max("retrieved_at").alias("last_seen"))
    s = s.join(q, "entity", "left").withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return s.withColumn("diversity", numbers.geometric(F.col("quality"), F.col("platforms")))


@query(f"""
SELECT entity, mentions, independence AS domains, platforms, contexts, languages, regions, aliases, pages, good, round_even(provenance, 6) AS provenance, round_even(copies, 6) AS copies, round_even(quality, 6) AS quality, round_even(diversity, 6) AS diversity, first_seen, last_seen FROM ({_MEASURES})""")
def entity_measures(spark: SparkSession, d: str) -> DataFrame:
    r = numbers.rounded
    return measures(spark, d).select("entity", "mentions", F.col("independence").alias("domains"), "platforms", "contexts", "languages", "regions", "aliases", "pages", "good", r(F.col("provenance")).alias("provenance"), r(F.col("copies")).alias("copies"),
                                     r(F.col("quality")).alias("quality"), r(F.col("diversity")).alias("diversity"), "first_seen", "last_seen")


_SHARES = " + ".join(f"coalesce({k} / nullif(max({k}) OVER (), 0)::DOUBLE, 0) * {w * 100 / sum(COMPONENTS.values())!r}::DOUBLE" for k, w in COMPONENTS.items())


@query(f"""
WITH s AS ({_MEASURES}), t AS (SELECT *, round_even(greatest(0, least(100, {_SHARES} - {COPY_PENALTY} * copies)), 6) AS score FROM s)
SELECT row_number() OVER (ORDER BY score DESC, independence DESC, quality DESC, copies, provenance DESC, entity) AS rank, entity, score, independence AS domains, round_even(quality, 6) AS quality FROM t ORDER BY rank LIMIT 100""")
def diagnostic_rank(spark: SparkSession, d: str) -> DataFrame:
    """Eight components as shares of their greatest value, weighted, less the penalty for copies. The greatest values are one row, joined to all."""
    s = measures(spark, d)
    top = s.agg(*[F.max(k).alias("max_" + k) for k in COMPONENTS])
    scale = 1 / sum(COMPONENTS.values())
    total = sum((numbers.normalized(F.col(k), F.col("max_" + k)) * (w * scale) for k, w in COMPONENTS.items()), F.lit(0.0)) - COPY_PENALTY * F.col("copies")
    r = s.crossJoin(F.broadcast(top)).withColumn("score", numbers.rounded(numbers.bounded(total)))
    best = relops.ranked(r, [F.desc("score"), F.desc("independence"), F.desc("quality"), F.asc("copies"), F.desc("provenance"), F.asc("entity")], 100)
    return best.select("rank", "entity", "score", F.col("independence").alias("domains"), numbers.rounded(F.col("quality")).alias("quality"))


@query("""
WITH p AS (SELECT canonical_hostname AS host, 'OWN' AS kind, result_row_id AS id, tavily_score AS s, 0 AS linked FROM search_results WHERE canonical_hostname IS NOT NULL
    UNION ALL SELECT regexp_replace(regexp_extract(lower(u), '^https?://([^/?#:]+)', 1), '^www[.]', ''), 'LINKED', result_row_id, tavily_score, 1 FROM (SELECT result_row_id, tavily_score, unnest(regexp_extract_all(coalesce(raw_content, ''), 'https?://[^ \\t\\r\\n)>"]+')) AS u FROM search_results)
    UNION ALL SELECT domain, 'MENTION', page_row_id, NULL, 0 FROM raw_brand_mentions WHERE domain IS NOT NULL)
SELECT host, count(*) AS evidence, bool_or(kind = 'OWN') AS own, bool_or(kind = 'MENTION') AS mentioned, count(DISTINCT id) AS pages, sum(linked)::BIGINT AS linked, max(s) AS best_score, arg_min(kind, struct_pack(i := id, k := kind)) AS first_kind FROM p WHERE host <> '' GROUP BY 1""")
def candidate_domains(spark: SparkSession, d: str) -> DataFrame:
    """Each domain seen, as own host, linked host or host of a mention, with flags, sums and the first evidence."""
    from sievework.functions import extract

    r = table(spark, d, "search_results")
    own = r.where("canonical_hostname IS NOT NULL").select(F.col("canonical_hostname").alias("host"), F.lit("OWN").alias("kind"), F.col("result_row_id").alias("id"), F.col("tavily_score").alias("s"), F.lit(0).alias("linked"))
    found = r.select(F.explode(extract.all_of(F.col("raw_content"), extract.ADDRESS)).alias("u"), "result_row_id", "tavily_score")
    links = found.select(F.regexp_replace(F.regexp_extract(F.lower("u"), "^https?://([^/?#:]+)", 1), "^www[.]", "").alias("host"), F.lit("LINKED").alias("kind"), F.col("result_row_id").alias("id"), F.col("tavily_score").alias("s"), F.lit(1).alias("linked"))
    said = table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL").select(F.col("domain").alias("host"), F.lit("MENTION").alias("kind"), F.col("page_row_id").alias("id"), F.lit(None).cast("double").alias("s"), F.lit(0).alias("linked"))
    p = own.unionByName(links).unionByName(said).where("host != ''")
    return p.groupBy("host").agg(F.count("*").alias("evidence"), F.bool_or(F.col("kind") == "OWN").alias("own"), F.bool_or(F.col("kind") == "MENTION").alias("mentioned"), F.count_distinct("id").alias("pages"), F.sum("linked").alias("linked"),
                                 F.max("s").alias("best_score"), F.min_by("kind", F.struct("id", "kind")).alias("first_kind"))


@query("""
WITH s AS (SELECT DISTINCT r.query_id AS o, q.category AS g, canonical_hostname AS e FROM search_results r JOIN query_plan q USING (query_id) WHERE canonical_hostname IS NOT NULL), z AS (SELECT o, g, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT a.o AS a, b.o AS b, a.g, a.n AS na, b.n AS nb FROM z a JOIN z b ON a.g = b.g AND a.o < b.o), c AS (SELECT x.o AS a, y.o AS b, count(*) AS k FROM s x JOIN s y ON x.e = y.e AND x.o < y.o GROUP BY 1, 2)
SELECT g AS category, count(*) AS pairs, round_even(avg(coalesce(k, 0) / (na + nb - coalesce(k, 0))::DOUBLE), 6) AS mean_jaccard, round_even(max(coalesce(k, 0) / (na + nb - coalesce(k, 0))::DOUBLE), 6) AS greatest_jaccard FROM p LEFT JOIN c USING (a, b) GROUP BY 1""")
def group_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Mean and greatest Jaccard similarity of the host sets of a category's queries; pairs without a common host count as 0. Groups are the plan's queries by category."""
    from sievework.operators.similarity import set_pairs

    plan = table(spark, d, "query_plan").select("query_id", "category")
    r = table(spark, d, "search_results").where("canonical_hostname IS NOT NULL").select("query_id", "canonical_hostname").join(relops.small(plan), "query_id")
    owners = r.select("query_id", "category").distinct()
    n = owners.groupBy("category").agg(F.count("*").alias("n"))
    p = set_pairs(r, "query_id", "canonical_hostname").join(owners.select(F.col("query_id").alias("a"), F.col("category").alias("category")), "a").join(owners.select(F.col("query_id").alias("b"), F.col("category").alias("other")), "b").where("category = other")
    j = p.withColumn("j", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")))
    g = n.join(j.groupBy("category").agg(F.sum("j").alias("total"), F.max("j").alias("most")), "category", "left").withColumn("pairs", F.expr("n * (n - 1) div 2")).where("pairs > 0")
    return g.select("category", "pairs", numbers.rounded(F.coalesce("total", F.lit(0.0)) / F.col("pairs")).alias("mean_jaccard"), numbers.rounded(F.coalesce("most", F.lit(0.0))).alias("greatest_jaccard"))


@query("""
WITH n AS (SELECT page_row_id, domain, array_to_string(names, chr(31)) AS names, n FROM (
    SELECT page_row_id, min(domain) AS domain, list(name ORDER BY place, name) AS names, count(*) AS n FROM (SELECT page_row_id, min(domain) AS domain, normalized_name AS name, min(mention_position) AS place FROM raw_brand_mentions WHERE normalized_name IS NOT NULL AND page_row_id IS NOT NULL GROUP BY 1, 3) GROUP BY 1)),
t AS (SELECT result_row_id, title FROM search_results WHERE length(title) >= 30)
SELECT sha256(lower(title) || chr(30) || names) AS print, count(*) AS pages, count(DISTINCT domain) AS hosts, min(page_row_id) AS first_page FROM n JOIN t ON page_row_id = result_row_id WHERE n >= 3 GROUP BY 1""")
def title_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the same title and the same names in the same order. A page's names are few; its list is built once for each page."""
    m = table(spark, d, "raw_brand_mentions").where("normalized_name IS NOT NULL AND page_row_id IS NOT NULL")
    one = m.groupBy("page_row_id", F.col("normalized_name").alias("name")).agg(F.min("domain").alias("domain"), F.min("mention_position").alias("at"))
    per = one.groupBy("page_row_id").agg(F.min("domain").alias("domain"), F.sort_array(F.collect_list(F.struct("at", "name"))).alias("l")).where(F.size("l") >= 3)
    t = table(spark, d, "search_results").where("length(title) >= 30").select(F.col("result_row_id").alias("page_row_id"), "title")
    p = per.join(t, "page_row_id").withColumn("print", F.sha2(F.concat(F.lower("title"), F.lit("\x1e"), F.array_join(F.transform("l", lambda x: x["name"]), "\x1f")), 256))
    return p.groupBy("print").agg(F.count("*").alias("pages"), F.count_distinct("domain").alias("hosts"), F.min("page_row_id").alias("first_page"))


#: Words that speak for and against a page that ranks or compares, parameters of the page score.
FOR_PAGE, AGAINST_PAGE = ("best", "review", "compared", "ranking", "mejores", "meilleurs", "beste", "melhores"), ("login", "cookie", "privacy", "terms of use", "basket")
_HEAD = "lower(coalesce(title, '') || ' ' || coalesce(content, ''))"
_COUNT = lambda words: " + ".join(f"contains({_HEAD}, '{w}')::INT" for w in words)
_LINES = "string_split(replace(coalesce(raw_content, ''), chr(13), ''), chr(10))"
_PAGES = f"""
WITH l AS (SELECT *, {_LINES} AS l FROM search_results), c AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '^(?:#+ )?[0-9]+[.)] '))) AS cand, len(list_filter(l, lambda x: regexp_matches(x, '^(?:#+ |=+ )'))) AS heads, len(list_filter(l, lambda x: starts_with(x, '|'))) AS tabled FROM l),
s AS (SELECT *, cand >= 3 OR tabled > 0 OR heads >= 4 AS structural FROM c)
SELECT result_row_id, canonical_hostname, is_duplicate, structural, cand, greatest(0, least(100, greatest(0, least(15, round_even(15 * coalesce(tavily_score, 0), 0))) + least(30, 3 * ({_COUNT(FOR_PAGE)})) + CASE WHEN structural THEN 15 ELSE 0 END + least(20, 2 * cand)
    + CASE WHEN contains(coalesce(title, '') || coalesce(raw_content, ''), '2026') THEN 8 WHEN contains(coalesce(title, '') || coalesce(raw_content, ''), '2025') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(coalesce(raw_content, ''), '(?m)^(?:By|Von|Por|Par) ') THEN 7 ELSE 0 END
    - least(35, 8 * ({_COUNT(AGAINST_PAGE)})) - CASE WHEN coalesce(raw_content, '') = '' THEN 5 ELSE 0 END))::BIGINT AS score FROM s"""


def page_scores(pages: DataFrame) -> DataFrame:
    """``pages`` with ``cand`` (numbered lines), ``structural`` and ``score`` (0 to 100): search score, words for and against, structure, year, author, emptiness."""
    from sievework.functions import extract

    lines = extract.lines(F.col("raw_content"))
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    p = pages.withColumn("cand", n(extract.NUMBERED)).withColumn("structural", (F.col("cand") >= 3) | F.exists(lines, lambda x: x.startswith("|")) | (n(extract.HEADING) >= 4))
    head = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    count = lambda words: sum((head.contains(w).cast("int") for w in words), F.lit(0))
    raw = F.coalesce("raw_content", F.lit(""))
    said = F.concat(F.coalesce("title", F.lit("")), raw)
    total = (numbers.bounded(F.bround(15 * F.coalesce("tavily_score", F.lit(0.0))), 0, 15) + F.least(F.lit(30), 3 * count(FOR_PAGE)) + F.when(F.col("structural"), 15).otherwise(0) + F.least(F.lit(20), 2 * F.col("cand"))
             + F.when(said.contains("2026"), 8).when(said.contains("2025"), 5).otherwise(0) + F.when(raw.rlike("(?m)^(?:By|Von|Por|Par) "), 7).otherwise(0) - F.least(F.lit(35), 8 * count(AGAINST_PAGE)) - F.when(raw == "", 5).otherwise(0))
    return p.withColumn("score", numbers.bounded(total).cast("bigint"))


@query(f"SELECT result_row_id, score, structural, structural AND score >= 60 AS eligible, NOT (structural AND score >= 60) AND score >= 45 AS review FROM ({_PAGES})")
def page_score(spark: SparkSession, d: str) -> DataFrame:
    """Pages worth mining, and those to look at."""
    p = page_scores(table(spark, d, "search_results"))
    ok = F.col("structural") & (F.col("score") >= 60)
    return p.select("result_row_id", "score", "structural", ok.alias("eligible"), (~ok & (F.col("score") >= 45)).alias("review"))


@query(f"""
WITH p AS ({_PAGES}), h AS (SELECT canonical_hostname AS host, count(*) AS pages, count_if(structural AND score >= 60) AS eligible, sum(score)::BIGINT AS points, count_if(is_duplicate) AS dups FROM p WHERE canonical_hostname IS NOT NULL GROUP BY 1),
m AS (SELECT domain AS host, count(DISTINCT normalized_name) AS names, count(DISTINCT region_code) AS regions, count(DISTINCT lang) AS langs FROM raw_brand_mentions WHERE domain IS NOT NULL GROUP BY 1)
SELECT host, pages, eligible, coalesce(names, 0) AS names, least(100, round_even(10 * eligible + least(25, coalesce(names, 0)) + 5 * coalesce(regions, 0) + 5 * coalesce(langs, 0) + 0.25::DOUBLE * points / pages - 3 * dups, 0))::BIGINT AS productivity FROM h LEFT JOIN m USING (host)""")
def domain_productivity_score(spark: SparkSession, d: str) -> DataFrame:
    """Hosts by eligible pages, names, regions, languages and mean page score, less repeated captures."""
    p = page_scores(table(spark, d, "search_results").where("canonical_hostname IS NOT NULL"))
    h = p.groupBy(F.col("canonical_hostname").alias("host")).agg(F.count("*").alias("pages"), F.count_if(F.col("structural") & (F.col("score") >= 60)).alias("eligible"), F.sum("score").alias("points"), F.count_if("is_duplicate").alias("dups"))
    m = table(spark, d, "raw_brand_mentions").where("domain IS NOT NULL").groupBy(F.col("domain").alias("host")).agg(F.count_distinct("normalized_name").alias("names"), F.count_distinct("region_code").alias("regions"), F.count_distinct("lang").alias("langs"))
    j = h.join(m, "host", "left").fillna(0, ["names", "regions", "langs"])
    total = 10 * F.col("eligible") + F.least(F.lit(25), F.col("names")) + 5 * F.col("regions") + 5 * F.col("langs") + 0.25 * F.col("points") / F.col("pages") - 3 * F.col("dups")
    return j.select("host", "pages", "eligible", "names", F.least(F.lit(100), F.bround(total)).cast("bigint").alias("productivity"))
