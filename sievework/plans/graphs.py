"""Queries of similarity and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import relops
from sievework.operators.graph import components
from sievework.operators.similarity import order_similarity, overlap, set_pairs
from sievework.plans.registry import query
from sievework.session import table, written


@query("""
WITH s AS (SELECT DISTINCT query_id AS o, canonical_hostname AS e FROM search_results WHERE query_id IS NOT NULL AND canonical_hostname IS NOT NULL), z AS (SELECT o, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.o AS a, y.o AS b, count(*) AS common FROM s x JOIN s y ON x.e = y.e AND x.o < y.o GROUP BY 1, 2)
SELECT a, b, common, round(common / (u.n + v.n - common)::DOUBLE, 6) AS jaccard FROM p JOIN z u ON u.o = a JOIN z v ON v.o = b""")
def query_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the host sets of every two queries; there are as many pairs as pairs of planned queries."""
    r = table(spark, d, "search_results").where("query_id IS NOT NULL")
    p = set_pairs(r, "query_id", "canonical_hostname")
    return p.select("a", "b", "common", F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6).alias("jaccard"))


@query("""
WITH k AS (SELECT b.brand_id, b.canonical_brand, d.dom FROM brand_accumulators b, unnest(b.domains) d(dom)),
n AS (SELECT DISTINCT canonical_brand AS brand, dom FROM k),
f AS (SELECT canonical_brand, source_count, brand_id FROM brand_accumulators)
SELECT dom AS domain, count(*) AS brands, min(brand) AS first_brand FROM n GROUP BY 1 HAVING count(*) > 1""")
def brand_domain_bridges(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "brand_accumulators").select("canonical_brand", F.explode("domains").alias("domain"))
    return relops.shared_values(b, "canonical_brand", "domain").select("domain", F.col("owners").alias("brands"), F.col("first_owner").alias("first_brand"))


@query("""
WITH RECURSIVE n AS (SELECT DISTINCT canonical_hostname AS h, sha256(content) AS c FROM search_results WHERE canonical_hostname IS NOT NULL AND length(content) >= 80),
e AS (SELECT DISTINCT a.h AS x, b.h AS y FROM n a JOIN n b USING (c)),
r(h, l) AS (SELECT h, h FROM n UNION SELECT r.h, e.y FROM r JOIN e ON e.x = r.l)
SELECT h AS host, min(l) AS component FROM r GROUP BY 1""")
def independence_components(spark: SparkSession, d: str) -> DataFrame:
    """Hosts tied by equal content. A text links its hosts as a star around its least host, never as all pairs."""
    n = table(spark, d, "search_results").where("canonical_hostname IS NOT NULL AND length(content) >= 80").select(F.col("canonical_hostname").alias("h"), F.sha2("content", 256).alias("c")).distinct()
    star = n.join(n.groupBy("c").agg(F.min("h").alias("low")), "c").select(F.col("h").alias("a"), F.col("low").alias("b"))
    return components(star).select(F.col("id").alias("host"), "component")


#: Lists of so many names or more are compared; two of different hosts are probable replicas at this overlap and this agreement in order.
LEAST_NAMES, OVERLAP, ORDER = 8, 0.85, 0.75


def name_lists(mentions: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(pages: page, domain, names; lists as a written table: names, page, low, high): each page's distinct names in their order, for pages of ``least`` names or more.

    Equal lists are one class, named by its least page; ``low`` and ``high`` are the least and the greatest host it stands on.
    """
    m = mentions.where("normalized_name IS NOT NULL AND domain IS NOT NULL")
    place = F.struct("mention_position", "mention_row_id")
    one = m.groupBy("page_row_id", F.col("normalized_name").alias("name")).agg(F.min("domain").alias("domain"), F.min(place).alias("place"))
    per = one.groupBy("page_row_id").agg(F.min("domain").alias("domain"), F.sort_array(F.collect_list(F.struct("place", "name"))).alias("l")).where(F.size("l") >= least)
    per = written(per.select(F.col("page_row_id").alias("page"), "domain", F.transform("l", lambda x: x["name"]).alias("names")), "pages")
    return per, written(per.groupBy("names").agg(F.min("page").alias("page"), F.min("domain").alias("low"), F.max("domain").alias("high")), "lists")


def replica_links(lists: DataFrame, overlap_least: float, least: int) -> DataFrame:
    """``a, b, overlap, order_similarity``: ``a < b`` two lists of different hosts whose common names are at least this share of the shorter list, ``a = b`` a list that stands on several hosts.

    Of a list of k names, one of the first ``k - ceil(share * k) + 1`` from the rarest up is common to a longer list that overlaps enough; of the longer list, one of the first
    ``k - ceil(share * least) + 1``. Only these meet, so common names pair no lists.
    """
    df = lists.select(F.explode("names").alias("n")).groupBy("n").agg(F.count("*").alias("df"))
    ranked = lists.select("page", F.size("names").alias("k"), F.explode("names").alias("n")).join(df, "n").groupBy("page", "k").agg(F.sort_array(F.collect_list(F.struct("df", "n"))).alias("by_df"))
    head = lambda share_of: ranked.select("page", "k", F.explode(F.slice("by_df", F.lit(1), (F.col("k") - F.ceil(overlap_least * share_of - 1e-9) + 1).cast("int"))).alias("r")).select("page", "k", F.col("r.n").alias("n"))
    short, long = head(F.col("k")), head(F.lit(float(least)))
    met = short.alias("x").join(long.alias("y"), F.expr("x.n = y.n AND x.page != y.page AND x.k <= y.k"))
    pairs = met.select(F.least("x.page", "y.page").alias("a"), F.greatest("x.page", "y.page").alias("b")).distinct()
    side = lambda c, k: lists.select(F.col("page").alias(c), *[F.col(x).alias(x + k) for x in ("names", "low", "high")])
    both = pairs.join(side("a", "1"), "a").join(side("b", "2"), "b").where("NOT (low1 = high1 AND low2 = high2 AND low1 = low2)").withColumn("overlap", overlap(F.col("names1"), F.col("names2"))).where(F.col("overlap") >= overlap_least)
    links = both.select("a", "b", F.bround("overlap", 6).alias("overlap"), F.bround(order_similarity(F.col("names1"), F.col("names2")), 6).alias("order_similarity"))
    same = lists.where("low < high").select(F.col("page").alias("a"), F.col("page").alias("b"), F.lit(1.0).alias("overlap"), F.lit(1.0).alias("order_similarity"))
    return links.unionByName(same)


_LISTS = """
WITH o AS (SELECT page_row_id AS page, min(domain) AS dom, normalized_name AS name, min(struct_pack(p := mention_position, i := mention_row_id)) AS place FROM raw_brand_mentions WHERE normalized_name IS NOT NULL AND domain IS NOT NULL GROUP BY 1, 3),
p AS (SELECT page, min(dom) AS dom, list(name ORDER BY place, name) AS names FROM o GROUP BY 1 HAVING count(*) >= {least}),
l AS (SELECT names, min(page) AS page, min(dom) AS low, max(dom) AS high FROM p GROUP BY 1)"""


@query(_LISTS.format(least=4) + """
SELECT x.page AS a, y.page AS b, round_even(len(list_intersect(x.names, y.names)) / least(len(x.names), len(y.names))::DOUBLE, 6) AS overlap FROM l x JOIN l y ON x.page < y.page AND NOT (x.low = x.high AND y.low = y.high AND x.low = y.low)
WHERE len(list_intersect(x.names, y.names)) / least(len(x.names), len(y.names))::DOUBLE >= 0.7 UNION ALL SELECT page, page, 1.0::DOUBLE FROM l WHERE low < high""")
def overlapping_lists(spark: SparkSession, d: str) -> DataFrame:
    """Name lists of four or more names that overlap by 0.7, of different hosts; one row a pair of distinct lists, and one for each list that several hosts have."""
    _, lists = name_lists(table(spark, d, "raw_brand_mentions"), 4)
    return replica_links(lists, 0.7, 4).select("a", "b", "overlap")


@query(_LISTS.format(least=4) + " SELECT p.page, p.dom AS domain, l.page AS class_id, low < high AS on_several_hosts FROM p JOIN l USING (names)")
def list_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each page's name list: equal lists are one."""
    per, lists = name_lists(table(spark, d, "raw_brand_mentions"), 4)
    return per.join(lists.select("names", F.col("page").alias("class_id"), (F.col("low") < F.col("high")).alias("on_several_hosts")), "names").select("page", "domain", "class_id", "on_several_hosts")


def replica_pages(mentions: DataFrame, overlap_least: float, least: int, order_least: float) -> DataFrame:
    """The links of ``replica_links`` that also agree in order, with a row for each ``page`` (of class ``class_id``, on ``domain``) that the other class, or its own where ``a = b``,
    meets on another host: no pairs of copies are written.
    """
    per, lists = name_lists(mentions, least)
    both = written(replica_links(lists, overlap_least, least).where(F.col("order_similarity") >= order_least), "links")
    hosts = lists.select("page", "low", "high")
    ends = lambda own, other: both.join(hosts.withColumnRenamed("page", other), other).select("a", "b", "overlap", "order_similarity", F.col(own).alias("class_id"), "low", "high")
    links = ends("a", "b").unionByName(ends("b", "a").where("a != b"))
    members = per.join(lists.select("names", F.col("page").alias("class_id")), "names").select("class_id", "page", "domain")
    return links.join(members, "class_id").where("NOT (low = high AND low = domain)").select("a", "b", "overlap", "order_similarity", "class_id", "page", "domain")


@query()
def ordered_replicas(spark: SparkSession, d: str) -> DataFrame:
    """Lists of three names or more on different hosts that overlap by 0.6, with the similarity of their order; a row for each page of a link."""
    return replica_pages(table(spark, d, "raw_brand_mentions"), 0.6, 3, 0.0)


@query(_LISTS.format(least=8) + """
SELECT x.page AS a, y.page AS b FROM l x JOIN l y ON x.page < y.page AND NOT (x.low = x.high AND y.low = y.high AND x.low = y.low)
WHERE len(list_intersect(x.names, y.names)) / least(len(x.names), len(y.names))::DOUBLE >= 0.85 UNION ALL SELECT page, page FROM l WHERE low < high""")
def probable_replicas(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of probable replicas by the definition's bounds: eight names, overlap 0.85 (their agreement in order, 0.75, is asked by ``replica_pages``); pages belong to classes as in ``list_classes``."""
    _, lists = name_lists(table(spark, d, "raw_brand_mentions"), LEAST_NAMES)
    return replica_links(lists, OVERLAP, LEAST_NAMES).select("a", "b")
