"""The queries of the problems p1 to p8, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import boilerplate, encoding, forms, leakage, lines, mixing, names, neardup
from sievework.session import table

#: The vocabulary of the public tokenizer that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.found(table(spark, sf_dir, "search_results"))


def p1_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "search_results").select("result_row_id", "title", "content", "raw_content")
    return boilerplate.main_body(pages)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(table(spark, sf_dir, "brand_accumulators"), table(spark, sf_dir, "candidate_hygiene_audit"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.clusters(table(spark, sf_dir, "brand_accumulators"), table(spark, sf_dir, "candidate_hygiene_audit"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = _captures(spark, sf_dir)
    return neardup.row_pairs(members, pairs)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked_rows(*_captures(spark, sf_dir))


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "search_results").select("result_row_id", "title", "content")
    return neardup.near_duplicates(rows, "result_row_id", "content", "title", n=3, threshold=0.5, min_words=12)


def p3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among documents: five words and 0.8."""
    return neardup.linked_rows(*neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "search_results"))


def p4_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "search_results").select("result_row_id", "canonical_hostname", "canonical_url", "raw_content")
    return lines.without_repeated_lines(pages).select("result_row_id", "clean_text", "lines_removed")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.found(table(spark, sf_dir, "corrected_name_variants"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.repaired(table(spark, sf_dir, "corrected_name_variants"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which 7 of 8 words in a row stand within a word of their place, and the most words met."""
    near = leakage.places(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), 8, least=7, slack=1)
    return near.select("doc_id", F.explode("item_ids").alias("item_id"), "hits").groupBy("doc_id", "item_id").agg(F.max("hits").alias("words_met"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.alike_pairs(table(spark, sf_dir, "documents"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.consistent(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "canonical_text", "forms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_main_body, p2_found, p2_clusters, p3_found, p3_links, p3_documents, p4_found, p4_clean_pages, p5_found, p5_repaired, p6_found, p6_proximity, p7_mix, p7_shares, p8_found, p8_forms)}


_LINES = r"""
WITH p AS (SELECT result_row_id, canonical_hostname AS h, canonical_url AS u, raw_content, string_split(raw_content, chr(10)) AS l FROM search_results WHERE raw_content <> ''),
x AS (SELECT result_row_id, h, u, (i - 1)::INT AS line_no, regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g') AS k FROM (SELECT result_row_id, h, u, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM p WHERE h IS NOT NULL)),
r AS (SELECT h, k FROM x WHERE k <> '' GROUP BY 1, 2 HAVING count(DISTINCT u) >= 8),
f AS (SELECT DISTINCT result_row_id, line_no FROM x JOIN r USING (h, k))"""

_CAPTURES = r"""
WITH w AS (SELECT result_row_id AS id, list_concat(regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}]+'), c) AS w FROM (
    SELECT *, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS c FROM search_results WHERE content IS NOT NULL) WHERE len(c) >= 12),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
f AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.5 * (x.n + y.n - k))"""


def oracle_sql() -> dict[str, str]:
    """SQL for the problems that it can express; the others are tested against brute force."""
    return {
        "p3_found": _CAPTURES + " SELECT a AS row_a, b AS row_b FROM f",
        "p3_links": _CAPTURES + """, k AS (SELECT id, array_to_string(w, ' ') AS t, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS class_size FROM w),
            e AS (SELECT x.class_id AS c, count(DISTINCT y.class_id) AS links FROM (SELECT a, b FROM f UNION ALL SELECT b, a FROM f) JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE x.class_id <> y.class_id GROUP BY 1)
            SELECT k.id AS row_id, k.class_id, class_size, coalesce(links, 0) AS links FROM k LEFT JOIN e ON e.c = k.class_id""",
        "p3_documents": r"""
            WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
            k AS (SELECT id, w, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS class_size FROM w),
            s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM k WHERE id = class_id AND len(w) >= 5)), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
            c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2), f AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k)),
            e AS (SELECT c, count(*) AS links FROM (SELECT a AS c FROM f UNION ALL SELECT b FROM f) GROUP BY 1)
            SELECT id AS row_id, class_id, class_size, coalesce(links, 0) AS links FROM k LEFT JOIN e ON e.c = k.class_id""",
        "p4_found": _LINES + " SELECT * FROM f",
        "p4_clean_pages": _LINES + """, g AS (SELECT result_row_id, list(line_no) AS gone FROM f GROUP BY 1)
            SELECT s.result_row_id, array_to_string(CASE WHEN gone IS NULL THEN string_split(s.raw_content, chr(10)) ELSE list_filter(string_split(s.raw_content, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)) END, chr(10)) AS clean_text, coalesce(len(gone), 0) AS lines_removed
            FROM search_results s LEFT JOIN g USING (result_row_id)""",
    }
