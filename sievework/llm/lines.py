"""Lines repeated across the documents of one source, by compressed bitmaps.

Every distinct (source, address) gets a dense document number, so that the documents of a source lie side by side.
A line's document set is kept as its non-empty 64-bit words (``word`` = number div 64, ``bits``): sets of rare lines
take one word, sets of furniture one word per 64 documents. Words are made by ``bit_or``, which combines before the
shuffle; variants of a line (case, marks, spaces) are united by the same ``bit_or``, as they share a key; exact
cardinalities are sums of ``bit_count``; a document's lines are looked up in the words of its own number.

Defined cases: a null source or a null or empty text has no repeated line; a null address belongs to no distinct address but its
rows are still cleaned; lines without a letter or digit are never repeated lines; empty tables give empty results;
repeated rows count once, as they share the address; further columns of the input are ignored or, for
``without_repeated_lines``, kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import written


def line_keys(text: str) -> F.Column:
    """64-bit keys of a text's lines, null for a line without letter or digit; equal where letters and digits agree."""
    bare = F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}\n]+", "")
    return F.transform(F.split(bare, "\n", -1), lambda x: F.when(x != "", F.xxhash64(x)))


def numbered(pages: DataFrame, row_id: str, source: str, url: str, text: str) -> DataFrame:
    """``row_id, source_h, word, bit, no_url, keys`` for each row with source and text, as a written table.

    Numbers come from a range sort of the distinct addresses, so no window holds a whole source; rows are then spread by
    (source, word), so that a word's bits meet in one task before the next shuffle.
    """
    p = pages.where(F.col(source).isNotNull() & (F.col(text) != "")).select(
        F.col(row_id).alias("row_id"), F.xxhash64(source).alias("source_h"), F.coalesce(F.xxhash64(F.when(F.col(url).isNotNull(), F.col(url))), F.lit(0)).alias("url_h"),
        F.col(url).isNull().cast("int").alias("no_url"), line_keys(text).alias("keys"))
    ids = p.select("source_h", "url_h", "no_url").distinct().repartitionByRange("source_h", "url_h", "no_url").sortWithinPartitions("source_h", "url_h", "no_url")
    # written before it is used, so that a stage that is tried again can't number otherwise
    ids = written(ids.withColumn("doc", F.monotonically_increasing_id()), "numbers")
    t = p.join(ids, ["source_h", "url_h", "no_url"]).select(
        "row_id", "source_h", F.shiftright("doc", 6).alias("word"), F.expr("shiftleft(1L, cast(doc & 63 as int))").alias("bit"), "no_url", "keys")
    # a rebalance, so that a word of which one address holds very many rows is split over tasks
    return written(t.hint("rebalance", F.col("source_h"), F.col("word")), "lines")


def repeated(t: DataFrame, min_urls: int) -> DataFrame:
    """``source_h, key, word, bits, docs`` of lines on at least ``min_urls`` distinct addresses of their source."""
    posts = t.select("source_h", "word", "bit", "no_url", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    words = posts.groupBy("source_h", "key", "word").agg(F.bit_or("bit").alias("bits"), F.max("no_url").alias("no_url"))
    # the same rows once more by line: the words of a line are few, 1 for 64 documents
    total = words.groupBy("source_h", "key").agg((F.sum(F.bit_count("bits")) - F.max("no_url")).alias("docs")).where(F.col("docs") >= min_urls)
    return words.select("source_h", "key", "word", "bits").join(total, ["source_h", "key"])


def hits(t: DataFrame, min_urls: int) -> DataFrame:
    """``row_id, lines``: the numbers of the repeated lines of each row that has any."""
    mine = repeated(t, min_urls).groupBy("source_h", "word").agg(F.collect_list(F.struct("key", "bits")).alias("marks"))
    found = t.join(mine, ["source_h", "word"]).withColumn(
        "valid", F.transform(F.filter("marks", lambda m: m["bits"].bitwiseAND(F.col("bit")) != 0), lambda m: m["key"]))
    lines = F.array_compact(F.transform("keys", lambda k, i: F.when(F.array_contains("valid", k), i)))
    return found.select("row_id", lines.alias("lines")).where(F.size("lines") > 0)


def repeated_lines(pages: DataFrame, row_id: str = "result_row_id", source: str = "canonical_hostname", url: str = "canonical_url",
                   text: str = "raw_content", min_urls: int = 8) -> DataFrame:
    """``row_id, line_no`` of every line that stands on at least ``min_urls`` distinct addresses of its source."""
    t = numbered(pages, row_id, source, url, text)
    return hits(t, min_urls).select(F.col("row_id").alias(row_id), F.explode("lines").alias("line_no")).distinct()


def without_repeated_lines(pages: DataFrame, row_id: str = "result_row_id", source: str = "canonical_hostname", url: str = "canonical_url",
                           text: str = "raw_content", min_urls: int = 8) -> DataFrame:
    """Every row of ``pages`` with ``clean_text`` (the text without the repeated lines) and ``lines_removed``; columns of these names are replaced."""
    h = hits(numbered(pages, row_id, source, url, text), min_urls).select(F.col("row_id").alias("_row"), F.col("lines").alias("_gone")).dropDuplicates(["_row"])
    p = pages.drop("clean_text", "lines_removed", "_row", "_gone")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)))
    out = p.join(h, F.col(row_id) == F.col("_row"), "left")
    return out.withColumn("clean_text", F.array_join(kept, "\n")).withColumn("lines_removed", F.coalesce(F.size("_gone"), F.lit(0))).drop("_row", "_gone")
