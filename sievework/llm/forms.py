"""One consistent form of texts that look alike.

Texts are mapped to plain forms and look-alike letters by one table (``textnorm.mapped``), then grouped in SQL under the
accent-sensitive, case-sensitive Unicode collation ``UNICODE``: it is the collation that makes composed and decomposed letters, and other canonical equivalents, equal.
It also passes over a few things that can be seen, joiners inside a picture and marks of some scripts; a group is split by these (``textnorm.shown``). One member of each class, by a fixed
order, is canonical and joined back.

Collation keys are long, so texts are first told apart by their bare letters: only texts that share these with a differing text are compared.

Defined cases: a null text keeps a null form and joins no group; empty texts form one group; texts equal as they stand
are one variant; the canonical member is a variant in plain forms without unseen characters, if there is one, then the one with the fewest
characters outside ASCII, then the most rows, then the smallest in code point order; a text of any length is mapped whole; extra columns of the input pass through ``consistent``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.textnorm import mapped, shown
from sievework.session import written


def _hash(x: F.Column) -> F.Column:
    return F.unhex(F.sha2(x, 256))


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``text_h, v, m, bare_h, unclean`` of each row with a text, as a written table: the text's hash, the text, and what ``mapped`` says of it."""
    v = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("v"), mapped(F.col(text)).alias("f"))
    return written(v.select(_hash(F.col("v")).alias("text_h"), "v", "f.*"), "texts")


def variants(docs: DataFrame, text: str, same: str = "UNICODE") -> DataFrame:
    """``text_h, read_h, canonical, forms`` of each distinct text that has variants: its hash, its class (the least hash), the class's canonical text and number of variants."""
    k = keyed(docs, text)
    shared = k.groupBy("bare_h").agg(F.min("text_h").alias("low"), F.max("text_h").alias("high")).where("low != high").select("bare_h")
    t = k.join(shared, "bare_h", "left_semi").groupBy("text_h").agg(F.first("v").alias("v"), F.first("m").alias("m"), F.first("unclean").alias("unclean"), F.count("*").alias("n"))
    odd = F.length(F.regexp_replace("v", r"[\x00-\x7F]+", ""))
    m = t.select("text_h", "v", "n", "unclean", odd.alias("odd"), F.coalesce("m", "v").alias("m"))
    m = written(m.withColumn("shown", shown(F.col("m"))), "forms").withColumn("key", F.collate("m", same))
    rank = F.struct("unclean", "odd", (-F.col("n")).alias("rare"), "v")
    classes = m.groupBy("key", "shown").agg(F.min(rank).alias("best"), F.min("text_h").alias("read_h"), F.count("*").alias("forms")).where("forms > 1")
    return m.join(classes, ["key", "shown"]).select("text_h", "read_h", F.col("best.v").alias("canonical"), "forms")


def consistent(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``read_h`` (the class), ``canonical_text`` and ``forms`` (variants in its class); columns of these names are replaced."""
    marked = docs.drop("read_h", "canonical_text", "forms", "text_h").withColumn("text_h", _hash(F.col(text)))
    out = marked.join(variants(docs, text).withColumnRenamed("canonical", "canonical_text"), "text_h", "left")
    alone = F.when(F.col(text).isNotNull(), 1)
    return out.withColumns({"read_h": F.coalesce("read_h", "text_h"), "canonical_text": F.coalesce("canonical_text", text), "forms": F.coalesce("forms", alone)}).drop("text_h")


def alike_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 21, same: str = "UNICODE") -> DataFrame:
    """``doc_a < doc_b`` of documents that read the same and differ in characters, each text of ``min_chars`` or more."""
    rows = docs.where(F.length(text) >= min_chars)
    t = written(variants(rows, text, same).select("read_h", "text_h"), "alike")
    # pairs of differing texts first, then their documents: copies of one text never meet each other
    pairs = t.alias("x").join(t.alias("y"), F.expr("x.read_h = y.read_h AND x.text_h < y.text_h")).select(F.col("x.text_h").alias("ta"), F.col("y.text_h").alias("tb"))
    r = rows.select(F.col(doc_id).alias("id"), _hash(F.col(text)).alias("text_h"))
    both = pairs.join(r.select(F.col("text_h").alias("ta"), F.col("id").alias("p")), "ta").join(r.select(F.col("text_h").alias("tb"), F.col("id").alias("q")), "tb").where("p != q")
    return both.select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b")).distinct()
