"""Mixing sources to target weights by systematic sampling.

Tokens of every document are counted with a public tokenizer, named by the path of its file. Unless a size is asked for, the size of the mix is the largest at which each present
source can give its share within its cap; a document's expected copies are its source's tokens in the mix over the
tokens it has. Within a source the expected copies are prefix-summed in a fixed order, one offset is added, and a copy is emitted for each
integer crossed. The order runs by document size, so each part of the source gives its tokens evenly.

Prefix sums take two levels: counts of bounded chunks (size class, hash), their running sums, then a rank inside
each chunk, so no task holds a whole source.

Defined cases: documents with null source, null or empty text or no token give nothing; sources missing from the documents are reported
with 0 and the other shares are scaled to 1; sources without a target are left out; a null or negative share counts as 0 and a cap below 1 as none; ties are
broken by document id; empty tables give an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import written

#: Expected copies are kept as whole millionths, so sums are exact.
UNIT = 1_000_000
#: Documents of one source and size are split into chunks of about this many.
CHUNK = 50_000


def token_counts(tokenizer: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for s in batches:
            s = s.fillna("").tolist()
            out: list[int] = []
            for i in range(0, len(s), 64):
                out += [len(e.ids) for e in t.encode_batch(s[i : i + 64], add_special_tokens=False)]
            yield pd.Series(out, dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")


def counted(docs: DataFrame, targets: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, source, tokens`` of the documents of target sources, as a written table."""
    # the sources of the targets are few and known; their number is checked before they are sent out
    names = targets.select("source").distinct()
    names = F.broadcast(names) if targets.count() <= 10_000 else names
    d = docs.select("doc_id", "source", "text").where("text != ''").join(names, "source", "left_semi")
    return written(d.select("doc_id", "source", token_counts(tokenizer)(F.col("text")).alias("tokens")).where("tokens > 0"), "tokens")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``source, share, have, rate``: the expected copies of each document of a source, in millionths.

    With ``total_tokens`` the mix aims at that size, and a source that can't give its share within its cap gives what it can.
    """
    t = targets.groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    s = t.join(sizes, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    live = (F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
    everything = Window.partitionBy(F.lit(1))  # one row a source
    s = s.withColumn("share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(everything)).otherwise(0.0))
    largest = F.min(F.when(live, F.col("max_repeats") * F.col("have") / F.col("share"))).over(everything)
    s = s.withColumn("mix_tokens", largest if total_tokens is None else F.lit(float(total_tokens)))
    rate = F.when(live, F.least(F.floor(F.col("share") * F.col("mix_tokens") / F.col("have") * UNIT + 1e-6), F.col("max_repeats") * UNIT)).otherwise(0)
    return s.select("source", "target_share", "share", "max_repeats", "have", "mix_tokens", rate.cast("bigint").alias("rate"))


def mixed(tokens: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, source, tokens, copies; rates): documents of the mix and how often each is taken."""
    r = rates(tokens.groupBy("source").agg(F.sum("tokens").alias("have")), targets, total_tokens)
    d = tokens.withColumn("size_class", F.least(F.col("tokens") / 8, F.lit(4095)).cast("int"))
    parts = d.groupBy("source", "size_class").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    d = d.join(parts, ["source", "size_class"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts"))).drop("parts")
    chunk = ["source", "size_class", "part"]
    before = Window.partitionBy("source").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk of a source
    starts = d.groupBy(*chunk).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    d = d.withColumn("k", F.row_number().over(Window.partitionBy(*chunk).orderBy("tokens", "doc_id"))).join(starts, chunk).join(r.select("source", "rate"), "source")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT))
    end = (F.col("before") + F.col("k")) * F.col("rate") + offset
    d = d.withColumn("_end", end).withColumn("copies", F.expr(f"(_end div {UNIT}) - ((_end - rate) div {UNIT})"))
    return d.where("copies > 0").select("doc_id", "source", "tokens", "copies"), r


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 1, total_tokens: int | None = None) -> DataFrame:
    """The mixed rows: ``source, doc_id, copy`` (from 1) and ``tokens``."""
    rows, _ = mixed(counted(docs, targets, tokenizer), targets, seed, total_tokens)
    return rows.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "tokens")


def shares(docs: DataFrame, targets: DataFrame, tokenizer: str, seed: int = 1, total_tokens: int | None = None) -> DataFrame:
    """A row a target source: its target, the tokens it has and gives, the share reached, and whether its cap keeps it short of its part of the mix."""
    rows, r = mixed(counted(docs, targets, tokenizer), targets, seed, total_tokens)
    got = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_rows"), F.max("copies").alias("most_copies"))
    out = r.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_rows", "most_copies"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return out.select("source", "target_share", "max_repeats", F.col("have").alias("source_tokens"), "mixed_tokens", "mixed_rows", "most_copies",
                      F.coalesce(F.try_divide(F.col("mixed_tokens"), total), F.lit(0.0)).alias("actual_share"),
                      (F.col("share") * F.col("mix_tokens") > F.col("max_repeats") * F.col("have") * (1 + 1e-9)).alias("capped"))
