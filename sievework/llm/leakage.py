"""Evaluation passages in a training corpus, by a distributed positional inverted index.

The index holds a posting (term, document, positions) for every term of every training document; it is written once, without a shuffle, and serves any test
set (``index``, ``search``). Each window of ``n`` test words is looked up from its rarest terms by corpus frequency: their positions,
less their offsets, are the places where the window may begin, give or take the slack; places that too few of them share are gone at once. The lists of the window's other
terms, adjusted by their offsets, are intersected with what is left; what all terms share is an exact occurrence. Proximity matches keep
the places that at least ``least`` of the terms share within a slack.

Defined cases: null or empty texts hold nothing; items shorter than ``n`` words have no window and leak nowhere; repeated
documents are one, as they share the id; repeated items share one set of windows; terms absent from the corpus end their windows
at once; texts are indexed whole; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.textnorm import look_alikes, reading_table, translated
from sievework.operators.relops import small
from sievework.session import written

#: Tags that end a line or a cell part words; other tags, emphasis and soft hyphens stand inside them.
PARTING = re.compile(
    r"</?(?:address|article|aside|blockquote|br|caption|center|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|body|legend|li|main|nav|ol|option|p|pre|section|select"
    r"|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/][^<>]*)?>|&nbsp;", re.I)
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|[*_`~]+|&shy;")
WORD = re.compile(r"[^\W_]+")
#: Test sets up to this many words are sent to every executor, some 20 MB; larger ones are joined by a shuffle.
BROADCAST_WORDS = 200_000
#: Passages of up to 60 times so many words have the places that are met as bits, longer ones as sets.
MASKS = 16
#: Terms of a window, beyond the rarest, that sort out its places before the others are looked up: in an exact search, in one with slack.
MORE_EXACT, MORE_NEAR = 1, 2


def tokens(text: str, table: dict[int, str]) -> list[str]:
    """The words of a text in lower case, without markup, in their reading form."""
    text = unicodedata.normalize("NFC", translated(text, table))
    if "<" in text or "&" in text:
        text = PARTING.sub(" ", text)
    return WORD.findall(MARKUP.sub("", text).lower())


def _table() -> dict[int, str]:
    return reading_table(look_alikes(SparkSession.active()))


def words(text: F.Column) -> F.Column:
    table = _table()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: tokens(t, table), na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(text)


def passages(items: DataFrame, n: int) -> DataFrame:
    """``text_id, w, item_ids`` of the distinct word lists of ``n`` words or more, and the items that are them, as a written table."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= n)
    return written(w.groupBy("w").agg(F.collect_set("item_id").alias("item_ids")).withColumn("text_id", F.xxhash64("w")), "passages")


def anchors(slots: DataFrame, df: DataFrame, n: int, take: int, apart: bool) -> DataFrame:
    """``text_id, i, at``: for the window from each place ``i`` of a passage the places of its ``take`` rarest terms.

    ``apart``: any terms will do, so after the rarest those come first that don't stand close to it, as neighbours often stand together elsewhere.
    """
    known = slots.join(df, "term", "left").select("text_id", "p", "len", F.coalesce("df", F.lit(0)).alias("df"))
    each = known.select("text_id", "p", "df", F.explode(F.sequence(F.greatest(F.col("p") - (n - 1), F.lit(0)), F.least(F.col("p"), F.col("len") - n))).alias("i"))
    ranked = each.groupBy("text_id", "i").agg(F.sort_array(F.collect_list(F.struct("df", "p"))).alias("by_df"))
    if apart:
        first = F.get("by_df", F.lit(0))["p"]
        rest = F.sort_array(F.transform(F.slice("by_df", 2, n), lambda x: F.struct((F.abs(x["p"] - first) < n // 3).alias("close"), x.alias("x"))))["x"]
        ranked = ranked.withColumn("by_df", F.concat(F.slice("by_df", 1, 1), rest))
    return ranked.select("text_id", "i", F.slice("by_df", 1, take)["p"].alias("at"))


def index(docs: DataFrame) -> DataFrame:
    """Postings ``term, doc_id, positions`` of every term of every document, as a written table."""
    table = _table()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                terms: list[str] = []
                ids: list[int] = []
                ends, flat = [0], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    at: dict[str, list[int]] = {}
                    for k, w in enumerate(tokens(text, table)):
                        at.setdefault(w, []).append(k)
                    terms += at
                    ids += [i] * len(at)
                    for x in at.values():
                        flat += x
                        ends.append(len(flat))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["term", "doc_id", "positions"])

    rows = docs.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select(F.col("doc_id").cast("bigint"), "text")
    return written(rows.mapInArrow(step, "term string, doc_id bigint, positions array<int>"), "postings")


def found(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """``doc_id, item_id`` where at least ``n`` consecutive words of the item stand in the document."""
    return places(docs, items, n).select("doc_id", F.explode("item_ids").alias("item_id")).distinct()


def places(docs: DataFrame, items: DataFrame, n: int, least: int | None = None, slack: int = 0) -> DataFrame:
    return search(index(docs), items, n, least, slack)


def search(postings: DataFrame, items: DataFrame, n: int, least: int | None = None, slack: int = 0) -> DataFrame:
    """``win, doc_id, start, hits, item_ids``: windows of which ``least`` (all) terms stand at their place, give or take ``slack``.

    A posting's place less the place of its term in a passage is a diagonal, the same for all terms of a copied passage, so the windows of a passage are looked up together:
    one row for each passage, document and diagonal, however many windows meet there.
    """
    least = n if least is None else least
    texts = passages(items, n)
    most = texts.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.max(F.size("w")), F.lit(0))).first()
    hint = F.broadcast if most[0] <= BROADCAST_WORDS else (lambda x: x)
    slots = texts.select("text_id", F.size("w").alias("len"), F.posexplode("w").alias("p", "term"))
    posts = postings.join(hint(slots.select("term").distinct()), "term", "left_semi")
    df = posts.groupBy("term").agg(F.sum(F.size("positions")).alias("df"))
    # of n terms, any `least` include one of the n - least + 1 rarest, two of one more, and so on; a term the corpus lacks is the rarest of all
    more = min(MORE_NEAR if slack else MORE_EXACT, least - 1)
    wins = written(anchors(slots, hint(df), n, n - least + 1 + more, least == n), "anchors")
    rare = wins.select("text_id", F.explode("at").alias("p")).distinct().join(hint(slots), ["text_id", "p"]).select("text_id", "p", "term")
    met = posts.join(hint(rare), "term").select("text_id", "doc_id", "p", F.explode(F.transform("positions", lambda q: q - F.col("p"))).alias("diag"))
    if slack:  # a rare term itself may stand off its place
        met = met.withColumn("diag", F.explode(F.sequence(F.col("diag") - slack, F.col("diag") + slack)))
    # the places of a passage that are met on a diagonal, as words of 60 bits
    parts = max(-(-most[1] // 60), 1)
    bits = [F.bit_or(F.when(F.expr(f"p div 60 = {k}"), F.expr("shiftleft(1L, cast(p % 60 as int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}") for k in range(parts)]
    by_place = parts <= MASKS
    met = met.groupBy("text_id", "doc_id", "diag").agg(*(bits if by_place else [F.collect_set("p").alias("got")]))
    if by_place:
        met = met.where(sum((F.bit_count(f"m{k}") for k in range(parts)), F.lit(0)) > more).withColumn("got", F.array(*[F.col(f"m{k}") for k in range(parts)]))
        mask = lambda k: F.aggregate(F.filter("at", lambda x: F.floor(x / 60) == k), F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % 60).cast("int"))))
        wins = wins.select("text_id", "i", F.array(*[mask(k) for k in range(parts)]).alias("at"))
        meets = lambda w: sum((F.bit_count(F.get("got", F.lit(k)).bitwiseAND(F.get(w["at"], F.lit(k)))) for k in range(parts)), F.lit(0))
    else:
        meets = lambda w: F.size(F.array_intersect("got", w["at"]))
    asked = wins.groupBy("text_id").agg(F.collect_list(F.struct("i", "at")).alias("asked"))  # a passage's own windows
    starts = met.join(hint(asked), "text_id").select("text_id", "doc_id", "diag", F.filter("asked", lambda w: meets(w) > more)["i"].alias("left"))
    starts = written(starts.where(F.size("left") > 0), "starts")
    # all terms of the windows that are left, at their offsets, against the postings of the documents that are left
    wanted = starts.select("*", F.explode(F.array_distinct(F.flatten(F.transform("left", lambda i: F.sequence(i, i + (n - 1)))))).alias("p")).join(hint(slots.drop("len")), ["text_id", "p"])
    mine = posts.join(small(starts.select("doc_id").distinct()), "doc_id", "left_semi")
    place = F.col("diag") + F.col("p")
    there = F.array_contains("positions", place) if not slack else F.exists("positions", lambda q: F.abs(q - place) <= slack)
    hits = wanted.join(mine, ["doc_id", "term"]).where(there).groupBy("text_id", "doc_id", "diag").agg(F.first("left").alias("left"), F.collect_set("p").alias("got"))
    each = hits.select("text_id", "doc_id", "diag", F.explode("left").alias("i"), "got").select("text_id", "doc_id", "diag", "i", F.size(F.filter("got", lambda x: (x >= F.col("i")) & (x < F.col("i") + n))).alias("hits"))
    return each.where(F.col("hits") >= least).join(hint(texts), "text_id").select(F.xxhash64(F.slice("w", F.col("i") + 1, n)).alias("win"), "doc_id", (F.col("diag") + F.col("i")).alias("start"), "hits", "item_ids")
