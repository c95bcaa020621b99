"""Near-duplicate records by MinHash banding, verified on full n-gram sets.

Rows with the same words form one class at once (``class_id`` = its smallest row id), so copies never multiply the work. A class's
set of word n-grams is signed by ``bands * rows`` minima; classes that share a band's hash are candidates, and each candidate
pair is verified on both full sets. ``plan_bands`` picks the number of bands from the collision curve.

Defined cases: a null id or fewer than ``min_words`` words in the text: the row takes no part; a null text or title counts as empty; a row of fewer than ``n`` words has no
n-gram: it is in the class of its words (rows without any word in one class) but in no pair of classes; ties and repeated rows fall into one class; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import let_go, written

WORD = r"[\p{L}\p{N}]+"
#: Buckets of more members than this are searched by their rarest grams instead of pair by pair.
HOT = 500
#: As many where pairs are checked in the bucket, and the bands hashed at once there.
HOT_CHECKED, BANDS_AT_ONCE = 5000, 10
#: 64-bit words of a sketch of a gram set.
LANES = 4


def collision(similarity: float, bands: int, rows: int) -> float:
    """The chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def plan_bands(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` minima that finds a pair at the threshold with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def words(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingles(w: str, n: int) -> F.Column:
    """Distinct 64-bit hashes of the n-word sequences of the array column ``w``."""
    at = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) >= n, F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(n)])))).otherwise(F.array().cast("array<bigint>"))


def band_hashes(bands: int, rows: int, seed: int = 7):
    """A ``mapInArrow`` step from (id, grams) to one row (band_h, id) a band."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        mix = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(0, 2**63, bands, dtype=np.uint64)
        for batch in batches:
            ids, grams = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            at, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
            for lo in range(0, len(ids), 512):
                n = min(512, len(ids) - lo)
                out = np.empty((n, bands), np.uint64)
                for k in range(n):
                    g = flat[at[lo + k] : at[lo + k + 1]]
                    # long texts in blocks of 4,096 grams, so that memory doesn't grow with them
                    sig = None
                    for s in range(0, len(g), 4096):
                        h = g[s : s + 4096, None] * a
                        h += b
                        m = h.min(axis=0)
                        sig = m if sig is None else np.minimum(sig, m)
                    sig = sig >> np.uint64(20)
                    v = (sig.reshape(bands, rows) * mix).sum(axis=1, dtype=np.uint64) + salt
                    v ^= v >> np.uint64(29)
                    v *= np.uint64(0xBF58476D1CE4E5B9)
                    out[k] = v ^ (v >> np.uint64(32))
                yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[lo : lo + n], bands))], ["band_h", "id"])

    return step


def classes(rows: DataFrame, row_id: str, title: str | None, text: str, n: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members: class_key, row_id; reps as a written table: class_key, id, size, grams)."""
    none = F.array().cast("array<string>")
    w = rows.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), F.coalesce(words(F.col(text)), none).alias("c"), F.coalesce(words(F.col(title)), none).alias("t") if title else none.alias("t"))
    w = w.where(F.size("c") >= min_words).select("row_id", F.concat("t", "c").alias("w"))
    key = F.unhex(F.md5(F.array_join("w", " ")))
    members = w.select(key.alias("class_key"), "row_id")
    reps = w.select(key.alias("class_key"), "row_id", shingles("w", n).alias("grams"))
    reps = reps.groupBy("class_key").agg(F.min("row_id").alias("id"), F.count("*").alias("size"), F.min_by("grams", "row_id").alias("grams"))
    return members, written(reps, "grams")


def candidates(sets: DataFrame, threshold: float, recall: float, rows: int, hot: int = HOT) -> DataFrame:
    """``a, b`` (a < b): pairs of ``sets`` (id, grams) that share a band, as found for a Jaccard similarity of ``threshold`` with chance ``recall``.

    Buckets of more than ``hot`` members write no pairs: their members meet in ``prefix_pairs``, which loses no pair at the threshold.
    """
    hashed = sets.where(F.size("grams") > 0).select("id", "grams").mapInArrow(band_hashes(plan_bands(threshold, recall, rows), rows), "band_h bigint, id bigint")
    hashed = hashed.repartition("band_h")  # one shuffle, read by both the count and the join, as both ask for the same columns
    shared = hashed.join(hashed.groupBy("band_h").agg(F.count("id").alias("n")).where("n > 1"), "band_h")
    shared = written(shared, "buckets")  # most buckets hold one member and are gone here
    few = shared.where(F.col("n") <= hot)
    found = few.alias("x").join(few.alias("y"), F.expr("x.band_h = y.band_h AND x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    many = shared.where(F.col("n") > hot).select("id").distinct()
    if not many.isEmpty():
        found = found.unionByName(prefix_pairs(sets.join(many, "id", "left_semi"), threshold))
    return found.distinct()


def sketched_bands(bands: int, rows: int, only: range, seed: int = 7):
    """A ``mapInArrow`` step from (id, grams), none empty, to a row (band_h, id, size, s0 to s3) for each band of ``only``: hashes as of ``band_hashes``, a bitmap of the grams beside them. Without bands, one row an id."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = (rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1))[only.start * rows : only.stop * rows]
        b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[only.start * rows : only.stop * rows]
        mix = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(0, 2**63, bands, dtype=np.uint64)[only.start : only.stop]
        m = len(only)
        for batch in batches:
            ids, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy().view(np.uint64)
            lo = 0
            while lo < len(ids):
                # as many ids as have 16,384 grams; one of more alone, in blocks
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 16384, "right")) - 1)
                flat, size = values[at[lo] : at[hi]], np.diff(at[lo : hi + 1])
                n = hi - lo
                bits = np.zeros((n, LANES), np.uint64)
                np.bitwise_or.at(bits, (np.repeat(np.arange(n), size), (flat >> np.uint64(6)) % np.uint64(LANES)), np.uint64(1) << (flat & np.uint64(63)))
                if m and n > 1:
                    sig = np.minimum.reduceat(flat[:, None] * a + b, at[lo:hi] - at[lo], axis=0)
                elif m:
                    sig = np.min([(flat[s : s + 4096, None] * a + b).min(axis=0) for s in range(0, len(flat), 4096)], axis=0)[None]
                if m:
                    v = ((sig >> np.uint64(20)).reshape(n, m, rows) * mix).sum(axis=2, dtype=np.uint64) + salt
                    v ^= v >> np.uint64(29)
                    v *= np.uint64(0xBF58476D1CE4E5B9)
                    v ^= v >> np.uint64(32)
                each = lambda x: pa.array(np.repeat(x, max(m, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(v.reshape(-1).view(np.int64) if m else np.zeros(n, np.int64)), each(ids[lo:hi]), each(size.astype(np.int32)), *[each(bits[:, k].view(np.int64)) for k in range(LANES)]], SKETCHED.names)
                lo = hi

    return step


SKETCHED = pa.schema([("band_h", pa.int64()), ("id", pa.int64()), ("size", pa.int32()), *[(f"s{k}", pa.int64()) for k in range(LANES)]])
SKETCHED_SQL = "band_h bigint, id bigint, size int, " + ", ".join(f"s{k} bigint" for k in range(LANES))


def may_overlap(least: float) -> str:
    """A condition on sketched x and y that holds for all pairs of a Jaccard similarity of ``least``, and few others.

    Common grams are at most the common bits and, where grams of a set share bits, as many more as the set has fewer bits than grams.
    """
    bits = lambda *s: " + ".join("bit_count(" + " & ".join(f"{t}.s{k}" for t in s) + ")" for k in range(LANES))
    common = f"({bits('x', 'y')} + least(x.size - ({bits('x')}), y.size - ({bits('y')})))"
    return f"{common} >= {least} * (x.size + y.size - {common})"


def checked_pairs(sets: DataFrame, threshold: float, recall: float, rows: int, least: float, check: Callable[[DataFrame], DataFrame], hot: int = HOT_CHECKED, at_once: int = BANDS_AT_ONCE) -> DataFrame:
    """What ``check`` keeps of the pairs of ``candidates``, less those whose sketches show that they overlap by less than ``least``; a written table.

    ``check`` gets a table ``a, b`` (a < b) and returns a written one that begins with these columns. The number of chance pairs grows with the square of the sets.
    Most are told in the bucket, where each member has its sketch with it, and are never written or shuffled. ``at_once`` bands are hashed, paired and
    checked at a time, so that no more of them and of their pairs are on disk; what an earlier round has kept isn't checked again.
    """
    bands = plan_bands(threshold, recall, rows)
    sets = sets.where(F.size("grams") > 0).select("id", "grams")
    kept: list[DataFrame] = []
    hot_ids: list[DataFrame] = []

    def keep(pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        if kept:
            pairs = pairs.join(reduce(DataFrame.unionByName, kept).select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        kept.append(check(pairs.where("b IS NOT NULL")))
        alone = pairs.where("b IS NULL").select(F.col("a").alias("id"))
        if not alone.isEmpty():
            hot_ids.append(written(alone, "hot"))
        let_go(pairs)

    for lo in range(0, bands, at_once):
        placed = sets.mapInArrow(sketched_bands(bands, rows, range(lo, min(bands, lo + at_once))), SKETCHED_SQL).repartition("band_h")
        placed = placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band_h")))
        few = placed.where((F.col("n") > 1) & (F.col("n") <= hot)).drop("n")
        found = few.alias("x").join(few.alias("y"), F.expr(f"x.band_h = y.band_h AND x.id < y.id AND {may_overlap(least)}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        # a member of a hot bucket is noted as a pair without an end: one shuffle is read by all
        keep(found.unionByName(placed.where(F.col("n") > hot).select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"))))
    if hot_ids:
        busy = written(sets.join(reduce(DataFrame.unionByName, hot_ids).distinct(), "id", "left_semi"), "busy")
        keep(prefix_pairs(busy, threshold, busy.mapInArrow(sketched_bands(bands, rows, range(0)), SKETCHED_SQL).drop("band_h", "size"), least))
        let_go(busy)
    got = written(reduce(DataFrame.unionByName, kept), "checked")
    let_go(*kept, *hot_ids)
    return got


def prefix_pairs(sets: DataFrame, threshold: float, sketch: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """``a, b`` (a < b) of all sets (id, grams) that may have this Jaccard similarity: both have one of the other's rarest grams.

    Two sets at the threshold share at least one of the first ``size - ceil(threshold * size) + 1`` grams of each in an order common to all,
    here from the rarest up, so what very many sets have in common pairs none of them. With a ``sketch`` (id, s0 to s3) pairs that overlap by less than ``least`` are left out.
    """
    g = sets.select("id", F.size("grams").alias("size"), F.explode("grams").alias("g"))
    df = g.groupBy("g").agg(F.count("*").alias("df"))
    ordered = g.join(df.where("df > 1"), "g").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("by_df"))
    # grams no other set has come first in the order and are left out of the list
    alone = F.col("size") - F.size("by_df")
    length = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1 - alone
    heads = written(ordered.where(length > 0).select("id", "size", F.explode(F.slice("by_df", F.lit(1), length.cast("int"))).alias("h")).select("id", "size", F.col("h.g").alias("g")), "heads")
    near = f"x.g = y.g AND x.id < y.id AND least(x.size, y.size) >= {threshold} * greatest(x.size, y.size)"
    if sketch is not None:
        heads, near = heads.join(sketch, "id"), f"{near} AND {may_overlap(least)}"
    near = F.expr(near)
    return heads.alias("x").join(heads.alias("y"), near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def similar_pairs(reps: DataFrame, threshold: float, recall: float, rows: int) -> DataFrame:
    """``a, b, similarity`` (a < b) of classes whose n-gram sets have at least this Jaccard similarity."""
    sets = reps.select("id", "grams")
    found = candidates(sets, threshold, recall, rows)
    both = found.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    # the shorter set bounds the similarity; sets too unequal in size are dropped before they are intersected
    both = both.where(F.least(F.size("ga"), F.size("gb")) >= threshold * F.greatest(F.size("ga"), F.size("gb")))
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(rows: DataFrame, row_id: str, text: str, title: str | None = None, n: int = 5, threshold: float = 0.8, min_words: int = 0,
                    recall: float = 0.995, band_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members: row_id, class_id, class_size; pairs: a, b, similarity of class ids)."""
    members, reps = classes(rows, row_id, title, text, n, min_words)
    placed = members.join(reps.select("class_key", F.col("id").alias("class_id"), F.col("size").alias("class_size")), "class_key").select("row_id", "class_id", "class_size")
    return placed, similar_pairs(reps, threshold, recall, band_rows)


def linked_rows(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a record: its class, the class's size and the number of other classes it is linked to."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("row_id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))


def row_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of records, copies included, as ``row_a < row_b``."""
    m = members.where("class_size > 1").select("class_id", "row_id")
    inner = m.alias("x").join(m.alias("y"), F.expr("x.class_id = y.class_id AND x.row_id < y.row_id")).select(F.col("x.row_id").alias("row_a"), F.col("y.row_id").alias("row_b"))
    left, right = members.select(F.col("class_id").alias("a"), F.col("row_id").alias("p")), members.select(F.col("class_id").alias("b"), F.col("row_id").alias("q"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("p", "q").alias("row_a"), F.greatest("p", "q").alias("row_b"))
    return inner.unionByName(across).distinct()
