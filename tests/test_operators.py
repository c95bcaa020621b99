import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import quality, relops
from sievework.operators.graph import components
from sievework.operators.sequential import keep_in_order
from sievework.operators.similarity import jaccard, order_similarity, overlap, set_pairs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_per_key_and_flags(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z"), ("a", 1, "q")], "k string, t int, v string")
    assert rows(relops.first_per_key(df, ["k"], [F.col("t"), F.coalesce("v", F.lit(""))]))[0] == ("a", 1, None)
    assert [r[3] for r in rows(relops.duplicates_flagged(df.where("v is not null"), ["k"], [F.col("t"), F.col("v")]))] == [1, 2, 1]


def test_modal_value_breaks_ties_by_length_then_text(spark):
    df = spark.createDataFrame([("k", "bbb"), ("k", "cc"), ("k", "aa"), ("k", None)], "k string, v string")
    assert rows(relops.modal_value(df, ["k"], "v", "v")) == [("k", 1, "aa")]


def test_fallback_join_needs_one_target(spark):
    facts = spark.createDataFrame([(1, "a b", "ab"), (2, "c", "c"), (3, "zz", "ab"), (4, "none", "none")], "i int, exact string, compact string")
    targets = spark.createDataFrame([("T1", "a b", "ab"), ("T2", "c", "c"), ("T3", "c", "cc")], "t string, exact string, compact string")
    got = {r.i: (r.target, r.matched_by) for r in relops.fallback_join(facts, targets, "t", ["exact", "compact"]).collect()}
    assert got == {1: ("T1", "exact"), 2: ("T2", "compact"), 3: ("T1", "compact"), 4: (None, "none")}


def test_checked_join_fails_on_a_miss(spark):
    f, d = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert rows(relops.checked_join(f.where("k = 1"), d, "k")) == [(1, "x")]
    with pytest.raises(Exception, match="no row for k 2"):
        relops.checked_join(f, d, "k").collect()


def test_full_compare_and_prefixes(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, r int"), spark.createDataFrame([("x", 1), ("y", 1), ("w", 4)], "k string, r int")
    assert {r.k: r.change for r in relops.full_compare(a, b, "k", "r").collect()} == {"x": "UNCHANGED", "y": "UP", "z": "EXITED", "w": "ENTERED"}
    n = spark.createDataFrame([("abcdef",), ("abcdefgh",), ("abc",), (None,)], "k string")
    assert rows(relops.prefix_pairs(n, "k", 6).select("short", "long")) == [("abcdef", "abcdefgh")]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (100, 101), (101, 102), (102, 103), (103, 104)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in {n for e in edges for n in e})
    df = spark.createDataFrame([*edges, (None, 1)], "a int, b int")
    assert rows(components(df)) == want
    assert rows(components(df.where("a < 0"))) == []


def test_components_of_a_long_path(spark):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(df).collect()} == {0}


def test_keep_in_order_against_a_scan(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(12)]), f"t{rng.randrange(15)}") for i in range(80)]
    seen, want = set(), {}
    for i, *keys in data:
        mine = {(k, v) for k, v in enumerate(keys) if v is not None}
        want[i] = not (mine & seen)
        if want[i]:
            seen |= mine
    df = spark.createDataFrame(data, "i int, a string, b int, c string")
    assert {r.i: r.kept for r in keep_in_order(df, "i", ["a", "b", "c"]).collect()} == want


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], ["d", "a", "b", "x"])], "p array<string>, q array<string>")
    r = df.select(jaccard(F.col("p"), F.col("q")), overlap(F.col("p"), F.col("q")), order_similarity(F.col("p"), F.col("q"))).first()
    assert r[0] == 0.6 and r[1] == 0.75 and abs(r[2] - 2 / 3) < 1e-9
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, None)], "o int, e string")
    assert rows(set_pairs(s, "o", "e").select("a", "b", "common", "size_a", "size_b")) == [(1, 2, 1, 2, 1)]


def test_contracts(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, "y")], "k int, v string")
    assert rows(quality.contract(df, "t", "k", ["v"])) == [("t", 3, 1, 1)]
    assert rows(quality.contract(df.where("k > 9"), "t", "k", ["v"])) == [("t", 0, 0, 0)]
    refs = spark.createDataFrame([("o", [1, 9])], "o string, ids array<int>")
    assert rows(quality.dangling(refs, "o", "ids", df, "k").select("o", "ref")) == [("o", 9)]
    assert quality.digest(df, "t").first() == quality.digest(df.orderBy(F.desc("v")).select("v", "k"), "t").first()
    assert rows(quality.differences(df, df.where("k = 1"))) == [(2, "y", "left")]


def test_the_register_needs_no_session():
    """Queries and SQL are listed before a session exists."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 80"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
