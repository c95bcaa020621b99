import random

import pytest
from pyspark.sql import functions as F

from sievework import session
from sievework.operators import graph, quality, relops, sequential
from sievework.streaming import ledger


def in_order(rows):
    owned, kept = set(), {}
    for i, *keys in sorted(rows):
        mine = {(n, k) for n, k in enumerate(keys) if k is not None}
        kept[i] = not mine & owned
        if kept[i]:
            owned |= mine
    return kept


@pytest.mark.parametrize("scanned", [1_000_000, 60])
def test_long_chains_are_kept_in_order(spark, scanned):
    """A chain of 300 rows would take as many rounds; groups above the bound go on in rounds to the end."""
    n = 300 if scanned > 1000 else 24
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}", None) for i in range(n)] + [(n + i, f"x{i % 5}", None, f"y{i % 3}") for i in range(20)] + [(n + 50, None, None, None)]
    df = spark.createDataFrame(rows, "i long, p string, q string, r string")
    got = {r.i: r.kept for r in sequential.keep_in_order(df, "i", ["p", "q", "r"], rounds=2, scanned=scanned).collect()}
    assert got == in_order(rows)


def test_a_path_of_many_nodes_is_one_component(spark):
    n = 700
    at = list(range(n))
    random.Random(3).shuffle(at)
    edges = spark.createDataFrame(list(zip(at, at[1:])) + [(2000, 2001), (3000, 3000), (None, 1)], "a long, b long")
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert set(got.values()) == {0, 2000, 3000} and sum(v == 0 for v in got.values()) == n


def hot(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, None if i % 41 == 0 else "hot" if i % 2 else f"k{rng.randrange(30)}", rng.randrange(50), rng.randrange(1, 9)) for i in range(n)]


def test_running_sums_with_a_key_of_half_of_all_rows(spark):
    data = hot()
    df = spark.createDataFrame(data, "i long, k string, t int, v int").repartition(7)
    out = relops.running(df, ["k"], [F.col("t"), F.col("i")], [F.lit(1).alias("place"), F.col("v").alias("spent")])
    got = {r.i: (r.place, r.spent) for r in out.collect()}
    want, seen = {}, {}
    for i, k, t, v in sorted(data, key=lambda r: (str(r[1]), r[2], r[0])):
        n, s = seen.get(k, (0, 0))
        want[i] = seen[k] = (n + 1, s + v)
    assert got == want
    flags = relops.duplicates_flagged(df, ["k"], [F.col("t"), F.col("i")])
    assert {r.i: r.copy_no for r in flags.collect()} == {i: n for i, (n, _) in want.items()}
    # no part holds the whole of the hot key
    parts = df.repartitionByRange(4, "k", "t", "i").withColumn("p", F.spark_partition_id()).where("k = 'hot'").groupBy("p").count().collect()
    assert len(parts) > 1
    assert relops.duplicates_flagged(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_budget_of_a_hot_user(spark):
    rows = [(k, k // 3, 1 if k % 2 else k, 10) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts long, user_id long, cost long")
    got = {r.user_id: (r.at, r.event) for r in ledger.over_budget(df, "user_id", ["ts", "event_id"], "cost", 55).collect()}
    mine = [r for r in rows if r[2] == 1]
    assert got == {1: (mine[5][1], mine[5][0])}


def test_operation_states(spark):
    e = [(1, "view"), (1, "error"), (2, "error"), (2, "error"), (2, "view"), (3, "error"), (3, "done"), (3, "error"), (3, "error"), (4, "view"), (5, "error"), (5, "view")]
    df = spark.createDataFrame([(k, u, t) for k, (u, t) in enumerate(e)], "i long, user_id long, kind string")
    got = {r.user_id: (r.attempts, r.failures, r.state) for r in ledger.operation_states(df, "user_id", ["i"], "kind", "error", "done").collect()}
    assert got == {1: (2, 1, "PENDING_RETRY"), 2: (3, 2, "FAILED"), 3: (2, 1, "COMPLETED"), 4: (1, 0, "ATTEMPT_RESERVED"), 5: (2, 1, "ATTEMPT_RESERVED")}


def test_every_change_of_a_row_changes_the_digest(spark):
    rows = [(i, f"n{i}", None if i % 7 == 0 else i * 3) for i in range(40)]
    schema = "i int, n string, v int"
    one = lambda data: tuple(quality.digest(spark.createDataFrame(data, schema), "t").first())
    base = one(rows)
    assert base == one(rows[::-1])
    for k in (0, 13, 39):
        assert one(rows[:k] + [(rows[k][0], rows[k][1] + "!", rows[k][2])] + rows[k + 1 :]) != base
    assert one([(1, "a|b", None)]) != one([(1, "a", None)]) and one([(1, "a", None)]) != one([(1, None, None)])
    assert one([]) == ("t", 0, "0", "0")


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_intermediate_tables_go_at_the_end_of_their_scope(spark):
    from pathlib import Path

    with session.released(spark):
        t = session.written(spark.range(5), "t")
        path = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 5 and Path(path).exists()
    assert not Path(path).exists()


def test_small_tables_are_bounded_in_bytes(spark):
    wide = spark.range(3).select("id", F.repeat(F.lit("x"), 20_000_000).alias("t"))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "ResolvedHint" in plan(relops.small(spark.range(3).toDF("id"))) and "ResolvedHint" not in plan(relops.small(wide))


def test_grids_of_large_dimensions_fail(spark, monkeypatch):
    monkeypatch.setattr(relops, "GRID_SIDE", 3)
    d = spark.range(5).toDF("k")
    with pytest.raises(ValueError):
        relops.coverage_grid(d.withColumn("j", F.col("k")), d, d.withColumnRenamed("k", "j"), "k", "j", F.count("*"), "n")
