import random

from sievework.llm import mixing
from sievework.llm.queries import TOKENIZER

DOCS = "doc_id long, source string, text string, copies int, rate string"
TARGETS = "source string, target_share double, max_repeats int"


def docs(n=600):
    rng = random.Random(1)
    out = [(i, ["big", "big", "big", "mid", "tiny" if i % 50 == 9 else "mid"][i % 5], "word " * rng.randrange(1, 40), None, None) for i in range(n)]
    return out + [(9001, None, "text", None, None), (9002, "big", None, None, None), (9003, "big", "", None, None), (9004, "untargeted", "text", None, None), (None, "mid", "word word", None, None)]


def test_shares_are_reached_within_the_caps(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.1, 3)], TARGETS)
    r = {x.source: x for x in mixing.shares(spark.createDataFrame(docs(), DOCS), t, TOKENIZER).collect()}
    assert r["absent"].actual_share == 0 and set(r) == {"big", "mid", "tiny", "absent"}
    for s, cap in (("big", 1), ("mid", 2), ("tiny", 4)):
        assert abs(r[s].actual_share - r[s].target_share / 0.9) < 0.02 and r[s].most_copies <= cap
    rows = mixing.mix(spark.createDataFrame(docs(), DOCS), t, TOKENIZER).collect()
    assert len(rows) == sum(x.mixed_rows for x in r.values()) == len({(x.source, x.doc_id, x.copy) for x in rows})
    assert rows == mixing.mix(spark.createDataFrame(docs()[::-1], DOCS).repartition(3), t, TOKENIZER).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(spark.createDataFrame(docs()[::-1], DOCS).repartition(3), t, TOKENIZER).collect()))


def test_one_copy_for_each_boundary_crossed(spark):
    """Each document gets the floor or the ceiling of its expected copies, and a source's total is its expectation's."""
    t = spark.createDataFrame([("big", 0.4, 5), ("mid", 0.6, 3)], TARGETS)
    tok = mixing.counted(spark.createDataFrame(docs(), DOCS), t, TOKENIZER)
    rows, rates = mixing.mixed(tok, t)
    rate, n = {r.source: r.rate / mixing.UNIT for r in rates.collect()}, {r.source: r["count"] for r in tok.groupBy("source").count().collect()}
    got = {}
    for r in rows.collect():
        assert int(rate[r.source]) <= r.copies <= int(rate[r.source]) + 1
        got[r.source] = got.get(r.source, 0) + r.copies
    for s in rate:
        assert abs(got[s] - rate[s] * n[s]) <= 1


def test_empty_tables(spark):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(d, t, TOKENIZER).count() == 0 and mixing.shares(d, t, TOKENIZER).first().actual_share == 0
    assert mixing.mix(spark.createDataFrame(docs(), DOCS), spark.createDataFrame([], TARGETS), TOKENIZER).count() == 0
    assert mixing.shares(spark.createDataFrame(docs(), DOCS), spark.createDataFrame([("big", None, None)], TARGETS), TOKENIZER).first().mixed_rows == 0


def test_a_size_that_is_asked_for(spark):
    """Sources that can't give their part within their cap give it whole and are reported."""
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 2)], TARGETS)
    d = spark.createDataFrame(docs(), DOCS)
    r = {x.source: x for x in mixing.shares(d, t, TOKENIZER, total_tokens=6000).collect()}
    assert r["tiny"].capped and r["tiny"].mixed_tokens == 2 * r["tiny"].source_tokens and r["tiny"].most_copies == 2 and not r["big"].capped and not r["mid"].capped
    assert abs(r["big"].mixed_tokens - 3000) < 150 and abs(r["mid"].mixed_tokens - 1800) < 150
    assert not any(x.capped for x in mixing.shares(d, t, TOKENIZER).collect())
