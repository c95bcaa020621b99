import random

from sievework.plans import graphs

MENTIONS = "page_row_id long, mention_row_id long, mention_position int, domain string, normalized_name string"


def pages():
    rng = random.Random(6)
    names = [f"n{k}" for k in range(14)]
    out = {k: (rng.choice("uvw"), rng.sample(names, rng.randrange(1, 6))) for k in range(60)}
    # one list on hosts a and b, a near copy on a and c; a near copy of another on its host alone; one list twice on one host
    lists = [("a", "pqrs"), ("b", "pqrs"), ("a", "pqrt"), ("c", "pqrt"), ("d", "efgh"), ("d", "efgi"), ("e", "jklm"), ("e", "jklm"), ("a", "pqrs"), ("f", "xy"), ("g", "xy")]
    return out | {100 + k: (h, list(x)) for k, (h, x) in enumerate(lists)}


def test_ordered_replicas_against_all_pairs_of_pages(spark, tmp_path):
    data = pages()
    rows = [(p, p * 100 + i, i, h, n) for p, (h, x) in data.items() for i, n in enumerate(x)] + [(100, 1, 9, "a", None)]
    spark.createDataFrame(rows, MENTIONS).write.parquet(str(tmp_path / "raw_brand_mentions.parquet"))
    got = graphs.replica_pages(spark.read.parquet(str(tmp_path / "raw_brand_mentions.parquet")), 0.6, 3, 0.0).collect()
    assert len(got) == len({(r.a, r.b, r.page) for r in got})
    sides = {}
    for r in got:
        assert r.class_id in (r.a, r.b) and r.domain == data[r.page][0]
        sides.setdefault((r.a, r.b, r.overlap), {}).setdefault(r.class_id, []).append(r.page)
    pairs = {(min(p, q), max(p, q), o) for (a, b, o), s in sides.items() for p in s[a] for q in s[b] if data[p][0] != data[q][0]}
    want, ends = set(), set()
    for p, (h, x) in data.items():
        for q, (g, y) in data.items():
            o = len({*x} & {*y}) / min(len(x), len(y))
            if p < q and h != g and min(len(x), len(y)) >= 3 and o >= 0.6:
                want.add((p, q, round(o, 6)))
                ends |= {p, q}
    assert pairs == want and {r.page for r in got} == ends
    assert {(100, 101, 1.0), (101, 108, 1.0), (100, 103, 0.75), (101, 102, 0.75)} <= want
