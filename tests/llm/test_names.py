import random

from sievework.llm import names, neardup, nicknames

B = "brand_id string, canonical_brand string, aliases array<string>, id int, words string"
C = "candidate_id string, original_name string, final_classification string, key int"


def test_folded_words():
    assert names.folded("Gupruri GIVÁKLÓ® 2026") == names.folded("gupruri givaklo") and names.folded("GivakloGupruri") == names.folded("Givaklo Gupruri")
    assert names.folded("Гивакло Гупрури") == names.folded("G1vaklo Gupruri") and names.folded("ResafÃ\xad Glenizi") == names.folded("Resafí Glenizi")
    assert names.folded(None) == names.folded("") == names.folded("2026 !") == []


def test_nicknames_are_no_long_list():
    assert len(nicknames.groups()) < 120 and ["robert", "bob", "rob", "bobby", "robbie", "bert"] in nicknames.groups()


def tables(spark):
    b = [("b1", "Givaklo Gupruri TV", ["Moyanru Keyelbo"], 1, None), ("b2", "Padoro Tokiwan", None, 1, None), ("b3", "Padoro Zumeshi", [], 1, None), ("b4", None, ["x"], 1, None)]
    c = [("c1", "Givakllo Guprri", "S", 1), ("c2", "givaklogupruri", "S", 1), ("c3", "KEYELBO MOYANRU", "S", 1), ("c4", "Tokiwan Padoro", "S", 1), ("c5", "Padroo Tokiwam", "S", 1), ("c6", "Padoro Zumeshi", "S", 1),
         ("c7", "Givaklo Gupruri", "EXCLUDED_GENERIC_TERM", 1), ("c8", None, "S", 1), ("c9", "Givaklo G. TV", None, 1), ("c1", "Givakllo Guprri", "S", 1), ("c0", "Padoro Tokiwan " * 500, "S", 1)]
    return spark.createDataFrame(b, B), spark.createDataFrame(c + filler(), C)


def filler(n=60, seed=3):
    """Other brands, each with the words of the trade, so that these are met beside many others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range(4))
    trade = ["TV", "Official", "Vision"]
    return [(f"f{seed}.{k}", f"{word()} {word()} {trade[k % 3]}", "S", 1) for k in range(n)]


def pairs(groups):
    return {(x, y) for g in groups for x in g for y in g if x < y}


def test_found(spark):
    got = {tuple(r) for r in names.found(*tables(spark)).collect()}
    assert got == pairs((["b1", "c1", "c2", "c3", "c9"], ["b2", "c0", "c4", "c5"], ["b3", "c6"]))


def found(spark, b, c):
    return {tuple(r) for r in names.found(spark.createDataFrame(b, B), spark.createDataFrame(c, C)).collect()}


def test_common_words_are_read_from_the_names(spark):
    c = filler(90)
    df = spark.createDataFrame([(k, names.folded(r[1])) for k, r in enumerate(c)], "id long, all array<string>")
    assert {r.w for r in names.common_words(df).collect()} == {names.sounded(w) for w in ("tv", "official", "vision")}
    # a brand named very often meets few words: its own aren't common
    hot = [(1000 + k, names.folded(f"Padoro Tokiwan {w}")) for k, w in enumerate(["TV", "Official", "Vision", "", "x", "Tokiwam", "Tokivan", "2026"] * 30)]
    df = df.union(spark.createDataFrame(hot, df.schema))
    assert not {"padoro", "tocivan"} & {r.w for r in names.common_words(df).collect()}


def test_links_stay_when_other_names_come(spark):
    b, c = tables(spark)
    rows = [tuple(r) for r in c.collect()]
    more = rows + filler(130, 11) + [("d" + r[0], r[1], r[2], r[3]) for r in rows if r[0] in ("c5", "c1")]
    got = {tuple(r) for r in names.found(b, spark.createDataFrame(more, C)).collect()}
    assert got >= pairs((["b1", "c1", "c2", "c3", "c9", "dc1"], ["b2", "c0", "c4", "c5", "dc5"], ["b3", "c6"]))


def test_rows_of_many_kinds(spark):
    """Names of common words only, sellers who share a word, rows named by an initial, slips: in one table, each as if alone."""
    b = [("b1", "Gudemi W. TV", ["Gudemi Winmoklo"], 1, None), ("b2", "Gudemi Wachetro", None, 1, None), ("b3", "Tokiwan Padoro", ["Fewelro Kochetri"], 1, None), ("b4", "Rilesa Zu", ["Kevo Bami"], 1, None), ("b9", "Hotel Euro", None, 1, None)]
    c = [(f"c{k}", "Gudemi Wachetro", "S", 1) for k in range(4)] + [("d1", "Gudemi Winmoklo", "S", 1), ("d2", "Kochetri Fewelro", "S", 1), ("d3", "Bami Kevo", "S", 1)]
    c += [(f"h{k}", n, "S", 1) for k, n in enumerate(("hotel  euro", "EURO HOTEL"))] + [("t1", "Vision Official", "S", 1), ("t2", "official VISION", "S", 1)]
    c += [(f"s{k + 1}", n, "S", 1) for k, n in enumerate(("Robert Zalanek", "Lupe Zalanek", "Bob Zalanek", "Guadalupe Zalanek", "Robert Zalanek Mirosto", "Zalanek, Bob (Mirosto)", "Robert Zalanek Padumi"))]
    rng, slips = random.Random(8), set()
    word = lambda: "".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range(4))
    for k in range(60):
        x, y, i = word(), word(), rng.randrange(1, 7)
        c += [(f"x{k:02}a", f"{x} {y}", "S", 1), (f"x{k:02}b", f"{x[:i] + x[i + 1:]} {y}", "S", 1), (f"x{k:02}c", f"{y} {x}", "S", 1), (f"x{k:02}d", x + y, "S", 1)]
        slips |= pairs(([f"x{k:02}{e}" for e in "abcd"],))
    got = found(spark, b, c + filler(90, 7))
    # recall as planned from the collision curve
    x = {p for p in got if p[0][0] == "x"}
    assert len(x & slips) >= 0.95 * len(slips) and len(x & slips) >= 0.98 * len(x)
    assert neardup.collision(0.4, neardup.plan_bands(0.4, 0.99, 3), 3) >= 0.99
    s = {p for p in got if p[0][0] == "s"}
    assert s >= {("s1", "s3"), ("s2", "s4"), ("s5", "s6")} and not {("s1", "s2"), ("s3", "s4"), ("s2", "s3"), ("s1", "s4"), ("s5", "s7"), ("s6", "s7")} & s
    assert got - x - s == pairs((["b2", "c0", "c1", "c2", "c3"], ["b1", "d1"], ["b3", "d2"], ["b4", "d3"], ["b9", "h0", "h1"], ["t1", "t2"]))


def test_stars_end_on_long_chains(spark):
    """A chain of falling weights gives one centre a round; every node is placed all the same."""
    n = 9
    nodes = spark.createDataFrame([(k, n - k) for k in range(n)], "id long, weight long")
    way = [(k, k + 1, 0.9) for k in range(n - 1)]
    links = spark.createDataFrame(way + [(b, a, s) for a, b, s in way], "a long, b long, sim double")
    got = {r.id: r.centre for r in names.stars(nodes, links).collect()}
    assert len(got) == n and {k for k in range(n) if got[k] == k} == set(range(0, n, 2))


def test_empty_tables(spark):
    b, c = tables(spark)
    assert names.found(b.limit(0), c.limit(0)).count() == 0 and names.clusters(b, c.limit(0)).count() == 3


def test_found_leaves_its_result_only(spark):
    """Intermediate tables and shuffle files go when they have been read, and the session's setting is as before."""
    from sievework import session

    b, c = tables(spark)
    before, setting = len(session._PATHS), spark.conf.get(session.CLEANUP)
    got = names.found(b, c)
    made = session._PATHS[before:]
    assert not [p for p in made if any(f"/{n}-" in p for n in ("names", "cores", "nodes", "pairs", "links", "checked", "rank", "open", "free", "centres", "stars"))]
    assert spark.conf.get(session.CLEANUP) == setting and got.count() == got.distinct().count() == 10 + 6 + 1
    assert "Aggregate" not in got.filter("true")._jdf.queryExecution().optimizedPlan().toString()
