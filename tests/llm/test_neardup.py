import random
import re

from sievework.llm import neardup

SCHEMA = "row_id long, title string, content string, class_id string, grams int"


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out, i = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(15, 60))]
        for k in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 12) if k else 0):
                w[rng.randrange(len(w))] = word()
            out.append((i, " ".join(w[:4]), " ".join(w[4:]), None, None))
            i += 1
    out += [(i, None, "too short", None, None), (i + 1, "t", None, None, None), (i + 2, "t", "", None, None), (None, *out[0][1:])]
    out += [(i + 3 + k, out[0][1], out[0][2].upper() + "!", None, None) for k in range(3)]
    out.append((i + 9, "long", " ".join(f"w{k}" for k in range(30_000)), None, None))
    out.append((i + 10, "long", " ".join(f"w{k}" for k in range(29_000)), None, None))
    return out


def grams(title, content, n):
    w = re.findall(r"[^\W_]+", (title or "").lower()) + re.findall(r"[^\W_]+", content.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(data, n, threshold, least):
    s = {i: grams(t, c, n) for i, t, c, *_ in data if i is not None and c is not None and len(re.findall(r"[^\W_]+", c)) >= least}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def test_pairs_and_links_against_brute_force(spark):
    data = corpus()
    df = spark.createDataFrame(data, SCHEMA)
    members, pairs = neardup.near_duplicates(df, "row_id", "content", "title", n=3, threshold=0.5, min_words=12, recall=0.999)
    want = brute(data, 3, 0.5, 12)
    got = {tuple(r) for r in neardup.row_pairs(members, pairs).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 40
    links = {r.row_id: r for r in neardup.linked_rows(members, pairs).collect()}
    assert links[0].class_size == 4 and None not in links


def test_short_and_empty_texts_have_a_class(spark):
    texts = [None, "", "...", "a b", "A, b!", "a c", "one", "x y z u v w", "x y z u v w", "X y z u v w!"]
    df = spark.createDataFrame([(k, None, t, None, None) for k, t in enumerate(texts)] + [(None, None, "a b", None, None)], SCHEMA)
    members, pairs = neardup.near_duplicates(df, "row_id", "content")
    got = {r.row_id: (r.class_id, r.class_size, r.links) for r in neardup.linked_rows(members, pairs).collect()}
    assert got == {0: (0, 3, 0), 1: (0, 3, 0), 2: (0, 3, 0), 3: (3, 2, 0), 4: (3, 2, 0), 5: (5, 1, 0), 6: (6, 1, 0), 7: (7, 3, 0), 8: (7, 3, 0), 9: (7, 3, 0)}
    members, pairs = neardup.near_duplicates(df, "row_id", "content", min_words=3)
    assert {r.row_id for r in members.collect()} == {7, 8, 9}


def test_plan_follows_the_collision_curve():
    for t, r, rows in ((0.5, 0.98, 5), (0.8, 0.99, 8)):
        b = neardup.plan_bands(t, r, rows)
        assert neardup.collision(t, b, rows) >= r > neardup.collision(t, b - 1, rows)


def test_empty_table(spark):
    members, pairs = neardup.near_duplicates(spark.createDataFrame([], SCHEMA), "row_id", "content", "title")
    assert members.count() == 0 and neardup.row_pairs(members, pairs).count() == 0 and neardup.linked_rows(members, pairs).count() == 0


def test_a_hot_bucket_loses_no_pair(spark):
    """One opening holds half of all rows: its bucket is searched by the rarest grams, with the same pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    opening = " ".join(word() for _ in range(30))
    rows = [(k, None, opening + " " + " ".join(word() for _ in range(rng.randrange(4, 30))), None, None) for k in range(60)] + [(100 + k, None, " ".join(word() for _ in range(30)), None, None) for k in range(60)]
    rows += [(200 + k, None, r[2] + " x", None, None) for k, r in enumerate(rows[:30])]
    df = spark.createDataFrame(rows, SCHEMA)
    _, reps = neardup.classes(df, "row_id", None, "content", 3, 0)
    sets = reps.select("id", "grams")
    want = brute(rows, 3, 0.5, 0)
    cut = {(r.a, r.b) for r in neardup.candidates(sets, 0.5, 0.999, 5, hot=5).collect()}
    every = {(r.a, r.b) for r in neardup.prefix_pairs(sets, 0.5).collect()}
    assert want <= every and len(want) > 100 and len(every) < 120 * 149 // 2
    assert want <= cut | {(r.a, r.b) for r in neardup.candidates(sets, 0.5, 0.999, 5).collect()}


def test_checked_pairs_are_the_verified_candidates(spark, monkeypatch):
    """Pairs checked by rounds of bands are those of all bands at once; chance pairs are never written; no round leaves a table behind."""
    import random

    from sievework import session

    rng = random.Random(5)
    base = [[rng.randrange(2**62) for _ in range(12)] for _ in range(60)]
    sets = [(k, base[k % 60][: 12 - k % 4] + [rng.randrange(2**62) for _ in range(k % 4)]) for k in range(180)]
    sets += [(1000 + k, [rng.randrange(40) for _ in range(9)]) for k in range(150)] + [(5000, []), (5001, [rng.randrange(2**62) for _ in range(20000)])]
    sets = [(k, list(dict.fromkeys(g))) for k, g in sets]
    of = dict(sets)
    jaccard = lambda a, b: len({*of[a]} & {*of[b]}) / len({*of[a]} | {*of[b]})
    df = spark.createDataFrame(sets, "id long, grams array<long>")
    asked: list = []

    def check(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return session.written(pairs.where("a < 1000"), "kept")

    whole = {(r.a, r.b) for r in neardup.candidates(df, 0.4, 0.99, 3).collect()}
    before = len(session._PATHS)
    got = neardup.checked_pairs(df, 0.4, 0.99, 3, 0.2, check, at_once=9)
    assert len(session._PATHS) == before + 1
    assert {p for p in whole if jaccard(*p) >= 0.2} <= {*asked} <= whole and len({*asked}) < len(whole)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(p for p in {*asked} if p[0] < 1000)
    # members of hot buckets meet by their rarest grams
    hot = {(r.a, r.b) for r in neardup.checked_pairs(df, 0.4, 0.99, 3, 0.2, lambda p: session.written(p, "kept"), hot=2).collect()}
    assert hot >= {p for p in whole if jaccard(*p) >= 0.4}
    monkeypatch.setattr(neardup, "may_overlap", lambda least: "true")
    assert {(r.a, r.b) for r in neardup.checked_pairs(df, 0.4, 0.99, 3, 0.2, lambda p: session.written(p, "kept")).collect()} == whole
