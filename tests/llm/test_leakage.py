import re

from pyspark.sql import SparkSession

from sievework.llm import leakage
from sievework.llm.textnorm import look_alikes, read_form

ITEM = "Survey crews near Luthen Gap measured 77 dropped frames on feed 2068 that Worgeze sells"
DOCS = "doc_id long, text string, term string, win long"
ITEMS = "item_id long, text string"


def docs():
    w = ITEM.split()
    return [
        (1, "x " + ITEM, None, None), (2, "say: " + " ".join(w[3:11]).upper() + " done", None, None), (3, " ".join(w[3:10]) + " no more", None, None),
        (4, "<p>" + " ".join(w[:4]) + "\n**" + "</b> ".join(w[4:9]) + "**", None, None), (5, "​".join(" ".join(w[2:12])) + " end", None, None),
        (6, " ".join(w[:6]).replace("e", "е") + " " + " ".join(w[6:8]), None, None), (7, None, None, None), (8, "", None, None), (9, " ".join(w[7:] + w[:7]), None, None),
        (10, "filler " * 50_000 + ITEM, None, None), (1, "x " + ITEM, None, None), (11, " ".join(w[:5]) + " then " + " ".join(w[5:]), None, None), (None, ITEM, None, None),
        (12, "<br>".join(w), None, None), (13, "<div class='x'>" + "</p><p>".join(w) + "</div>", None, None), (14, "<b>Sur</b>vey <I title='" + "q" * 900 + "'>crews</I> " + " ".join(w[2:]), None, None),
        (15, "<ul><li>" + "</li>\n<li>".join(w) + "<BR/>", None, None), (16, "<span>" + "</span><span>".join(w) + "</span>", None, None),
    ]


def words(t):
    """By a parser of its own: block tags and breaks part words, other tags don't, whatever their length."""
    t, out, block = read_form(t, look_alikes(SparkSession.active())), "", {"p", "br", "div", "li", "ul", "td", "tr", "h1", "h2"}
    while (m := re.search(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>", t)) is not None:
        out, t = out + t[: m.start()] + (" " if m[2].lower() in block else ""), t[m.end() :]
    return re.findall(r"[^\W_]+", re.sub(r"[*_`~]+|&shy;", "", (out + t).replace("&nbsp;", " ")).lower())


def brute(d, items, n=8):
    out = set()
    for i, t, *_ in d:
        a = words(t or "")
        have = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)}
        for j, u in items:
            b = words(u or "")
            if i is not None and any(tuple(b[k : k + n]) in have for k in range(len(b) - n + 1)):
                out.add((i, j))
    return out


def test_found_against_brute_force(spark):
    items = [(1, ITEM), (2, "feed 2068 that Worgeze sells and " + "other words follow here now"), (3, "too short"), (4, None), (5, ITEM)]
    got = {tuple(r) for r in leakage.found(spark.createDataFrame(docs(), DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(docs(), items) and {(1, 1), (1, 5), (2, 1), (4, 1), (5, 1), (6, 1), (10, 1), (12, 1), (13, 1), (14, 1), (15, 1)} <= got and not {i for i, _ in got} & {3, 7, 8, 16}


def test_proximity_allows_slack(spark):
    d = [(1, "Survey crews near the Luthen Gap measured 77 dropped"), (2, "Survey of crews and of near and of Luthen")]
    near = leakage.places(spark.createDataFrame([(i, t, None, None) for i, t in d], DOCS), spark.createDataFrame([(1, ITEM)], ITEMS), 8, least=7, slack=1)
    assert {r.doc_id for r in near.collect()} == {1}


def near(d, items, n, least, slack):
    """The most words met by a window of an item at any place of a document, by trying all places."""
    out = {}
    for i, t, *_ in d:
        a = words(t or "")
        for j, u in items:
            b = words(u or "")
            for k in range(len(b) - n + 1):
                for s in range(-n, len(a) + n):
                    met = sum(any(0 <= p < len(a) and a[p] == w for p in range(s + o - slack, s + o + slack + 1)) for o, w in enumerate(b[k : k + n]))
                    if met >= least:
                        out[i, j] = max(out.get((i, j), 0), met)
    return out


def test_proximity_with_two_insertions_against_all_places(spark):
    item = "w0 w1 w2 w3 w4 w5 w6 w7"
    apart = "w0 w1 x w2 w3 w4 y w5 w6 w7"  # all eight within 1 of start 1
    for rare in ("w0 w1", "w5 w6 w7", "w2 w4"):
        common = " . ".join(w for w in item.split() if w not in rare.split())
        d = [(1, apart, None, None), (2, "z z z " + apart + " z", None, None), (3, "w1 w0 x y w3 w2 w4 w5 w7 w6", None, None)] + [(10 + k, f"{common} q", None, None) for k in range(9)]
        for least in (6, 7, 8):
            got = leakage.places(spark.createDataFrame(d, DOCS), spark.createDataFrame([(1, item)], ITEMS), 8, least=least, slack=1)
            most = {}
            for r in got.collect():
                most[r.doc_id, 1] = max(most.get((r.doc_id, 1), 0), r.hits)
            want = near(d, [(1, item)], 8, least, 1)
            assert most == want and want[1, 1] == want[2, 1] == 8


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leakage.found(d, spark.createDataFrame([(1, ITEM)], ITEMS)).count() == 0 and leakage.found(spark.createDataFrame(docs(), DOCS), i).count() == 0


def test_one_index_serves_every_test_set(spark):
    postings = leakage.index(spark.createDataFrame(docs(), DOCS))
    for items in ([(1, ITEM)], [(7, "feed 2068 that Worgeze sells and other words follow here now"), (8, ITEM)]):
        got = {(r.doc_id, i) for r in leakage.search(postings, spark.createDataFrame(items, ITEMS), 8).collect() for i in r.item_ids}
        assert got == brute(docs(), items) and got
    one = {(r.term, r.doc_id): r.positions for r in postings.collect()}
    assert one["survey", 1] == [1] and one["filler", 10] == list(range(50_000))


def test_long_passages_and_sets_of_places(spark, monkeypatch):
    """A passage over several words of bits, and the same with sets instead of bits."""
    w = [f"w{k}" for k in range(150)]
    d = [(1, " ".join(w[55:70]), None, None), (2, " ".join(w[118:126]) + " x " + " ".join(w[0:8]), None, None), (3, " ".join(w[10:17]), None, None), (4, "w1 w2 " + " ".join(w), None, None)]
    items = [(1, " ".join(w)), (2, " ".join(w[60:69]))]
    want = brute(d, items)
    for masks in (leakage.MASKS, 0):
        monkeypatch.setattr(leakage, "MASKS", masks)
        got = {tuple(r) for r in leakage.found(spark.createDataFrame(d, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
        assert got == want == {(1, 1), (1, 2), (2, 1), (4, 1), (4, 2)}
