import random

from sievework.llm import boilerplate as bp

SCHEMA = "result_row_id long, title string, content string, raw_content string, lines string, row_id string"
TITLE, TEXT = "Is Murado still brisk in June 2024?", "Murado answered the support desk within 4 hours and restored the voucher. Menus opened in 9 seconds on a tablet."
PAGE = f"""Home
[Sign in]
We use cookies to count visits. Read more in our policy.
# {TITLE}
By Ada Lopo
{TEXT}
## 2. Murado – 9.50 EUR
Advertisement
A newsletter sent in June promised a bouquet for coastal towns at 3.10 EUR. Nobody could trace it.
| 1 | Murado | 9.50 | 12 |
- Murado: a spare login, 9.50
***
Copy link
12 comments, join the talk
Ted57 says It was slow for a week on my box.
Related reading
› Is Tolani still dated in May 2023?
Tolani dropped a trial in May, and one reseller called it thin…
© 2026 Murado Daily. All rights reserved.
Back to top"""
BODY = {3, 5, 6, 8, 9, 10}


def segments(s, drop):
    """All (first, past the last, sum) whose beginnings and ends sum to more than 0 and that never fall more than ``drop`` below an earlier sum."""
    out = []
    for i in range(len(s)):
        best = total = 0.0
        for k in range(i, len(s)):
            total += s[k]
            if total <= 0 or best - total > drop:
                break
            if total > best:
                best = total
                out.append((i, k + 1, total))
    return out


def test_regions_are_maximal_against_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randrange(0, 14))]
        for drop in (1.5, 3, float("inf")):
            got, every = bp.regions(s, drop), segments(s, drop)
            assert all(abs(sum(s[a:b]) - t) < 1e-9 and (a, b, t) in every for a, b, t in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
            assert {i for i, v in enumerate(s) if v > 0} <= {i for a, b, _ in got for i in range(a, b)}
            # none of them could go on
            assert not any(a == c and e > b for a, b, _ in got for c, e, _ in every)
        if s and max(s) > 0:
            whole = max(sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1))
            assert abs(max(t for *_, t in bp.regions(s, float("inf"))) - whole) < 1e-9


def test_words_score_up_and_tags_down():
    w = bp.train([(TITLE, TEXT)])[0]
    tags = {t for t in w if t[0] == "<" and len(t) > 1}
    assert all(w[t] <= 0 for t in tags) and all(v >= 0 for t, v in w.items() if t not in tags) and w["<line>"] < 0


def test_the_scan_decides_beside_the_scores():
    """A short line that scores below 0 belongs to the article around it; a weak line on its own doesn't."""
    scores = [-5.0, 0.3, -5.0, 3.0, -1.5, 2.5, -5.0, -5.0]
    kept = {i for a, b, t in bp.regions(scores) if t >= bp.MIN_SCORE for i in range(a, b)}
    assert kept == {3, 4, 5} and kept != {i for i, s in enumerate(scores) if s > 0}
    w = bp.train([(TITLE, TEXT)])
    lines = ["Home", TEXT, "Murado zolani", TEXT, "Home", "Sitemap"]
    s, _ = bp.line_scores(lines, "", "", w, {})
    assert s[2] <= 0 < s[1] and s[4] < -bp.DROP
    gone = bp.outside("\n".join(lines), "", "", w, {})
    assert (2 in gone) == (s[2] < -bp.DROP) and {0, 4, 5} <= set(gone)


def test_found_on_pages_of_every_kind(spark):
    rows = [(1, TITLE, TEXT, PAGE, None, None), (2, TITLE, None, PAGE.replace("\n", "\r\n"), None, None), (3, None, None, None, None, None), (4, TITLE, TEXT, "", None, None), (1, TITLE, TEXT, PAGE, None, None), (5, "x", "y", "!" * 200_000 + "a " + "word " * 100_000, None, None)]
    # the corpus's other pages lend their vocabulary
    rows += [(100 + k, f"Is Sample {k} still {w} in May 2024?", f"A newsletter sent in {m} promised a bouquet for the {p} at {k}.10 EUR. Nobody could trace the refund in {m}.", None, None, None)
             for k, (w, m, p) in enumerate((w, m, p) for w in ("thin", "dated", "brisk") for m in ("June", "March", "April") for p in ("coastal towns", "capital", "old port"))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in bp.found(df).distinct().collect():
        got.setdefault(r.result_row_id, set()).add(r.line_no)
    want = set(range(20)) - BODY - {11}
    assert got[1] == want and got[2] == want and 3 not in got and 4 not in got
    body = {r.result_row_id: r for r in bp.main_body(df).collect()}
    assert body[1].main_text.split("\n")[0] == "# " + TITLE and len(body[1].main_text.split("\n")) == len(BODY) and body[3].main_text is None and body[4].main_text == ""


def test_held_out_accuracy():
    """Weights must judge lines that stand in no labelled page."""
    w = bp.train([(TITLE, TEXT)])
    good = ["3. Sasori – 9.10 GBP", "| 4 | Sasori | 7.00 | 33 |", "Sasori: parental locks, 3.20", "Between May and July the refund count rose to 40 with no explanation, and the desk gave no reason for it."]
    poor = ["Sitemap", "Kim40: It never worked on my box.", "Home | News | Contact", "News > Guides > Sasori again", "All rights reserved. © 2025 Sasori Guide", "Share this page", "Aviso legal"]
    known = {}
    assert [x for x in good if bp.outside(x, "", "", w, known)] == [] and [x for x in poor if not bp.outside(x, "", "", w, known)] == []


def test_a_language_left_out_of_the_fit():
    """Pages of a language whose labelled pages were held back: recall and precision of the lines outside."""
    for left in range(len(bp.PAGES)):
        w = bp.train([], [p for k, p in enumerate(bp.PAGES) if k != left])
        both = found = true = 0
        for page in bp.generated([], [bp.PAGES[left]], 40, seed=left):
            title = next((line.lstrip("#= ") for _, what, line in page if what == "@title"), "")
            gone = set(bp.outside("\n".join(line for *_, line in page), title, "", w, {}))
            want = {i for i, (mark, *_) in enumerate(page) if mark != "+"}
            both, found, true = both + len(gone & want), found + len(gone), true + len(want)
        print("held out", left, "recall", round(both / true, 3), "precision", round(both / found, 3))
        assert both >= 0.85 * true and both >= 0.85 * found


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bp.found(df).count() == 0 and bp.main_body(df).count() == 0
