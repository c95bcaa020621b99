"""The main body of captured pages, by maximum-scoring subsequences.

A line is a run of words, between a line tag and tags that say how it is set (short, a bar of links, a breadcrumb, decorated, broken off, a
speaker's, below another page's headline). Words score 0 or more and tags 0 or less: the weights come from labelled pages by logistic regression under these signs.
One linear scan over a page's lines finds the maximum-scoring subsequences: a region begins at a line that scores, grows while its sum stays
above 0 and within ``DROP`` of its best, and ends at its best. All lines of regions of at least ``MIN_SCORE`` are the main body, also those in between
that score below 0; lines outside are not, also those that score above. An article broken by notices comes out as several regions.

Defined cases: a null or empty page has no lines; lines without letter or digit are never reported; a null
title matches no line; texts are scanned whole, whatever their length; repeated captures are judged each; without any page to draw
the vocabulary from, the labelled lines alone train the weights; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.labelled_pages import FILLERS, PAGES

#: Pages of the corpus, at most, whose title and opening go into the labelled pages, and characters of an opening that do.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 2_000
#: Generated labelled pages the weights are fitted on.
TRAINING_PAGES = 500
#: The least score of a region, and how far its sum may fall below its best; for 0 to 2 and 0.7 to 3 results hardly differ (README).
MIN_SCORE, DROP = 0.5, 2.0
#: Words on fewer training lines than this share one weight, which is also that of words never seen.
RARE, OTHER_WORD = 3, "~"
#: A line's words count as at most this many, so that a long line isn't the sum of all its words.
WORDS = 3.0
#: Lines whose score a task keeps at once; furniture recurs.
KEPT = 100_000

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[^\w\s]")
#: Signs that only decorate the ends of a line.
BEFORE, AFTER = " \t\xa0[»›•*+-", " \t\xa0]»›!+"
CLOCK = re.compile(r"\d\d:\d\d")
HOST = re.compile(r"\b[^\W_](?:[\w-]*[^\W_])?\.[a-z]{2,}\b")
#: The first word of a line mixes letters and digits, as the names of speakers do.
SPEAKER = re.compile(r"^\W*[^\W\d_]+\d+\b")
#: The line is the page's own title or opening; a paragraph alone below another page's headline.
OWN, BLURB = "=own", "<blurb>"


_NO_WORD, _SAYS = re.compile(r"[\W_]+"), re.compile(r"[^\W_]")


def key(text: str) -> str:
    return _NO_WORD.sub("", text.lower())


def features(line: str) -> tuple[set[str], set[str], set[str]]:
    """(words, pairs of a word, number or sign and the next sign or number, tags) of a line."""
    core = line.lstrip(BEFORE).rstrip(AFTER)
    seen = TOKEN.findall(core.lower())
    words = {t for t in seen if t[0].isalpha()}
    kind = ["^", *("w" if t[0].isalpha() else t if not t[0].isdigit() else "0" if t.isdigit() else "0.0" for t in seen), "$"]
    pairs = {f"{a} {b}" for a, b in zip(kind, kind[1:]) if not (a in "w^" and b in "w$")}
    n = sum(t[0].isalpha() or t[0].isdigit() for t in seen)
    tags = {"<line>"} | {f"<under {k}>" for k in (3, 5, 9, 15) if n < k}
    holds = ((" | " in core or "](" in core, "<bar>"), (" > " in core, "<crumb>"), (SPEAKER.match(core), "<speaker>"), (core[-1:] == "…" or core[-3:] == "...", "<broken>"), (core.isupper(), "<caps>"), ("©" in core, "<copyright>"),
             (CLOCK.search(core), "<clock>"), (HOST.search(core.lower()), "<host>"), (core[-1:] not in ".", "<no stop>"), (core[-1:] == "?", "<asks>"), (line[:1] in "[»›+" or line[-1:] in "]»!›+", "<deco>"))
    return words, pairs, tags | {tag for so, tag in holds if so}


def fit(rows: list[tuple[tuple[set[str], set[str], set[str]], float]], signed: bool, rounds: int = 400) -> dict[str, float]:
    """Weights by token, by logistic regression; both classes weigh the same. ``signed``: words and pairs score 0 or more, tags 0 or less."""
    seen = Counter(w for (ws, _, _), _ in rows for w in ws)
    known = [({w if seen[w] >= RARE else OTHER_WORD for w in ws}, [*ps, *ts]) for (ws, ps, ts), _ in rows]
    names = sorted({t for ws, rest in known for t in (*ws, *rest)} | {BLURB})
    at = {t: i for i, t in enumerate(names)}
    r = np.concatenate([np.full(len(ws) + len(rest), i) for i, (ws, rest) in enumerate(known)])
    c = np.concatenate([[at[t] for t in (*sorted(ws), *sorted(rest))] for ws, rest in known]).astype(int)
    x = np.concatenate([[WORDS / max(len(ws), WORDS)] * len(ws) + [1.0] * len(rest) for ws, rest in known])
    y = np.array([v for _, v in rows])
    tag = np.array([t[0] == "<" and len(t) > 1 for t in names])
    w, grad2 = np.zeros(len(names)), np.full(len(names), 1e-2)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(rounds):
        z = np.bincount(r, weights=w[c] * x, minlength=len(rows))
        e = (1 / (1 + np.exp(-z.clip(-30, 30))) - y) * weight
        g = np.bincount(c, weights=e[r] * x, minlength=len(names)) + 0.02 * w
        grad2 += g * g
        w -= 0.5 * g / np.sqrt(grad2)
        if signed:
            w = np.where(tag, np.minimum(w, 0.0), np.maximum(w, 0.0))
    return dict(zip(names, w.tolist(), strict=True))


def generated(sample: list[tuple[str, str]], pages: list[str] = PAGES, count: int = TRAINING_PAGES, seed: int = 5) -> Iterator[list[tuple[str, str, str]]]:
    """Labelled pages with titles and texts put in: per page its lines as (mark, what stands for, text)."""
    rng = np.random.default_rng(seed)
    fill = [*FILLERS, *sample]
    order = rng.permutation(len(fill))
    for k in range(count):
        title, text = fill[order[k % len(fill)]]
        # the first pages stand whole; later ones leave out lines, so that what stands beside what varies
        part = re.split(r"(?<=\.) ", text)
        out = []
        for marked in pages[k % len(pages)].strip().split("\n"):
            mark, said = marked[0], marked[2:]
            if k >= 2 * len(pages) and rng.random() < (0.35 if "@" in said else 0.6):
                continue
            cut = text[: max(20, int(len(text) * rng.uniform(0.3, 0.9)))].rstrip(" .") + ("…" if rng.random() < 0.5 else "...")
            other, blurb = fill[rng.integers(len(fill))]
            what = said.lstrip("#=›- ")
            for _ in range(2 if what == "@other" else 1):
                out.append((mark, what, said.replace("@text", " ".join(part[: rng.integers(1, len(part) + 1)])).replace("@title", title).replace("@cut", cut).replace("@other", other).replace("@blurb", blurb)))
                other = fill[rng.integers(len(fill))][0]
        yield out


def train(sample: list[tuple[str, str]], pages: list[str] = PAGES) -> tuple[dict[str, float], ...]:
    """Weights for main body, for being some page's title, and for closing an article, from the labelled pages with ``sample`` put in."""
    body, heads, closing = [], [], []
    for page in generated(sample, pages):
        for i, (mark, what, line) in enumerate(page):
            words, pairs, tags = features(line)
            heads.append(((words, pairs, tags), float(what in ("@title", "@other"))))
            if mark != "+":
                closing.append(((words, pairs, tags), float(mark == "=")))
            after = page[i + 1][0] if i + 1 < len(page) else "-"
            if what in ("@text", "@blurb") and i and page[i - 1][1] == "@other" and after == "-":
                tags = tags | {BLURB}
            body.append(((words, pairs | {OWN} if what == "@title" else pairs, tags), float(mark == "+")))
    return fit(body, signed=True), fit(heads, signed=False), fit(closing, signed=False)


def score(tokens: tuple[set[str], set[str], set[str]], weights: dict[str, float]) -> float:
    """The sum of a line's words and tags."""
    words, pairs, tags = tokens
    other = weights.get(OTHER_WORD, 0.0)
    said = sum(weights.get(w, other) for w in words) * WORDS / max(len(words), WORDS)
    return said + sum(weights.get(t, 0.0) for t in (*pairs, *tags))


def regions(scores: list[float], drop: float = DROP) -> list[tuple[int, int, float]]:
    """The maximum-scoring subsequences as (first, past the last, score), found from the left.

    Each begins at a positive score, all its beginnings and ends sum to more than 0, and within it no sum falls more than ``drop`` below an
    earlier one. With ``drop`` infinite these are those that end where their sum is greatest.
    """
    out: list[tuple[int, int, float]] = []
    i = 0
    while i < len(scores):
        if scores[i] <= 0:
            i += 1
            continue
        first, total, best, end = i, 0.0, 0.0, i
        while i < len(scores):
            total += scores[i]
            i += 1
            if total > best:
                best, end = total, i
            elif total <= 0 or best - total > drop:
                break
        out.append((first, end, best))
        i = end
    return out


def line_scores(lines: list[str], title: str, opening: str, weights: tuple[dict[str, float], ...], known: dict) -> tuple[list[float], list[int]]:
    """(score of every line, numbers of the lines that say something)."""
    own = {key(title), key(opening)} - {""}
    shortest, longest = min(map(len, own), default=0), max(2 * len(title) + 8, 2 * len(opening) + 8) if own else -1
    scores: list[float] = []
    kinds: list[tuple[bool, bool]] = []
    said: list[int] = []
    for i, line in enumerate(lines):
        line = line.strip()
        got = known.get(line)
        if got is None:
            f = features(line)
            s = score(f, weights[0])
            # whose title a line is, or whether it closes an article, is asked of lines outside only
            got = (s, s <= 0 and score(f, weights[1]) > 0, s <= 0 and score(f, weights[2]) > 0, _SAYS.search(line) is not None)
            if len(known) >= KEPT:
                known.clear()
            known[line] = got
        s, head, closing, says = got
        if says:
            said.append(i)
            if shortest <= len(line) <= longest and key(line) in own:
                s, head = s + weights[0].get(OWN, 0.0), False
        scores.append(s if says else 0.0)
        kinds.append((head and s <= 0, closing and s <= 0))
    # a paragraph alone below another page's headline is its blurb, unless what comes next closes the article
    blurb = weights[0].get(BLURB, 0.0)
    alone = [i for p, i, n in zip(said, said[1:], [*said[2:], None]) if scores[i] > 0 and kinds[p][0] and (n is None or scores[n] <= 0 and not kinds[n][1])]
    for i in alone:
        scores[i] += blurb
    return scores, said


def outside(text: str, title: str, opening: str, weights: tuple[dict[str, float], ...], known: dict) -> list[int]:
    """The numbers of the lines outside the main body; ``opening`` is the page's snippet, if it has one."""
    scores, said = line_scores(text.split("\n"), title, opening, weights, known)
    kept = {i for a, b, t in regions(scores) if t >= MIN_SCORE for i in range(a, b)}
    return [i for i in said if i not in kept]


def _sample(pages: DataFrame, row_id: str) -> list[tuple[str, str]]:
    """At most ``SAMPLE_PAGES`` titles and openings: of each part of the hash range the page with the least hash."""
    rows = pages.where("content != '' AND title != ''").select(F.substring("title", 1, SAMPLE_CHARS).alias("title"), F.substring("content", 1, SAMPLE_CHARS).alias("content"), F.xxhash64(row_id).alias("h"))
    least = rows.groupBy(F.pmod("h", F.lit(SAMPLE_PAGES)).alias("part")).agg(F.min_by(F.struct("title", "content"), "h").alias("r"))  # SAMPLE_PAGES rows
    return sorted({(r.title, r.content) for r in least.select("r.*").collect()})


def outside_lines(pages: DataFrame, row_id: str = "result_row_id", title: str = "title", text: str = "raw_content", opening: str = "content") -> DataFrame:
    """``row_id, lines``: per page the numbers of the lines outside the main body."""
    weights = train(_sample(pages, row_id))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            ids, titles, texts, openings = (b.column(i) for i in range(4))
            out = [outside(t.as_py(), h.as_py() or "", o.as_py() or "", weights, known) for h, t, o in zip(titles, texts, openings, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.int32()))], ["row_id", "lines"])

    return pages.where(F.col(text) != "").select(F.col(row_id).cast("bigint").alias("row_id"), title, text, opening).mapInArrow(step, "row_id bigint, lines array<int>")


def found(pages: DataFrame) -> DataFrame:
    return outside_lines(pages).select(F.col("row_id").alias("result_row_id"), F.explode("lines").alias("line_no"))


def main_body(pages: DataFrame, row_id: str = "result_row_id", text: str = "raw_content") -> DataFrame:
    """``row_id, main_text, lines_removed`` of every page; null texts stay null."""
    out = outside_lines(pages, row_id=row_id, text=text).select(F.col("row_id").alias("_id"), F.col("lines").alias("_gone"))
    p = pages.select(F.col(row_id).alias("_row"), F.col(text).alias("_text"))
    kept = F.filter(F.split(F.regexp_replace("_text", "\r", ""), "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False)) & x.rlike(r"[\p{L}\p{N}]"))
    return p.join(out, F.col("_row") == F.col("_id"), "left").select(F.col("_row").alias(row_id), F.array_join(kept, "\n").alias("main_text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("lines_removed"))
