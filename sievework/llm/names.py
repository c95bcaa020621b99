"""Variant spellings of names, linked to the entity they mean.

A name is folded to words: encodings repaired, scripts and accents folded, digits for letters undone, joined words split. Which words describe and which
tell apart is read from the names themselves: a word that stands beside many different rarer words (``WIDE`` of its names) is a common one. The other words
are a name's core. Distinct cores are signed by MinHash over padded q-grams and banded, the number of bands from the collision curve;
candidates are verified by Monge-Elkan similarity with an inner edit similarity, in which given names count less and match by their short forms
(``nicknames``); stars are grown around the cores that stand for most records. The stars of a row's name and its aliases are then one, as far as
these names are firm; a row whose own name is an initial or damaged goes to the star of its firm aliases.

Defined cases: a null or empty name, and one without a letter, links to nothing; a name of common words only keeps them all; repeated rows are
one record; null or empty aliases add nothing; ties between centres go to the more similar, then the more frequent, then the smaller core;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import nicknames
from sievework.llm.encoding import HYPOTHESES, LOST, RUN, restored, swapped
from sievework.llm.neardup import checked_pairs
from sievework.operators.graph import components
from sievework.session import let_go, tidy, written

#: A word of n names is a common one if it stands beside at least ``WIDE * n`` different rarer words and as many more as chance may add, the root of n.
WIDE = 0.6
#: Words of up to ``SHORT`` letters may be pieces of a word typed apart: they are common only if at least this share of all names has them, else they count in the joined name alone.
SHORT, OFTEN = 3, 0.01
#: The share of a word of the core that a given name counts.
GIVEN_WEIGHT = 0.6
#: Joined names of up to this many words are compared in every turn of their words.
TURNED = 8
# Cyrillic letters and the Latin ones they stand for.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєў", "a b v g d e e zh z i j k l m n o p r s t u f h c ch sh shch - y - e yu ya i i e u".split(), strict=True))
PLAIN = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "ı": "i", "œ": "oe", "æ": "ae", "đ": "d", "ð": "d", "þ": "th", "€": "e", "£": "l", "™": "", "γ": "g"} | {k: v.strip("-") for k, v in CYRILLIC.items()})
DIGITS = str.maketrans("0134579", "oieastg")
#: Where joined words meet: a small letter, then a capital and a small one.
SEAM = regex.compile(r"(?<=\p{Ll}\d?)(?=\p{Lu}\p{Ll})")
#: The ending of a host name, right behind a word.
HOST_END = re.compile(r"(?<=\w)((?:\.[a-z]{2,3})?\.[a-z]{2,})\b", re.I)
UTF8 = [h for h in HYPOTHESES if h.startswith("utf-8>")]
#: Pairs of letters typed for each other because they sound alike.
SOUNDS = (("ph", "f"), ("ch", "c"), ("sh", "x"), ("th", "t"))
ALIKE = str.maketrans("kqzywb", "ccsivv")


def sounded(word: str) -> str:
    """The word with letters that sound alike written alike, doubled ones once."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", word.translate(ALIKE))


def folded(name: str | None) -> list[str]:
    """The words of a name in order, folded; years and numbers are none."""
    if not name:
        return []
    name = html.unescape(name)
    if RUN.search(name):
        bits = re.split(r"([^\x00-\x7f]+)", name)
        if got := restored(bits[1::2], UTF8, name in (name.lower(), name.upper())):
            for i, text in enumerate(got[0]):
                bits[2 * i + 1] = text or bits[2 * i + 1]
            name = "".join(bits)
        elif not re.search("[A-Za-z]{4}", name) and (whole := swapped(name, HYPOTHESES)):
            name = whole[0]
    name = SEAM.sub(" ", HOST_END.sub(r" \1", name))
    text = "".join(c for c in unicodedata.normalize("NFKD", name.lower().translate(PLAIN)) if not unicodedata.combining(c)).lower().translate(PLAIN)
    words: list[str] = []
    for w in re.findall(rf"[\w{LOST}]+", text):
        if w.isdigit():
            continue
        if any(c.isdigit() for c in w):
            w = re.sub(r"\d{4}$", "", w).translate(DIGITS)
        w = re.sub(rf"[\d_{LOST}]", "", w)
        if w:
            words.append(sounded(w))
    return words


def name_words(names: F.Column) -> F.Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(folded)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<string>")(names)


def common_words(names: DataFrame) -> DataFrame:
    """``w, sure`` of the words of ``names`` (id, all) that describe rather than tell apart; short ones are ``sure`` if they are frequent.

    Each name says of each of its words which are the two rarest others. A word that tells a brand meets that brand's few others, however often the
    brand is named; a descriptive word or a given name meets those of ever new brands. Both counts are taken over distinct names.
    """
    w = names.select("id", F.explode(F.array_distinct("all")).alias("w"))
    df = w.groupBy("w").agg(F.count("*").alias("df"))
    placed = w.join(df, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("by_df"))
    three = placed.select("by_df", F.slice("by_df", 1, 3).alias("rare"))
    met = three.select(F.explode("by_df").alias("x"), "rare").select(F.col("x.w").alias("w"), F.col("x.df").alias("df"),
                                                                    F.explode(F.filter("rare", lambda r: r["df"] < F.col("x.df"))).alias("r"))
    wide = met.groupBy("w", "df").agg(F.count_distinct("r.w").alias("beside"))
    wide = wide.where(F.col("beside") >= WIDE * F.col("df") + F.sqrt("df")).crossJoin(F.broadcast(names.agg(F.count("*").alias("names"))))  # one row
    return wide.select("w", ((F.length("w") > SHORT) | (F.col("df") >= OFTEN * F.col("names"))).alias("sure"))


def _without_ending(joined: DataFrame, common: DataFrame) -> DataFrame:
    """``w, head``: joined words that end in a common word, without the longest such ending; at least eight letters stay."""
    at = joined.where(F.length("w") > 9).select("w", F.explode(F.sequence(F.lit(8), F.length("w") - 2)).alias("k"))
    ends = at.select("w", F.substring("w", F.lit(1), F.col("k")).alias("head"), F.expr("substring(w, k + 1)").alias("end"))
    return ends.join(common.where("sure").select(F.col("w").alias("end")), "end").groupBy("w").agg(F.min_by("head", F.length("head")).alias("head"))


def cores(names: DataFrame) -> DataFrame:
    """``id, words, parts, given`` of ``names`` (id, all): the words that tell a name from others, two in alphabetical order; these and the short words
    that may be pieces of some, as written; the full forms of given names.
    """
    common = written(common_words(names), "common")
    forms = {sounded(f): sounded(g[0]) for g in reversed(nicknames.groups()) for f in g}
    full = F.create_map(*[F.lit(x) for kv in sorted(forms.items()) for x in kv])
    w = names.select("id", F.posexplode("all").alias("at", "w"))
    # a joined name may end in a common word: its ending is looked up among them
    joined = w.where(F.length("w") > 9).select("w").distinct()
    cut = _without_ending(joined, common)
    again = _without_ending(cut.select(F.col("head").alias("w")).where(F.length("w") > 9).distinct(), common).select(F.col("w").alias("head"), F.col("head").alias("rest"))
    step = cut.join(again, "head", "left").select("w", F.coalesce("rest", "head").alias("head"))
    marked = w.join(common.withColumn("common", F.lit(True)), "w", "left").join(step, "w", "left")
    kind = F.struct("at", F.coalesce("head", "w").alias("w"), F.coalesce("common", F.lit(False)).alias("common"), F.coalesce("sure", F.lit(False)).alias("sure"))
    p = marked.groupBy("id").agg(F.sort_array(F.collect_list(kind)).alias("p"))
    name = lambda x: F.element_at(full, x["w"])
    p = p.select("id", "p", F.filter("p", lambda x: (F.length(x["w"]) > 1) & ~x["common"] & name(x).isNull()).alias("long"),
                 F.array_sort(F.array_distinct(F.transform(F.filter("p", lambda x: name(x).isNotNull()), name))).alias("given"))
    # beside one word, the initial next to it; where nothing tells apart, everything
    first = F.get("long", F.lit(0))
    near = F.sort_array(F.transform(F.filter("p", lambda x: F.length(x["w"]) == 1), lambda x: F.struct(F.abs(x["at"] - first["at"]).alias("d"), x["at"].alias("at"), x["w"].alias("w"), x["common"].alias("common"), x["sure"].alias("sure"))))
    one = F.concat("long", F.transform(F.slice(near, 1, 1), lambda x: F.struct(x["at"], x["w"], x["common"], x["sure"])))
    every = F.filter("p", lambda x: F.length(x["w"]) > 1)
    kept = F.when(F.size("long") > 1, F.col("long")).when(F.size("long") == 1, one).otherwise(every)
    words = F.array_distinct(F.transform(kept, lambda x: x["w"]))
    parts = F.when(F.size("long") > 0, F.transform(F.filter("p", lambda x: ~x["sure"] & name(x).isNull()), lambda x: x["w"])).otherwise(words)
    given = F.when(F.size("long") > 0, F.col("given")).otherwise(F.array().cast("array<string>"))
    return p.select("id", F.when(F.size(words) == 2, F.array_sort(words)).otherwise(words).alias("words"), F.array_distinct(parts).alias("parts"), given.alias("given")).where(F.size("words") > 0)


def grams(words: str, q: int = 3) -> F.Column:
    """Hashes of the q-grams of each word, padded by one sign at both ends."""
    padded = F.transform(words, lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    each = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (q - 1), F.lit(1))), lambda i: F.xxhash64(F.substring(w, i, q))))
    return F.array_distinct(F.flatten(each))


def edit(a: F.Column, b: F.Column) -> F.Column:
    """1 less the edits over the longer length, letters that changed places being one edit less; an initial is near to any word it begins."""
    initial = (F.least(F.length(a), F.length(b)) == 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    letters = lambda w: F.array_sort(F.split(w, ""))
    swap = F.when((a != b) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)), 1).otherwise(0)
    return F.when(initial, F.lit(0.8)).otherwise(1 - (F.levenshtein(a, b) - swap) / F.greatest(F.length(a), F.length(b)))


def monge_elkan(x: str, y: str) -> tuple[F.Column, F.Column]:
    """(mean, least) over the words of ``x`` of the best edit similarity to a word of ``y``."""
    best = F.transform(x, lambda a: F.array_max(F.transform(y, lambda b: edit(a, b))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(x), F.array_min(best)


def _alike(a: F.Column, b: F.Column) -> F.Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def compared(pairs: DataFrame) -> DataFrame:
    """``pairs`` (x, y word lists; px, py with pieces; gx, gy given names) with ``by_word`` and ``least``, the similarity of all words and of the worst, ``as_one``, that of the joined words, and ``sim``, the greater one.

    Given names count where both sides have some: each as ``GIVEN_WEIGHT`` of a word.
    """
    (ma, la), (mb, lb) = monge_elkan("x", "y"), monge_elkan("y", "x")
    many = (F.size("x") > 1) & (F.size("y") > 1)
    # the joined names: one list's words as written, the other's from each word on; names of many words as written alone
    starts = lambda q: F.when(F.size(q) <= TURNED, F.sequence(F.lit(0), F.size(q) - 1)).otherwise(F.array(F.lit(0)))
    turned = lambda p, q: F.array_max(F.transform(starts(q), lambda i: _alike(F.array_join(p, ""), F.array_join(F.concat(F.slice(q, i + 1, F.size(q)), F.slice(q, F.lit(1), i)), ""))))
    long = [F.length(F.array_join(c, "")) for c in ("px", "py")]
    string = F.when(F.least(*long) < 0.7 * F.greatest(*long), 0.0).when(F.size("px") > F.size("py"), turned("px", "py")).otherwise(turned("py", "px"))
    pairs = pairs.withColumn("by_word", F.when(many, F.least(ma, mb)).otherwise(0.0)).withColumn("least", F.when(many, F.least(la, lb)).otherwise(0.0)).withColumn("as_one", string)
    both = (F.size("gx") > 0) & (F.size("gy") > 0)
    given = F.array_max(F.transform("gx", lambda a: F.array_max(F.transform("gy", lambda b: edit(a, b)))))
    n = F.least(F.size("x"), F.size("y"), F.lit(2))
    weighed = lambda c: F.when(both, (F.col(c) * n + GIVEN_WEIGHT * given) / (n + GIVEN_WEIGHT)).otherwise(F.col(c))
    pairs = pairs.withColumn("by_word", weighed("by_word")).withColumn("as_one", weighed("as_one"))
    return pairs.withColumn("sim", F.greatest("by_word", "as_one"))


def edges(nodes: DataFrame, similarity: float = 0.4, recall: float = 0.99, rows: int = 3, mean: float = 0.77, least: float = 0.55, joined: float = 0.79) -> DataFrame:
    """``a, b, sim`` (a < b), a written table, of similar cores; nodes have ``id, words, parts, given, grams``: similar word by word, each word at least ``least``, or as one string.

    Candidates whose q-grams overlap by less than half the planned similarity met by chance and aren't compared.
    """
    # a name travels as one string, and its q-grams are made again where it has come to its pair
    text = nodes.select("id", F.concat_ws("|", *[F.array_join(c, " ") for c in ("words", "parts", "given")]).alias("t"))
    part = lambda t, i: F.filter(F.split(F.split_part(t, F.lit("|"), F.lit(i)), " "), lambda w: w != "")
    sides = [part(F.col(t), i + 1).alias(c + k) for t, k in (("ta", "x"), ("tb", "y")) for i, c in enumerate(("", "p", "g"))]

    def check(found: DataFrame) -> DataFrame:
        pairs = found.join(text.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(text.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
        pairs = pairs.select("a", "b", *sides).withColumns({"qx": grams("x"), "qy": grams("y")})
        common = F.size(F.array_intersect("qx", "qy"))
        near = written(pairs.where(common >= similarity / 2 * (F.size("qx") + F.size("qy") - common)).drop("qx", "qy"), "near")
        kept = compared(near).where(((F.col("by_word") >= mean) & (F.col("least") >= least)) | (F.col("as_one") >= joined))
        kept = written(kept.select("a", "b", "sim"), "links")
        let_go(near)
        return kept

    return checked_pairs(nodes.select("id", "grams"), similarity, recall, rows, similarity / 2, check)


def stars(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, centre``: star clustering. Nodes have ``id, weight``, links ``a, b, sim`` both ways.

    A node is a centre once no free neighbour weighs more; its free neighbours are its satellites. At the end a satellite goes to
    the most similar of the centres it touches. The heaviest free node is a centre in each round, so the rounds end with every node placed.
    """
    deg = links.groupBy("a").agg(F.count("*").alias("deg"))
    rank = written(nodes.join(deg, nodes.id == deg.a, "left").select("id", F.struct("weight", F.coalesce("deg", F.lit(0)).alias("deg"), (-F.col("id")).alias("low")).alias("p")), "rank")
    # nodes without a link are centres at once; the rounds see the others only
    free, open_links = rank.where("p.deg > 0"), links
    centres, placed, at_work = rank.where("p.deg = 0").select("id"), [], False
    while not free.isEmpty():
        e = open_links.select("a", "b").join(free.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(free.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        e = written(e, "open")
        beaten = e.where("pb > pa").select(F.col("a").alias("id")).distinct()
        new = written(free.join(beaten, "id", "left_anti").select("id"), "centres")
        centres = centres.unionByName(new)
        taken = e.join(new.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id")).union(new).distinct()
        over = [free, open_links] if at_work else []
        free, open_links, at_work = written(free.join(taken, "id", "left_anti"), "free"), e, True
        let_go(*over)
        placed.append(new)
    centres = written(centres, "centres")
    let_go(*placed, *([free, open_links] if at_work else []))
    touch = links.join(centres.join(rank, "id").select(F.col("id").alias("b"), "p"), "b").join(centres.select(F.col("id").alias("a")), "a", "left_anti")
    best = touch.groupBy("a").agg(F.max_by("b", F.struct("sim", "p")).alias("centre"))
    star = written(centres.select("id", F.col("id").alias("centre")).unionByName(best.select(F.col("a").alias("id"), "centre")), "stars")
    let_go(centres, rank)
    return star


def clusters(brands: DataFrame, candidates: DataFrame) -> DataFrame:
    """``key, cluster``: records (brand rows and candidates that aren't generic) by the entity they name."""
    b = brands.select(F.col("brand_id").alias("key"), F.col("canonical_brand").alias("name"), F.lit(True).alias("own")).distinct()
    alias = brands.select(F.col("brand_id").alias("key"), F.explode("aliases").alias("name"), F.lit(False).alias("own")).distinct()
    c = candidates.where("coalesce(final_classification, '') != 'EXCLUDED_GENERIC_TERM'").select(F.col("candidate_id").alias("key"), F.col("original_name").alias("name"), F.lit(True).alias("own")).distinct()
    said = b.unionByName(alias).unionByName(c).where("key IS NOT NULL AND name IS NOT NULL")
    said = written(said.select("key", "own", name_words(F.col("name")).alias("all")).where(F.size("all") > 0).withColumn("form", F.xxhash64("all")), "names")
    core = cores(said.groupBy(F.col("form").alias("id")).agg(F.first("all").alias("all"))).select(F.col("id").alias("form"), "words", "parts", "given", F.xxhash64("words", "parts", "given").alias("id"))
    spoken, said = said, written(said.select("key", "own", "form").join(core, "form").drop("form"), "cores")
    let_go(spoken)
    nodes = written(said.groupBy("id").agg(F.first("words").alias("words"), F.first("parts").alias("parts"), F.first("given").alias("given"), F.count_distinct("key").alias("weight")).withColumn("grams", grams("words")), "nodes")
    one_way = edges(nodes)
    links = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    star = stars(nodes.select("id", "weight"), links)
    let_go(one_way)
    # how firmly a name stands for its star: an initial or a damaged name may be any brand's
    middle = nodes.select(F.col("id").alias("centre"), F.col("words").alias("y"), F.col("parts").alias("py"), F.col("given").alias("gy"))
    near = said.join(star, "id").join(middle, "centre").withColumnsRenamed({"words": "x", "parts": "px", "given": "gx"})
    near = written(compared(near).select("key", "own", "centre", ((F.col("sim") >= 0.84) & (F.array_min(F.transform("x", F.length)) > 1)).alias("firm")), "near")
    let_go(said, nodes, star)
    # a row's aliases are its brand's: the stars of its firm names are one
    firm = near.where("firm")
    said_by = firm.groupBy("key").agg(F.min("centre").alias("low"), F.bool_or(~F.col("own")).alias("by_alias")).where("by_alias").select("key", "low")
    whole = components(firm.join(said_by, "key").where("centre != low").select(F.col("centre").alias("a"), F.col("low").alias("b")).distinct())
    own = near.where("own").join(said_by, "key", "left").select("key", F.when(F.col("firm"), F.col("centre")).otherwise(F.coalesce("low", "centre")).alias("centre"))
    return own.join(whole, F.col("centre") == F.col("id"), "left").select("key", F.coalesce("component", "centre").alias("cluster")).distinct()


def found(brands: DataFrame, candidates: DataFrame) -> DataFrame:
    with tidy(brands.sparkSession):
        c = written(clusters(brands, candidates).groupBy("key").agg(F.collect_set("cluster").alias("all")), "clusters")
    c = c.select("key", "all", F.explode("all").alias("cluster"))
    # a pair in several clusters is one in the least of them, so pairs need no shuffle
    once = "(size(x.all) = 1 OR size(y.all) = 1 OR array_min(array_intersect(x.all, y.all)) = x.cluster)"
    return c.alias("x").join(c.alias("y"), F.expr(f"x.cluster = y.cluster AND x.key < y.key AND {once}")).select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
