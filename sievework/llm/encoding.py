"""Names read in a wrong encoding: transformations learned from near-twins, then applied to all.

A garbled name and its clean twin agree once characters outside ASCII are taken out. Names are joined on that text (and
a record's two names with each other), the runs between the shared ASCII characters are aligned, and each aligned pair is
explained by a transformation: bytes written in one encoding and read in another, characters dropped for U+FFFD. What
twins confirm is learned, with its support; the learned transformations alone decide for all names. Pairs of encodings are tried as explanations; a run
that none explains is learned as it is aligned, from two twins or more.

Defined cases: null and empty names are never affected; names in ASCII neither; repeated rows give one result; a
name garbled more than once is undone step by step (at most ``DEPTH`` times); a name of which a part can't be
recovered is reported and keeps that part; in an empty table or one without twins nothing is learned and nothing reported, but
for U+FFFD, which itself says that a character was lost; further columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import written

#: Readers tried for UTF-8 bytes, and (written, read) pairs of one-byte encodings.
READERS = ("cp1252", "latin1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "cp1253", "cp1254", "cp1257", "cp852", "iso8859_15", "mac_latin2")
# written, read
SWAPS = (("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1251", "latin1"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_roman"), ("cp1253", "cp1252"), ("cp1255", "cp1252"), ("cp1256", "cp1252"), ("iso8859_7", "latin1"))
DEPTH = 4
LOST = "�"
#: Signs that close a good word.
SIGNS = "®™©’”"
RUN = re.compile(r"[^\x00-\x7f]+")


def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes the encoding leaves open read as the control of that number, as browsers do."""
    out: dict[str, int] = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    return out


_TABLES: dict[str, dict[str, int]] = {}


def _bytes(text: str, codec: str) -> bytes | None:
    t = _TABLES.setdefault(codec, _table(codec)) if codec not in _TABLES else _TABLES[codec]
    try:
        return bytes(t[ch] for ch in text)
    except KeyError:
        return None


@cache
def script(ch: str) -> str:
    """The script of a letter by its name, "" for other characters; the scripts that Japanese mixes are one."""
    if not ch.isalpha():
        return ""
    first = unicodedata.name(ch, "?").split()[0].split("-")[0]
    return "JAPANESE" if first in ("CJK", "HIRAGANA", "KATAKANA") else "OTHER" if first in ("FEMININE", "MASCULINE", "MICRO", "MODIFIER") else first


def sane(text: str) -> bool:
    """Assigned characters of any script, none of control or private use, and no mark without a letter before it."""
    return all(unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in text) and not any(unicodedata.category(c) == "Mn" and not (k and (text[k - 1].isalpha() or unicodedata.category(text[k - 1]) == "Mn")) for k, c in enumerate(text))


def near(text: str) -> bool:
    """Letters of Latin, Greek or Cyrillic as names have them, and ordinary signs only: a single one says enough."""
    return all(ord(c) < 0x250 or 0x370 <= ord(c) < 0x460 or ord(c) in (0x490, 0x491) or 0x1E00 <= ord(c) < 0x2000 or 0x2010 <= ord(c) <= 0x2122 for c in text) and sane(text)


def told(text: str) -> bool:
    """Two letters or more of one other script, from its main block: bytes seldom make these by chance."""
    found = [c for c in text if script(c) not in ("", "LATIN", "GREEK", "CYRILLIC", "OTHER")]
    rest = "".join(c for c in text if c not in found)
    return len(found) > 1 and len({script(c) for c in found}) == 1 and all(not 0x3400 <= ord(c) < 0x4E00 and not 0xA000 <= ord(c) < 0xAC00 and ord(c) < 0xF900 for c in found) and near(rest) and sane(text)


def undo(run: str, chain: str) -> str | None:
    """The run before this one transformation (``written>read``), or null where it doesn't fit."""
    writer, reader = chain.split(">")
    raw = _bytes(run, reader)
    if raw is None:
        return None
    try:
        out = raw.decode(writer)
    except UnicodeDecodeError:
        return None
    return out if out != run else None


#: Runs of up to so many cased characters are tried in every case; longer ones are read character by character.
CASED = 6


def cased(run: str, chain: str) -> Iterator[str]:
    """The run, then the run with other cases, for names put in one case after they were garbled."""
    yield run
    letters = [(c, c.swapcase()) if len(c.swapcase()) == 1 and c.swapcase() != c else (c,) for c in run]
    if sum(len(x) > 1 for x in letters) <= CASED:
        yield from (v for x in itertools.product(*letters) if (v := "".join(x)) != run)
    elif (v := recased(letters, chain)) is not None and v != run:
        yield v


def recased(letters: list[tuple[str, ...]], chain: str) -> str | None:
    """The cases in which the characters are the bytes of UTF-8 text, or null: each character of the text is the first that its lead byte and what follows allow, letters before signs.

    A lead byte says how many bytes follow, so this reads on without looking back: a run costs its length, whatever that is.
    """
    writer, reader = chain.split(">")
    if writer != "utf-8":
        return None
    table = _TABLES.setdefault(reader, _table(reader))
    out, i = "", 0
    while i < len(letters):
        best = None
        for lead in letters[i]:
            b = table.get(lead, 0)
            n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            for rest in itertools.product(*letters[i + 1 : i + n]) if n and i + n <= len(letters) else ():
                raw = bytes([b, *(table.get(c, 0) for c in rest)])
                try:
                    ch = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                rank = (near(ch), ch.isalpha(), lead == letters[i][0])
                if best is None or rank > best[0]:
                    best = rank, lead + "".join(rest)
        if best is None:
            return None
        out, i = out + best[1], i + len(best[1])
    return out


def undone(run: str, chain: str, any_case: bool) -> str | None:
    """The run of non-ASCII characters as it was before this UTF-8 transformation, undone as often as it fits."""
    for v in cased(run, chain) if any_case else (run,):
        text, best = v, None
        for _ in range(DEPTH):
            text = undo(text, chain) if RUN.search(text) else None
            if text is None:
                break
            # a good letter before a sign may seem to undo once more
            best = text if near(text) or v == run and told(text) else best
        if best is not None:
            return best.lower() if v != run and run == run.lower() else best
    return None


def restored(runs: list[str], chains: list[str], any_case: bool) -> tuple[list[str | None], str] | None:
    """The runs as they were (null where no transformation fits), by the transformation that fits most of them."""
    tried = [(c, [undone(r, c, any_case) for r in runs]) for c in chains if c.startswith("utf-8>")]
    tried = [(c, x) for c, x in tried if any(x)]
    if not tried:
        return None
    chain, best = max(tried, key=lambda t: sum(v is not None for v in t[1]))  # the first, so the best confirmed, of equals
    for _, x in tried:
        best = [p if p is not None else q for p, q in zip(best, x, strict=True)]
    return best, chain


# Vowels of the alphabets that one-byte encodings hold beside the Latin one.
VOWELS = {"CYRILLIC": set("аеёиоуыэюяіїєў"), "GREEK": set("αεηιουωάέήίόύώϊϋ"), "HEBREW": set("אהוי"), "ARABIC": set("اويىآأإئؤ")}


def plausible(words: list[str], at: str) -> float | None:
    """How far the share of vowels is from what words have, or null where the letters aren't all of the script ``at`` in a usual case."""
    if not all(w and any(c.isalpha() for c in w) and all(script(c) == at if c.isalpha() else c in SIGNS or unicodedata.category(c)[0] in "PM" for c in w) and (at not in ("CYRILLIC", "GREEK") or w.islower() or w.isupper() or w.istitle()) and sane(w) for w in words):
        return None
    letters = [unicodedata.normalize("NFD", c)[0] for w in words for c in w.lower() if c.isalpha()]
    return abs(sum(c in VOWELS[at] for c in letters) / len(letters) - 0.42)


def swapped(name: str, chains: list[str]) -> tuple[str, str] | None:
    """(the name as it was, the transformation) where whole words change their script.

    Words are runs without ASCII; one of four letters or more must change, or a word of three that no ASCII letter touches. Of the transformations that fit, the one whose
    letters are most like words decides, the better confirmed of equals.
    """
    words = [w for w in re.split(r"[\x00-\x7f]+", name) if w]
    letters = [w for w in words if any(c.isalpha() for c in w)]
    alone = [w for w in name.split() if len(w) >= 3 and not re.search("[A-Za-z]", w) and any(c.isalpha() for c in w)]
    if max(map(len, letters), default=0) < 4 and not (alone and len(alone) == len(letters)):
        return None
    fits = []
    for k, chain in enumerate(chains):
        if chain.startswith("utf-8>"):
            continue
        back = [undo(w, chain) for w in letters]
        if not all(back):
            continue
        for at in VOWELS:
            far = plausible(back, at)
            if far is not None and not any(plausible([w], at) is not None for w in letters):
                fits.append((round(far, 1), k, chain, back))
    if not fits:
        return None
    _, _, chain, back = min(fits, key=lambda f: f[:2])
    out = name
    for w, b in zip(letters, back, strict=True):
        out = out.replace(w, b)
    return out, chain


SWAP_NAMES = [f"{a}>{b}" for a, b in SWAPS]
HYPOTHESES = [f"utf-8>{r}" for r in READERS] + SWAP_NAMES


#: What an aligned run that no pair of encodings explains is learned as, and the distinct names that must confirm it.
RUN_MARK, RUN_SUPPORT = "run>", 2


def explain(garbled: str, clean: str) -> list[str]:
    """The transformations that lead from clean to garbled, by alignment on the shared ASCII characters: pairs of encodings, or the aligned run itself, if it has grown and holds signs where letters were."""
    garbled, clean = html.unescape(garbled), html.unescape(clean)
    if garbled == clean or RUN.sub("", garbled) != RUN.sub("", clean):
        return []
    a, b = re.split(r"([\x00-\x7f])", garbled), re.split(r"([\x00-\x7f])", clean)
    out: set[str] = set()
    out |= {c for c in SWAP_NAMES if (whole := swapped(garbled, [c])) and whole[0] == clean}
    if len(a) == len(b):
        for g, c in zip(a[::2], b[::2], strict=True):
            if g != c and c and g:
                if set(g) == {LOST}:
                    out.add("lost")
                before = len(out)
                for chain in HYPOTHESES:
                    text = g
                    for _ in range(DEPTH):
                        if text is None or text == c:
                            break
                        text = undo(text, chain)
                    if text == c:
                        out.add(chain)
                if len(out) == before and LOST not in g + c and len(g) > len(c) and c.isalpha() and near(c) and not g.isalpha():
                    out.add(f"{RUN_MARK}{g}>{c}")
    return sorted(out)


def plain(name: str) -> str:
    return RUN.sub("", name)


def _map(f, out: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return lambda df: df.mapInPandas(run, out)


def learn(records: DataFrame, names: DataFrame) -> DataFrame:
    """``chain, support``: transformations that near-twins confirm, with the number of distinct garbled names."""
    ascii_left = F.regexp_replace("name", r"[^\x00-\x7F]+", "")
    keyed = names.select("name", F.trim(ascii_left).alias("k"), F.length(F.regexp_replace("name", r"[\x00-\x7F]+", "")).alias("odd"))
    keyed = keyed.where(F.col("k").rlike("[A-Za-z]"))
    # one clean member a key, so that pairs stay as many as names: the one with the fewest characters outside ASCII, but
    # those that keep one a run; ties by code point
    clean = keyed.where(~F.col("name").contains(LOST)).groupBy("k").agg(F.min(F.struct("odd", "name")).alias("m")).select("k", F.col("m.name").alias("clean"))
    twins = keyed.join(clean, "k").where("name != clean").select("name", "clean")
    own = records.where("original_name != corrected_name").select(F.explode(F.array(F.struct(F.col("original_name").alias("name"), F.col("corrected_name").alias("clean")), F.struct(F.col("corrected_name").alias("name"), F.col("original_name").alias("clean")))).alias("p")).select("p.name", "p.clean")
    pairs = twins.unionByName(own).distinct()
    found = _map(lambda b: pd.DataFrame([(n, c) for n, k in zip(b.name, b.clean, strict=True) for c in explain(n, k)], columns=["name", "chain"]), "name string, chain string")(pairs)
    # a name of another script leaves no ASCII to join on: its words, once undone, are met as words of clean names
    undone_words = _map(lambda b: pd.DataFrame([(n, c, w) for n in b.name for c in SWAP_NAMES if (x := swapped(n, [c])) for w in x[0].split()], columns=["name", "chain", "w"]), "name string, chain string, w string")(names)
    words = names.select(F.explode(F.split("name", r"\s+")).alias("w")).where(r"w RLIKE '^[\\x{400}-\\x{45F}]{2,}$'").distinct()
    more = undone_words.join(words, "w", "left_semi").select("name", "chain")
    return found.unionByName(more).groupBy("chain").agg(F.count_distinct("name").alias("support"))


def by_runs(names: DataFrame, learned: DataFrame) -> DataFrame:
    """``name, repaired, chain, open_word`` of names that hold runs learned as such, each from two names or more and always for the same letters."""
    both = F.split(F.substring("chain", len(RUN_MARK) + 1, 1_000), ">")
    runs = learned.where(F.col("chain").startswith(RUN_MARK) & (F.col("support") >= RUN_SUPPORT)).select(F.get(both, F.lit(0)).alias("run"), F.get(both, F.lit(1)).alias("letters"))
    runs = runs.groupBy("run").agg(F.max("letters").alias("letters"), F.count("*").alias("n")).where("n = 1").select("run", "letters")
    found = names.select("name", F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(r"[^\x00-\x7F]+"), F.lit(0)))).alias("run")).join(runs, "run")
    each = found.groupBy("name").agg(F.sort_array(F.collect_list(F.struct((-F.length("run")).alias("k"), "run", "letters"))).alias("l"))
    return each.select("name", F.aggregate("l", F.col("name"), lambda t, x: F.replace(t, x["run"], x["letters"])).alias("repaired"), F.lit("run").alias("chain"), F.lit(None).cast("string").alias("open_word"))


def judged(records: DataFrame) -> DataFrame:
    """``name, repaired, chain, open_word`` of each affected name; ``open_word``: see ``affected``."""
    names = records.select(F.explode(F.array("original_name", "corrected_name")).alias("name")).where(r"name RLIKE '[^\\x00-\\x7F]|&#'").distinct()
    names = written(names, "names")
    # at most one row a hypothesis
    learned = written(learn(records, names), "learned")
    known = {r.chain: r.support for r in learned.where(~F.col("chain").startswith(RUN_MARK)).collect()}
    chains = sorted(known.keys() - {"lost"}, key=lambda c: (-known[c], HYPOTHESES.index(c) if c in HYPOTHESES else 99))

    def judge(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for said in b.name:
            name = html.unescape(said)  # characters written as entities after they were garbled
            one_case = name == name.lower() or name == name.upper()
            hit, out, open_word = None, name, None
            bits = re.split(r"([^\x00-\x7f]+)", name)
            if got := restored(bits[1::2], chains, one_case):
                hit, sure = got[1], False
                for i, text in enumerate(got[0]):
                    if text is not None:
                        run, k = bits[2 * i + 1], 2 * i + 1
                        # a good letter and a closing sign may look like a garbled letter
                        if len(run) == 2 and run[1] in SIGNS and (not bits[k + 1] or bits[k + 1][0] == " "):
                            open_word = re.split(r"\s", "".join(bits[:k]))[-1] + run[0]
                        else:
                            sure = True
                        bits[k] = text
                out = "".join(bits)
                open_word = None if sure else open_word
            elif whole := swapped(name, chains):
                hit, out = whole[1], whole[0]
            # the second half of a letter became a blank: a capital inside or alone before a small letter
            elif not one_case and (m := re.search(r"(?:(?<=[a-z])|(?<=\s)|^)([^\x00-\x7f]) (?=[a-z])", name)) and m[1].isupper():
                if fits := [c for c in chains if c.startswith("utf-8>") and (t := undo(m[1] + "\xa0", c)) and near(t)]:
                    hit, out = fits[0], name[: m.start(1)] + undo(m[1] + "\xa0", fits[0]) + name[m.end(1) + 1 :]
            if LOST in name:
                hit, open_word = hit or "lost", None
            if hit:
                rows.append((said, out, hit, open_word))
        return pd.DataFrame(rows, columns=["name", "repaired", "chain", "open_word"])

    # names spread evenly: undoing is the work
    first = written(_map(judge, "name string, repaired string, chain string, open_word string")(names), "first")
    return first.unionByName(by_runs(names.join(first.select("name"), "name", "left_anti"), learned))


def affected(records: DataFrame) -> DataFrame:
    """``name, repaired, chain`` of each affected name; lost characters are filled from clean words of the same shape."""
    j = written(judged(records), "judged")
    every = records.select(F.explode(F.array("original_name", "corrected_name")).alias("name")).where("name IS NOT NULL").distinct()
    clean = every.join(j.where("open_word IS NULL").select("name"), "name", "left_anti")
    words = clean.select(F.explode(F.split("name", r"[\s/()\-–]+")).alias("w")).where(r"w RLIKE '[^\\x00-\\x7F]'").groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    # the word without its sign is a good word seen elsewhere: the name is good
    good = j.where("open_word IS NOT NULL").join(words, F.lower("open_word") == F.col("w"), "left_semi").select("name")
    j = j.join(good, "name", "left_anti")
    shape = words.select(F.regexp_replace("w", r"[^\x00-\x7F]", LOST).alias("shape"), "w", "n").groupBy("shape").agg(F.max(F.struct("n", "w")).alias("best"), F.count("*").alias("c")).where("c = 1").select("shape", F.col("best.w").alias("fill"))
    lost = j.where(F.col("repaired").contains(LOST)).select("name", F.posexplode(F.split("repaired", " ")).alias("i", "w"))
    lost = lost.join(shape, F.lower("w") == F.col("shape"), "left")
    # in the case of the damaged word
    fill = F.when(F.upper("w") == F.col("w"), F.upper("fill")).when(F.lower("w") == F.col("w"), F.col("fill")).otherwise(F.initcap("fill"))
    lost = lost.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce(fill, F.col("w")).alias("x")))), lambda s: s["x"]), " ").alias("filled"))
    return j.join(lost, "name", "left").select("name", F.coalesce("filled", "repaired").alias("repaired"), "chain")


def _fields(records: DataFrame) -> DataFrame:
    return records.select("candidate_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("name")) for c in ("original_name", "corrected_name")])).alias("f")).select("candidate_id", "f.field_name", "f.name")


def found(records: DataFrame) -> DataFrame:
    return _fields(records).join(affected(records).select("name"), "name", "left_semi").select("candidate_id", "field_name").distinct()


def repaired(records: DataFrame) -> DataFrame:
    """``candidate_id, field_name, name, repaired, chain, recovered`` of the affected names."""
    r = _fields(records).join(affected(records), "name").distinct()
    return r.select("candidate_id", "field_name", "name", "repaired", "chain", (~F.col("repaired").contains(LOST)).alias("recovered"))
