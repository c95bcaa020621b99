"""One form for texts that read the same: compatibility forms, unseen characters, blanks and look-alike letters, by one translation table.

What looks alike comes from Unicode's confusables, as ICU holds them: a cased letter outside ASCII that has the skeleton of an ASCII letter of its
case is drawn as that letter. Letters of caseless scripts are left alone, as are Latin letters, but for the two that differ from ``a`` and ``g`` by font only.
Of the compatibility forms those count that are set otherwise and read the same (wide, narrow, joined, font, presentation forms), not superscripts, circles or fractions.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Latin letters that differ from an ASCII one by font only, hyphens drawn as the ASCII one.
FONT_ONLY = {"ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-"}
#: Kinds of compatibility forms that read as their plain form.
SAME = {"<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: A joiner that joins no pictures; other characters that can't be seen go by the table.
JOINER = regex.compile(r"(?<=\p{Extended_Pictographic}\ufe0f?\p{EMod}?)\u200d(?=\p{Extended_Pictographic})(*SKIP)(*FAIL)|\u200d")
UNSEEN = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}--\u200d]|(?![\t\n\r])\p{Cc}", regex.V1)
#: Code points with letters or compatibility forms that may look like others.
REACH = [c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]


@cache
def plain_forms() -> dict[str, str]:
    """Characters with the form they read as: compatibility forms of the kinds in ``SAME``, and characters whose composed form is another."""
    out = {}
    for c in map(chr, REACH):
        kind = unicodedata.decomposition(c)
        if (kind[:1] == "<" and kind.split()[0] in SAME) or (kind and unicodedata.normalize("NFC", c) != c):
            # what a form decomposes to may be one in turn, but a mark of another kind is no plain form
            plain = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", x) if x != c else x for x in unicodedata.normalize("NFKC", c)))
            if plain != c and plain[0] not in " \n":  # a lone accent is no space and mark
                out[c] = plain
    return out


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters outside ASCII with the ASCII letter of their case that they are drawn as, by the confusables of ICU."""
    return _look_alikes(spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker)


_LETTERS: dict[str, str] = {}


def _look_alikes(checker) -> dict[str, str]:
    if not _LETTERS:
        skeleton = checker.Builder().build().getSkeleton
        of = lambda text: skeleton("\n".join(text)).split("\n")
        ascii_letters = [chr(c) for c in range(65, 123) if chr(c).isalpha()]
        latin = {(s, a.isupper()): a for a, s in zip(ascii_letters, of(ascii_letters), strict=True)}
        cased = [c for c in map(chr, REACH) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.name(c, "LATIN").startswith(("LATIN", "MATHEMATICAL", "FULLWIDTH")) and c not in plain_forms()]
        _LETTERS.update({c: latin[s, unicodedata.category(c) == "Lu"] for c, s in zip(cased, of(cased), strict=True) if (s, unicodedata.category(c) == "Lu") in latin})
        _LETTERS.update(FONT_ONLY)
        # letters with marks on such a letter, so that they agree with their decomposed form
        marked = {c: d for c in map(chr, REACH) if unicodedata.category(c)[0] == "L" and (d := unicodedata.normalize("NFD", c)) != c and d[0] in _LETTERS}
        _LETTERS.update({c: n for c, d in marked.items() if len(n := unicodedata.normalize("NFC", _LETTERS[d[0]] + d[1:])) == 1})
    return _LETTERS


@cache
def _plain_table() -> dict[int, str]:
    """Plain forms, nothing for characters that can't be seen, blanks as spaces, line ends as newlines."""
    table = {ord(c): p for c, p in plain_forms().items()}
    for c in map(chr, [*range(0x80), *REACH, *range(0xE0000, 0xE1000)]):
        if UNSEEN.match(c):
            table[ord(c)] = ""
        elif c == "\t" or unicodedata.category(c) == "Zs":
            table[ord(c)] = " "
    return table | dict.fromkeys((0x0D, 0x85, 0x2028, 0x2029), "\n")


def reading_table(letters: dict[str, str]) -> dict[int, str]:
    """The plain table with look-alike letters as the Latin ones, also where a plain form is one."""
    table = str.maketrans(letters)
    return {k: v.translate(table) for k, v in _plain_table().items()} | {k: v for k, v in table.items() if k not in _plain_table()}


def translated(text: str, table: dict[int, str]) -> str:
    if text.isascii() and text.replace("\n", "").isprintable():
        return text
    text = text.replace("\r\n", "\n").translate(table)
    return JOINER.sub("", text) if "\u200d" in text else text


def read_form(text: str, letters: dict[str, str]) -> str:
    """The reading form of a text, composed; equal for texts that read the same."""
    return unicodedata.normalize("NFC", translated(text, reading_table(letters)))


def read(text: Column) -> Column:
    """``read_form`` of texts, by Arrow batches."""
    table = reading_table(look_alikes(SparkSession.active()))  # made once, sent with the step

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFC", translated(t, table)), na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(text)


@cache
def _bases() -> dict[int, str]:
    """Letters that decompose to an ASCII letter and marks, and that letter."""
    return {ord(c): d[0] for c in map(chr, REACH) if (d := unicodedata.normalize("NFD", c))[0].isascii() and d[0].isalpha()}


_NO_LETTER = bytes(c for c in range(256) if not chr(c).isalnum() or c > 127)


def skeleton(mapped: str, bases: dict[int, str]) -> bytes:
    """A mapped text's ASCII letters and digits, accented ones without accent: the same for texts equal under the collation."""
    return (mapped if mapped.isascii() else mapped.translate(bases)).encode("ascii", "ignore").translate(None, _NO_LETTER)


def mapped(text: Column) -> Column:
    """A struct for each text: ``m``, its plain form with look-alike letters as the Latin ones, not composed, null where that is the text itself; ``bare_h``, the hash
    of its skeleton; ``unclean``, whether it holds other than composed plain forms."""
    table, plain, bases = reading_table(look_alikes(SparkSession.active())), _plain_table(), _bases()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                m = translated(t, table)
                bare = int.from_bytes(hashlib.blake2b(skeleton(m, bases), digest_size=8).digest(), "big", signed=True)
                rows.append((None if m == t else m, bare, not t.isascii() and (translated(t, plain) != t or not unicodedata.is_normalized("NFC", t)) or m != t and t.isascii()))
            yield pd.DataFrame(rows, columns=["m", "bare_h", "unclean"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "m string, bare_h bigint, unclean boolean")(text)


def shown(mapped_text: Column) -> Column:
    """What the collation ignores and can be seen: joiners between pictures, marks beyond the common diacritics; in a fixed order."""
    joined = F.regexp_extract_all(mapped_text, F.lit(r"[\p{So}\x{1F3FB}-\x{1F3FF}]\x{200D}(?=\p{So})"), F.lit(0))
    marks = F.regexp_extract_all(mapped_text, F.lit(r"[\p{M}\x{640}&&[^\x{300}-\x{36F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]]"), F.lit(0))
    return F.array_join(F.array_sort(F.concat(joined, marks)), "")
