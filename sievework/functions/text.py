"""Text expressions: every function takes and gives Columns, so plans stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their base letter, by Unicode's own decomposition.
_PAIRS = [(chr(c), d[0]) for a, z in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(a, z) if (d := unicodedata.normalize("NFKD", chr(c)))[0].isascii() and d[0].isalpha() and len([x for x in d if not unicodedata.combining(x)]) == 1]
ACCENTED, BASE = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
# Words of the trade that entity keys leave out.
SERVICE_WORDS = ("iptv", "tv", "ott", "hd", "4k", "plus", "pro", "stream", "streams", "service", "services")


def clean_text(x: Column) -> Column:
    """Null as "", runs of blanks as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[ \t\n\r]+", " "))


def strip_accents(x: Column) -> Column:
    """Accented Latin letters as their base letters; ß, æ and ø stay, as they don't decompose."""
    return F.translate(x, ACCENTED, BASE)


def ascii_fold(x: Column) -> Column:
    """Lower-case words of a-z and 0-9, one space between; other characters are dropped first, without leaving a gap."""
    plain = F.regexp_replace(strip_accents(F.coalesce(x, F.lit(""))), r"[^\x00-\x7F]+", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def compact_key(x: Column) -> Column:
    return F.replace(ascii_fold(x), F.lit(" "), F.lit(""))


def tokens(x: Column) -> Column:
    return F.filter(F.split(ascii_fold(x), " "), lambda t: t != "")


def sorted_token_key(x: Column) -> Column:
    return F.array_join(F.array_sort(tokens(x)), " ")


def without_words(x: Column, words: tuple[str, ...] = SERVICE_WORDS) -> Column:
    """The folded name without these words; the whole folded name where nothing else is left."""
    kept = F.array_join(F.filter(tokens(x), lambda t: ~t.isin(*words)), " ")
    return F.when(kept != "", kept).otherwise(ascii_fold(x))


def camel_split(x: Column) -> Column:
    return F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")


def fingerprint_text(x: Column) -> Column:
    """Folded text without addresses, for content fingerprints."""
    return ascii_fold(F.regexp_replace(F.coalesce(x, F.lit("")), r"https?://[^ \t\r\n]+", " "))


def occurrences(x: Column, term: Column) -> Column:
    """How often the folded term stands in the folded text, without overlap; 0 for an empty term."""
    text, t = ascii_fold(x), ascii_fold(term)
    return F.when(F.length(t) > 0, F.floor((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t))).otherwise(0)


def window_around(x: Column, term: Column, width: int) -> Column:
    """The text from ``width`` characters before the term's first place to as many after it; null if it isn't there."""
    at = F.position(term, x)
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(x, start, at - start + F.length(term) + width))


def first_sentence(x: Column) -> Column:
    return F.regexp_extract(clean_text(x), r"^([^.!?]*[.!?])", 1)


def redacted(x: Column) -> Column:
    """E-mail addresses, keys and bearer tokens as [REDACTED]."""
    x = F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED]")
    return F.regexp_replace(x, r"(?i)\b(?:bearer\s+|api[_-]?key\s*[=:]\s*)[A-Za-z0-9._-]{8,}", "[REDACTED]")


def slug_title(url: Column) -> Column:
    """The last part of a path as a title."""
    slug = F.regexp_extract(url, r"/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def clean_candidate(x: Column, most: int = 100) -> Column:
    """A name from a Markdown line: marks, numbering and lead-ins gone, a name said twice said once, at most ``most`` characters."""
    x = F.regexp_replace(clean_text(x), r"^(?:[#>*|=-]+ *)*(?:[0-9]+[.)] *)?", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\*\*|__|`", ""), r"(?i)^(?:best overall|editor'?s choice|top pick): *", "")
    w = F.split(F.trim(x), " ")
    half = F.floor(F.size(w) / 2).cast("int")
    twice = (F.size(w) % 2 == 0) & (F.lower(F.array_join(F.slice(w, F.lit(1), F.greatest(half, F.lit(1))), " ")) == F.lower(F.array_join(F.slice(w, half + 1, F.greatest(half, F.lit(1))), " ")))
    return F.trim(F.substring(F.when(twice, F.array_join(F.slice(w, F.lit(1), F.greatest(half, F.lit(1))), " ")).otherwise(F.trim(x)), F.lit(1), F.lit(most)))
