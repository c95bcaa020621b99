"""Facts mined from text by patterns that Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PRICE = r"([0-9]+[.,][0-9]{2}) ?(?:€|EUR|USD|GBP|crowns|credits)"
PRICE_AFTER = r"(?:€|EUR|USD|GBP|[$£]) ?([0-9]+(?:[.,][0-9]{2})?)"
#: Digits in groups, perhaps with a prefix for abroad.
PHONE = r"(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{2,4}\)?[ .-]?){2,5}[0-9]{2,4}"
YEAR = r"(20[0-9]{2})"
ADDRESS = r"https?://[^ \t\r\n)>\"]+"
HEADING = r"^(?:#+ |=+ )"
NUMBERED = r"^(?:#+ )?[0-9]+[.)] "


def all_of(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(group))


def emails(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(all_of(x, EMAIL), F.lower)))


def prices(x: Column) -> Column:
    return F.transform(all_of(x, PRICE, 1), lambda p: F.replace(p, F.lit(","), F.lit(".")).cast("decimal(18,2)"))


def prefixed_prices(x: Column) -> Column:
    return F.transform(all_of(x, PRICE_AFTER, 1), lambda p: F.replace(p, F.lit(","), F.lit(".")).cast("decimal(18,2)"))


def phones(x: Column) -> Column:
    """Distinct numbers of 7 to 16 digits, as written."""
    digits = lambda p: F.length(F.regexp_replace(p, "[^0-9]", ""))
    return F.array_sort(F.array_distinct(F.filter(all_of(x, PHONE), lambda p: digits(p).between(7, 16))))


def addresses(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(all_of(x, ADDRESS), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))))


def linked_domains(x: Column, own: Column) -> Column:
    """Hosts of the addresses in a text, but for its own."""
    hosts = F.transform(all_of(x, ADDRESS), lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/?#:]+)", 1)), r"^www\.|\.$", ""))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: (h != "") & (h != F.coalesce(own, F.lit(""))))))


def latest_year(x: Column) -> Column:
    return F.array_max(F.transform(all_of(x, YEAR, 1), lambda y: y.cast("int")))


def lines(x: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(x, F.lit("")), "\r", ""), "\n", -1)


def json_prefix(x: Column) -> Column:
    """The text from its first bracket to its last, for outputs that speak before and after their JSON; null without one."""
    found = F.regexp_extract(x, r"(?s)([\[{].*[\]}])", 1)
    return F.when(found != "", found)


COMPANY = r"((?:[A-Z][A-Za-z0-9&.-]+ ){1,4}(?:Ltd|Limited|LLC|Inc|GmbH|Lda|SARL))"


def company(x: Column) -> Column:
    """The first name of a company by its legal form, or null."""
    found = F.regexp_extract(F.coalesce(x, F.lit("")), COMPANY, 1)
    return F.when(found != "", found)


def places(x: Column, names: tuple[str, ...], most: int = 3) -> Column:
    """The names of a list that stand in the text as bounded words, in the list's order, joined; AMBIGUOUS where more than ``most`` do, null where none does."""
    text = F.concat(F.lit(" "), F.coalesce(x, F.lit("")), F.lit(" "))
    found = F.array_compact(F.array(*[F.when(text.rlike(f"[^A-Za-z]{n}[^A-Za-z]"), F.lit(n)) for n in names]))
    return F.when(F.size(found) > most, "AMBIGUOUS").when(F.size(found) > 0, F.array_join(found, " | "))


def first_claim(x: Column, patterns: dict[str, str]) -> Column:
    """``label: what it says`` of the first pattern, in their order, that matches; null if none does."""
    said = [F.when(F.regexp_extract(F.coalesce(x, F.lit("")), p, 1) != "", F.concat(F.lit(label + ": "), F.regexp_extract(x, p, 1))) for label, p in patterns.items()]
    return F.coalesce(*said)
