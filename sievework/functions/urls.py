"""Address expressions. The canonical forms differ on purpose and keep their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
# Suffixes of two labels under which names are registered, by variant.
SUFFIXES = {
    "discovery": ("co.uk", "com.au", "com.br", "com.mx", "co.in", "com.ar", "com.co"),
    "families": ("co.uk", "org.uk", "com.au", "co.nz", "com.br", "co.za", "com.mx"),
    "probe": ("co.uk", "com.au", "com.br", "com.mx", "co.nz", "co.jp"),
}


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, n)


def host(url: Column) -> Column:
    """Lower-case host without user, port, a last dot or a leading www."""
    h = F.regexp_replace(F.lower(part(url, 2)), r"^[^@]*@", "")
    return F.regexp_replace(F.regexp_replace(h, r":[0-9]+$", ""), r"\.$|^www\.", "")


def host_with_www(url: Column) -> Column:
    """Lower-case host without a default port and a last dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r":(80|443)$", ""), r"\.$", "")


def parameters(url: Column, drop: str) -> Column:
    """Non-empty parameters that don't match ``drop``, in their order."""
    return F.filter(F.split(part(url, 4), "&"), lambda x: (x != "") & ~F.lower(x).rlike(drop))


def _joined(base: Column, params: Column) -> Column:
    return F.when(F.size(params) > 0, F.concat(base, F.lit("?"), F.array_join(params, "&"))).otherwise(base)


def canonical_sorted(url: Column) -> Column:
    """http(s) only, else ""; host in lower case; slashes collapsed; parameters that begin utm_, ref or aff dropped, the rest sorted; no fragment."""
    path = F.regexp_replace(F.regexp_replace(part(url, 3), "/+", "/"), "/$", "")
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), host_with_www(url), path)
    return F.when(part(url, 2) != "", _joined(base, F.array_sort(parameters(url, "^(utm_|ref|aff)")))).otherwise("")


def canonical_ordered(url: Column) -> Column:
    """https always, host without www; known tracking keys dropped, the rest in order; no fragment."""
    path = F.regexp_replace(part(url, 3), "/$", "")
    base = F.concat(F.lit("https://"), host(url), path)
    return F.when(part(url, 2) != "", _joined(base, parameters(url, r"^(utm_[a-z]+|gclid|fbclid|msclkid|ref|source)="))).otherwise("")


def canonical_bare(url: Column) -> Column:
    """Host without www and path only."""
    return F.when(part(url, 2) != "", F.concat(host(url), F.regexp_replace(part(url, 3), "/+$", ""))).otherwise("")


def registrable(h: Column, variant: str = "discovery") -> Column:
    """The host's last two labels, or three under a suffix of two labels of the variant; the variant ``probe`` leaves addresses of numbers whole."""
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    whole = F.size(labels) <= 2
    if variant == "probe":
        whole = whole | h.rlike("^[0-9.]+$")
    return F.when(whole, h).when(last(2).isin(*SUFFIXES[variant]), F.when(F.size(labels) >= 3, last(3)).otherwise(h)).otherwise(last(2))


def domain_slug(h: Column) -> Column:
    """The label before the suffix, letters and digits alone; a second label such as ``co`` or ``com`` belongs to the suffix."""
    labels = F.split(h, r"\.")
    at = F.when((F.size(labels) >= 3) & F.element_at(labels, -2).isin("co", "com", "net", "org"), -3).otherwise(F.when(F.size(labels) >= 2, -2).otherwise(-1))
    return F.regexp_replace(F.lower(F.element_at(labels, at)), "[^a-z0-9]", "")


def canonical_probe(url: Column) -> Column:
    """Any scheme kept; default ports dropped; an empty path as "/", a last "/" kept; parameters sorted; no fragment. Without a host the text itself, trimmed."""
    u = F.trim(F.coalesce(url, F.lit("")))
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme, net, path, asked = (F.regexp_extract(u, pattern, k) for k in (1, 2, 3, 4))
    scheme, net = F.lower(scheme), F.regexp_replace(F.lower(net), "^[^@]*@", "")
    net = F.when(scheme == "https", F.regexp_replace(net, ":443$", "")).when(scheme == "http", F.regexp_replace(net, ":80$", "")).otherwise(net)
    base = F.concat(scheme, F.lit("://"), F.regexp_replace(net, r"\.$", ""), F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(net != "", _joined(base, F.array_sort(F.filter(F.split(asked, "&"), lambda x: x != "")))).otherwise(u)


def canonical_pilot(url: Column) -> Column:
    """Parameters sorted, a last "/" dropped, the port kept; what has no host stays as it is."""
    base = F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.regexp_replace(part(url, 3), "/+$", ""))
    return F.when(part(url, 2) != "", _joined(base, F.array_sort(F.filter(F.split(part(url, 4), "&"), lambda x: x != "")))).otherwise(url)


def belongs_to(h: Column, domain: Column) -> Column:
    """Whether a host is the domain or one of its subdomains."""
    return F.coalesce((h == domain) | h.endswith(F.concat(F.lit("."), domain)), F.lit(False))


def path_score(url: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """45, 12 more for each good word in the path, 30 less for each bad one; 0 to 100."""
    p = F.lower(part(url, 3))
    n = lambda words: sum((p.contains(w).cast("int") for w in words), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), 45 + 12 * n(positive) - 30 * n(negative)))


def redirects_stay(hops: Column, domain: Column) -> Column:
    """Whether every hop of a chain of redirects leads to the domain or its ``www``; an empty or null chain stays."""
    return F.coalesce(F.forall(hops, lambda u: F.lower(part(u, 2)).isin("") | (host(u) == F.regexp_replace(F.lower(domain), r"^www\.", ""))), F.lit(True))


def names_brand(h: Column, brand: Column) -> Column:
    """Whether a host holds the brand's compact name, of four letters or more."""
    from sievework.functions.text import compact_key

    key = compact_key(brand)
    return F.coalesce((F.length(key) >= 4) & compact_key(h).contains(key), F.lit(False))
