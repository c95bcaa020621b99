from pyspark.sql import functions as F

from sievework.functions import extract, ids, text, urls
from sievework.operators.rules import any_word, cascade, first_word


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_text_functions(spark):
    x = F.col("x")
    r = one(spark, "  Ünïted\tSTREAM—TV  ß ", text.clean_text(x), text.ascii_fold(x), text.compact_key(x), text.sorted_token_key(x), text.without_words(x))
    assert tuple(r) == ("Ünïted STREAM—TV ß", "united streamtv", "unitedstreamtv", "streamtv united", "united streamtv")
    assert one(spark, "tv plus", text.without_words(x))[0] == "tv plus"
    assert one(spark, None, text.ascii_fold(x), text.clean_text(x))[:] == ("", "")
    assert one(spark, "aBc dEf", text.camel_split(x))[0] == "a Bc d Ef"
    assert one(spark, "ab ab ab", text.occurrences(x, F.lit("ab")))[0] == 3
    assert one(spark, "one two three", text.window_around(x, F.lit("two"), 2))[0] == "e two t"
    assert one(spark, "one", text.window_around(x, F.lit("zzz"), 2))[0] is None
    assert one(spark, "mail a.b@c.org api_key=abcdefgh1", text.redacted(x))[0] == "mail [REDACTED] [REDACTED]"
    assert one(spark, "https://h.example/a/good-news_now/?q=1", text.slug_title(x))[0] == "Good News Now"


def test_url_forms_differ(spark):
    x = F.col("x")
    u = "HTTPS://WWW.Shop.Example:443//a//b/?b=2&utm_source=x&a=1&reference=9#top"
    r = one(spark, u, urls.canonical_sorted(x), urls.canonical_ordered(x), urls.canonical_bare(x), urls.host(x))
    assert tuple(r) == ("https://www.shop.example/a/b?a=1&b=2", "https://shop.example//a//b?b=2&a=1&reference=9", "shop.example//a//b", "shop.example")
    assert one(spark, "ftp://x", urls.canonical_sorted(x))[0] == "" and one(spark, None, urls.host(x))[0] == ""
    assert one(spark, "a.b.co.uk", urls.registrable(x))[0] == "b.co.uk" and one(spark, "a.b.org", urls.registrable(x))[0] == "b.org" and one(spark, "local", urls.registrable(x))[0] == "local"
    assert one(spark, "http://h.example/best/review/login", urls.path_score(x, ("best", "review"), ("login",)))[0] == 39


def test_extraction(spark):
    x = F.col("x")
    r = one(spark, "9.50 EUR and 3,20 € in 2024, 2026: A@b.org a@B.org", extract.prices(x), extract.latest_year(x), extract.emails(x))
    assert [str(p) for p in r[0]] == ["9.50", "3.20"] and r[1] == 2026 and r[2] == ["a@b.org"]
    assert one(spark, None, extract.prices(x), extract.latest_year(x))[:] == ([], None)


def test_ids_tell_null_from_empty_only_in_digests(spark):
    x = F.col("x")
    assert one(spark, None, ids.stable_id("a", x))[0] == one(spark, "", ids.stable_id("a", x))[0]
    assert one(spark, None, ids.row_digest(x))[0] != one(spark, "", ids.row_digest(x))[0]


def test_cascade_takes_the_first_rule_and_null_does_not_hold(spark):
    x = F.col("x")
    rule = cascade([(x == "a", "A"), (x.isin("a", "b"), "AB")], "NONE")
    assert [one(spark, v, rule)[0] for v in ("a", "b", "c", None)] == ["A", "AB", "NONE", "NONE"]
    assert one(spark, "smart tv box", any_word(x, ("tv",)), any_word(x, ("ox",)), first_word(x, ("box", "tv")))[:] == (True, False, "box")


def test_candidates_terms_and_json(spark):
    from sievework.operators.rules import first_term, matches_term

    x = F.col("x")
    for said, want in (("## 3. **Best overall: Murado Play**", "Murado Play"), ("Murado Play murado play", "Murado Play"), ("1) x", "x"), (None, ""), ("", ""), ("a" * 300, "a" * 100)):
        assert one(spark, said, text.clean_candidate(x))[0] == want
    assert one(spark, "a Smart\nTV-box", matches_term(x, "smart tv"), matches_term(x, "mart"), matches_term(x, "tv-box"), first_term(x, ["zz", "box"]))[:] == (True, False, True, "box")
    assert one(spark, "see h.example/x", matches_term(x, "h.example"))[0]
    assert one(spark, 'log: {"a": [1]} done', extract.json_prefix(x))[0] == '{"a": [1]}' and one(spark, "none", extract.json_prefix(x))[0] is None
