import itertools
import random

import pytest

from sievework.functions import extract, ids, numbers, text, urls
from sievework.plans import graphs
from sievework.sources import io


def lists(n=60, seed=4):
    rng = random.Random(seed)
    base = [[f"n{k}.{j}" for j in range(9)] for k in range(8)]
    out = []
    for page in range(n):
        names = list(base[page % 8])
        for _ in range(rng.randrange(0, 3)):
            names[rng.randrange(len(names))] = f"own{page}"
        if page % 5 == 0:
            rng.shuffle(names)
        out.append((page, f"h{rng.randrange(4)}", list(dict.fromkeys(names + ["common"]))))
    return out


def test_replica_links_against_all_pairs(spark):
    data = lists()
    rows = [(p, h, name, k, 1000 * p + k) for p, h, names in data for k, name in enumerate(names)] + [(p, h, names[0], 99, 1000 * p + 99) for p, h, names in data]
    m = spark.createDataFrame(rows, "page_row_id long, domain string, normalized_name string, mention_position int, mention_row_id long")
    per, found = graphs.name_lists(m, 8)
    assert {r.page: tuple(r.names) for r in per.collect()} == {p: tuple(n) for p, _, n in data}
    classes = {}
    for p, h, n in data:
        classes.setdefault(tuple(n), []).append((p, h))
    want = {(min(p for p, _ in v),) * 2 for v in classes.values() if len({h for _, h in v}) > 1}
    for (a, x), (b, y) in itertools.combinations(classes.items(), 2):
        hosts = {h for _, h in x}, {h for _, h in y}
        if len(set(a) & set(b)) / min(len(a), len(b)) >= 0.85 - 1e-9 and not (len(hosts[0]) == len(hosts[1]) == 1 and hosts[0] == hosts[1]):
            want.add(tuple(sorted((min(p for p, _ in x), min(p for p, _ in y)))))
    got = {(r.a, r.b) for r in graphs.replica_links(found, 0.85, 8).collect()}
    assert got == want and len(want) > 20


def test_address_variants(spark):
    df = spark.createDataFrame([("HTTPS://User@Www.A-b.co.uk:443/x//y/?b=2&a=1&utm_x=1#f", "www.a-b.co.uk"), ("ftp://h.com.ar/", "h.com.ar"), ("no address", "1.2.3.4"), (None, "x"), ("http://c.org:8080", "sub.c.org.uk")], "u string, h string")
    r = df.select(urls.canonical_probe(df.u).alias("p"), urls.canonical_pilot(df.u).alias("q"), urls.domain_slug(df.h).alias("s"), *[urls.registrable(df.h, k).alias(k) for k in urls.SUFFIXES]).collect()
    assert [x.p for x in r] == ["https://www.a-b.co.uk/x//y/?a=1&b=2&utm_x=1", "ftp://h.com.ar/", "no address", "", "http://c.org:8080/"]
    assert [x.q for x in r] == ["https://user@www.a-b.co.uk:443/x//y?a=1&b=2&utm_x=1", "ftp://h.com.ar/", "no address", None, "http://c.org:8080"]
    assert [x.s for x in r] == ["ab", "h", "3", "x", "c"]
    assert [x.discovery for x in r] == ["a-b.co.uk", "h.com.ar", "3.4", "x", "org.uk"] and [x.families for x in r] == ["a-b.co.uk", "com.ar", "3.4", "x", "c.org.uk"] and [x.probe for x in r][2] == "1.2.3.4"


def test_contacts_and_numbers(spark):
    df = spark.createDataFrame([("Call +44 20 7946 0958 or (030) 123-4567, not 12 34. See https://www.b.test/x, https://a.test/y; EUR 9,99 or $5", 2.5, 3.5), (None, None, None)], "t string, a double, b double")
    r = df.select(extract.phones(df.t).alias("p"), extract.linked_domains(df.t, df.t.substr(1, 0)).alias("l"), extract.prefixed_prices(df.t).alias("e"), numbers.rounded(df.a, 0).alias("r"), numbers.geometric(df.a, df.b).alias("g"), numbers.normalized(df.a, df.b).alias("n"),
                  numbers.truthy(df.t.substr(1, 0)).alias("y"), ids.identifier(df.t).alias("i"), text.clean_text(df.t).alias("c")).collect()
    assert r[0].p == ["(030) 123-4567", "+44 20 7946 0958"] and r[0].l == ["a.test", "b.test"] and list(map(float, r[0].e)) == [9.99, 5.0] and r[0].r == 2.0 and abs(r[0].g - 8.75**0.5) < 1e-12 and not r[0].y and not r[0].i
    assert r[1].p == [] and r[1].l == [] and r[1].r is None and not r[1].y


def test_html_entities_links_and_footer(spark):
    html = "<title>A &amp; B&nbsp;&lt;x&gt;</title><a href='/in'>i</a><a href='https://www.o.test/q'>o</a><a href='//own.test/z'>z</a><footer><p>Imprint &amp; co</p></footer>"
    df = spark.createDataFrame([(html, "own.test"), (None, None)], "h string, host string")
    p = io.parse_html("h")
    within, outside = io.split_links(p["links"], df.host)
    r = df.select(*[p[k].alias(k) for k in ("title", "footer", "links")], within.alias("w"), outside.alias("o")).collect()
    assert r[0].title == "A & B <x>" and r[0].footer == "Imprint & co" and set(r[0].w) == {"/in", "//own.test/z"} and r[0].o == ["https://www.o.test/q"] and r[1].title == ""


def test_contract_columns_and_replacement(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    with pytest.raises(ValueError):
        io.write_contract(df, str(tmp_path / "c"), ["x"])
    io.write_contract(df, str(tmp_path / "c"), ["y", "x"])
    assert io.read_csv(spark, str(tmp_path / "c"), df.select("y", "x").schema).first() == ("a", 1)
    lines = spark.createDataFrame([(1, "two\nlines")], "x int, y string")
    io.write_csv(lines, str(tmp_path / "m"))
    assert io.read_csv(spark, str(tmp_path / "m"), lines.schema, multi_line=True).first() == (1, "two\nlines")
    path = str(tmp_path / "t")
    for v in (1, 2):
        io.replace_table(spark.createDataFrame([(v,)], "v int"), path)
        assert [r.v for r in spark.read.parquet(path).collect()] == [v] and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_workbooks_keep_sheets_and_their_order(spark, tmp_path):
    from sievework.sources import xlsx

    first, second = spark.createDataFrame([("a <b> & c", 1, None), ("\x01 x", 2, 0.5)], "t string, n int, v double"), spark.createDataFrame([(7,)], "k int")
    xlsx.write_xlsx({"top & more": first, "rest": second}, str(tmp_path / "w.xlsx"))
    rows = sorted((r.row_no, r.cells) for r in xlsx.read_xlsx(spark, str(tmp_path)).collect())
    assert rows == [(0, ["t", "n", "v"]), (1, ["a <b> & c", "1", None]), (2, [" x", "2", "0.5"])]
    # listed first, whatever the number of its part
    import zipfile

    with zipfile.ZipFile(tmp_path / "w.xlsx") as z, zipfile.ZipFile(tmp_path / "v.xlsx", "w") as out:
        for n in z.namelist():
            out.writestr(n, z.read(n).replace(b'r:id="r1"', b'r:id="r9"').replace(b'r:id="r2"', b'r:id="r1"').replace(b'r:id="r9"', b'r:id="r2"') if n == "xl/workbook.xml" else z.read(n))
    (tmp_path / "w.xlsx").unlink()
    assert [r.cells for r in xlsx.read_xlsx(spark, str(tmp_path)).orderBy("row_no").collect()] == [["k"], ["7"]]
    with pytest.raises(ValueError):
        xlsx.write_xlsx({"a": first}, str(tmp_path / "u.xlsx"), most_rows=1)


def test_redirects_and_brand_hosts(spark):
    df = spark.createDataFrame([(["https://www.a.test/x", "http://a.test:80/"], "a.test", "Ab Cd"), (["https://a.test/", "https://b.test/"], "a.test", "x"), ([], "a.test", None), (None, None, None)], "hops array<string>, d string, b string")
    assert [r[0] for r in df.select(urls.redirects_stay(df.hops, df.d)).collect()] == [True, False, True, True]
    hosts = spark.createDataFrame([("my-abcd.test", "Ab Cd"), ("abc.test", "Abc"), ("x.test", None), (None, "Ab Cd")], "h string, b string")
    assert [r[0] for r in hosts.select(urls.names_brand(hosts.h, hosts.b)).collect()] == [True, False, False, False]
