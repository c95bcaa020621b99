from collections import defaultdict

from pyspark.sql import functions as F

from sievework.llm import lines

SCHEMA = "result_row_id long, canonical_hostname string, canonical_url string, raw_content string, lines string, key long"


def pages(n=200):
    out = []
    for i in range(n):
        host = ["a.test", "b.test", None, "a.test"][i % 4]
        url = None if i % 17 == 0 else f"u{i // 2}"
        text = f"Menu!\nown line {i}\n m e n u\n***\n" + ("rare thing\n" if i < 9 else "") + "Été ① footer"
        out.append((i, host, url, [text, text, text.upper(), None, ""][0 if i % 9 else i % 5], "x", 1))
    out.append(out[1])  # a repeated row
    out.append((900, "a.test", "long", "Menu\n" + "w " * 200_000 + "\nfooter", "x", 1))
    return out


def brute(rows, least):
    urls, where = defaultdict(set), defaultdict(set)
    for i, host, url, text, *_ in rows:
        if host is None or not text:
            continue
        for k, line in enumerate(text.split("\n")):
            bare = "".join(c for c in line.lower() if c.isalnum())
            if bare:
                where[host, bare].add((i, k))
                if url is not None:
                    urls[host, bare].add(url)
    return {x for k, v in where.items() if len(urls[k]) >= least for x in v}


def test_repeated_lines_against_brute_force(spark):
    data = pages()
    df = spark.createDataFrame(data, SCHEMA)
    for least in (2, 8, 60):
        assert {tuple(r) for r in lines.repeated_lines(df, min_urls=least).collect()} == brute(data, least)


def test_cleaned_pages_keep_every_row_and_column(spark):
    data = pages(60)
    df = spark.createDataFrame(data, SCHEMA).withColumn("clean_text", F.lit("old"))
    out = lines.without_repeated_lines(df)
    gone = brute(data, 8)
    got = out.select("result_row_id", "raw_content", "clean_text", "lines_removed").collect()
    assert len(got) == len(data) and set(out.columns) == {*df.columns, "lines_removed"}
    for i, text, clean, n in got:
        keep = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        assert clean == keep and n == (0 if text is None else len(text.split("\n")) - len([k for k in range(len(text.split("\n"))) if (i, k) not in gone]))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lines.repeated_lines(df).count() == 0 and lines.without_repeated_lines(df).count() == 0
