import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.session import shared_dir, written
from sievework.sources import io
from sievework.streaming import ledger


def test_csv_keeps_nulls_empty_strings_quotes_and_line_ends(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, ""), (3, None), (4, "x")], "i int, s string")
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(io.read_csv(spark, str(tmp_path / "c"), df.schema, multi_line=True).collect()) == sorted(df.collect())
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfi,s\n1,x\n")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "bom.csv"), df.schema).collect()] == [(1, "x")]
    io.write_csv(df.where("i > 9"), str(tmp_path / "e"))
    assert io.read_csv(spark, str(tmp_path / "e"), df.schema).count() == 0


def test_jsonl_marks_bad_lines_or_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"i": 1}\n\n{"i": \n{"i": 2}\n')
    got = io.read_jsonl(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("i", T.IntegerType())])).collect()
    assert [r.i for r in got if r._corrupt_record is None] == [1, 2] and sum(r._corrupt_record is not None for r in got) == 1


def test_xml_and_gz(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b & c", 2)], "n string, v int")
    io.write_xml(df, str(tmp_path / "x"), "all", "row", compress=True)
    assert sorted(tuple(r) for r in io.read_xml(spark, str(tmp_path / "x"), "row", df.schema).collect()) == [("a", 1), ("b & c", 2)]


def test_envelopes_keep_every_row_once(spark):
    df = spark.range(95).select((F.col("id") % 3).alias("k"), "id", F.col("id").cast("string").alias("v"))
    packed = io.pack_envelopes(df, "k", "id", 10)
    assert packed.agg(F.max(F.size("results"))).first()[0] < 32
    assert sorted(r.id for r in io.explode_envelopes(packed, "k").collect()) == list(range(95))


def test_html(spark):
    page = '<html><title> A\n page</title><link rel="canonical" href="https://h.example/a"><a href="/x">x</a> <a href=\'https://y.example\'>y</a><script type="application/ld+json">{"a":1}</script></html>'
    p = io.parse_html("h")
    r = spark.createDataFrame([(page,), (None,)], "h string").select(*[c.alias(n) for n, c in p.items()]).collect()
    assert r[0].title == "A page" and r[0].canonical == "https://h.example/a" and r[0].links == ["/x", "https://y.example"] and r[0].ld_json == ['{"a":1}']
    assert r[1].title == "" and r[1].links == []


def test_directory_fingerprint_ignores_order(spark, tmp_path):
    for d, names in (("p", "ab"), ("q", "ba")):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / f"{n}.txt").write_text(n)
    a, b = (io.directory_fingerprint(spark, str(tmp_path / d)).first() for d in "pq")
    assert a == b and a.files == 2


def test_written_tables_go_to_the_shared_folder(spark):
    df = written(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and shared_dir(spark).split("://")[-1] in df.inputFiles()[0]


def test_ledger_and_budget(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 7, "view", 1.0), (2, t, 7, "error", 2.0), (3, t + dt.timedelta(hours=1), 8, "view", 9.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    got = {r.user_id: (r.events, r.errors, r.last_type) for r in ledger.last_states(df, "user_id", ["ts", "event_id"], "event_type").collect()}
    assert got == {7: (2, 1, "error"), 8: (1, 0, "view")}
    assert [(r.user_id, r.event) for r in ledger.over_budget(df, "user_id", ["ts", "event_id"], "value", 2.5).orderBy("user_id").collect()] == [(7, 2), (8, 3)]


def test_xlsx(spark, tmp_path):
    import zipfile

    from sievework.sources.xlsx import read_xlsx

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Mu</t></r><r><t>rado</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    got = [(r.file, r.row_no, r.cells) for r in read_xlsx(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [("a.xlsx", 0, ["name", None, "n"]), ("a.xlsx", 1, ["Murado", None, "7"])]
