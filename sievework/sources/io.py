"""Readers and writers: CSV, JSON lines, XML, HTML, response envelopes, file inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The text that stands for null in CSV, so that empty strings stay empty.
NULL_MARK = "\\N"
#: Times are written with all their digits.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_OPTIONS = TIMES | {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, null: str = NULL_MARK, multi_line: bool = False) -> DataFrame:
    """CSV with a header and a byte-order mark or none. ``multi_line`` reads quoted line ends; then a file can't be split over tasks."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, quote='"', escape='"', nullValue=null, emptyValue="", encoding="UTF-8", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def write_csv(df: DataFrame, path: str, null: str = NULL_MARK) -> None:
    """CSV part files with the frame's columns in order; the header is written even for no rows."""
    df.write.csv(path, header=True, quote='"', escape='"', nullValue=null, encoding="UTF-8", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines. Strict reading fails on a bad line; else a bad line is a row with its text in ``_corrupt_record``."""
    if strict:
        return spark.read.json(path, schema=schema, mode="FAILFAST", **TIMES)
    checked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.json(path, schema=checked, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", **TIMES)


def replace_table(df: DataFrame, path: str) -> None:
    """Replaces a table: the new one is written whole beside it, then takes its place by a rename, so no reader sees half of either."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    at = {k: spark._jvm.org.apache.hadoop.fs.Path(k) for k in (path, new, old)}
    fs = at[path].getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at[old], True)
    if fs.exists(at[path]) and not fs.rename(at[path], at[old]):
        raise OSError(f"can't move {path}")
    if not fs.rename(at[new], at[path]):
        raise OSError(f"can't move {new}")
    fs.delete(at[old], True)


def write_contract(df: DataFrame, path: str, columns: list[str], null: str = NULL_MARK) -> None:
    """CSV of exactly these columns in their order; a frame that lacks one or has others fails."""
    if set(df.columns) != set(columns):
        raise ValueError(f"columns differ from the contract: {sorted(set(df.columns) ^ set(columns))}")
    write_csv(df.select(*columns), path, null)


def write_jsonl(df: DataFrame, path: str) -> None:
    w = df.write.option("ignoreNullFields", False)
    for k, v in _OPTIONS.items():
        w = w.option(k, v)
    w.json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one array or one object each."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    """One row an element; .xml and .xml.gz alike; spaces around a value are the value's."""
    r = spark.read.format("xml").option("rowTag", row_tag).option("ignoreSurroundingSpaces", False)
    return (r.schema(schema) if schema else r).load(path)


def write_xml(df: DataFrame, path: str, root: str, row_tag: str, compress: bool = False) -> None:
    w = df.write.format("xml").option("rootTag", root).option("rowTag", row_tag)
    (w.option("compression", "gzip") if compress else w).save(path)


def pack_envelopes(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """``key, part, results``: the rows of a key in envelopes of at most about ``size``, whatever the key's size."""
    fields = [c for c in rows.columns if c != key]
    count = rows.groupBy(key).agg(F.count("*").alias("_n"))
    r = rows.join(count, key).withColumn("part", F.pmod(F.xxhash64(order), F.ceil(F.col("_n") / size)))
    return r.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias("results"))


def envelope_schema(rows: DataFrame, key: str, order: str) -> T.StructType:
    fields = [rows.schema[order], *[f for f in rows.schema.fields if f.name not in (key, order)]]
    return T.StructType([rows.schema[key], T.StructField("part", T.LongType()), T.StructField("results", T.ArrayType(T.StructType(fields)))])


def explode_envelopes(envelopes: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """One row a result with its rank in the envelope; an envelope of more than ``most`` results fails the job."""
    ok = envelopes.withColumn("_ok", F.assert_true(F.coalesce(F.size("results"), F.lit(0)) <= most, F.lit("too many results"))).where("_ok IS NULL")
    return ok.select(key, F.posexplode("results").alias("pos", "r")).select(key, (F.col("pos") + 1).alias("rank"), "r.*")


def unescaped(x: F.Column) -> F.Column:
    """The common named entities as their characters, the ampersand last."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
    return x


def split_links(links: F.Column, host: F.Column) -> tuple[F.Column, F.Column]:
    """(links within the host, links to others): relative ones are within."""
    to = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?:https?:)?//([^/?#:]+)", 1)), r"^www\.", "")
    return F.filter(links, lambda u: (to(u) == "") | (to(u) == host)), F.filter(links, lambda u: (to(u) != "") & (to(u) != host))


def parse_html(html: str) -> dict[str, F.Column]:
    """Title, canonical address, links and JSON-LD blocks of an HTML column, by patterns."""
    h = F.coalesce(F.col(html), F.lit(""))
    return {
        "title": F.trim(F.regexp_replace(unescaped(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " ")),
        "canonical": F.regexp_extract(h, r"(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)", 1),
        "links": F.array_distinct(F.regexp_extract_all(h, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1))),
        "ld_json": F.regexp_extract_all(h, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)),
        "footer": F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.regexp_extract(h, r"(?is)<footer[^>]*>(.*?)</footer>", 1), r"(?s)<[^>]*>", " ")), r"\s+", " ")),
    }


def inspect_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, length, digest`` of every file below a path, read as bytes by the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("digest"))


def directory_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row: the digest of the sorted ``name:digest`` lines. There is one line a file, so the list stays small."""
    f = inspect_files(spark, path)
    return f.agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "digest"))), "\n"), 256).alias("fingerprint"))
