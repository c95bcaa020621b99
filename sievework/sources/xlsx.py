"""XLSX files: a workbook is a zip of XML parts. The first sheet of many is read by the executors; reports of bounded size are written as sheets of one."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, row_no int, cells array<string>"
_TAG = re.compile(r"\{[^}]*\}")


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _TAG.sub("", t.tag) == "t")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _first_sheet(z: zipfile.ZipFile, names: set[str]) -> str | None:
    """The part of the sheet that the workbook lists first; without a list that of the least number."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        to = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
            if _TAG.sub("", x.tag) == "sheet":
                target = to.get(next((v for k, v in x.items() if _TAG.sub("", k) == "id" and k != "id"), None), "")
                part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if part in names:
                    return part
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]), default=None)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet as texts; gaps are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = _first_sheet(z, names)
        if sheet is None:
            return
        for _, row in ElementTree.iterparse(io.BytesIO(z.read(sheet))):
            if _TAG.sub("", row.tag) != "row":
                continue
            cells: list[str | None] = []
            for c in row:
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                value = next((x.text for x in c if _TAG.sub("", x.tag) == "v"), None)
                kind = c.get("t")
                cells.append(_texts(c) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value)
            yield cells
            row.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_no, cells`` of the first sheet of each workbook below a path; row 0 is the header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content, strict=True):
                rows = [(p.rsplit("/", 1)[-1], i, cells) for i, cells in enumerate(sheet_rows(content))]
                yield pd.DataFrame(rows, columns=["file", "row_no", "cells"])

    return files.mapInPandas(step, SCHEMA)


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _sheet(columns: list[str], rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        # characters that XML can't hold are left out
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(columns), *rows])
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'


def write_xlsx(sheets: dict[str, DataFrame], path: str, most_rows: int = 100_000) -> None:
    """One workbook with a sheet for each frame, in their order; a frame of more than ``most_rows`` rows fails, as a sheet is a report and is made in one place."""
    parts = []
    for name, df in sheets.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"more than {most_rows} rows in {name}")
        parts.append((name, _sheet(df.columns, [tuple(r) for r in rows])))
    listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(parts, 1))
    rels = "".join(f'<Relationship Id="r{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(parts) + 1))
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(parts) + 1))
    package = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{rels}</Relationships>')
        for k, (_, xml) in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", xml)
