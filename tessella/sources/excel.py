"""Workbooks (xlsx) as wide tables: each file is read in a task, its header row found by a name that it must hold.

Cells come as text: numbers as the file has them, cells with a date format as ISO dates (with the time, if there is one), truth as TRUE and FALSE.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import register_reader

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _place(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


# fixed values: numbers of the built-in formats that show a date
_BUILT_IN = {*range(14, 18), 22, *range(27, 37), *range(50, 59)}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date: built-in formats, and own ones with a year, month or day outside of quotes and brackets."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower() for f in root.iter(f"{_NS}numFmt")}
    shows = lambda n: bool(re.search(r"[yd]|m(?!.*:)", own[n])) and "general" not in own[n] if n in own else n in _BUILT_IN
    styles = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if shows(int(x.get("numFmtId", 0)))}


def _from_1904(z: zipfile.ZipFile) -> bool:
    if "xl/workbook.xml" not in z.namelist():
        return False
    setting = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}workbookPr")
    return setting is not None and setting.get("date1904", "") in ("1", "true")


def serial_date(text: str, from_1904: bool = False) -> str:
    """A day number as ISO text. Days before March 1900 are one off, as the format counts a 29 February 1900."""
    days = float(text)
    at = (dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30 if days >= 60 else 31)) + dt.timedelta(seconds=round(days * 86400))
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat(" ")


def sheet_rows(content: bytes, sheet: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of a sheet, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        dates, from_1904, number = _date_styles(z), _from_1904(z), 0
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    at = _place(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is not None and c.get("t") == "s":
                        cells[at] = shared[int(v.text)]
                    elif v is not None and c.get("t") == "b":
                        cells[at] = "TRUE" if v.text == "1" else "FALSE"
                    elif v is not None and c.get("t", "n") == "n" and int(c.get("s", -1)) in dates:
                        cells[at] = serial_date(v.text, from_1904)
                    elif v is not None:
                        cells[at] = v.text
                number = int(row.get("r")) if row.get("r") else number + 1
                yield number, cells
                row.clear()


def read_excel(spark: SparkSession, path: str, header: str = "Symbol", sheet: int = 1) -> DataFrame:
    """All columns as text, of the rows below the first that holds the cell `header`; columns without a name go. Files must share their header."""

    def parse(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                rows = list(sheet_rows(bytes(content), sheet))  # a sheet has a million rows at most
                yield pd.DataFrame({"path": name, "row": [r for r, _ in rows], "cells": [c for _, c in rows]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row long, cells array<string>")
    heads = rows.filter(F.array_contains("cells", header)).groupBy("path").agg(F.min(F.struct("row", "cells")).alias("head"))
    first = heads.orderBy("path").first()
    if first is None:
        raise ValueError(f"no row with {header} in {path}")
    below = rows.join(F.broadcast(heads.select("path", F.col("head.row").alias("head"))), "path").filter("row > head")  # a row per file
    return below.select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(first["head"]["cells"]) if c])


register_reader("excel", lambda spark, f: read_excel(spark, f.table))
