"""Readers of containers that need Python: tar archives and workbooks.

Each file is one row of Spark's binary reader and is opened in a worker; many
files are read in parallel.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_tar(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """``file, member, content`` of the members whose names match."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and re.fullmatch(pattern, m.name):
                            yield pd.DataFrame({"file": [file], "member": [m.name], "content": [tar.extractfile(m).read()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "file string, member string, content binary")


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(content: bytes, sheet: str) -> list[tuple[int, int, str | None, bool, bool]]:
    """Cells of a workbook's sheet: row and column from 0, text, whether it is a formula's, whether its row or column is hidden."""
    book = zipfile.ZipFile(io.BytesIO(content))
    tree = lambda name: ElementTree.fromstring(book.read(name))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in tree("xl/sharedStrings.xml").iter(f"{_MAIN}si")]
    ids = {s.get("name"): s.get(f"{_REL}id") for s in tree("xl/workbook.xml").iter(f"{_MAIN}sheet")}
    if sheet not in ids:
        raise ValueError(f"no sheet {sheet}")
    target = next(r.get("Target") for r in tree("xl/_rels/workbook.xml.rels") if r.get("Id") == ids[sheet])
    root = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    hidden = {k for c in root.iter(f"{_MAIN}col") if c.get("hidden") in ("1", "true") for k in range(int(c.get("min")) - 1, int(c.get("max")))}
    out = []
    for row in root.iter(f"{_MAIN}row"):
        row_hidden = row.get("hidden") in ("1", "true")
        for cell in row.iter(f"{_MAIN}c"):
            letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            value = cell.find(f"{_MAIN}v")
            if cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif value is None:
                text = None
            else:
                text = shared[int(value.text)] if cell.get("t") == "s" else value.text
            column = _number(letters)
            out.append((int(digits) - 1, column, text, cell.find(f"{_MAIN}f") is not None, row_hidden or column in hidden))
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """Cells of a sheet in long form: ``file, row, col, text, formula, hidden``."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                found = pd.DataFrame(sheet_cells(content, sheet), columns=["row", "col", "text", "formula", "hidden"])
                found.insert(0, "file", file)
                yield found

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "file string, row int, col int, text string, formula boolean, hidden boolean")


def sheet_table(cells: DataFrame, columns: list[str], header_row: int = 0) -> DataFrame:
    """Rows below a header as a table of the named columns; a hidden or computed cell in them is an error."""
    head = cells.filter(F.col("row") == header_row).select("file", "col", F.trim("text").alias("name"))
    body = cells.filter(F.col("row") > header_row).join(head, ["file", "col"])
    own = body.filter(F.col("name").isin(columns))
    checked = F.when(F.col("hidden") | F.col("formula"), F.raise_error(F.concat(F.lit("hidden or computed cell in "), F.col("name")))).otherwise(F.col("text"))
    return own.withColumn("text", checked).groupBy("file", "row").pivot("name", columns).agg(F.first("text"))
