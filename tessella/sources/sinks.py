"""Writers: CSV with empty nulls and fixed number formats, JSON without non-finite numbers, Markdown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def formatted(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Columns as text in a ``printf`` format; null stays null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))) for c, f in formats.items()})


def write_csv(df: DataFrame, path: str, formats: Mapping[str, str] | None = None, sep: str = ",", one_file: bool = True, bom: bool = False) -> None:
    """CSV with a header, columns in order, nulls as empty fields. One file is for results of bounded size.

    With ``bom`` the header begins with a byte order mark, which some programs
    need to read UTF-8.
    """
    out = formatted(df, formats or {})
    if bom:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, sep=sep, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str, one_file: bool = True) -> None:
    """JSON lines; a number that is not finite is an error, raised by the task that meets it. One file is for results of bounded size."""
    checked = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            x = F.col(f.name)
            checked[f.name] = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit(f"{f.name} is not finite"))).otherwise(x)
    out = df.withColumns(checked) if checked else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A bounded result as a Markdown table."""
    lines = [" | ".join(df.columns), "|".join(["---"] * len(df.columns))]
    body = [" | ".join("" if v is None else str(v) for v in r) for r in df.limit(most).collect()]
    return "\n".join([f"| {lines[0]} |", f"|{lines[1]}|", *[f"| {b} |" for b in body]])


def write_twins(df: DataFrame, csv_path: str, json_path: str) -> None:
    """The same rows as CSV with a byte order mark and as JSON, computed once."""
    kept = df.persist()
    try:
        write_csv(kept, csv_path, bom=True)
        write_json(kept, json_path)
    finally:
        kept.unpersist()
