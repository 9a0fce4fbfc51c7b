"""Coercion of text fields: numbers, units, booleans, labels, and column resolution.

All casts are tolerant: what cannot be read is null, never an error, and a
number that is not finite is null as well.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def normal_name(name: str, mark: str = "") -> str:
    """A field name in lower case with runs of other than letters and digits as ``mark``."""
    return re.sub(r"[^a-z0-9]+", mark, name.strip("﻿ ").lower()).strip(mark or None)


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], mode: str = "alias") -> DataFrame:
    """Select fields by name.

    ``exact``: the header must be the keys, in order. ``required``: the keys
    must be there; others stay. ``alias``: each key takes the first column
    whose normalised name is one of its aliases'; a field without one is null.
    """
    if mode == "exact":
        if df.columns != list(aliases):
            raise ValueError(f"header {df.columns} is not {list(aliases)}")
        return df
    if mode == "required":
        if missing := [k for k in aliases if k not in df.columns]:
            raise ValueError(f"missing columns {missing}")
        return df
    by_name = {normal_name(c): c for c in reversed(df.columns)}
    picked = []
    for key, names in aliases.items():
        own = [by_name[n] for n in map(normal_name, [key, *names]) if n in by_name]
        picked.append((F.col(f"`{own[0]}`") if own else F.lit(None).cast("string")).alias(key))
    return df.select(*picked)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def finite(x: Column) -> Column:
    """The number itself, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(text: Column) -> Column:
    """A finite double; thousands commas are dropped, null for anything else."""
    return finite(F.regexp_replace(F.trim(text.cast("string")), ",", "").try_cast("double"))


def integer(text: Column) -> Column:
    """The first whole number in a text."""
    return F.regexp_extract(text, r"([-+]?\d+)", 1).try_cast("long")


def with_unit(text: Column, units: Mapping[str, float]) -> Column:
    """A number times the factor of the unit that follows it, in any case; without a unit times one."""
    value = F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, rf"{NUMBER}\s*([A-Za-z]+)", 1))
    factor = F.lit(1.0)
    for name, x in units.items():
        factor = F.when(unit == name.lower(), F.lit(float(x))).otherwise(factor)
    return finite(value * factor)


def fraction(text: Column) -> Column:
    """A share between 0 and 1: a percent sign, or a value from above 1 to 100, is divided by 100."""
    value = F.regexp_extract(text, f"({NUMBER})", 1).try_cast("double")
    return F.when(text.contains("%") | ((value > 1) & (value <= 100)), value / 100).otherwise(value)


#: Spellings of truth.
TRUE, FALSE = ("true", "t", "yes", "y", "1", "pass", "ok"), ("false", "f", "no", "n", "0", "fail")


def boolean(text: Column) -> Column:
    """True, false, or null for spellings that are neither."""
    own = F.lower(F.trim(text.cast("string")))
    return F.when(own.isin(*TRUE), True).when(own.isin(*FALSE), False)


def label(text: Column, aliases: Mapping[str, Sequence[str]], other: str | None = None) -> Column:
    """The canonical label one of whose aliases a text's normalised form is."""
    own = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    out = F.lit(other)
    for name, spellings in reversed(aliases.items()):
        out = F.when(own.isin(*{normal_name(s) for s in [name, *spellings]}), F.lit(name)).otherwise(out)
    return out


def chromosome(text: Column) -> Column:
    """A chromosome's bare name: no ``chr``, ``M`` for the mitochondrial one."""
    bare = F.regexp_replace(F.trim(text), "(?i)^chr", "")
    return F.when(F.upper(bare) == "MT", "M").otherwise(F.upper(bare))


def near(a: Column, b: Column, rel: float = 0.0, tol: float = 0.0) -> Column:
    """Whether two numbers agree within a relative and an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(float(rel)) * F.greatest(F.abs(a), F.abs(b)), F.lit(float(tol)))


def written_tolerance(text: Column) -> Column:
    """Half a unit, and a little, of the last decimal place that a number is written with."""
    places = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    return 0.500001 * F.pow(F.lit(10.0), -places)


def bucket(x: Column, width: float, origin: float = 0) -> Column:
    """The start of the fixed-width bucket that holds ``x``."""
    return F.floor((x - origin) / width) * width + origin


def round_half_up(x: Column, unit: float) -> Column:
    """The nearest multiple of ``unit``; halves go up."""
    return F.floor(x / unit + 0.5) * unit


def ratio_text(text: Column) -> Column:
    """``n/m`` as a number; null if it is no ratio or ``m`` is 0."""
    return F.try_divide(F.regexp_extract(text, r"^\s*(\d+)\s*/\s*\d+\s*$", 1).try_cast("double"), F.regexp_extract(text, r"^\s*\d+\s*/\s*(\d+)\s*$", 1).try_cast("double"))


def rejections(**reasons: Column) -> Column:
    """The names of those conditions that hold, sorted; null conditions don't."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in reasons.items()])))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with none of ``columns`` null, and one row of how often each is."""
    return df.na.drop(subset=list(columns)), df.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])
