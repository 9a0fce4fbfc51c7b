"""Checks of tables, documents and scripts."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, unique: Sequence[str] = (), complete: Sequence[str] = (), positive: Sequence[str] = ()) -> DataFrame:
    """How many rows break each rule: ``rule, n``, for rules that are broken."""
    one = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in complete],
        *[F.count_if(~F.coalesce(F.col(c) > 0, F.lit(False))).alias(f"not positive {c}") for c in positive],
        F.count(F.lit(1)).alias("rows"),
    )
    rules = [c for c in one.columns if c != "rows"]
    out = one.select(F.explode(F.array(F.struct(F.lit("").alias("rule"), F.lit(0).cast("long").alias("n")), *[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in rules])).alias("x")).select("x.*")
    if unique:
        twice = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"repeated {', '.join(unique)}").alias("rule"), "n")
        out = out.unionByName(twice)
    return out.filter("n > 0")


def demand(df: DataFrame, **rules: Column) -> DataFrame:
    """The same rows; a row that breaks a rule is an error with the rule's name, raised where it is met."""
    out = df
    for name, rule in rules.items():
        first = out.columns[0]
        out = out.withColumn(first, F.when(F.coalesce(rule, F.lit(False)), F.col(f"`{first}`")).otherwise(F.raise_error(F.lit(name))))
    return out


def bijection(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """One row: whether a table pairs ``n`` of ``a`` with ``n`` of ``b``, each once."""
    return df.agg(((F.count(F.lit(1)) == n) & (F.countDistinct(a) == n) & (F.countDistinct(b) == n)).alias("ok"))


def leaks(ids: DataFrame, labels: DataFrame, item: str, label: str, least: int = 3) -> DataFrame:
    """Ids that contain a label of at least ``least`` characters, whatever their case and marks. More than 10,000 distinct labels are an error."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    words = [r[0] for r in labels.select(bare(label)).distinct().filter(F.length(bare(label)) >= least).limit(10_001).collect()]
    if len(words) > 10_000:
        raise ValueError("more than 10,000 distinct labels")
    hit = F.filter(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), lambda w: F.contains(bare(item), w))
    return ids.withColumn("leaked", hit).filter(F.size("leaked") > 0)


def leaf_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Every leaf of JSON texts: ``key, path, name, value, number, inherited``.

    ``inherited`` is the nearest enclosing object's own text fields, as JSON;
    a number that is not finite, or a text that is no JSON, is a leaf named
    ``!`` with what is wrong as its value.
    """

    def walk(node, path, name, above):
        if isinstance(node, dict):
            own = above | {k: v for k, v in node.items() if isinstance(v, str)}
            for k, v in node.items():
                yield from walk(v, f"{path}.{k}", str(k), own)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, f"{path}[{i}]", name, above)
        elif isinstance(node, float) and not math.isfinite(node):
            yield path, "!", "not finite", None, json.dumps(above)
        else:
            number = float(node) if isinstance(node, (int, float)) and not isinstance(node, bool) else None
            yield path, name, None if node is None else str(node), number, json.dumps(above)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    out += [(k, *leaf) for leaf in walk(json.loads(t), "$", "", {})]
                except (TypeError, ValueError):
                    out.append((k, "$", "!", "no JSON", None, "{}"))
            yield pd.DataFrame(out, columns=["key", "path", "name", "value", "number", "inherited"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(leaves, f"key {kind}, path string, name string, value string, number double, inherited string")


def last_leaves(leaves: DataFrame) -> DataFrame:
    """One value for each document and name: that of the last path."""
    return leaves.filter("name <> '!'").groupBy("key", "name").agg(F.max_by("value", "path").alias("value"))


def labelled_after(features: DataFrame, labels: DataFrame, key: str, label: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores made without labels, then joined with them: ``score`` never sees the table of labels.

    A label that is among the features is an error.
    """
    if label in features.columns:
        raise ValueError(f"{label} is among the features")
    return score(features).join(labels.select(key, label), key)


_FACTS = "syntax_ok boolean, calls array<string>, strings array<string>, numbers array<double>, absolute_paths array<string>, tainted array<string>"


def _facts(source: str, secrets: Sequence[str], sinks: Sequence[str]) -> dict:
    empty = {"syntax_ok": False, "calls": [], "strings": [], "numbers": [], "absolute_paths": [], "tainted": []}
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return empty
    nodes = list(ast.walk(tree))
    name = lambda f: f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""
    values = [n.value for n in nodes if isinstance(n, ast.Constant)]
    strings = [v for v in values if isinstance(v, str)]
    tainted = set(secrets)
    names_in = lambda node: {n.id for n in ast.walk(node) if isinstance(n, ast.Name)} | {n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    grown = True
    while grown:  # what is assigned from a tainted name is tainted
        grown = False
        for n in nodes:
            value = getattr(n, "value", None)
            if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and value is not None and names_in(value) & tainted:
                for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    new = {x.id for x in ast.walk(target) if isinstance(x, ast.Name)} - tainted
                    tainted |= new
                    grown |= bool(new)
    reached = {name(n.func) for n in nodes if isinstance(n, ast.Call) and name(n.func) in sinks and any(names_in(a) & tainted for a in [*n.args, *(k.value for k in n.keywords)])}
    return {
        "syntax_ok": True,
        "calls": [name(n.func) for n in nodes if isinstance(n, ast.Call)],
        "strings": strings,
        "numbers": [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)],
        "absolute_paths": sorted({s for s in strings if s.startswith("/") and len(s) > 1 or s[1:3] == ":\\"}),
        "tainted": sorted(reached),
    }


def script_facts(scripts: DataFrame, source: str, secrets: Sequence[str] = (), sinks: Sequence[str] = ()) -> DataFrame:
    """Add ``facts`` of Python sources: whether they parse, what they call, their constants and absolute paths, and
    which of ``sinks`` are called with something that comes from ``secrets``. Sources are parsed, never run."""

    @F.pandas_udf(_FACTS)
    def facts(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_facts(s, secrets, sinks) for s in sources], columns=["syntax_ok", "calls", "strings", "numbers", "absolute_paths", "tainted"])

    return scripts.withColumn("facts", facts(source))


def artifact_ok(name: Column, content: Column) -> Column:
    """Whether a file's content is what its suffix says, by its first bytes or by parsing."""
    text = content.cast("string")
    return (
        F.when(name.endswith(".json"), F.try_parse_json(text).isNotNull())
        .when(name.endswith(".png"), F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A")
        .when(name.endswith(".svg"), text.contains("<svg"))
        .when(name.endswith(".csv") | name.endswith(".tsv"), F.size(F.split(F.regexp_replace(text, r"\s+$", ""), "\n")) >= 2)
        .otherwise(F.length(F.trim(text)) > 0)
    )
