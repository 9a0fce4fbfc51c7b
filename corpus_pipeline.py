"""From documents to token files, in five stages.

Each stage is a function of (spark, docs, sf_dir). Its result is written as a
table, and the next one reads that. All but the last return documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut
from tessella.llm.decontaminate import decontaminate
from tessella.llm.language_id import crc_fold, identify
from tessella.llm.mixing import mixed
from tessella.llm.near_dedup import without_near_copies
from tessella.llm.token_output import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence.

    Null texts and texts without a letter are rejected. Repeated rows are
    treated alike; an empty table gives no rows; extra columns are kept.
    """
    found = identify(docs, crc_fold(F.col("doc_id"), 5) != 0, keep=tuple(docs.columns))
    return found.filter(~F.col("rejected")).select(*[F.col(f"`kept_{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 of their five-word shingles, the row with the smallest id.

    Null ids come last, and rows are told apart by id and text, so a null or
    repeated id loses no text that is no copy. Null and empty texts are copies
    of each other. An empty table gives no rows; extra columns are kept.
    """
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Rows are told apart by their text alone, as that decides; so null and
    repeated ids are treated like others. Null and empty texts are clean. An
    empty table gives no rows; extra columns are kept.
    """
    # whole rows travel in one column, so that no name of theirs can clash
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text", F.struct("*").alias("row"))
    found = decontaminate(keyed.select("text_key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="text_key")
    dirty = found.filter("contaminated").select(F.col("doc_id").alias("text_key")).distinct()
    return keyed.join(dirty, "text_key", "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it.

    Null and empty texts have no words and are not taken; a null source is one
    source; repeated rows are interchangeable. An empty table gives no rows;
    extra columns are kept.
    """
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix stands in the token files.

    Null and empty texts hold the end id alone; null ids come first and repeated
    rows stand side by side. An empty table gives no rows; other columns go.
    """
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: Trained and hashed stages have no SQL form; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
