"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import json
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder that driver and executors share.

    The setting is read from the session. Only in local mode may it be unset;
    then a folder of this machine is chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tessella-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tessella-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


#: With this set, a statement's shuffle files are deleted when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    What follows then depends on files instead of on the plan, so a lost
    executor costs no recomputation and no branch is computed twice. The
    shuffle files of the write are deleted, as nothing needs them any more.
    """
    spark = df.sparkSession
    path = where or shared_dir(spark)
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`cut` wrote and nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Cuts:
    """The tables that an operator cuts on its way; they are deleted when the ``with`` block ends.

    What the operator returns must read none of them: its last step is
    :func:`cut` itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Cuts:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        self.paths[path] = None
        out = cut(df, path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete some of the tables before the end."""
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            del self.paths[path]
            remove(self.spark, path)

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove(self.spark, path)


#: 64-bit words of the filter that :func:`among` makes.
AMONG = 1 << 14


def long_array(values: list[int]) -> Column:
    """An array literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def among(place: list[str], rows: DataFrame) -> Column:
    """A condition that holds for all places in ``rows`` and for few others.

    It is a filter of 2^20 hashed bits, which goes with the plan. What passes
    it must be joined still; if it fills up, that join has more to do.
    """
    at = F.xxhash64(*place).bitwiseAND(F.lit(AMONG * 64 - 1)).cast("int")
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63))
    masks = rows.groupBy(word.alias("b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect()  # AMONG rows at most
    found = [0] * AMONG
    for b, bits in masks:
        found[b] = bits
    return F.getbit(F.get(long_array(found), word), bit) == 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, without copying, and n+1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), at


def blocks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows whose texts hold ``most`` bytes together at most; a longer text is a range of its own."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        out.append((first, last))
        first = last
    return out


#: Rows and bytes of text that go to a Python worker at once; the memory of a worker follows from them.
TEXT_ROWS, TEXT_BYTES = 1000, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of :data:`TEXT_ROWS` rows and :data:`TEXT_BYTES` bytes at most, as rows hold whole texts.

    The session keeps this, as it must hold when the result is computed; lower
    bounds stay as they are.
    """
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        plain = int(now) if now and re.fullmatch(r"-?[0-9]+", now) else 0  # others are written with a unit
        if plain <= 0 or plain > most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Return freed memory of this worker process to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
