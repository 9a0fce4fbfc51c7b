"""Session settings that the library's plans rely on."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "tessella", **conf: str) -> SparkSession:
    """A local session with adaptive execution and UTC; extra settings override."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder.

    Where executors have other disks, ship the package with ``--py-files``.
    """
    root, own = str(Path(__file__).parent.parent), spark.sparkContext.environment
    paths = own.get("PYTHONPATH", "").split(":")
    if root not in paths:
        own["PYTHONPATH"] = ":".join(filter(None, [root, *paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table of ``sf_dir`` as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of each application under the shared one.
_FOLDERS: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; in local mode that may be unset.

    It lies in a folder of this application, which is deleted when the driver
    ends, as results that read it end with the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tessella-scratch"
    own = f"{base.rstrip('/')}/tessella-{spark.sparkContext.applicationId}"
    if _FOLDERS.get(base) != own:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[base] = own
    return f"{own}/files-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file wherever Spark can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that what follows depends on files instead of on the plan."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task holds at most when rows are dealt out by a key.
_TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as a number of rows asks for; never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _TASK_ROWS))


def _tasks(df: DataFrame) -> int:
    return tasks_for(df.sparkSession, df.count())


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out by ``by`` over as many tasks as their number asks for, so that none holds more when the input grows."""
    return df.repartition(_tasks(df), *by)


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows dealt out in ranges of ``order``, as many as their number asks for, and sorted in each."""
    return df.repartitionByRange(_tasks(df), *order).sortWithinPartitions(*order)
