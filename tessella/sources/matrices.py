"""Sparse matrices with tables of their rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sparse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A matrix as Parquet: ``entries`` (row, col, value, from 0), ``obs`` (row, ...) and ``var`` (col, ...).

    This is the columnar form of a single-cell container. An entry whose row or
    column has no description is an error, raised where it is met.
    """
    entries, obs, var = (spark.read.parquet(f"{path}/{name}") for name in ("entries", "obs", "var"))
    known = entries.join(obs.select("row", F.lit(True).alias("_r")), "row", "left").join(var.select("col", F.lit(True).alias("_c")), "col", "left")
    value = F.when(F.col("_r") & F.col("_c"), F.col("value")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no description of entry"), "row", "col")))
    return known.select("row", "col", value.alias("value")), obs, var


def write_sparse(entries: DataFrame, obs: DataFrame, var: DataFrame, path: str) -> None:
    """Write what :func:`read_sparse` reads; zeros are left out."""
    entries.filter("value <> 0").select("row", "col", "value").write.mode("overwrite").parquet(f"{path}/entries")
    obs.write.mode("overwrite").parquet(f"{path}/obs")
    var.write.mode("overwrite").parquet(f"{path}/var")


def from_h5ad(path: str):
    """``entries, obs, var`` of an HDF5 container as pandas tables, where h5py is installed; for files that fit on the driver."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 containers needs h5py") from e
    import numpy as np
    import pandas as pd

    with h5py.File(path) as f:
        x = f["X"]
        data, indices, indptr = x["data"][:], x["indices"][:], x["indptr"][:]
        rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
        text = lambda v: [s.decode() if isinstance(s, bytes) else s for s in v]
        tables = []
        for name, key in (("obs", "row"), ("var", "col")):
            group = f[name]
            columns = {}
            for c, v in group.items():
                if isinstance(v, h5py.Group) and "codes" in v:
                    columns[c] = np.asarray(text(v["categories"][:]), object)[v["codes"][:]]
                elif isinstance(v, h5py.Dataset):
                    columns[c] = text(v[:])
            tables.append(pd.DataFrame(columns).rename_axis(key).reset_index())
    return pd.DataFrame({"row": rows, "col": indices, "value": data}), *tables
