"""Places that the driver and all executors share, and cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, in local mode (tests), a temporary one is set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not at and held.isDefined():
        return held.get()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="typolith-")
    if held.isEmpty():
        sc.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/typolith-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", instead_of: DataFrame | None = None) -> DataFrame:
    """The rows, written to the shared folder as Parquet and reread: later jobs neither recompute nor lose them.

    The files go when the driver ends.  A cut that stands in place of an earlier one, which nothing
    else reads, deletes that one's files once its own are written.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if instead_of is not None:
        drop_path(spark, instead_of.cut_path)
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    place, fs = _place(spark, path)
    fs.delete(place, True)


def packed(df: DataFrame, *drop: str) -> Column:
    """All columns of a row but some, as one column, so that no name of theirs can meet a name used within an operator."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns if c not in drop])
