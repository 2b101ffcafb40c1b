"""Tables written to the folder that driver and executors share, once for a state of their input."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Used only where spark.checkpoint.dir is unset and everything runs in one process, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/kinspan"

#: Folder and schema of the staged tables of this driver: by application, name, input path and the state of its files.
_STAGED: dict[tuple, tuple[str, StructType]] = {}


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or LOCAL_SHARED_DIR


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Number of files below a path, their bytes, and the latest time one was changed."""
    fs, at = file_system(spark, path)
    listed, n, size, latest = fs.listFiles(at, True), 0, 0, 0
    while listed.hasNext():
        s = listed.next()
        n, size, latest = n + 1, size + s.getLen(), max(latest, s.getModificationTime())
    return n, size, latest


def _write(df: DataFrame, name: str) -> str:
    """A new folder below the shared one with df in it; it goes when the driver ends."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    fs, at = file_system(spark, out)
    fs.deleteOnExit(at)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def staged(spark: SparkSession, name: str, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written when it is first asked for and again only if files below `path` have changed.

    The folder goes when the driver ends.
    """
    key = (spark.sparkContext.applicationId, name, path, state(spark, path))
    if key not in _STAGED:
        df = make()
        _STAGED[key] = _write(df, name), df.schema
    out, schema = _STAGED[key]
    return spark.read.schema(schema).parquet(out)


def forget() -> None:
    """Write staged tables anew from now on, as a measurement of their cost needs."""
    _STAGED.clear()
