"""Sinks: numbered parts, refuse-to-overwrite features, read-through tables, dead letters, reports, a log of loaded batches.

All files are written by the Hadoop file system, so driver and executors see the same ones.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.operators.records import PROCESSED
from kinspan.sources.staging import file_system


def write_parts(df: DataFrame, folder: str, rows: int = 10_000, compression: str = "snappy", prefix: str | None = None) -> list[str]:
    """Parquet parts of at most `rows` rows; with `prefix` they are named {prefix}_part_00000.parquet and so on.

    Parts without rows are not kept. Returns the names of the parts.
    """
    df.write.option("maxRecordsPerFile", rows).option("compression", compression).mode("overwrite").parquet(folder)
    fs, at = file_system(df.sparkSession, folder)
    files = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet"))
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    if prefix is None:
        return files
    empty = {r[0] for r in df.sparkSession.read.parquet(folder).select(F.col("_metadata.file_name")).distinct().collect()}
    names = []
    for name in files:
        if name not in empty:
            fs.delete(path(at, name), False)
            continue
        names.append(f"{prefix}_part_{len(names):05d}.parquet")
        fs.rename(path(at, name), path(at, names[-1]))
    return names


def write_features(df: DataFrame, folder: str) -> None:
    """Fails if the folder is there."""
    df.write.mode("errorifexists").parquet(folder)


def cached(df: DataFrame, folder: str) -> DataFrame:
    """What the folder holds if it was written to its end, as the marker of Spark's commit tells; else df is written to it."""
    spark = df.sparkSession
    fs, marker = file_system(spark, f"{folder}/_SUCCESS")
    if not fs.exists(marker):
        df.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def split_bad(df: DataFrame, bad: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters with a reason."""
    marked = F.coalesce(bad, F.lit(False))
    return df.filter(~marked), df.filter(marked).withColumn("reason", reason)


def with_fallback(processed: DataFrame, raw: DataFrame, bad: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """All rows as processed records, and dead letters: a raw row that is bad stands with its raw columns and nothing derived."""
    good, letters = split_bad(raw, bad, reason)
    kept = processed.join(good.select("source", "entity_id"), ["source", "entity_id"], "left_semi").select(*PROCESSED)
    types = dict(processed.dtypes)
    bare = letters.select(*[F.col(c).cast(types[c]).alias(c) if c in raw.columns else F.lit(None).cast(types[c]).alias(c) for c in PROCESSED])
    return kept.unionByName(bare), letters


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, there whole or not at all."""
    fs, aside = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(file_system(spark, path)[1], False)
    fs.rename(aside, file_system(spark, path)[1])


def write_report(df: DataFrame, path: str) -> list[dict]:
    """Rows of a small report as JSON."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    write_text(df.sparkSession, path, json.dumps(rows, indent=2, default=str, ensure_ascii=False))
    return rows


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    write_text(df.sparkSession, path, f"# {title}\n\n{head}\n" + "".join("| " + " | ".join(map(str, r)) + " |\n" for r in df.collect()))


class LoadLog:
    """An incremental load: each batch is a folder of Parquet below one root, and counts from when Spark has committed it.

    Nothing is noted beside the data, so progress can't disagree with it: which batches are done, their rows and their
    input come from the folders themselves.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, batch: str, df: DataFrame, source: str, input_file: str) -> bool:
        """Write a batch unless it is there; one that was cut short is written anew."""
        folder = f"{self.root}/batch={batch}"
        fs, marker = file_system(self.spark, f"{folder}/_SUCCESS")
        if fs.exists(marker):
            return False
        stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        df.withColumns({"load_source": F.lit(source), "load_input": F.lit(input_file), "load_time": F.lit(stamp)}).write.mode("overwrite").parquet(folder)
        return True

    def done(self) -> list[str]:
        fs, at = file_system(self.spark, self.root)
        if not fs.exists(at):
            return []
        folders = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("batch=")]
        return sorted(p.getName().removeprefix("batch=") for p in folders if fs.exists(file_system(self.spark, f"{p.toString()}/_SUCCESS")[1]))

    def rows(self) -> DataFrame | None:
        """All rows of committed batches, None without any."""
        done = self.done()
        return self.spark.read.parquet(*[f"{self.root}/batch={b}" for b in done]) if done else None

    def progress(self) -> DataFrame:
        """load_source, load_input, load_time and rows of each batch that has rows."""
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], "load_source string, load_input string, load_time string, rows long")
        return rows.groupBy("load_source", "load_input", "load_time").agg(F.count(F.lit(1)).alias("rows"))
