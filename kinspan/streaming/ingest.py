"""The record pipeline as a file-source stream: new TSV parts in, processed Parquet out, exactly once by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinspan.operators.records import RAW, process


def stream_raw(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Rows of headerless tab-separated files as they arrive."""
    cells = F.split("value", "\t", len(RAW))
    lines = spark.readStream.text(folder)
    return lines.select(F.lit(source).alias("source"), *[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(RAW)])


def run_stream(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a restart goes on where the last run ended."""
    return process(raw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
