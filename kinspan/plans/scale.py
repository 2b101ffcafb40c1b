"""Rates of the costly steps at several sizes, with the checks that a run at scale has to pass."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.functions.translit import transliterate
from kinspan.operators.blocking import PAIR
from kinspan.operators.features import feature_ranges, pair_features
from kinspan.operators.profile import transliteration_audit


def _timed(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def transliteration_rate(spark: SparkSession, texts: DataFrame, records: int) -> DataFrame:
    """One row: records, seconds, records a second, and residual, empty and unchanged outputs. `texts` (key, text) is repeated to `records` rows."""
    n = max(1, texts.count())
    copies = texts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(-(-records // n))))).limit(records)
    made = copies.select("key", "text", transliterate(F.col("text")).alias("output"))
    seconds = _timed(made)
    audit = transliteration_audit(made, records).first()
    row = (records, round(seconds, 3), round(records / max(seconds, 1e-9), 1), audit.residual, audit.empty, audit.unchanged)
    return spark.createDataFrame([row], "records long, seconds double, per_second double, residual long, empty long, unchanged long")


def feature_scale(pairs: DataFrame, represented: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each size: pairs, seconds, pairs a second, and features with nulls or values outside their domain."""
    rows = []
    for size in sizes:
        some = pairs.orderBy(F.md5(F.concat_ws("|", *PAIR)), *PAIR).limit(size)
        made = pair_features(some, represented)
        seconds, n = _timed(made), some.count()
        bad = feature_ranges(made).agg(F.count_if((F.col("nulls") > 0) | ~F.col("in_domain"))).first()[0]
        rows.append((n, round(seconds, 3), round(n / max(seconds, 1e-9), 1), bad))
    return pairs.sparkSession.createDataFrame(rows, "pairs long, seconds double, per_second double, bad_features long")
