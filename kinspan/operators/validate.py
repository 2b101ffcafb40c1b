"""Validation: predicates that raise on the driver or count violations in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.functions.text import blank
from kinspan.operators.blocking import PAIR
from kinspan.operators.features import FEATURES
from kinspan.operators.records import PROCESSED, RAW

# The id prefix of each source.
PREFIX = {"source1": "S1-", "source2": "S2-", "source3": "S3-"}
DERIVED = [c for c in PROCESSED if c not in ("source", *RAW)]


class ValidationError(ValueError):
    """Input that breaks a rule."""


class ReadOnlyViolationError(ValidationError):
    """Raw data was about to be opened for writing."""


def open_mode(mode: str) -> str:
    if mode not in ("r", "rt", "rb"):
        raise ReadOnlyViolationError(f"raw data is read-only, not {mode!r}")
    return mode


def headers(columns: list[str], required: list[str] = RAW) -> None:
    if lacking := [c for c in required if c not in columns]:
        raise ValidationError(f"columns lacking: {lacking}")


def bad_namespace(source: Column, entity_id: Column) -> Column:
    """True for an unknown source, and an id that is empty or lacks its source's prefix."""
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])[source]
    return prefix.isNull() | blank(entity_id) | ~F.coalesce(F.startswith(entity_id, prefix), F.lit(False))


def checked_namespace(df: DataFrame) -> DataFrame:
    """The same rows; the job fails at the first one that breaks the namespace rule."""
    message = F.concat(F.lit("bad entity id: "), F.coalesce("entity_id", F.lit("null")), F.lit(" in "), F.coalesce("source", F.lit("null")))
    checked = F.when(bad_namespace(F.col("source"), F.col("entity_id")), F.raise_error(message)).otherwise(F.col("entity_id"))
    return df.withColumn("entity_id", checked.cast("string"))


def canonical_at_ingest(df: DataFrame) -> None:
    if early := [c for c in DERIVED if c in df.columns]:
        raise ValidationError(f"derived columns at ingest: {early}")


def processed_output(df: DataFrame, source: str) -> DataFrame:
    """One row of counts that a sound output has at expected values."""
    address = F.col("business_address")
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("entity_id").alias("distinct_ids"),
        F.count_if(F.col("source") != source).alias("wrong_source"),
        F.count_if(~F.coalesce(F.startswith("entity_id", F.lit(PREFIX[source])), F.lit(False))).alias("wrong_prefix"),
        F.count_if(F.col("entity_id").isNull()).alias("null_ids"),
        F.count_if(address.isin("nan", "None", "null", "NaN")).alias("sentinel_addresses"),
        F.count_if(address.isNull()).alias("null_addresses"),
    )


def feature_frame(df: DataFrame) -> None:
    """Columns, order and types of a feature frame; ids present and pairs unique."""
    expected = [(c, "string") for c in PAIR] + [(n, {"byte": "tinyint", "short": "smallint"}.get(t, t)) for n, t in FEATURES.items()]
    if df.dtypes != expected:
        raise ValidationError(f"feature frame has {df.dtypes}")
    bad = F.lit(False)
    for c in PAIR:
        bad = bad | blank(F.col(c))
    if df.filter(bad).limit(1).count() or df.groupBy(*PAIR).count().filter("count > 1").limit(1).count():
        raise ValidationError("blank ids or repeated pairs")


def column_health(df: DataFrame) -> DataFrame:
    """column, nulls, nans and infinite values of each numeric column."""
    names = [n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("v")) for n in names]))
    return df.select(rows.alias("r")).groupBy(F.col("r.column").alias("column")).agg(F.count_if(F.col("r.v").isNull()).alias("nulls"), F.count_if(F.isnan("r.v")).alias("nans"), F.count_if(F.abs("r.v") == float("inf")).alias("infinite"))
