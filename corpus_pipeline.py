"""The corpus pipeline: toxicity, exact duplicates, near duplicates, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, and the last returns the chosen documents with their number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import read, stage
from kinspan.llm.decontamination import contaminated
from kinspan.llm.exact_dedup import exact_duplicates
from kinspan.llm.minhash_dedup import near_duplicates
from kinspan.llm.mixing import mix, target_weights
from kinspan.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text_hash are in `dropped`; a row without doc_id stays."""
    gone = dropped.select("doc_id", "text_hash").filter("doc_id is not null").distinct()
    hashed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    return hashed.join(gone, ["doc_id", "text_hash"], "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; empty and null texts score low and stay."""
    carried = [c for c in COLUMNS if c != "doc_id"]
    return score_toxicity(docs, read(spark, sf_dir, "labels"), carry=carried).filter("predicted = 0").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): that with the smallest doc_id.

    All empty and null texts are one group. Rows that repeat doc_id and text are one row after this. Of groups without
    any doc_id all rows stay.
    """
    found = stage(exact_duplicates(docs), "exact")
    kept = _without(docs, found.filter("not kept"))
    # rows that share the smallest doc_id of their group, if there are any
    twice = found.filter("kept and doc_id is not null").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not twice.limit(1).count():
        return kept
    again = kept.withColumn("text_hash", F.xxhash64("text")).join(found.join(twice, ["doc_id", "text_sha256"]).select("doc_id", "text_hash", "text_sha256").distinct(), ["doc_id", "text_hash"], "left")
    one = again.filter("text_sha256 is not null").dropDuplicates(["doc_id", "text_sha256"])
    return again.filter("text_sha256 is null").unionByName(one).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, similarity 0.8): that with the smallest doc_id.

    Texts without words are linked with nothing and stay, and so do rows without doc_id.
    """
    return _without(docs, near_duplicates(docs, width=5, percent=80).filter("not kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without doc_id stay."""
    return _without(docs, stage(contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id", "text_hash"), "leaks"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights choose, with their tokens and number of copies; those without words go."""
    return mix(docs, weights=target_weights(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL cannot express the learned toxicity score nor the sketches; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage_function in STAGES:
        docs = stage(stage_function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
