"""Exact duplicates by a heavy-hitter split.

The frequent-items sketch behind approx_top_k is the mergeable Misra-Gries summary: it keeps TRACKED counters, so any
digest with more than N / (0.75 * TRACKED) rows is among its items. The most frequent WINNERS items are counted exactly;
those that hold at least one row in SHARE are broadcast, and their rows are settled where they are read. All other
digests, of which none has more than about N / WINNERS rows, are summed up by a shuffle of ids and digests, and only
those of several rows are joined back. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import WS, read, stage

TRACKED, WINNERS, SHARE = 8192, 1000, 10_000


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Group texts that are equal once each run of ASCII white space is one space.

    Takes doc_id and text; other columns are ignored. Returns doc_id, keep_id (the group's smallest doc_id), group_size,
    kept (doc_id = keep_id), text_sha256 and text_hash (xxhash64 of the text as it is), a row for each row. A null text is empty. Of rows that repeat a text with
    the same doc_id all or none are kept. A row without doc_id stays only if its whole group has none (keep_id is null
    then). An empty table gives no rows.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"{WS}+", " ")
    digests = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64("text").alias("text_hash")), "digests")

    items = digests.selectExpr(f"inline(approx_top_k(text_sha256, {WINNERS}, {TRACKED}))").select(F.col("item").alias("text_sha256"))
    counted = digests.join(F.broadcast(items), "text_sha256").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    total = digests.count()
    winners = F.broadcast(stage(counted.filter(F.col("group_size") >= max(2, total // SHARE)), "winners"))

    hot = digests.join(winners, "text_sha256")
    rest = digests.join(winners, "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    cold = rest.join(groups, "text_sha256", "left").withColumns({"keep_id": F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least")), "group_size": F.coalesce("n", F.lit(1))})
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_hash"]
    return hot.select(*columns).unionByName(cold.select(*columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


OP3_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id is not distinct from min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""
