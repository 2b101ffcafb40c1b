"""From scored pairs (PAIR, probability) to linkages and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspan.operators.blocking import PAIR


def mark_pairs(scored: DataFrame, threshold: float, margin: float | None = None, top_k: int | None = None) -> DataFrame:
    """Adds `accepted`: threshold, then margin against the entity's best of all sources, then the best top_k of each source."""
    good = F.coalesce(F.col("probability") >= threshold, F.lit(False))
    marked = scored.withColumn("accepted", good)
    if margin is not None:
        best = F.max(F.when(F.col("accepted"), F.col("probability"))).over(Window.partitionBy(PAIR[0]))
        marked = marked.withColumn("best", best).withColumn("accepted", F.col("accepted") & (F.col("probability") >= F.col("best") - margin)).drop("best")
    if top_k is not None:
        rank = F.row_number().over(Window.partitionBy(PAIR[0], PAIR[2]).orderBy(F.desc("accepted"), F.desc("probability"), PAIR[1]))
        marked = marked.withColumn("rank", rank).withColumn("accepted", F.col("accepted") & (F.col("rank") <= top_k)).drop("rank")
    return marked


def filter_pairs(scored: DataFrame, threshold: float, margin: float | None = None, top_k: int | None = None) -> DataFrame:
    """The pairs that mark_pairs accepts; those below the threshold go before anything is sorted."""
    return mark_pairs(scored.filter(F.col("probability") >= threshold), threshold, margin, top_k).filter("accepted").drop("accepted")


def linkages(accepted: DataFrame, entities: DataFrame) -> DataFrame:
    """Every source1 entity with its matches, best first, joined by commas; '' for none."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), F.col(PAIR[1]).alias("id"))))
    lists = accepted.groupBy(PAIR[0]).agg(F.array_join(F.transform(order, lambda x: x["id"]), ",").alias("matched_entity_ids"))
    return entities.select(PAIR[0]).distinct().join(lists, PAIR[0], "left").fillna({"matched_entity_ids": ""})


def diagnostics(marked: DataFrame, entities: DataFrame) -> DataFrame:
    """One row over pairs with `accepted`: entities by number of matches, accepted by source, probabilities of accepted and rejected pairs."""
    p, yes = F.col("probability"), F.col("accepted")
    of = {"accepted": F.when(yes, p), "rejected": F.when(~yes, p)}
    by = marked.groupBy(PAIR[0]).agg(F.count_if(yes).alias("n"))
    counts = entities.select(PAIR[0]).distinct().join(by, PAIR[0], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counts = counts.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") == 0).alias("zero"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    stats = marked.agg(
        F.count_if(yes & (F.col(PAIR[2]) == "source2")).alias("source2_accepted"),
        F.count_if(yes & (F.col(PAIR[2]) == "source3")).alias("source3_accepted"),
        F.count_if(~yes).alias("rejected"),
        *[F.round(f, 6).alias(f"{k}_{n}") for k, v in of.items() for n, f in (("least", F.min(v)), ("mean", F.avg(v)), ("median", F.percentile(v, F.lit(0.5))), ("std", F.stddev_pop(v)), ("most", F.max(v)))],
    )
    pct = {f"{c}_pct": F.round(100.0 * F.col(c) / F.greatest("entities", F.lit(1)), 6) for c in ("zero", "single", "multi")}
    # two frames of one row each
    return counts.join(F.broadcast(stats)).withColumns(pct)


def worst_errors(scored: DataFrame, threshold: float, n: int = 10) -> DataFrame:
    """The n most confident false positives and the n least confident false negatives; `scored` has label."""
    wrong = scored.filter((F.col("label") == 1) != (F.col("probability") >= threshold)).withColumn("kind", F.when(F.col("label") == 1, "false_negative").otherwise("false_positive"))
    worst = F.when(F.col("label") == 1, F.col("probability")).otherwise(-F.col("probability"))
    parts = [wrong.filter(F.col("kind") == k).orderBy(worst, *PAIR).limit(n) for k in ("false_negative", "false_positive")]
    return parts[0].unionByName(parts[1]).select("kind", *PAIR, "probability")
