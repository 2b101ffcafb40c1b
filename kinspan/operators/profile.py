"""Profiling, audits and samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import text as T
from kinspan.functions.digest import Tails
from kinspan.operators.blocking import PAIR

#: Tasks a core that the blocks of hard negatives are dealt to: their costs differ.
BLOCK_TASKS = 8


def nearest_quantiles(df: DataFrame, by: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """By group, the value at the index nearest to q * (n - 1) of each quantile, exact; nulls are left out.

    Values are counted first, so what is sorted are a group's distinct values, not its rows.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    last = F.sum("rows").over(all_.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"n": F.sum("rows").over(all_), "last": last})
    at = {k: F.rint((F.col("n") - 1) * F.lit(q)) for k, q in quantiles.items()}
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("last") > v, F.col("value"))).alias(k) for k, v in at.items()])


def raw_source(df: DataFrame) -> DataFrame:
    """One row a source: counts, repeated ids, missing values, lengths, words, distinct and non-ASCII names."""
    name, addr = F.col("business_name"), F.col("business_address")
    length, words = F.length(name), F.size(F.split(T.squeeze(F.coalesce(name, F.lit(""))), " "))
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count(F.lit(1)), 6)
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count_distinct("entity_id")).alias("repeated_ids"),
        pct(T.blank(name)).alias("missing_name_pct"),
        pct(T.blank(addr)).alias("missing_address_pct"),
        F.count_distinct("country").alias("countries"),
        F.min(length).alias("name_least"),
        F.round(F.avg(length), 6).alias("name_mean"),
        F.percentile(length, F.lit(0.5)).alias("name_median"),
        F.max(length).alias("name_most"),
        F.round(F.avg(words), 6).alias("name_words_mean"),
        F.count_distinct(name).alias("distinct_names"),
        pct(name.rlike(r"[^\x00-\x7F]")).alias("non_ascii_name_pct"),
    )


def processed_source(df: DataFrame) -> DataFrame:
    """One row a source: scripts, changed names, and how far distinct names shrink by normalisation."""
    raw, norm = F.col("business_name"), F.col("business_name_normalized")
    d_raw, d_norm = F.count_distinct(raw), F.count_distinct(norm)
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("business_name_script") == "Latin").alias("latin_names"),
        F.count_if(F.col("business_name_script") == "Mixed").alias("mixed_names"),
        F.count_if(norm.isNotNull() & (norm != raw)).alias("changed_names"),
        F.count_if(F.col("business_address_normalized").isNotNull() & (F.col("business_address_normalized") != F.col("business_address"))).alias("changed_addresses"),
        d_raw.alias("distinct_raw"),
        d_norm.alias("distinct_normalized"),
        F.round(100.0 * (d_raw - d_norm) / F.greatest(d_raw, F.lit(1)), 6).alias("compression_pct"),
        F.count_distinct(F.concat_ws("||", norm, F.col("country_normalized"))).alias("distinct_name_country"),
    )


def distribution(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """value, rows and percent of a column, most frequent first if only n are wanted."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(total))
    out = out.select("value", "rows", F.round(100.0 * F.col("rows") / F.col("total"), 6).alias("pct"))
    return out if n is None else out.orderBy(F.desc("rows"), "value").limit(n)


def truth_cardinality(truth: DataFrame) -> DataFrame:
    """match_count (of the comma list as it stands), entities and percent."""
    text = F.trim(F.coalesce("matched_entity_ids", F.lit("")))
    return distribution(truth.select(F.when(text == "", 0).otherwise(F.size(F.split(text, ","))).alias("n")), "n").withColumnsRenamed({"value": "match_count", "rows": "entities"})


def source_overlap(exploded: DataFrame) -> DataFrame:
    """How many entities match both other sources or only one."""
    by = exploded.groupBy(PAIR[0]).agg(F.collect_set("target_source").alias("s"))
    two, three = F.array_contains("s", "source2"), F.array_contains("s", "source3")
    return by.agg(F.count_if(two & three).alias("both"), F.count_if(two & ~three).alias("only_source2"), F.count_if(three & ~two).alias("only_source3"))


def token_audit(df: DataFrame, n: int = 200) -> DataFrame:
    """The most frequent name tokens and trailing token pairs."""
    tokens = F.col("business_name_tokens")
    one = df.select(F.lit("token").alias("kind"), F.explode(tokens).alias("value"))
    last = df.filter(F.size(tokens) >= 2).select(F.lit("last_two").alias("kind"), F.array_join(F.slice(tokens, F.lit(-2), F.lit(2)), " ").alias("value"))
    count = lambda d: d.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)
    return count(one).unionByName(count(last))


def column_types(df: DataFrame) -> DataFrame:
    """column, type (integer, float, string, empty) of string columns, and empty values."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("v")) for c in df.columns]))
    v = F.col("r.v")
    whole, number = v.rlike(r"^\d+$"), v.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")
    kinds = df.select(rows.alias("r")).groupBy(F.col("r.column").alias("column")).agg(F.count_if(v == "").alias("empty"), F.count_if(v != "").alias("n"), F.count_if(whole).alias("w"), F.count_if(number).alias("f"))
    kind = F.when(F.col("n") == 0, "empty").when(F.col("w") == F.col("n"), "integer").when(F.col("f") == F.col("n"), "float").otherwise("string")
    return kinds.select("column", kind.alias("type"), "empty")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by md5(seed|key): the same on any engine."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def every(df: DataFrame, key: str, step: int) -> DataFrame:
    """Every step-th row by key, from the first: ranks within ranges of the key, and the rows of all ranges before."""
    if step < 1:
        raise ValueError(f"a step of at least 1 is wanted: {step}")
    ranged = df.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id())
    inside = ranged.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    # a row for each partition
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return inside.join(F.broadcast(before), "part").filter((F.col("before") + F.col("row") - 1) % step == 0).select(*df.columns)


def _least_of_blocks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """For each source1 entity of a block (ones: id, true; others: id, source), its least pair by md5."""

    def part(x: str | None) -> bytes:  # a null is left out, as concat_ws does
        return b"" if x is None else b"|" + x.encode()

    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            ones, others = one.column("ones")[0].as_py(), one.column("others")[0].as_py()
            others.sort(key=lambda x: (x["id"] is not None, x["id"] or "", x["source"]))
            places: dict[str, list[int]] = {}
            for i, x in enumerate(others):
                places.setdefault(x["id"], []).append(i)
            tails, found = Tails([part(x["id"]) for x in others]), []
            for x in ones:
                least = tails.least(f"{seed}".encode() + part(x["id"]), [i for t in x["true"] or () if t is not None for i in places.get(t, ())])
                if least is not None:
                    found.append((x["id"], {"md5": least[0].hex(), "id": others[least[1]]["id"], "source": others[least[1]]["source"]}))
            b = pa.struct([("md5", pa.string()), ("id", pa.string()), ("source", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], b)], names=[PAIR[0], "b"])


def hard_negatives(processed: DataFrame, truth: DataFrame, least: int = 4, chunk: int = 8192, seed: int = 42) -> DataFrame:
    """One non-matching candidate for each source1 entity with a country and a longer name token in common: the least by md5 of the pair.

    Entities of a token meet as arrays, of about `chunk` candidates and a sixteenth as many source1 entities, dealt by
    hash; each two arrays are hashed at once in NumPy, so no row a pair is made. The hashing itself still grows with the
    square of a token's entities.
    """
    tokens = F.array_distinct(F.filter(F.coalesce("business_name_tokens", F.array().cast("array<string>")), lambda t: F.length(t) >= least))
    long = processed.select("source", "entity_id", "country_normalized", F.explode(tokens).alias("token"))
    by = ["country_normalized", "token"]
    true = truth.groupBy(PAIR[0]).agg(F.collect_set(PAIR[1]).alias("true"))

    def dealt(rows: DataFrame, most: int, entity: Column, name: str) -> DataFrame:
        sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / max(most, 1)).alias("chunks"))
        return rows.join(sizes, by).groupBy(*by, F.pmod(F.xxhash64("id"), F.col("chunks")).alias("part")).agg(F.collect_list(entity).alias(name)).drop("part")

    one = long.filter("source = 'source1'").select(*by, F.col("entity_id").alias("id")).join(true.withColumnRenamed(PAIR[0], "id"), "id", "left")
    two = long.filter("source <> 'source1'").select(*by, F.col("entity_id").alias("id"), "source")
    blocks = dealt(one, chunk // 16, F.struct("id", "true"), "ones").join(dealt(two, chunk, F.struct("id", "source"), "others"), by).select("ones", "others")
    tasks = BLOCK_TASKS * processed.sparkSession.sparkContext.defaultParallelism
    found = blocks.repartition(tasks).mapInArrow(lambda batches: _least_of_blocks(batches, seed), f"{PAIR[0]} string, b struct<md5: string, id: string, source: string>")
    best = found.groupBy(PAIR[0]).agg(F.min("b").alias("b"))
    return best.select(PAIR[0], F.col("b.id").alias(PAIR[1]), F.col("b.source").alias(PAIR[2]))


def transliteration_audit(df: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """Of a sample of texts (key, text, output): residual Indic characters, empty and unchanged outputs."""
    rows = sample(df.filter(F.col("text").rlike(r"[\x{0900}-\x{0D7F}]")), "key", n, seed)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("output").rlike(r"[\x{0900}-\x{0D7F}]")).alias("residual"), F.count_if(T.blank(F.col("output"))).alias("empty"), F.count_if(F.col("output") == F.col("text")).alias("unchanged"))
