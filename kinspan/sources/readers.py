"""Readers: TSV with exact ragged-row rules, ground truth, Parquet parts; column pruning and pushdown stay with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.operators.records import RAW
from kinspan.operators.validate import PREFIX, ValidationError, checked_namespace, headers
from kinspan.sources.staging import file_system

# Texts that the profiling loader takes for nulls.
NULLS = ["", "NULL", "null", "None", "NaN"]


def dataset_path(spark: SparkSession, root: str, split: str, name: str) -> str:
    """The file of a split's source: in the split's folder, or beside it as older layouts have it; an error if neither is there."""
    tried = [f"{root}/{split}/{split}_{name}.tsv", f"{root}/{split}/{name}.tsv", f"{root}/{split}_{name}.tsv"]
    for path in tried:
        fs, at = file_system(spark, path)
        if fs.exists(at):
            return path
    raise ValidationError(f"none of these is there: {tried}")


def read_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """TSV without quoting: short rows are padded with '', overflow cells stay in the last column with their tabs.

    The first line of each file is its header; a later line equal to it is a row like others.
    """
    lines = spark.read.text(path)
    head = lines.limit(1).collect()
    names = [h.strip() for h in head[0][0].lstrip("\ufeff").split("\t")] if head else []
    headers(names, columns)
    cells = F.split("value", "\t", len(names))
    # the reader takes the header of each file away; a separator that no text holds leaves lines whole
    body = spark.read.csv(path, schema="value string", header=True, sep="\x01", quote="", escape="", comment="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", maxCharsPerColumn=-1, enforceSchema=True)
    return body.filter(F.trim("value") != "").select(*[F.coalesce(F.get(cells, F.lit(names.index(c))), F.lit("")).alias(c) for c in columns])


def read_quoted(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """TSV with double quotes, as the ingest reads by default: short rows are padded with '', cells beyond the header go."""
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", inferSchema=False, nullValue="\u0000", emptyValue="")
    df = df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])
    headers(df.columns, columns)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def read_source(spark: SparkSession, path: str, source: str, max_rows: int | None = None, quoted: bool = False) -> DataFrame:
    """source and RAW columns, ids stripped and checked against the source's namespace; other text stays raw."""
    df = (read_quoted if quoted else read_lines)(spark, path, RAW)
    df = df.withColumn("entity_id", F.trim("entity_id")).withColumn("source", F.lit(source)).select("source", *RAW)
    return checked_namespace(df if max_rows is None else df.limit(max_rows))


def read_truth(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Ground truth rows; with strict, an id that is no S1- id fails the job."""
    df = read_lines(spark, path, ["source1_entity_id", "matched_entity_ids"])
    key = F.trim("source1_entity_id")
    bad = F.when(~key.startswith("S1-"), F.raise_error(F.concat(F.lit("bad source1 id: "), key))).otherwise(key) if strict else key
    return df.withColumn("source1_entity_id", bad.cast("string"))


def load_raw(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Profiling loader: overflow cells are dropped and null texts become nulls."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE", inferSchema=False)
    df = df.select(*(columns or df.columns))
    df = df.select(*[F.when(~F.col(c).isin(NULLS), F.col(c)).alias(c) for c in df.columns])
    return df if limit is None else df.limit(limit)


def load_processed(spark: SparkSession, folder: str, source: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """All Parquet parts below a folder, or those named *_{source}_*; unknown columns are left out."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*_{source}_*.parquet" if source else "*.parquet")
    df = reader.parquet(folder)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def discover_parts(spark: SparkSession, folder: str) -> tuple[dict[str, list[str]], list[str]]:
    """Parquet files below a folder by source, and those that are out of place.

    The file's name tells the source, or else the folders above it. A file of which neither does, or of which they tell
    different sources, is out of place.
    """
    fs, at = file_system(spark, folder)
    listed, found, misplaced = fs.listFiles(at, True), {}, []
    top = fs.makeQualified(at).toString().rstrip("/")
    while listed.hasNext():
        path = listed.next().getPath().toString()
        if not path.endswith(".parquet"):
            continue
        *above, name = path[len(top) + 1 :].split("/")
        by_name = [s for s in PREFIX if s in name]
        by_folder = [s for part in reversed(above) for s in PREFIX if s in part]
        source = (by_name or by_folder or [None])[0]
        if source is None or (by_name and by_folder and by_name[0] != by_folder[0]):
            misplaced.append(path)
        else:
            found.setdefault(source, []).append(path)
    return {k: sorted(v) for k, v in sorted(found.items())}, sorted(misplaced)


def first_parts(spark: SparkSession, folder: str, n: int, source: str | None = None) -> DataFrame:
    """The first n part files by name."""
    files = sorted(load_processed(spark, folder, source).inputFiles())[:n]
    if not files:
        raise ValidationError(f"no parts in {folder}")
    return spark.read.parquet(*files)


def source_of_file(path: str) -> str:
    found = [s for s in ("source1", "source2", "source3") if s in path]
    if not found:
        raise ValidationError(f"no source in {path}")
    return found[0]


def from_file_name(df: DataFrame) -> DataFrame:
    """Adds the source that the name of a row's file holds."""
    return df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), "(source[123])", 1))
