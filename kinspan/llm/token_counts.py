"""Token counts as a rollup that is maintained by deltas.

A change is a document with a sign: +1 inserts it, -1 deletes it (with the text it had), a revision is both. A batch of
changes is counted, summed by source, language and tokenizer version, and written aside; a rename that fails if the
batch id is there makes it visible at once. So a batch id counts once, whoever commits it and however often, and a commit
that was cut short leaves nothing. Totals are sums, so batches may come in any order; compact() folds committed batches
into one base table with their ids, so reading doesn't follow the number of batches.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import WS, read, shared_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bound of a vocabulary file, which goes to the driver and from there to each task.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: the pattern that splits text before the merges of this public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer_version")


def _counts(vocabulary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(n, pa.int64())], [*names, "n_tokens"])

    return run


class Rollup:
    """Totals of documents and tokens in a folder that driver and executors share: a folder for each batch, and bases."""

    SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, folder: str, vocabulary: str = VOCABULARY) -> None:
        self.spark, self.folder, self.vocabulary = spark, folder.rstrip("/"), vocabulary
        self.version = vocabulary.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        if not self._fs().exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(""))]
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def _publish(self, name: str, as_name: str) -> bool:
        """Rename a finished folder; False, and the folder is gone, if the other name is taken."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().makeQualified(self._path("")).toUri(), conf)
        try:
            files.rename(self._path(name), self._path(as_name), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Py4JJavaError as error:
            if not self._fs().exists(self._path(as_name)):
                raise error
            self._fs().delete(self._path(name), True)
            return False

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches in it."""
        bases = self._names("base-")
        if not bases:
            return None, set()
        ids = self.spark.read.schema("batch string").parquet(f"{self.folder}/base-{bases[-1]}/batches").collect()
        return bases[-1], {r[0] for r in ids}

    def committed(self) -> list[str]:
        return sorted({*self._names("batch-"), *self._base()[1]})

    def _ranks(self) -> bytes:
        file = self.spark.read.format("binaryFile").load(self.vocabulary).filter(F.col("length") <= VOCABULARY_BYTES).select("content").first()
        if file is None:
            raise ValueError(f"a vocabulary of at most {VOCABULARY_BYTES} bytes is wanted: {self.vocabulary}")
        return bytes(file[0])

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes (sign, source, lang, text); False if that id is there already.

        A null source or lang is a group of its own, a null text has no tokens, a null sign or one of 0 changes nothing.
        Other columns are ignored. An empty batch is committed and adds nothing.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        signed = changes.select(F.coalesce(F.col("sign").cast("long"), F.lit(0)).alias("sign"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").filter("sign <> 0")
        counted = signed.mapInArrow(_counts(self._ranks()), "sign long, source string, lang string, n_tokens long")
        deltas = counted.groupBy("source", "lang").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        aside = f"_aside-{uuid.uuid4().hex}"
        deltas.withColumn("tokenizer_version", F.lit(self.version)).select(*KEYS, "n_docs", "n_tokens").write.parquet(f"{self.folder}/{aside}")
        return self._publish(aside, f"batch-{batch_id}")

    def _rows(self) -> tuple[DataFrame, set[str]]:
        base, folded = self._base()
        names = [f"{self.folder}/batch-{n}" for n in self._names("batch-") if n not in folded] + ([f"{self.folder}/base-{base}/totals"] if base is not None else [])
        rows = self.spark.read.schema(self.SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), folded

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups whose changes cancel out are left out."""
        return self._rows()[0].filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new base. Their folders go once the base is there; ids stay known."""
        ids = self.committed()
        base = self._base()[0]
        aside, name = f"_aside-{uuid.uuid4().hex}", f"{int(base or 0) + 1:08d}"
        self._rows()[0].write.parquet(f"{self.folder}/{aside}/totals")
        self.spark.createDataFrame([(i,) for i in ids], "batch string").write.parquet(f"{self.folder}/{aside}/batches")
        if self._publish(aside, f"base-{name}"):
            for i in self._names("batch-"):
                if i in ids:
                    self._fs().delete(self._path(f"batch-{i}"), True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the whole table, after drafts of its texts in one line each were loaded and revised to what they are.

    The revision (-1 draft, +1 text, where they differ) comes before the load that it revises, and the load comes twice.
    """
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    rollup._fs().deleteOnExit(rollup._path(""))  # this query's rollup is of one use
    docs = read(spark, sf_dir, "documents").select("source", "lang", "text")
    draft = docs.withColumn("draft", F.regexp_replace("text", f"{WS}+", " "))
    both = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("draft").alias("text")), F.struct(F.lit(1).alias("sign"), F.col("text").alias("text"))))
    rollup.commit("revision", draft.filter("draft <> text").select("source", "lang", both.alias("c")).select("source", "lang", "c.*"))
    load = draft.select("source", "lang", F.col("draft").alias("text"), F.lit(1).alias("sign"))
    rollup.commit("load", load)
    rollup.compact()
    rollup.commit("load", load)
    return rollup.totals()
