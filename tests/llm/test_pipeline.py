"""Each stage of the pipeline against brute force on what the stage before it kept."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import pyarrow as pa
from kinspan.llm.common import fold_is
from kinspan.llm.mixing import OP6_SQL
from kinspan.llm.toxicity import THRESHOLD, fit
from pyspark.sql import functions as F

from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_learned import brute_score
from tests.llm.test_minhash_dedup import brute as brute_near

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "decontamination", "mixing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    kept = set(rows)

    def run(name):
        docs = spark.createDataFrame([rows[i] for i in sorted(kept)], table.schema)
        return stages[name](spark, docs, SF)

    learn = spark.read.parquet(f"{SF}/labels.parquet").filter(~fold_is(F.col("doc_id"), 4, 2)).select("doc_id", "toxic")
    model = fit(table.select("doc_id", "text"), learn)
    got = {r.doc_id for r in run("toxicity").collect()}
    assert got == {i for i in kept if brute_score(rows[i].text, *model) < THRESHOLD}
    kept = got

    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    out = run("exact_dedup")
    assert out.columns == table.columns
    got = {r.doc_id for r in out.collect()}
    assert got == set(first.values())
    kept = got

    near = brute_near([(i, rows[i].text) for i in kept], 5)
    got = {r.doc_id for r in run("minhash_dedup").collect()}
    assert got == {i for i, (_, _, stays) in near.items() if stays}
    kept = got

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _, _ in brute_leaks([(i, rows[i].text) for i in kept], items)}
    got = {r.doc_id for r in run("decontamination").collect()}
    assert got == kept - leaks
    kept = got

    mixed = Counter(tuple(r) for r in run("mixing").select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect())
    documents = pa.Table.from_pylist([rows[i].asDict() for i in sorted(kept)])  # read by name below
    duck = duckdb.connect()
    duck.register("documents", documents)
    assert mixed == Counter(duck.execute(f"select doc_id, domain, lang, source, n_tokens, copies from ({OP6_SQL})").fetchall())
