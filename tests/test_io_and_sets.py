"""Sources, sinks, streaming, supervised sets, post-processing."""

import pytest
from pyspark.sql import functions as F

from kinspan.operators import metrics, postprocess, supervised, validate
from kinspan.sources import readers, sinks
from kinspan.streaming.ingest import run_stream, stream_raw


def test_tsv_ragged_rows_and_namespace(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1 \tA\nS1-2\tB\tx\tUS\textra\n", encoding="utf-8")
    got = {r.entity_id: (r.business_name, r.business_address, r.country) for r in readers.read_source(spark, str(path), "source1").collect()}
    assert got == {"S1-1": ("A", "", ""), "S1-2": ("B", "x", "US\textra")}
    with pytest.raises(Exception, match="bad entity id"):
        readers.read_source(spark, str(path), "source2").collect()
    with pytest.raises(validate.ValidationError):
        readers.read_lines(spark, str(path), ["nothing"])


def test_parts_and_refusal(spark, tmp_path):
    df = spark.range(25)
    sinks.write_parts(df.coalesce(1), str(tmp_path / "p"), rows=10)
    assert len(list((tmp_path / "p").glob("*.parquet"))) == 3
    sinks.write_features(df, str(tmp_path / "f"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_features(df, str(tmp_path / "f"))
def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text("S1-1\tAcme Inc.\t12 Main St\tUS\n", encoding="utf-8")
    for _ in range(2):  # the second run finds nothing new
        run_stream(stream_raw(spark, str(tmp_path / "in"), "source1"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.entity_id, r.business_name_normalized, r.country_normalized) for r in rows] == [("S1-1", "acme inc", "united states")]


def pairs(spark):
    rows = [(f"S1-{i}", f"S{2 + j % 2}-{i}{j}", f"source{2 + j % 2}", int(j < i % 3)) for i in range(30) for j in range(5)]
    return spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, candidate_source string, label int")


def test_split_has_no_leakage_and_samples_training_only(spark):
    whole, less = supervised.split(pairs(spark)), supervised.split(pairs(spark), ratio=2.0)
    sides = whole.groupBy("source1_entity_id").agg(F.count_distinct("split").alias("n"))
    assert sides.agg(F.max("n")).first()[0] == 1
    counts = {(r["split"], r["label"]): r["count"] for r in less.groupBy("split", "label").count().collect()}
    assert counts["train", 0] == 2 * counts["train", 1]
    assert whole.filter("split = 'validation'").count() == less.filter("split = 'validation'").count()


def test_truth_formats(spark):
    raw = spark.createDataFrame([("S1-1", "S2-1, S3-2"), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, matched_entity_ids string")
    assert supervised.normalize_truth(raw).count() == 2
    with pytest.raises(ValueError):
        supervised.normalize_truth(spark.range(1))


def test_metrics(spark):
    y, p = [1, 1, 1, 0, 0, 0, 0, 0], [0.95, 0.85, 0.45, 0.60, 0.30, 0.10, 0.05, 0.02]
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p double")
    at = metrics.sweep(df, [0.8]).first()
    assert (at.precision, at.tp, at.fp) == (1.0, 2, 0)
    assert tuple(metrics.ranking_metrics(df).first()) == (0.916667, 0.933333)
    assert tuple(metrics.ranking_metrics(df.filter("y = 1")).first()) == (0.0, 0.0)


def test_post_processing(spark):
    rows = [("S1-A", "S2-1", "source2", 0.9), ("S1-A", "S2-2", "source2", 0.8), ("S1-A", "S3-1", "source3", 0.6), ("S1-Z", "S2-9", "source2", 0.2)]
    scored = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, candidate_source string, probability double")
    assert postprocess.filter_pairs(scored, 0.5).count() == 3
    assert postprocess.filter_pairs(scored, 0.5, margin=0.15).count() == 2
    kept = postprocess.filter_pairs(scored, 0.5, top_k=1)
    out = {r[0]: r[1] for r in postprocess.linkages(kept, scored).collect()}
    assert out == {"S1-A": "S2-1,S3-1", "S1-Z": ""}
