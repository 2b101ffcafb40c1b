"""Splits, truths, samples, sources, sinks, models and summaries on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from kinspan.functions import text as T
from kinspan.operators import features, model, postprocess, profile, records, summaries, supervised, validate
from kinspan.sources import readers, sinks, staging

PAIRS = "source1_entity_id string, candidate_entity_id string, candidate_source string"


def test_every_step_over_many_partitions(spark):
    for n, step in ((40, 3), (1, 5), (0, 2), (100, 1), (17, 20)):
        df = spark.range(1, n + 1).repartition(7)
        assert sorted(r.id for r in profile.every(df, "id", step).collect()) == list(range(1, n + 1, step))
    with pytest.raises(ValueError):
        profile.every(spark.range(3), "id", 0)


def test_nearest_quantiles(spark):
    rows = [("a", v) for v in [5, 1, 1, 9, 3, 7, 7, 7, 2, 4, None]] + [("b", 6)]
    got = {r.g: (r.p10, r.p50, r.p90) for r in profile.nearest_quantiles(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    values = sorted(v for g, v in rows if g == "a" and v is not None)
    assert got == {"a": tuple(values[round((len(values) - 1) * q)] for q in (0.1, 0.5, 0.9)), "b": (6, 6, 6)}


def test_normalize_truth_keeps_stated_sources(spark):
    rows = [("S1-1", "X9", "source2"), (" S1-1", "S3-2 ", None), ("S1-2", "S2_5", ""), ("S1-1", "X9", "source2"), ("", "S2-1", "source2")]
    got = {tuple(r) for r in supervised.normalize_truth(supervised.truth_of(spark, rows)).collect()}
    assert got == {("S1-1", "X9", "source2"), ("S1-1", "S3-2", "source3"), ("S1-2", "S2_5", "source2")}
    exploded = spark.createDataFrame([("S1-1", "K1", "source3")], "source1_entity_id string, matched_entity_id string, target_source string")
    assert supervised.normalize_truth(exploded).collect()[0].candidate_source == "source3"


def test_truth_from_tuples_and_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n", encoding="utf-8")
    assert supervised.normalize_truth(supervised.truth_of(spark, str(tmp_path / "t.tsv"))).count() == 2
    assert supervised.normalize_truth(supervised.truth_of(spark, [("S1-1", "S2-1")])).collect()[0].candidate_source == "source2"


def labelled(spark, n=60):
    rows = [(f"S1-{i}", f"S{2 + j % 2}-{i}{j}", f"source{2 + j % 2}", float(j < i % 3), float(i % 7), int(j < i % 3)) for i in range(n) for j in range(4)]
    return spark.createDataFrame(rows, f"{PAIRS}, x double, z double, label int")


def test_split_matches_sorting_all(spark):
    df = labelled(spark).select("source1_entity_id", "candidate_entity_id", "candidate_source", "label")
    got = {r.source1_entity_id for r in supervised.split(df, 0.3).filter("split = 'validation'").collect()}
    want, buckets = set(), {}
    for i in range(60):
        buckets.setdefault(min(2, i % 3), []).append(f"S1-{i}")
    for ids in buckets.values():
        ids.sort(key=lambda x: (hashlib.md5(f"42|{x}".encode()).hexdigest(), x))
        want |= set(ids[: max(1, round(len(ids) * 0.3))])
    assert got == want
    for bad in (-0.1, 1.0):
        with pytest.raises(ValueError):
            supervised.split(df, bad)


def test_training_set(spark):
    truth = labelled(spark).filter("label = 1").select("source1_entity_id", "candidate_entity_id")
    made = supervised.TrainingSet(labelled(spark).drop("label"), truth, ratio=1.0)
    assert tuple(made.overlaps().first()) == (0, 0, 0)
    assert made.validation_recall().first().recall == 1.0
    stats = {r["split"]: (r.positives, r.negatives) for r in made.stats().collect()}
    assert stats["train"][0] == stats["train"][1] and stats["validation"][1] > 0


def test_quoted_tsv_with_ragged_rows(spark, tmp_path):
    text = 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"A ""B"" C"\t"1 Main\tSt"\tUS\nS2-2\tshort\nS2-3\tx\ty\tFR\textra\n'
    (tmp_path / "s.tsv").write_text(text, encoding="utf-8")
    got = {r.entity_id: (r.business_name, r.business_address, r.country) for r in readers.read_source(spark, str(tmp_path / "s.tsv"), "source2", quoted=True).collect()}
    assert got == {"S2-1": ('A "B" C', "1 Main\tSt", "US"), "S2-2": ("short", "", ""), "S2-3": ("x", "y", "FR")}


def test_a_row_that_equals_the_header_is_a_row(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("a\tb\n1\t2\na\tb\n  \n\t4\n", encoding="utf-8")
    assert sorted(tuple(r) for r in readers.read_lines(spark, str(tmp_path / "s.tsv"), ["a", "b"]).collect()) == [("", "4"), ("1", "2"), ("a", "b")]


def test_paths_and_part_discovery(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train_source1.tsv").write_text("x", encoding="utf-8")
    assert readers.dataset_path(spark, str(tmp_path), "train", "source1").endswith("/train_source1.tsv")
    with pytest.raises(validate.ValidationError):
        readers.dataset_path(spark, str(tmp_path), "train", "source2")
    for name in ("a/train_source1_part_00000.parquet", "source2/part_00000.parquet", "source2/x_source3_y.parquet", "other/z.parquet"):
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_bytes(b"")
    found, misplaced = readers.discover_parts(spark, str(tmp_path / "p"))
    assert {k: len(v) for k, v in found.items()} == {"source1": 1, "source2": 1} and len(misplaced) == 2


def test_readers_of_parts(spark, tmp_path):
    spark.range(3).selectExpr("concat('S1-', id) entity_id").coalesce(1).write.parquet(str(tmp_path / "x"))
    names = sinks.write_parts(spark.range(25).coalesce(1), str(tmp_path / "parts"), rows=10, prefix="train_source1")
    assert names == [f"train_source1_part_{k:05d}.parquet" for k in range(3)]
    assert readers.first_parts(spark, str(tmp_path / "parts"), 2).count() == 20
    assert readers.load_processed(spark, str(tmp_path / "parts"), "source1", ["id", "nothing"]).columns == ["id"]
    assert readers.from_file_name(readers.load_processed(spark, str(tmp_path / "parts"))).select("source").distinct().collect()[0][0] == "source1"
    assert sinks.write_parts(spark.range(0), str(tmp_path / "none"), prefix="p") == []
    assert readers.source_of_file("/a/source3/b") == "source3"
    with pytest.raises(validate.ValidationError):
        readers.source_of_file("/a/b")


def test_raw_loader_takes_texts_for_nulls(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("a\tb\n1\tNULL\nNaN\tx\tbeyond\n", encoding="utf-8")
    assert [tuple(r) for r in readers.load_raw(spark, str(tmp_path / "r.tsv")).collect()] == [("1", None), (None, "x")]
    assert readers.load_raw(spark, str(tmp_path / "r.tsv"), ["b"], 1).collect()[0][0] is None


def test_cached_reads_only_finished_folders(spark, tmp_path):
    out = str(tmp_path / "c")
    spark.range(2).write.parquet(out)
    (tmp_path / "c/_SUCCESS").unlink()  # as a writer that was cut short leaves it
    assert sinks.cached(spark.range(5), out).count() == 5
    assert sinks.cached(spark.range(9), out).count() == 5


def test_load_log(spark, tmp_path):
    log = sinks.LoadLog(spark, str(tmp_path / "log"))
    assert log.done() == [] and log.progress().count() == 0
    assert log.add("b1", spark.range(4), "source1", "in.tsv") and not log.add("b1", spark.range(4), "source1", "in.tsv")
    log.add("b2", spark.range(3), "source2", "in2.tsv")
    (tmp_path / "log/batch=b2/_SUCCESS").unlink()
    assert log.done() == ["b1"] and log.rows().count() == 4
    assert log.add("b2", spark.range(3), "source2", "in2.tsv")
    assert {(r.load_source, r.load_input, r.rows) for r in log.progress().collect()} == {("source1", "in.tsv", 4), ("source2", "in2.tsv", 3)}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    for _ in range(2):
        assert sinks.write_report(df, str(tmp_path / "r.json")) == [{"a": "x", "b": 1}]
    assert json.loads((tmp_path / "r.json").read_text()) == [{"a": "x", "b": 1}]
    sinks.write_markdown(df, str(tmp_path / "r.md"), "T")
    assert "| x | 1 |" in (tmp_path / "r.md").read_text()


def raw(spark, rows):
    return spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")


def test_dead_letters_keep_a_fallback_row(spark):
    rows = raw(spark, [("source1", "S1-1", "Acme Inc.", "1 Main St", "US"), ("source1", "X-2", "Bad", None, "US")])
    bad = validate.bad_namespace(F.col("source"), F.col("entity_id"))
    kept, letters = sinks.with_fallback(records.process(rows, indic=False), rows, bad, F.lit("namespace"))
    got = {r.entity_id: (r.business_name, r.business_name_normalized) for r in kept.collect()}
    assert got == {"S1-1": ("Acme Inc.", "acme inc"), "X-2": ("Bad", None)}
    assert [r.reason for r in letters.collect()] == ["namespace"]


def test_staged_tables_follow_their_input(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    spark.range(1).write.parquet(str(tmp_path / "in"))
    assert [staging.staged(spark, "t", str(tmp_path / "in"), make).count() for _ in range(2)] == [1, 1]
    spark.range(5).write.mode("append").parquet(str(tmp_path / "in"))
    assert staging.staged(spark, "t", str(tmp_path / "in"), make).count() == 2 and len(calls) == 2


def test_validation_predicates(spark):
    assert validate.open_mode("rb") == "rb"
    with pytest.raises(validate.ReadOnlyViolationError):
        validate.open_mode("w")
    with pytest.raises(validate.ValidationError):
        validate.canonical_at_ingest(spark.createDataFrame([], "business_name_tokens array<string>"))
    with pytest.raises(validate.ValidationError):
        validate.feature_frame(spark.range(1))
    health = validate.column_health(spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),)], "x double")).first()
    assert (health.nulls, health.nans, health.infinite) == (1, 1, 1)


def test_key_labels_and_sources(spark):
    df = spark.createDataFrame([("key_C||x",), ("a",), ("B||y",), (None,)], "k string")
    assert [r[0] for r in df.select(T.key_label(F.col("k"))).collect()] == ["C", "A", None, None]
    ids = spark.createDataFrame([("S2-1",), ("S3_9",), ("S1-1",), ("S22",)], "k string")
    assert [r[0] for r in ids.select(T.source_of_id(F.col("k"))).collect()] == ["source2", "source3", "unknown", "unknown"]


def test_profile_scripts(spark):
    rows = [("Tata मोटर्स", ["Devanagari", "Latin"]), ("Москва 東京 かな 한국 ไทย", ["Cyrillic", "Han (Chinese)", "Japanese (Kana)", "Korean (Hangul)", "Thai"]), ("Երևան ელ", ["Armenian", "Georgian"]), ("12 !", []), (None, [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.select("i", summaries.profile_scripts(F.col("t")).alias("s")).orderBy("i").select("s").collect()] == [s for _, s in rows]
    shown = {r.script: r.rows for r in summaries.script_shares(df, "t", "i", 1).collect()}
    assert shown[summaries.NO_LETTERS] == 2 and shown["Latin"] == 1


def test_folds_are_disjoint_and_models_survive_saving(spark, tmp_path):
    df = labelled(spark)
    scored = model.out_of_fold(df, folds=3, iterations=2, features=["x", "z"], least_rows=1)
    assert scored.count() == df.count() and scored.filter("probability < 0 or probability > 1").count() == 0
    assert scored.groupBy("source1_entity_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    best = model.best_threshold_oof(df, folds=3, iterations=2, features=["x", "z"], least_rows=1).first()
    assert best.f_beta > 0.95
    train, held = df.filter("hash(source1_entity_id) % 2 = 0"), df.filter("hash(source1_entity_id) % 2 <> 0")
    one = model.Matcher(["x", "z"], iterations=3, least_rows=1).fit(train, held)
    names = [n for n, _, _ in one.importances()]
    assert names[0] == "x" and abs(sum(p for _, _, p in one.importances("split")) - 100) < 1e-6
    one.save(str(tmp_path / "m"))
    again = model.load_matcher(spark, str(tmp_path / "m"), ["x", "z"])
    key = ["source1_entity_id", "candidate_entity_id"]
    assert sorted(map(tuple, one.predict_proba(held).select(*key, "probability").collect())) == sorted(map(tuple, again.predict_proba(held).select(*key, "probability").collect()))
    assert one.evaluate(held, [0.5]).first().precision == 1.0
    got = {r.training: r.train_pairs for r in model.compare_sampling(df, ratio=1.0, iterations=2, features=["x", "z"], least_rows=1).collect()}
    assert got["sampled"] < got["natural"]


def test_marked_pairs_and_diagnostics(spark):
    rows = [("S1-A", "S2-1", "source2", 0.9), ("S1-A", "S2-2", "source2", 0.85), ("S1-A", "S3-1", "source3", 0.6), ("S1-Z", "S2-9", "source2", 0.2)]
    scored = spark.createDataFrame(rows, f"{PAIRS}, probability double")
    marked = postprocess.mark_pairs(scored, 0.5, 0.2, 1)
    assert {r.candidate_entity_id for r in marked.filter("accepted").collect()} == {"S2-1"}
    d = postprocess.diagnostics(marked, spark.createDataFrame([("S1-A",), ("S1-Z",), ("S1-Q",)], "source1_entity_id string")).first()
    assert (d.entities, d.zero, d.single, d.rejected, d.source2_accepted, d.accepted_std, d.rejected_most, d.zero_pct) == (3, 2, 1, 3, 1, 0.0, 0.85, 66.666667)


def test_combined_frames(spark):
    one = spark.createDataFrame([("a", "b", "source2", 1)], f"{PAIRS}, x int")
    two = spark.createDataFrame([("a", "b", "source2", 2)], f"{PAIRS}, y int")
    assert tuple(summaries.combine_features(one, two).first()) == ("a", "b", "source2", 1, 2)
    with pytest.raises(ValueError):
        summaries.combine_features(one, one)
    with pytest.raises(Exception, match="pairs differ"):
        summaries.combine_features(one, two.withColumn("source1_entity_id", F.lit("z"))).collect()


def test_features_of_two_feature_groups_and_aliases(spark):
    rows = raw(spark, [("source1", "S1-1", "Acme Foods Inc.", "12 Main St", "US"), ("source2", "S2-1", "Acme Food Inc", "12 Main Street", "US")])
    entities = records.representations(records.blocking_keys(records.process(rows, indic=False)))
    pairs = spark.createDataFrame([("S1-1", "S2-1", "source2", ["A"])], f"{PAIRS}, labels array<string>")
    whole = features.pair_features(pairs, entities)
    validate.feature_frame(whole)
    meta = features.feature_metadata()
    assert [m["name"] for m in meta] == whole.columns[3:] and {m["group"] for m in meta} == {"name", "address", "cross", "blocking"}
    names = list(features.FEATURES)
    parts = summaries.combine_features(features.pair_features(pairs, entities, names[:12]), features.pair_features(pairs, entities, names[12:]))
    assert tuple(parts.first()) == tuple(whole.first()) and parts.columns == whole.columns
    assert records.with_aliases(entities).filter("is_address_missing or primary_address_number <> '12'").count() == 0


def test_features_at_several_sizes_and_one_by_one(spark):
    from kinspan.plans.queries import candidates
    from kinspan.plans.scale import feature_scale, transliteration_rate
    from kinspan.plans.views import represented

    sf = "/root/testdata/sf0.001"
    pairs, entities = candidates(spark, sf), represented(spark, sf)
    assert [(r.pairs, r.bad_features) for r in feature_scale(pairs, entities, [5, 40]).collect()] == [(5, 0), (40, 0)]
    some = pairs.orderBy(*features.PAIR).limit(4)
    together = sorted(tuple(r) for r in features.pair_features(some, entities).collect())
    alone = sorted(tuple(features.pair_features(spark.createDataFrame([r], some.schema), entities).first()) for r in some.collect())
    assert together == alone
    texts = spark.createDataFrame([("a", "राम मार्केटिंग"), ("b", "শক্তি")], "key string, text string")
    rate = transliteration_rate(spark, texts, 50).first()
    assert (rate.records, rate.residual, rate.empty, rate.unchanged) == (50, 0, 0, 0)
