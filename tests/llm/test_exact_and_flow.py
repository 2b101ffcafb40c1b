"""Exact duplicates, leaks, mixing, token counts, the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from kinspan.llm.exact_dedup import exact_duplicates
from kinspan.llm import exact_dedup
from kinspan.llm.mixing import WEIGHTS, budgets, mix, target_weights
from kinspan.llm.queries import oracle_sql, queries
from kinspan.llm.token_counts import PATTERN, VOCABULARY, Rollup, op9_token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "clash") for i, t in rows], DOCS)


def test_exact_duplicates(spark):
    rows = [(5, "a  b"), (3, "a\n b"), (9, "a b"), (4, None), (8, ""), (7, " a b"), (None, "solo"), *[(100 + i, "hot\ttext") for i in range(60)]]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = {(i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    got = exact_duplicates(frame(spark, rows)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_duplicates(frame(spark, rows[:0])).collect() == []


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 100), ("a", "en", "y", 10), ("a", "de", "z", 5), ("b", "en", "w", 40)], "domain string, lang string, source string, tokens long")
    got = {r.source: round(r.given, 6) for r in budgets(leaves, 1.0, 1).collect()}
    assert got == {"x": 100.0, "y": 10.0, "z": 5.0, "w": 40.0}
    got = {r.source: round(r.given, 6) for r in budgets(leaves, 0.4, 1).collect()}  # 62: 31 each; z is short, en takes 26
    assert got == {"x": 16.0, "y": 10.0, "z": 5.0, "w": 31.0}


def test_budgets_follow_weights(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 100), ("a", "de", "y", 100), ("b", "en", "z", 100), ("b", "en", "w", 7)], "domain string, lang string, source string, tokens long")
    weights = spark.createDataFrame([(1, "a", 3.0), (2, "de", 4.0), (2, "de", 2.0), (3, "w", 9.0), (2, "en", None), (1, "b", -1.0)], "depth int, name string, weight double")
    got = {r.source: round(r.given, 6) for r in budgets(leaves, 120 / 307, 1, weights).collect()}
    assert got == {"x": 18.0, "y": 72.0, "z": 23.0, "w": 7.0}  # 90 and 30; de has 4 of 5; w gives all of its 7


def test_mix_takes_prefixes_of_seeded_epochs(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else None, f"src{i % 2}", 0, None) for i in range(400)]
    got = mix(spark.createDataFrame(rows, DOCS), share=0.5, epochs=3).collect()
    leaf = defaultdict(list)
    for r in got:
        leaf[r.domain, r.lang, r.source].append(r.n_tokens * r.copies)
    total = sum(1 + i % 7 for i in range(400))
    for taken in leaf.values():
        assert 0 <= sum(taken) - total * 0.5 / len(leaf) < 7
    assert mix(spark.createDataFrame([], DOCS)).collect() == []


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    make = lambda rows: spark.createDataFrame(rows, "sign int, source string, lang string, text string")
    assert rollup.commit("1", make([(1, "s", "en", "hello world"), (1, "s", None, None), (1, "t", "en", "a")]))
    assert not rollup.commit("1", make([(1, "s", "en", "hello world")]))
    before = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert before == {("s", "en"): (1, 2), ("s", None): (1, 0), ("t", "en"): (1, 1)}
    rollup.commit("2", make([(-1, "s", "en", "hello world"), (1, "s", "en", "hello"), (-1, "t", "en", "a")]))
    after = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert after == {("s", "en"): (1, 1), ("s", None): (1, 0)}


def test_mix_odd_rows(spark):
    schema = f"{DOCS}, domain string, copies int, tokens long"
    rows = [(1, "a b", None, None), (1, "a b", None, None), (None, "c d e", "en", "s1"), (2, None, "en", "s1"), (3, "", "en", "s1"), (4, "w " * 50_000, "de", "s2"), (5, "a", "de", "s99999999999")]
    got = mix(spark.createDataFrame([(*r, 0, None, "clash", 9, 9) for r in rows], schema), share=1.0, epochs=1).collect()
    assert Counter((r.doc_id, r.n_tokens, r.copies) for r in got) == {(1, 2, 1): 2, (None, 3, 1): 1, (4, 50_000, 1): 1, (5, 1, 1): 1}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_and_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    found = duck.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in found.fetchall()) == Counter(tuple(r) for r in df.select(*names).collect())


def test_exact_duplicates_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARE", 2)
    schema = "doc_id long, text string, keep_id string, least int, n int, text_hash int"
    rows = [(1, "long " * 100_000), (2, "long\n" * 100_000), (3, "x"), (3, "x"), (3, "y"), (None, "y"), (None, None), (None, "")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.createDataFrame([(*x, "c", 1, 1, 1) for x in rows], schema)).collect())
    assert got == {(1, 1, 2, True): 1, (2, 1, 2, False): 1, (3, 3, 2, True): 3, (None, 3, 2, False): 1, (None, None, 2, True): 2}


def test_rollup_compacts_and_survives_a_cut_commit(spark, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "r"))
    make = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], "sign int, source string, lang string, text string, n_tokens string")
    (tmp_path / "r/_aside-cut").mkdir(parents=True)  # what a commit that was cut short leaves
    assert rollup.totals().collect() == [] and rollup.committed() == []
    rollup.commit("late", make([(-1, "s", "en", "a b"), (None, "s", "en", "x"), (0, "s", "en", "x")]))
    rollup.commit("empty", make([]))
    rollup.compact()
    assert rollup.commit("load", make([(1, "s", "en", "a b"), (1, "s", "en", "word " * 30_000)]))
    assert not rollup.commit("late", make([(-1, "s", "en", "a b")])) and rollup.committed() == ["empty", "late", "load"]
    rollup.compact()
    assert not rollup.commit("load", make([(1, "s", "en", "a")]))
    rows = rollup.totals().collect()
    assert [(r.source, r.n_docs) for r in rows] == [("s", 1)] and rows[0].n_tokens >= 30_000


def test_token_counts_match_plain_python(spark):
    import base64

    import tiktoken

    sf = "/root/testdata/sf0.001"
    with open(VOCABULARY, "rb") as f:
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want[r.source, r.lang][0] += 1
        want[r.source, r.lang][1] += len(encoding.encode_ordinary(r.text or ""))
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in op9_token_counts(spark, sf).collect()} == dict(want)


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns
        seen.append(out.count())
        docs = out
    assert seen == sorted(seen, reverse=True)
    kept = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()]
    assert len(kept) == len(set(kept))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0


PIPELINE_ODD = [(1, "same  text of five words"), (1, "same text of five words"), (1, "same text of five words"), (1, "another text that has the same number"), (2, "same text of five words"), (3, None), (4, ""), (None, "no number at all here"), (5, "word " * 40_000), (6, "one")]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, score string"
    odd = spark.createDataFrame([(i, t, None, "s", 1, "clash", "clash") for i, t in PIPELINE_ODD], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage_function in corpus_pipeline.STAGES:
            docs = stage_function(spark, docs, str(tmp_path))
            if name == "exact_dedup":
                kept = [(r.doc_id, " ".join((r.text or "").split())[:12]) for r in docs.collect()]
                assert not kept or Counter(kept) == Counter([(1, "same text of"), (1, "another text"), (3, ""), (None, "no number at"), (5, "word word wo"), (6, "one")])
        rows = docs.collect()
        assert all(r.copies >= 1 for r in rows)


def test_target_weights_are_unequal(spark):
    assert len({w for _, _, w in WEIGHTS}) > 1 and target_weights(spark).count() == len(WEIGHTS)
