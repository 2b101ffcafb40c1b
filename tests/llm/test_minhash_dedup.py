import random
import re

import numpy as np

from kinspan.llm.graph import components
from kinspan.llm.minhash_dedup import T, near_duplicates, op5_minhash_dedup, parities, sketch

SCHEMA = "doc_id long, text string, rep string, bucket int"


def brute(rows, width, percent=80):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    met = {(a, b) for ds in having.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in met:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÉé\xa0") for _ in range(r.randint(1, 5)))
    bases = [[word() for _ in range(r.randint(20, 120))] for _ in range(6)]
    rows = []
    for i in range(150):
        base = list(r.choice(bases))
        for _ in range(r.randint(0, 6)):
            base[r.randrange(len(base))] = word()
        rows.append((i * 3, r.choice([" ", "\n", "\t "]).join(base).upper() if i % 7 == 0 else " ".join(base)))
    chain = [f"w{i}" for i in range(60)]
    for i in range(25):  # a chain: neighbours are linked, the ends are not
        rows.append((1000 - i, " ".join(chain[i : i + 60] + [f"w{60 + k}" for k in range(i)][-60:])))
    return [*rows, (2000, ""), (2001, None), (2002, " \n "), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "two one")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA).repartition(4)
    for width in (4, 5):
        assert result(near_duplicates(df, width)) == brute(rows, width)


def test_sketch_fills_every_coordinate_and_estimates():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.r_[common, a], np.r_[common, b], common[:1]]
    rows = np.repeat(np.arange(3), [len(x) for x in sets])
    s = sketch(np.concatenate(sets), rows, 3)
    assert (s < np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).sum() / T - 0.8) < 0.12
    assert (sketch(sets[1], np.zeros(900, np.int64), 1)[0] == s[1]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (5, 100), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, 101: 0, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_null_ids_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (None, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_query_on_tables(spark):
    got = result(op5_minhash_dedup(spark, "/root/testdata/sf0.01"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert got == brute([tuple(x) for x in docs], 4)


def test_parity_bitmaps_differ_by_no_more_bits_than_sets_by_elements():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    for gone in (0, 1, 40, 500):
        other = np.r_[base[gone:], rng.integers(0, 2**63, gone // 2).astype(np.uint64)]
        x, y = (parities(h, np.zeros(len(h), np.int64), 1)[0] for h in (base, other))
        bits = sum(int(v).bit_count() for v in x ^ y)
        assert bits <= gone + gone // 2 and (bits > 0) == (gone > 0)
    assert not parities(base[:0], np.zeros(0, np.int64), 2).any()


def test_texts_that_share_a_doc_id_keep_their_links(spark):
    r = random.Random(8)
    a, b = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " zz"), (3, b + " zz"), (3, "other words that stand alone here"), (4, a)]
    got = near_duplicates(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)).collect()
    assert sorted((x.doc_id, x.component_id, x.kept) for x in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 3, True), (4, 1, False)]


def test_buckets_meet_by_blocks(spark, monkeypatch):
    import kinspan.llm.minhash_dedup as m

    monkeypatch.setattr(m, "BLOCK", 3)
    monkeypatch.setattr(m, "TURNS", 0)
    rows = corpus(21)
    assert result(near_duplicates(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA), 4)) == brute(rows, 4)
