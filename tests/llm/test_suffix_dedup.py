import hashlib
import random

from kinspan.llm.suffix_dedup import dedup_substrings, op7_suffix_dedup, suffix_array

SCHEMA = "doc_id long, text string, marks string, anchor long"


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed=7):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage, base = text(14), text(60), [word() for _ in range(150)]
    rows = [(i, text(r.randint(0, 80))) for i in range(40)]
    for i in range(40, 80):
        edited = [word() if r.random() < 0.03 else w for w in base]
        rows.append((i, r.choice([" ".join(edited), f"{text(9)}\n{line}\n{text(20)}", f"{text(5)} {passage} {text(5)}", "in. " * r.randint(1, 90)])))
    return [*rows, (80, ""), (81, None), (82, "x" * 99), (83, "x" * 100), (84, "x" * 5000), (85, rows[3][1]), (-5, passage + line)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA).repartition(5)
    assert result(dedup_substrings(df)) == brute(rows)


def test_long_text_over_many_pieces(spark, monkeypatch):
    import kinspan.llm.suffix_dedup as m

    monkeypatch.setattr(m, "POSITION_BITS", 9)  # closures read it when they are made
    rows = corpus(11)
    assert result(dedup_substrings(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA))) == brute(rows)


def test_heavy_triggers_are_salted(spark, monkeypatch):
    import kinspan.llm.suffix_dedup as m

    monkeypatch.setattr(m, "HEAVY_LEAST", 2)
    monkeypatch.setattr(m, "SAMPLE", 1)
    monkeypatch.setattr(m, "GROUPS", 1 << 6)
    rows = corpus(13)
    assert result(dedup_substrings(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA))) == brute(rows)


def test_groups_beyond_a_suffix_array_are_cut(spark, monkeypatch):
    import kinspan.llm.suffix_dedup as m

    monkeypatch.setattr(m, "AT_ONCE", 3)
    rows = corpus(17)
    assert result(dedup_substrings(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA))) == brute(rows)


def test_suffix_array_is_the_sorted_order():
    phrases = [b"abracadabra", b"cadabrac", b"abra", b"bracad"]
    phrase, offset, order, same = suffix_array(phrases, 4)
    want = [(i, k) for i, p in enumerate(phrases) for k in range(len(p) - 3)]
    assert list(zip(phrase.tolist(), offset.tolist())) == want
    cut = [phrases[i][k : k + 4] for i, k in want]
    assert order.tolist() == sorted(range(len(cut)), key=lambda x: (cut[x], x))
    assert same.tolist() == [n > 0 and cut[order[n]] == cut[order[n - 1]] for n in range(len(cut))]


def test_different_texts_with_one_doc_id(spark):
    a, b = "first " * 40 + "of the two " * 30, "second text " * 50
    rows = [(1, a), (1, b), (2, b + "first " * 40), (2, "short"), (3, a)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in dedup_substrings(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)).collect())
    alone = {t: brute([(1, t)])[1][1] for t in (a, b)}
    after = brute([(1, a), (2, b), (3, b + "first " * 40)])[3][1]
    assert got == sorted([(1, len(a), alone[a]), (1, len(b), alone[b]), (2, len(rows[2][1]), after), (2, 5, 0), (3, len(a), len(a))])


def test_empty_null_ids_and_repeated_rows(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "y" * 150), (1, "y" * 150), (None, "z" * 150), (None, "z" * 150)]
    got = dedup_substrings(spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)).collect()
    assert [r.n_removed for r in got if r.doc_id == 1] == [149, 149]
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]


def test_query_on_tables(spark):
    got = result(op7_suffix_dedup(spark, "/root/testdata/sf0.001"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == brute([tuple(x) for x in docs])
