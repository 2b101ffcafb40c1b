"""The least MD5 of many messages against hashlib, and hard negatives of copies against brute force."""

import hashlib

import pytest

from kinspan.functions.digest import Tails
from kinspan.operators import profile


@pytest.mark.parametrize("prefix", [b"42", b"42|S1-7", b"42|S1-1234567", b"x" * 44, b"42|" + "é".encode() * 30])
def test_least_digest(prefix):
    tails = [b"", *[b"|S2-%d" % (i * i) for i in range(3000)], b"|" + b"y" * 60, b"|S2-49"]
    made = Tails(tails)
    want = sorted((hashlib.md5(prefix + t).digest(), i) for i, t in enumerate(tails))
    assert made.least(prefix) == want[0]
    assert made.least(prefix, [want[0][1], want[1][1]]) == want[2]
    assert made.least(prefix, range(len(tails))) is None


def test_blocks_are_hashed_and_not_pairs(spark, monkeypatch):
    """Work of the JVM follows blocks: no expression is evaluated for a pair, and results don't hang on the blocks' size."""
    rows = [("source1" if k % 3 == 0 else f"source{k % 3 + 1}", f"S{1 if k % 3 == 0 else k % 3 + 1}-{k}", "us", ["alpha", "of", f"word{k % 4}"]) for k in range(300)]
    records = spark.createDataFrame(rows, "source string, entity_id string, country_normalized string, business_name_tokens array<string>")
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k + 1}", "source2") for k in range(0, 300, 3)], "source1_entity_id string, candidate_entity_id string, candidate_source string")
    wrong = {(r[0], r[1]) for r in truth.collect()}
    want = {a[1]: min((hashlib.md5(f"42|{a[1]}|{b[1]}".encode()).hexdigest(), b[1], b[0]) for b in rows if b[0] != "source1" and (a[1], b[1]) not in wrong)[1:] for a in rows if a[0] == "source1"}
    for chunk in (16, 50, 8192):
        found = profile.hard_negatives(records, truth, chunk=chunk)
        assert {r[0]: (r[1], r[2]) for r in found.collect()} == want
    assert "lambdafunction(md5" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace(" ", "")
