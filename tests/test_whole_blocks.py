"""Large blocks and frequent tokens: nothing is left out."""

from hashlib import md5

from kinspan.operators.profile import hard_negatives
from kinspan.plans.queries import QUERIES


def part(spark, tmp_path, n):
    """n parts of one name, type, brand and size, so that all share one block of each key, dealt over three sources."""
    rows = spark.range(n).selectExpr("cast(id as int) p_partkey", "'almond azure' p_name", "'Brand#11' p_brand", "'SMALL PLATED TIN' p_type", "1 p_size")
    rows.write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_blocks_of_more_than_500_pairs_are_kept(spark, tmp_path):
    sf = part(spark, tmp_path, 90)  # 30 by 60 pairs
    got = {r.label: (r.pairs, r.entities) for r in QUERIES["q_pairs_per_key"](spark, sf).collect()}
    assert got["C"] == (1800, 30)
    assert QUERIES["q_features29"](spark, sf).count() == 1800
    assert QUERIES["q_blocking_recall"](spark, sf).first().recall == 1.0


def test_frequent_tokens_give_hard_negatives(spark):
    rows = [(f"source{k % 3 + 1}", f"S{k % 3 + 1}-{k}", "india", ["acme"]) for k in range(300)]  # one token of 300 entities
    records = spark.createDataFrame(rows, "source string, entity_id string, country_normalized string, business_name_tokens array<string>")
    ones, others = [f"S1-{k}" for k in range(0, 300, 3)], [f"S{k % 3 + 1}-{k}" for k in range(300) if k % 3]
    order = {a: sorted(others, key=lambda b: (md5(f"42|{a}|{b}".encode()).hexdigest(), b)) for a in ones}
    truth = spark.createDataFrame([(a, order[a][0], f"source{order[a][0][1]}") for a in ones], "source1_entity_id string, candidate_entity_id string, candidate_source string")
    for chunk in (7, 1000):
        got = {r[0]: (r[1], r[2]) for r in hard_negatives(records, truth, chunk=chunk).collect()}
        assert got == {a: (order[a][1], f"source{order[a][1][1]}") for a in ones}
