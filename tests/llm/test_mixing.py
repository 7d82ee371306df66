import random

import numpy as np

from rosterlake.llm.mixing import mix_shares, mix_sources, pivotal


def test_pivotal_keeps_sum_and_probabilities():
    rng = np.random.default_rng(1)
    p = np.array([0.3, 0.7, 0.2, 0.9, 0.4, 0.5])
    hits, left = np.zeros(6), np.zeros(6)
    for _ in range(6000):
        out, i, rest = pivotal(p, rng)
        assert abs(out.sum() + rest - p.sum()) < 1e-6
        hits += out
        if i >= 0:
            left[i] += rest
    assert np.abs((hits + left) / 6000 - p).max() < 0.03


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(1, 400), "x") for i, s in enumerate(["big"] * 4000 + ["mid"] * 800 + ["tiny"] * 40 + ["unused"] * 50)]
    rows += [(9001, None, 10, "x"), (9002, "big", 0, "x"), (9003, "big", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, mix_id string")
    targets = spark.createDataFrame(
        [(1, "big", 0.5, 2), (1, "mid", 0.3, 2), (1, "tiny", 0.1, 4), (1, "absent", 0.1, 4), (2, "absent", 1.0, 3)],
        "mix_id long, source string, target_share double, max_repeats int",
    )
    drawn = mix_sources(df, targets, shard_records=100, fan_in=4)
    shares = {(r["mix_id"], r["source"]): r for r in mix_shares(drawn, targets).collect()}
    assert shares[1, "absent"]["actual_share"] == 0 and shares[2, "absent"]["actual_share"] == 0
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(shares[1, s]["actual_share"] - share / 0.9) < 0.01
        assert shares[1, s]["most_copies"] <= {"big": 2, "mid": 2, "tiny": 4}[s]
    got = [r["doc_id"] for r in drawn.collect()]
    assert len(got) == len(set(got)) and not set(got) & {9001, 9002, 9003}
    assert drawn.count() == mix_sources(df, targets, shard_records=100, fan_in=4).count()
    assert mix_sources(df.limit(0), targets).count() == 0


def test_inclusion_probabilities_hold_through_the_operator(spark):
    """Over many seeds every size class is drawn as often as its probability says, within three standard deviations."""
    rows = [(i, "a", 1 + i % 50 * 8, "x") for i in range(400)] + [(1000 + i, "b", 100, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, mix_id string")
    targets = spark.createDataFrame([(1, "a", 0.8, 1), (1, "b", 0.2, 1)], "mix_id long, source string, target_share double, max_repeats int")
    total, seeds, hits = sum(r[2] for r in rows[:400]), 25, {}
    p = min(1.0, 60 * 100 / 0.2 * 0.8 / total)
    for seed in range(seeds):
        for r in mix_sources(df, targets, seed=seed, shard_records=64, fan_in=4).filter("source = 'a'").collect():
            hits[(r["n_tokens"] - 1) // 80] = hits.get((r["n_tokens"] - 1) // 80, 0) + r["copies"]
    n = seeds * 80
    assert 0.2 < p < 0.8 and len(hits) == 5
    assert all(abs(h - n * p) < 3 * (n * p * (1 - p)) ** 0.5 for h in hits.values())
