from collections import Counter

import numpy as np

from lodemine.llm import sharding


def test_hypergeometric_has_the_right_distribution():
    rng = np.random.default_rng(0)
    draws = np.asarray([sharding.hypergeometric(rng, 7, 13, 6) for _ in range(6000)])
    want = np.random.default_rng(1).hypergeometric(7, 13, 6, 200_000)
    for k in range(7):
        assert abs((draws == k).mean() - (want == k).mean()) < 0.03
    big = [sharding.hypergeometric(rng, 3 * 10**11, 7 * 10**11, 10**10) for _ in range(20)]
    assert abs(np.mean(big) - 3 * 10**9) < 3 * 10**5
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


def test_matrix_has_exact_margins():
    sizes = [5, 0, 17, 1, 40, 3]
    before = np.concatenate([[0], np.cumsum(sizes)])
    rows = [sharding.matrix_row(before, at, 4, seed=9) for at in range(len(sizes))]
    assert [sum(r) for r in rows] == sizes
    assert [sum(c) for c in zip(*rows, strict=True)] == sharding.shard_sizes(66, 4)


def check(spark, rows, n_shards, **options):
    frame = spark.createDataFrame(rows, "doc_id bigint, shard string, idx int").repartition(5)
    got = sharding.shuffle_into_shards(frame, n_shards, **options).select("row.doc_id", "row.shard", "row.idx", sharding.F.col("shard").alias("to"), "slot").collect()
    assert Counter((r["doc_id"], r["shard"], r["idx"]) for r in got) == Counter(rows)
    sizes = Counter(r["to"] for r in got)
    assert [sizes[s] for s in range(n_shards)] == sharding.shard_sizes(len(rows), n_shards)
    for s in range(n_shards):
        assert sorted(r["slot"] for r in got if r["to"] == s) == list(range(sizes[s]))
    return got


def test_every_row_once_with_gapless_slots(spark):
    rows = [(i, "s", i % 7) for i in range(97)] + [(None, None, None)] * 3 + [(1, "s", 1)] * 5
    check(spark, rows, 8)
    got = check(spark, rows, 3, rows_per_bucket=4)
    assert [r["slot"] for r in sorted(got, key=lambda r: str(r["doc_id"]))] != sorted(r["slot"] for r in got)
    check(spark, rows[:2], 5)


def test_empty(spark):
    assert sharding.shuffle_into_shards(spark.createDataFrame([], "doc_id bigint"), 4).count() == 0
