import random

import pytest
from pyspark.sql import functions as F

from lodemine.operators.skew import hot_keys, positions, segment_lines, skew_join


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(1)
    left = [(1 if rng.random() < 0.4 else rng.randint(2, 30), i) for i in range(300)] + [(None, 1000 + i) for i in range(20)]
    right = [(k, f"r{k}") for k in range(0, 25)] + [(1, "again")]
    return spark.createDataFrame(left, "k int, v int"), spark.createDataFrame(right, "k int, w string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(sides, how):
    left, right = sides
    assert not hot_keys(left, ["k"], 20).isEmpty()
    got = skew_join(left, right, "k", how, rows_per_split=20).collect()
    want = left.join(right, "k", how).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("rows_per_split", [1_000_000, 50, 1])
def test_positions_number_hot_groups(spark, rows_per_split):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, None, None, *range(2, 7)]), rng.randint(0, 40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, v int").repartition(5)
    got = {(r.g, r.o, r.v): (r.pos, r.n) for r in positions(df, ["g"], ["o", "v"], total="n", rows_per_split=rows_per_split).collect()}
    for g in [None, *range(1, 7)]:
        members = sorted((o, v) for gg, o, v in rows if gg == g)
        for at, (o, v) in enumerate(members, 1):
            assert got[(g, o, v)] == (at, len(members))


def test_positions_without_group_is_a_dense_index(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("x"))
    rows = positions(df, [], ["x"]).collect()
    assert sorted((r.x, r.pos) for r in rows) == [(i, i + 1) for i in range(200)]


def test_segment_lines_concatenate_to_the_whole_line(spark):
    df = spark.createDataFrame([("a", i, f"m{i}") for i in range(25)] + [("b", 0, "z")], "g string, o int, t string")
    rows = segment_lines(df, ["g"], ["o"], "t", ",", per_segment=10).collect()
    parts = [r.line for r in sorted((r for r in rows if r.g == "a"), key=lambda r: r.segment)]
    assert len(parts) == 3
    assert ",".join(parts) == ",".join(f"m{i}" for i in range(25))
