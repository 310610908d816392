import random
from itertools import combinations

import pytest

from lodemine.operators import overlap


def brute(sets, at_least):
    out = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)}
    return {pair: n for pair, n in out.items() if n >= at_least}


def table_of(spark, sets, repeat=1):
    rows = [(i, e) for i, s in sets.items() for e in s] * repeat
    return spark.createDataFrame(rows, "vertex long, item string")


@pytest.mark.parametrize(("at_least", "crowded"), [(1, 1000), (3, 1000), (3, 4), (6, 2)])
def test_shared_pairs_with_light_and_crowded_elements(spark, at_least, crowded):
    rng = random.Random(at_least + crowded)
    sets = {i: {f"e{int(rng.paretovariate(0.7))}" for _ in range(rng.choice([2, 10, 25]))} for i in range(40)}
    got = overlap.shared_pairs(table_of(spark, sets, repeat=2), "vertex", "item", at_least, crowded=crowded).collect()
    assert {(r["id_1"], r["id_2"]): r["n"] for r in got} == brute(sets, at_least)


def test_shared_pairs_of_nothing(spark):
    assert overlap.shared_pairs(table_of(spark, {}), "vertex", "item", 3).count() == 0


@pytest.mark.parametrize("block_ids", [7, 1000])
def test_block_counts_add_crowded_elements_to_what_was_met(spark, block_ids):
    rng = random.Random(block_ids)
    sets = {f"v{i}": {f"e{rng.randrange(6)}" for _ in range(5)} for i in range(60)}
    light = {(a, b): rng.randrange(1, 3) for a, b in combinations(sorted(sets), 2) if rng.random() < 0.2}
    heavy = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id string, elem string")
    started = spark.createDataFrame([(*k, n) for k, n in light.items()], "id_1 string, id_2 string, n long")
    got = overlap._block_counts(heavy, started, 3, block_ids).collect()
    both = {(a, b): len(sets[a] & sets[b]) + light.get((a, b), 0) for a, b in combinations(sorted(sets), 2)}
    assert {(r["id_1"], r["id_2"]): r["n"] for r in got} == {k: n for k, n in both.items() if n >= 3}
    assert len(got) == len({(r["id_1"], r["id_2"]) for r in got})


@pytest.mark.parametrize("split", [3, 50_000])
def test_pairs_are_summed_where_their_first_id_is(spark, split, monkeypatch):
    monkeypatch.setattr(overlap, "PAIR_SPLIT", split)
    rng = random.Random(split)
    values = {i: {e: rng.randrange(1, 6) for e in rng.sample(range(30), 12)} for i in range(20)}
    rows = spark.createDataFrame([(i, e, float(v)) for i, s in values.items() for e, v in s.items()] + [(None, 1, 2.0), (3, None, 2.0)], "i long, e long, v double")
    found = overlap.shared_pairs(rows, "i", "e", 2, value="v")
    got = {(r.id_1, r.id_2): (r.n, r.sx, r.syy, r.sxy, r.x_min, r.y_max) for r in found.collect()}
    want = {}
    for a, b in combinations(values, 2):
        both = [(values[a][e], values[b][e]) for e in set(values[a]) & set(values[b])]
        if len(both) >= 2:
            xs, ys = zip(*both, strict=True)
            want[a, b] = (len(both), sum(xs), sum(y * y for y in ys), sum(x * y for x, y in both), min(xs), max(ys))
    assert got == want
    if split > 3:  # holders and lists are shuffled; joined rows never are
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
