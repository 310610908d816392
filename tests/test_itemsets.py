import random
from collections import Counter
from itertools import combinations

import pytest

from lodemine.operators import itemsets


def basket_frame(spark, rows):
    return spark.createDataFrame([(k, i) for k, items in rows.items() for i in items], "basket long, item string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = {k: {x for x in "abcdefgh" if rng.random() < 0.4} | {"a"} for k in range(60)}
    out[60] = set("abcdefghijklmnop")
    return out


def brute(rows, support, max_k=9):
    counts = Counter()
    for items in rows.values():
        for k in range(1, max_k + 1):
            counts.update(combinations(sorted(items), k))
    return {s: n for s, n in counts.items() if n >= support}


def as_dict(df):
    return {tuple(r.itemset): r.freq for r in df.collect()}


@pytest.mark.parametrize("chunks", [1, 3, 7])
def test_result_does_not_depend_on_chunks(spark, rows, chunks):
    b = basket_frame(spark, rows)
    assert as_dict(itemsets.frequent_itemsets(b, 12, chunks=chunks)) == brute(rows, 12)


def test_backends_agree(spark, rows):
    b = basket_frame(spark, rows)
    assert as_dict(itemsets.frequent_itemsets(b, 15, max_k=3, backend="fpgrowth")) == brute(rows, 15, 3)


def test_candidates_are_the_union_of_local_results(spark, rows):
    want = set()
    for c in range(3):
        local = {k: v for k, v in rows.items() if k % 3 == c}
        want |= {s for s, n in brute(local, 1).items() if n * len(rows) >= len(local) * 12}
    got = {tuple(r.itemset) for r in itemsets.son_candidates(basket_frame(spark, rows), 12, 3).collect()}
    assert got == want


def test_empty_and_unreachable_support(spark):
    empty = spark.createDataFrame([], "basket long, item string")
    assert itemsets.frequent_itemsets(empty, 2).count() == 0
    assert itemsets.frequent_itemsets(empty, 2, backend="fpgrowth").count() == 0
    few = basket_frame(spark, {1: {"a"}, 2: {"b"}})
    assert itemsets.frequent_itemsets(few, 2).count() == 0


def test_baskets_fold_repeats_but_count_rows(spark):
    df = spark.createDataFrame([("d", 1, "x"), ("d", 1, "x"), ("d", 1, "y"), ("d", 2, "x"), ("d", 2, "y")], "day string, c int, p string")
    got = {(r.basket, r.item) for r in itemsets.baskets(df, ["day", "c"], "p", min_rows=2).collect()}
    assert got == {("d-1", "x"), ("d-1", "y")}
    assert itemsets.baskets(df, ["day", "c"], "p", min_rows=2, count_distinct=True).count() == 0


def test_extended_candidates_need_all_subsets(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("a", "e")]
    df = spark.createDataFrame([(2, list(p)) for p in pairs], "size int, itemset array<string>")
    assert {tuple(r.itemset) for r in itemsets.extend_candidates(df, 2).collect()} == {("a", "b", "c"), ("b", "c", "d")}
    triples = [t for t in combinations("abcd", 3)] + [("a", "b", "e")]
    df3 = spark.createDataFrame([(3, list(t)) for t in triples], "size int, itemset array<string>")
    assert [tuple(r.itemset) for r in itemsets.extend_candidates(df3, 3).collect()] == [("a", "b", "c", "d")]


def test_report_lines(spark):
    df = spark.createDataFrame([(1, ["b"]), (1, ["a"]), (2, ["a", "b"])], "size int, itemset array<string>")
    rows = itemsets.itemset_lines({"Candidates": df, "Frequent Itemsets": df.where("size = 1")}).collect()
    assert [(r.section, r.size, r.line) for r in rows] == [
        ("Candidates", 1, "('a'),('b')"), ("Candidates", 2, "('a', 'b')"), ("Frequent Itemsets", 1, "('a'),('b')")]


def test_bitmaps_and_walk_count_alike(spark, monkeypatch):
    rng = random.Random(12)
    rows = sorted({(b, rng.choice("abcdefgh")) for b in range(300) for _ in range(rng.randrange(1, 6))})
    b = spark.createDataFrame([*rows, (1000, None)], "basket long, item string").repartition(3)
    sets = [s for k in (1, 2, 3) for s in combinations("abcdefg", k)] + [("h",), ("zz",)]
    candidates = spark.createDataFrame([(len(s), list(s)) for s in sets], "size int, itemset array<string>")
    held = {}
    for basket, item in rows:
        held.setdefault(basket, set()).add(item)
    want = {s: n for s in sets if (n := sum(set(s) <= items for items in held.values()))}
    monkeypatch.setattr(itemsets, "BITMAP_BYTES", 900)  # several blocks of baskets and candidates
    for counted in (itemsets.count_by_bitmaps(b, candidates), itemsets.count_by_walking(b, candidates)):
        assert {tuple(r["itemset"]): r["freq"] for r in counted.collect()} == want
    assert itemsets.count_itemsets(b, candidates.limit(0)).count() == 0
