import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodemine.llm import periodic_runs
from lodemine.llm.queries import REGISTRY


def plain_runs(words, min_length=12):
    """Every run by comparing all neighbours at every distance."""
    n, found = len(words), {}
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            length = i - start + period
            if i > start and length >= max(min_length, 2 * period):
                found.setdefault((start, length), period)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def odd_words(rng):
    kinds, n = rng.choice([1, 2, 3, 50]), rng.choice([0, 1, 11, 12, 13, 30, 80, 200])
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n > 20 and rng.random() < 0.6:
        period, a = rng.randrange(1, n // 3), rng.randrange(n // 2)
        words = words[:a] + [words[a + (i - a) % period] for i in range(a, n)]
    return words


def test_extensions_agree_with_a_plain_walk():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(2) for _ in range(60)]
        sequence = np.array([2, *words, 3])
        levels = periodic_runs.grammar(sequence)
        one, two = np.array([(i, j) for i in range(1, 61) for j in range(i + 1, 61)]).T
        for ahead, step in ((True, 1), (False, -1)):
            got = periodic_runs.extension(levels, one, two, ahead)
            for i, j, length in zip(one, two, got, strict=True):
                n = 0
                while sequence[i + step * n] == sequence[j + step * n]:
                    n += 1
                assert n == length


def test_grammar_levels_expand_to_the_sequence_and_shrink():
    sequence = np.random.default_rng(1).integers(0, 3, 5000)
    levels = periodic_runs.grammar(sequence)
    assert len(np.unique(levels[-1].symbols)) == len(levels[-1].symbols)
    for below, above in zip(levels, levels[1:], strict=False):
        assert len(above.symbols) <= len(below.symbols)
        assert np.array_equal(np.diff(below.first), np.bincount(below.parent))
        for symbol in np.unique(above.symbols)[:50]:  # equal symbols stand for equal stretches
            at = np.flatnonzero(above.symbols == symbol)
            assert len({tuple(below.symbols[below.first[i] : below.first[i + 1]]) for i in at}) == 1


def test_runs_match_brute_force(spark):
    rng = random.Random(2)
    texts = [odd_words(rng) for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = periodic_runs.periodic_runs(spark.createDataFrame(rows, "id int, text string").repartition(3), "text", [F.col("id")])
    for row in found.collect():
        words = texts[row["id"]]
        runs = plain_runs(words)
        assert [tuple(r) for r in row["runs"]] == runs
        assert row["collapsed"] == " ".join(plain_collapsed(words, runs))
        assert row["n_words"] == len(words)


def test_one_text_longer_than_a_slice(spark):
    text = " ".join(f"word{i}" for i in range(400_000)) + " a b c" * 100_000
    docs = spark.createDataFrame([(text,), ("x " * 40,), (text,)], "text string").coalesce(1)
    got = [[tuple(r) for r in row["runs"]] for row in periodic_runs.periodic_runs(docs, "text", [F.lit(1).alias("one")]).collect()]
    assert got == [[(400_000, 300_000, 3)], [(0, 40, 1)], [(400_000, 300_000, 3)]]


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, "a " * 20), (3, "a " * 20), (None, "é é " * 13)]
    docs = spark.createDataFrame(rows, "runs int, text string").withColumn("collapsed", F.lit("x"))
    keep = [F.col("runs").alias("id"), F.col("collapsed").alias("other")]
    got = sorted((repr(r["id"]), r["other"], r["collapsed"], len(r["runs"])) for r in periodic_runs.periodic_runs(docs, "text", keep).collect())
    assert got == sorted([("None", "x", "", 0), ("1", "x", "", 0), ("2", "x", "", 0), ("3", "x", "a", 1), ("3", "x", "a", 1), ("None", "x", "é é", 1)])
    assert periodic_runs.periodic_runs(docs.where("false"), "text", keep).count() == 0


def test_query_matches_the_contract_in_plain_python(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i if i % 17 else None, " ".join(odd_words(rng)) if i % 13 else None) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        n = len(words)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if runs else None
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        collapsed = " ".join(plain_collapsed(words, runs))
        want.append((doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest()))
    got = [tuple(r) for r in REGISTRY["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 50
