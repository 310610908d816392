import random
import re

from lodemine.llm import ngram_join

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    reach = {i: i for i, _ in sets if i is not None}

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                reach[q] = p
    return sorted((i, len(s), root(i) if i is not None and s else i) for i, s in sets if i is not None)


def texts(rng, n, vocabulary):
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 20, 40, 80]))]
        rows.append(" ".join(words))
    return rows


def got(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, size int").repartition(3)
    return ngram_join.similar_components(frame, **options).collect()


def test_components_match_brute_force(spark):
    for seed, n_words in ((1, 500), (2, 2)):
        rng = random.Random(seed)
        vocabulary = [f"W{k}" for k in range(n_words)]
        rows = list(enumerate(texts(rng, 70, vocabulary), start=10))
        rows += [(1, None), (2, ""), (3, " \t\n"), (4, rows[9][1].upper()), (5, rows[9][1]), (6, "é x " * 9), (7, "a\x0bb"), (8, "x" * 300 + " y")]
        found = sorted(tuple(r) for r in got(spark, rows, held=40 if seed == 1 else 100_000))
        assert found == brute(rows)


def test_a_group_around_one_text_and_a_shared_passage(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = [(100, " ".join(base))]
    for i in range(40):  # all similar to the first, few to each other
        words = list(base)
        for at in rng.sample(range(5, 95), 2):
            words[at] = f"e{i}.{at}"
        rows.append((101 + i, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(200 + i, passage + " " + " ".join(f"u{i}.{k}" for k in range(rng.choice([5, 40])))) for i in range(30)]
    assert sorted(tuple(r) for r in got(spark, rows)) == brute(rows)


def test_odd_ids(spark):
    text = "one two three four five six seven"
    rows = [(3, text), (3, text), (None, text), (9, text), (5, "other words here"), (5, text), (None, "alone here"), (None, None)]
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got(spark, rows)}
    assert found == {(3, 3, 3), (None, 3, 3), (9, 3, 3), (5, 1, 3), (5, 3, 3), (None, 1, None), (None, 0, None)}
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, row int")
    kept = sorted(repr((r["doc_id"], r["text"])) for r in ngram_join.keep_one(frame).collect())
    assert kept == sorted(map(repr, [(3, text), (5, "other words here"), (None, text), (None, "alone here"), (None, None)]))


def test_repeated_ids_chain_components_and_lose_no_text(spark):
    a, b, c = ("one two three four five six", "red green blue black white grey", "ten twenty thirty forty fifty sixty")
    rows = [(4, a), (2, b), (7, a), (7, b), (8, b), (8, c), (9, c), (8, c), (8, ""), (8, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(frame).collect()}
    assert found == {(4, 2), (2, 2), (7, 2), (8, 2), (9, 2), (8, 8)}
    kept = sorted(map(repr, ((r["doc_id"], r["text"]) for r in ngram_join.keep_one(frame).collect())))
    assert kept == sorted(map(repr, [(4, a), (2, b), (8, c), (8, ""), (8, None)]))


def test_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(frame).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {r["doc_id"] for r in ngram_join.keep_one(frame).collect()} == {"a", "c"}


def test_fragments_follow_the_order_and_have_equal_load():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 50))
    counts = rng.integers(50, 400, 50)
    ranks = (np.argsort(np.argsort(counts)) + 1).astype(np.int32)
    rare = rng.integers(-(2**63), 2**63 - 1, 20_000)
    total = len(rare) + int(counts.sum())
    cuts = ngram_join.pivots(total, keys, ranks, counts, 4)
    whole = np.unique(np.concatenate([rare, keys]))
    parts = ngram_join.fragments_of(whole, (keys, ranks), cuts)
    assert len(parts) == 4 and np.array_equal(np.sort(np.concatenate(parts)), whole)
    weight = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    loads = [sum(weight.get(g, 1) for g in p.tolist()) for p in parts]
    assert max(loads) < 1.1 * total / 4
    place = {k: (1, r) for k, r in zip(keys.tolist(), ranks.tolist(), strict=True)}
    highs = [max(place.get(g, (0, g)) for g in p.tolist()) for p in parts]
    lows = [min(place.get(g, (0, g)) for g in p.tolist()) for p in parts]
    assert all(h < low for h, low in zip(highs, lows[1:], strict=False))
    assert all(np.array_equal(p, np.sort(p)) for p in parts)
    none = np.zeros(0, dtype=np.int64)
    assert [len(p) for p in ngram_join.fragments_of(whole, (none, none), ngram_join.pivots(len(whole), none, none, none, 3))][0] > 6000


def test_empty(spark):
    assert got(spark, []) == []
    assert ngram_join.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_frequent_summary_bounds_its_error():
    import numpy as np

    rng = np.random.default_rng(0)
    summary = ngram_join.Frequent(held=50, buffer=500)
    stream = np.concatenate([np.repeat(np.arange(10), 400), rng.integers(1000, 100_000, 6000)])
    rng.shuffle(stream)
    for part in np.array_split(stream, 100):
        summary.add(part)
    summary.flush()
    known = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert len(known) <= 50
    for k in range(10):
        assert 400 - len(stream) / 50 <= known[k] <= 400


def test_only_texts_asked_for_are_moved(spark):
    rows = [(f"d{i}" if i else None, f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "name string, body string").repartition(3)
    asked = spark.createDataFrame([(f"d{i}",) for i in range(7, 4000, 100)], "doc_id string")
    found = {(r.doc_id, r.text) for r in ngram_join.texts_asked(docs, "name", "body", asked).collect()}
    assert {(f"d{i}", f"text {i}") for i in range(7, 4000, 100)} <= found <= set(rows) and len(found) < 100
    none = ngram_join.texts_asked(docs, "name", "body", asked.limit(0))
    assert none.count() == 0


def test_few_hashes_still_have_all_that_was_asked_for(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_PLACES", 40)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    found = {r.doc_id for r in ngram_join.texts_asked(docs, "doc_id", "text", docs.where("doc_id % 2 = 0")).collect()}
    assert found >= set(range(0, 500, 2))
