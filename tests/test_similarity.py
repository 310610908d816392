import hashlib
import random
from itertools import combinations

import pytest

from lodemine.functions.hashing import affine_family
from lodemine.operators import overlap, similarity
from lodemine.operators.overlap import shared_pairs
from lodemine.plans.queries import REGISTRY


def make_sets(seed, n=50):
    rng = random.Random(seed)
    base = [set(rng.sample(range(60), rng.randint(1, 14))) for _ in range(8)]
    out = {}
    for i in range(n):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.randint(0, 60)}
        s |= {0} if rng.random() < 0.6 else set()  # an element most sets hold
        out[i] = s or {1}
    for i in range(n, n + 6):
        out[i] = {0, 1}  # a mass of copies
    for i in range(n + 6, n + 16):
        out[i] = {0, 100 + i}  # small sets that meet only in the common element
    return out


def frame(spark, sets):
    return spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id long, e long")


def jac(a, b):
    return len(a & b) / len(a | b)


def reps(sets):
    seen = {}
    for i in sorted(sets):
        seen.setdefault(frozenset(sets[i]), i)
    return {i: set(s) for s, i in seen.items()}


@pytest.mark.parametrize("threshold,crowded", [(0.5, 1000), (0.5, 3), (0.3, 4), (0.8, 2)])
def test_jaccard_pairs_equal_brute_force(spark, threshold, crowded):
    sets = make_sets(1)
    got = {(r.item_1, r.item_2): r.similarity for r in similarity.jaccard_pairs(frame(spark, sets), "id", "e", threshold, crowded=crowded).collect()}
    r = reps(sets)
    want = {(a, b): jac(r[a], r[b]) for a, b in combinations(sorted(r), 2) if jac(r[a], r[b]) >= threshold}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("crowded,n_bands,modulus", [(1000, 40, 10000), (2, 40, 10000), (1000, 20, 2147483647)])
def test_lsh_pairs_share_a_band_and_reach_the_threshold(spark, crowded, n_bands, modulus):
    sets = make_sets(2)
    width = 80 // n_bands
    family = affine_family(80, 80, modulus + 1, modulus)
    sig = {i: [min((a * e + b) % modulus for e in s) for _, a, b in family] for i, s in sets.items()}
    r = reps(sets)
    want = {
        (a, b): jac(r[a], r[b])
        for a, b in combinations(sorted(r), 2)
        if jac(r[a], r[b]) >= 0.5 and any(sig[a][k : k + width] == sig[b][k : k + width] for k in range(0, 80, width))
    }
    got = similarity.lsh_pairs(frame(spark, sets), "id", "e", n_bands=n_bands, modulus=modulus, crowded=crowded)
    assert {(x.item_1, x.item_2): x.similarity for x in got.collect()} == pytest.approx(want)
    assert want


@pytest.mark.parametrize("places", [3, 2**21])
def test_blocks_of_sets_meet_whole(spark, places, monkeypatch):
    for name, value in (("LEAST_LOAD", 300), ("MOST_LOAD", 300), ("SET_LOAD", 2), ("MOVED_LOAD", 2000), ("COUNTED_PAIRS", 40), ("UNFOLDED_ROWS", 7), ("ROWS_PER_PASS", 400)):
        monkeypatch.setattr(overlap, name, value)
    monkeypatch.setattr(similarity, "COPY_PLACES", places)
    sets = make_sets(5, 90)
    r = reps(sets)
    named = spark.createDataFrame([(f"d{i:03}", f"w{e}") for i, s in sets.items() for e in s], "id string, e string")
    want = {(f"d{a:03}", f"d{b:03}"): jac(r[a], r[b]) for a, b in combinations(sorted(r), 2) if jac(r[a], r[b]) >= 0.4}
    assert {(x.item_1, x.item_2): x.similarity for x in similarity.jaccard_pairs(named, "id", "e", 0.4).collect()} == pytest.approx(want)
    meet = similarity.lsh_pairs(named, "id", "e", n_bands=80, modulus=3, threshold=0.4)  # every bucket is crowded
    assert {(x.item_1, x.item_2): x.similarity for x in meet.collect()} == pytest.approx(want)


def test_repeated_rows_need_their_first_common_element_in_reach(spark):
    # Every row comes twice: sizes are 12, 8 common rows are needed, an element in common makes four, the rarest come first.
    sets = {1: "abcxyz", 2: "defxyz", 3: "ghrstu", 4: "ijrstu"}
    rows = [(i, e) for i, s in sets.items() for e in s] * 2
    groups = spark.createDataFrame([(i, i, 1) for i in sets], "id long, rep long, n_copies long")
    found = similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, e string"), "id", "e", groups=groups).collect()
    assert [(x.item_1, x.item_2, x.similarity) for x in found] == [(3, 4, 2.0)]


def test_expanded_pairs_are_all_pairs_of_items(spark):
    sets = make_sets(3)
    df = frame(spark, sets)
    groups = similarity.set_groups(df, "id", "e")
    pairs = similarity.jaccard_pairs(df, "id", "e", 0.5)
    got = {(r.item_1, r.item_2): r.similarity for r in similarity.expand_pairs(pairs, groups, "id").collect()}
    want = {(a, b): jac(sets[a], sets[b]) for a, b in combinations(sorted(sets), 2) if jac(sets[a], sets[b]) >= 0.5}
    assert got == pytest.approx(want)


def test_minhash_of_words_uses_a_hash_of_the_word(spark):
    docs = spark.createDataFrame([(1, "b A  c"), (2, "c\nd"), (3, "   ")], "id long, text string")
    words = similarity.words(docs, "id", "text")
    index = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (2**31 - 1) for w in "abcd"}
    sets = {1: ["a", "b", "c"], 2: ["c", "d"]}
    got = {(r.id, r.hash_no): r.min_hash for r in similarity.minhash(words, "id", "word", 13, 100, 9).collect()}
    family = affine_family(13, 9, 101, 100)
    assert got == {(i, j): min((a * index[w] + b) % 100 for w in ws) for i, ws in sets.items() for j, a, b in family}


@pytest.mark.parametrize("at_least,crowded", [(2, 1000), (2, 3), (4, 2), (1, 2)])
def test_shared_pairs_equal_brute_force(spark, at_least, crowded):
    sets = make_sets(4, 35)
    got = {(r.id_1, r.id_2): r.n for r in shared_pairs(frame(spark, sets), "id", "e", at_least, crowded=crowded).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= at_least}
    assert got == want


def test_minhash_signature_ranks_the_words_of_all_documents(spark, tmp_path):
    texts = {1: "b a", 2: "c B é", 3: None, 4: "z c c a", 5: " "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.hash_no): r.min_hash for r in REGISTRY["minhash_signature"](spark, str(tmp_path)).collect()}
    words = {d: set(t.lower().split()) for d, t in texts.items() if t and t.strip()}
    rank = {w: i for i, w in enumerate(sorted(set().union(*words.values())))}
    assert got == {(d, j): min((a * rank[w] + b) % 10000 for w in ws) for d, ws in words.items() for j, a, b in affine_family(80, 80, 10001, 10000)}
