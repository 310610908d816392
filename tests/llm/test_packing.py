import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodemine.llm import packing
from lodemine.llm.common import tokenizer_file
from lodemine.llm.queries import REGISTRY

tokenizers = pytest.importorskip("tokenizers")
PARTS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", " the", " cat", " ", "　", "9", ",", ".", " ;", "<|endoftext|>", "\x1c", " \n ", "​", "\x85", " ᠎a", "\0"]


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_encoder_gives_the_ids_of_the_tokenizer(plain):
    rng = random.Random(3)
    encoder = packing.Encoder(tokenizer_file("byte_bpe_50k.json"))
    for _ in range(150):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 40, 200]))) for _ in range(rng.randrange(1, 9))]
        ids, sizes = encoder.encode(pa.array(texts, pa.string()), 0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_other_tokenizer_files_are_applied_to_whole_texts():
    path = tokenizer_file("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["Some  words here", "", "and\nmore"]
    ids, sizes = packing.Encoder(path).encode(pa.array(texts), 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*t.encode(x, add_special_tokens=False).ids, 7] for x in texts]


def used(patterns, capacity):
    out = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= capacity and n > 0
        for length in pattern:
            out[length] += n
    return out


def test_plans_use_every_piece_once_and_come_near_the_least_number():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 101, 5000), np.clip(rng.lognormal(2.5, 1, 5000), 1, 100).astype(int), rng.integers(30, 65, 3000), np.full(9, 100), np.full(7, 1)):
        counts = Counter(lengths.tolist())
        patterns = packing.plan(counts, 100)
        assert used(patterns, 100) == counts
        least = -(-int(lengths.sum()) // 100)
        half = int((lengths > 50).sum())
        assert sum(n for _, n in patterns) <= 1.03 * max(least, half) + 1
    assert packing.plan({}, 100) == []


def test_exact_complements_of_one_two_and_three_lengths():
    for counts in ({60: 4, 40: 4}, {60: 4, 25: 4, 15: 4}, {50: 3, 20: 3, 19: 3, 11: 3}, {25: 8}):
        patterns = packing.exact_plan(counts, 100, 3)
        assert used(patterns, 100) == Counter(counts) and all(sum(p) == 100 for p, _ in patterns)


def test_pair_counts_stay_right_while_lengths_run_out():
    rng = np.random.default_rng(2)
    index = packing.SumIndex(np.append(0, rng.integers(0, 3, 40)))
    for length in range(40, 0, -1):
        while index.left[length]:
            found = index.exact(length, 3) or (length,)
            index.take(found, index.times(found))
            there = (index.left > 0).astype(int)
            assert np.array_equal(index.pairs, np.convolve(there, there)[:41])


def rows_of(spark, documents, capacity, plain):
    made = packing.pieces(documents, "text", [F.col("id")], tokenizer_file("byte_bpe_50k.json"), capacity)
    return packing.pack_pieces(made, capacity)


def test_packed_sequences_hold_every_document_whole(spark, plain):
    rng = random.Random(8)
    rows = [(i % 50, " ".join(rng.choice(["the", "cat", "Ünder", "x9"]) for _ in range(rng.choice([0, 1, 5, 30, 90])))) for i in range(150)]
    rows += [(None, None), (3, None), (7, "same text"), (7, "same text")]
    documents = spark.createDataFrame(rows, "id int, text string").withColumn("length", F.lit("clash")).repartition(4)
    packed = rows_of(spark, documents, 32, plain)
    sequences = packing.sequences(packed).collect()
    assert len({s["sequence_id"] for s in sequences}) == len(sequences)
    stretches = []
    for s in sequences:
        assert len(s["ids"]) <= 32
        assert [p["offset"] for p in s["parts"]] == np.cumsum([0, *[p["length"] for p in s["parts"]]])[:-1].tolist()
        stretches += [(p["doc"]["id"], p["piece"], p["start"], tuple(s["ids"][p["offset"] : p["offset"] + p["length"]])) for p in s["parts"]]
    want = []
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        at = [0, *range(len(ids) % 32 or 32, len(ids), 32), len(ids)]
        want += [(i, k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    assert sorted(map(repr, stretches)) == sorted(map(repr, want))
    total = sum(len(w[3]) for w in want)
    assert len(sequences) <= -(-total // 32) + 1


def test_query_on_a_table(spark, tmp_path, plain):
    rows = [(i, "word " * (700 * i)) for i in range(8)] + [(9, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = REGISTRY["op11_packing"](spark, str(tmp_path)).collect()
    for i, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and [r["length"] for r in mine[1:]] == [2048] * (len(mine) - 1)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert REGISTRY["op11_packing"](spark, f"{tmp_path}/none").count() == 0
