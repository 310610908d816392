import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemine.llm import filter_audit
from lodemine.llm.filter_audit import FIGURES, classes, distinct_spans, figures
from lodemine.llm.queries import REGISTRY

PARTS = ["a", "B", "é", "漢", "😀", " ", "\n", "\t", "#", "|", "ab", "Zz", "x" * 9, "longwordlongword", "longwordlongworD", " ", " "]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words), len(set(words)), len(text), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)))


def test_figures_match_regular_expressions():
    rng = random.Random(2)
    for _ in range(80):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 40, 2000]))) for _ in range(rng.randrange(1, 9))]
        got = figures([t.encode() for t in texts], classes("#$%&*|"))
        assert [plain(t) for t in texts] == list(zip(*[got[f].tolist() for f in FIGURES], strict=True))


def test_malformed_bytes_have_defined_counts():
    got = figures([b"\x80\x80 \xff", b"\xe6\xbc a", b"\xf0\x9f"], classes("#"))
    assert got["n_points"].tolist() == [4, 3, 1]
    assert got["n_words"].tolist() == [2, 2, 1]


def test_words_with_equal_hash_keys_are_told_apart():
    """With all keys equal only the comparison of bytes is left."""
    words = [b"alpha", b"beta!", b"alpha", b"gamma", b"alphabetically1", b"alphabetically2", b"alphabetically1"]
    data = np.frombuffer(b"".join(words) + bytes(8), dtype=np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    real = filter_audit._eights
    try:
        filter_audit._eights = lambda d, s, n, o: np.zeros(len(s), dtype=np.uint64) if len(s) == len(words) and o == 0 else real(d, s, n, o)
        assert distinct_spans(data, starts, lengths, np.zeros(len(words), dtype=np.int64), 1).tolist() == [5]
    finally:
        filter_audit._eights = real


def write(spark, folder, documents, labels):
    spark.createDataFrame(documents, "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def fails(row, documents):
    words, distinct, points, capitals, symbols = plain(row[1] or "")
    out = {"A"} if words < 200 else set()
    out |= {"B"} if 100 * distinct < 50 * words else set()
    out |= {"C"} if 100 * capitals > 3 * points else set()
    out |= {"D"} if symbols else set()
    smaller = any(d[0] is not None and d[0] < row[0] and (d[1] or "") == (row[1] or "") for d in documents) if row[0] is not None else False
    return out | ({"E"} if smaller else set())


def test_query_matches_filters_applied_one_after_another(spark, tmp_path):
    rng = random.Random(4)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "A B", "#", long, long + " #", long.upper(), "w " * 300, "W# " * 300, long]
    documents = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    documents.append((99, long, "only"))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(30)] + [(3, 1, 0), (3, 0, 1)]
    write(spark, str(tmp_path), documents, labels)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = [(d[2] or "", fails(d, documents), d[0] in good, d[0] in toxic) for d in documents]
    want, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            mine = alive
            for step, letter in enumerate(order, 1):
                gone = [r for r in alive if letter in r[1]]
                redundant = sum(letter in r[1] for r in mine) - len(gone)
                alive = [r for r in alive if letter not in r[1]]
                unique = sum(r[1] == {letter} for r in mine)
                want[part, "".join(order), step] = [len(alive), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
    got = REGISTRY["op12_filter_audit"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 600 * 4
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        counts = [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]]
        assert counts == want[key], key
        assert r["shapley"] == removed_by[r["part"], r["filter_order"][r["step"] - 1]]


@pytest.mark.parametrize("which", ["documents", "labels"])
def test_empty_tables(spark, tmp_path, which):
    write(spark, str(tmp_path), [] if which == "documents" else [(1, "x", None)], [] if which == "labels" else [(1, 1, 1)])
    assert REGISTRY["op12_filter_audit"](spark, str(tmp_path)).count() == (0 if which == "documents" else 600)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([("a B", 5, "c")], "text string, n_words int, kept string")
    got = filter_audit.text_figures(docs, "text", [F.col("n_words").alias("mine"), F.col("kept")]).first()
    assert (got["mine"], got["kept"], got["n_words"], got["n_capitals"]) == (5, "c", 2, 1)
