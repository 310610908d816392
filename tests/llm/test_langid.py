import random
from collections import Counter

import numpy as np

from lodemine.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, score string"


def naive_windows(text):
    """Boundary-padded windows of up to three characters: letters, pairs with at most one boundary, triples around a letter."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + "".join(w + " " for w in words) if words else " "
    found = Counter(c for c in padded if c != " ")
    found.update(padded[i : i + 2] for i in range(len(padded) - 1))
    found.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return Counter({k: v for k, v in found.items() if k.strip()})


def test_ngrams_are_those_of_each_text_alone():
    texts = ["Ab  c!", None, "", "42 ++", "é\nf", "  zz top  "]
    for together in (texts, texts[::-1]):
        got = {i: Counter() for i in range(len(together))}
        for owner, bucket in langid.ngrams(together, 3, 1 << 40):
            for o, b in zip(owner.tolist(), bucket.tolist(), strict=True):
                got[o][b] += 1
        for i, text in enumerate(together):
            assert sorted(got[i].values()) == sorted(naive_windows(text or "").values())
            alone = Counter(b for _, bs in langid.ngrams([text], 3, 1 << 40) for b in bs.tolist())
            assert got[i] == alone


def test_long_texts_are_cut_at_spaces(monkeypatch):
    text = "abc de " * 50
    whole = Counter(b for _, bs in langid.ngrams([text], 3, 1 << 40) for b in bs.tolist())
    monkeypatch.setattr(langid, "PIECE", 20)
    assert Counter(b for _, bs in langid.ngrams([text], 3, 1 << 40) for b in bs.tolist()) == whole


def test_learns_languages_and_defines_odd_rows(spark):
    rng = random.Random(1)
    words = {"xx": ["foo", "bar", "ofo"], "yy": ["zig", "quz", "izq"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=8)), lang, "s") for i, lang in enumerate(["xx", "yy"] * 30)]
    odd = [(100, None, "xx", "s"), (101, "", "yy", "s"), (102, "12 !!", None, "s"), (None, "foo bar", None, None), (104, "zig " * 5000, None, None), (0, rows[0][1], "xx", "s")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    model = langid.train(docs, "text", "lang")
    assert model.languages == ["xx", "yy"]
    got = langid.predict(spark, docs, "doc_id", "text", model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert all(by[i][0] == lang for i, _, lang, _ in rows)
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[None][0] == "xx" and by[104][0] == "yy"
    assert all(0 <= s <= 1 for _, s in by.values())


def test_empty_table_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, None)], SCHEMA)
    model = langid.train(docs, "text", "lang")
    assert langid.predict(spark, docs, "doc_id", "text", model).first()["lang_pred"] == "und"
    assert langid.predict(spark, docs.limit(0), "doc_id", "text", model).count() == 0


def test_table_holds_log_probabilities(spark):
    docs = spark.createDataFrame([(1, "aa ab", "p", ""), (2, "ba", "q", "")], SCHEMA)
    model = langid.train(docs, "text", "lang", n_buckets=64)
    assert np.allclose(np.exp(model.table.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert np.allclose(np.exp(model.priors), 0.5)
