import numpy as np

from lodemine.llm import mixing

F = mixing.F


def naive(cells, targets, rounds=200):
    """Raking in numpy: cells is a list of (keys, tokens), targets a list of dictionaries."""
    tokens = np.asarray([t for _, t in cells], float)
    weight = np.ones(len(cells))
    for _ in range(rounds):
        for d, target in enumerate(targets):
            present = {k[d] for k, t in cells if t}
            whole = sum(v for k, v in target.items() if k in present)
            for value in present:
                mine = np.asarray([k[d] == value for k, _ in cells])
                share = (tokens * weight)[mine].sum() / tokens.sum()
                weight[mine & (tokens > 0)] *= target.get(value, 0) / whole / share if share else 1
    return weight


def test_raking_matches_numpy(spark):
    cells = [(("a", "x"), 100), (("a", "y"), 30), (("b", "x"), 10), (("b", "y"), 50), (("c", "y"), 20), (("c", "x"), 0)]
    targets = [{"a": 2.0, "b": 2.0, "c": 1.0, "nothing": 5.0}, {"x": 0.4, "y": 0.6}]
    frame = spark.createDataFrame([(*k, t) for k, t in cells], "s string, l string, tokens bigint")
    given = {n: spark.createDataFrame(list(t.items()), "value string, share double") for n, t in zip(("s", "l"), targets, strict=True)}
    got = {(r["s"], r["l"]): r["weight"] for r in mixing.rake(frame, given, tolerance=1e-9, max_rounds=200).collect()}
    want = naive(cells, targets)
    for (k, _), w in zip(cells, want, strict=True):
        assert abs(got[k] - w) < 1e-5
    only = {"s": given["s"].where("value != 'b'")}
    assert {r["s"]: r["weight"] for r in mixing.rake(frame, only).collect()}["b"] == 0


def test_documents_get_calibrated_rates(spark):
    rows = [(i, "w " * (1 + i % 9) + ("| " if i % 5 == 0 else ""), "en" if i % 3 else None, "big" if i % 4 else "small") for i in range(4000)]
    rows += [(-1, None, None, None), (-2, "", "en", "big"), (None, "x", "en", "big"), rows[0], (-3, "long " * 100_000, "en", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("tokens", F.lit("clash"))
    found = mixing.mix_documents(docs)
    got = found.select("doc.doc_id", "doc.source", "tokens", "rate", "copies").collect()
    assert len(got) == len(rows)
    assert all(0 <= r["rate"] <= 1 + 1e-9 and r["copies"] in (0, 1) for r in got)
    assert max(r["rate"] for r in got) > 0.999
    totals = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in ("big", "small")}
    expected = {s: sum(r["tokens"] * r["rate"] for r in got if r["source"] == s) for s in totals}
    assert abs(expected["big"] / expected["small"] / (totals["big"] / totals["small"]) ** 0.8 - 1) < 0.01
    taken = sum(r["copies"] for r in got)
    mean = sum(r["rate"] for r in got)
    assert abs(taken - mean) < 5 * sum(r["rate"] * (1 - r["rate"]) for r in got) ** 0.5 + 1
    assert sorted(map(str, found.select("doc.doc_id", "copies").collect())) == sorted(map(str, mixing.mix_documents(docs.repartition(3)).select("doc.doc_id", "copies").collect()))


def test_budget_repeats_documents(spark):
    docs = spark.createDataFrame([(i, "a b", "en", "s") for i in range(50)], "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(docs, {"k": F.col("source")}, {"k": 1.0}, budget=250.0).collect()
    assert all(abs(r["rate"] - 2.5) < 1e-6 and r["copies"] in (2, 3) for r in got)
    assert {r["copies"] for r in got} == {2, 3}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert mixing.mix_documents(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "s")], "doc_id bigint, text string, lang string, source string")
    assert [r["copies"] for r in mixing.mix_documents(blank).collect()] == [1]


def test_a_tiny_cell_does_not_thin_out_the_others(spark):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string"
    docs = spark.createDataFrame([(i, "w " * 200, "en" if i % 3 else "de", "big" if i % 4 else "small") for i in range(2000)] + [(-1, "a b c", "en", "tiny")], schema)
    rows = mixing.mix_documents(docs).select("doc.doc_id", "rate", "copies").collect()
    assert sum(r["rate"] for r in rows if r["doc_id"] >= 0) > 0.6 * 2000
    (one,) = (r for r in rows if r["doc_id"] == -1)
    assert one["rate"] > 2 and one["copies"] in (int(one["rate"]), int(one["rate"]) + 1)
    kept = [r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, "").collect()]
    assert kept.count(-1) == one["copies"] and len(kept) == sum(r["copies"] for r in rows)
