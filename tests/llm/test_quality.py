import math
import random

from lodemine.llm import quality

DOCS = "doc_id bigint, text string, n_words string"


def rows_of(rng, n):
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(90)) for _ in range(rng.randrange(5, 60))]
        out.append((i, " ".join(words) + "." if good else " ".join(w + rng.choice(["###", "***"]) for w in words), int(good)))
    return out


def test_statistics_by_hand(spark):
    text = "Ab AB!! ab ab | #x\nAb AB!! ab ab | #x\n\n x1."
    docs = spark.createDataFrame([(1, text, "z"), (2, None, None), (3, "", None), (4, " \n\t", None)], DOCS)
    got = {r["doc_id"]: r.asDict() for r in quality.statistics(docs, "text", [quality.F.col("doc_id")]).collect()}
    one = got[1]
    assert one["n_words"] == 13 and one["same_line_share"] == 1 / 3 and one["line_words"] == 13 / 3
    assert one["bar_share"] == 2 / 13 and one["bang_share"] == 4 / 13 and one["capital_share"] == 2 / 13 and one["repeat_share"] == 2 / 13
    assert one["distinct_share"] == 6 / 13 and one["stop_share"] == 1 / 13
    assert one["symbol_share"] == 4 / len(text) and one["digit_share"] == 1 / len(text)
    for i in (2, 3):
        assert all(v == 0 for k, v in got[i].items() if k != "doc_id")
    assert got[4]["n_words"] == 0


def test_tree_paths_become_rules():
    text = """DecisionTreeClassificationModel: depth=2
  If (feature 3 <= 0.5)
   If (feature 0 <= 2.0)
    Predict: 0.0
   Else (feature 0 > 2.0)
    Predict: 1.0
  Else (feature 3 > 0.5)
   If (feature 3 <= 0.75)
    Predict: 0.0
   Else (feature 3 > 0.75)
    Predict: 1.0
"""
    inf = math.inf
    assert quality.tree_rules(text) == [
        ((3, -inf, 0.5),),
        ((0, -inf, 2.0), (3, -inf, 0.5)),
        ((0, 2.0, inf), (3, -inf, 0.5)),
        ((3, 0.5, inf),),
        ((3, 0.5, 0.75),),
        ((3, 0.75, inf),),
    ]


def test_learns_and_the_column_is_the_weighted_sum_of_rules(spark):
    rows = rows_of(random.Random(4), 300)
    docs = spark.createDataFrame([(i, t, "") for i, t, _ in rows] + [(900, None, None), (901, "", None), (902, "word " * 50_000, None), rows[0][:2] + ("",)], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(900, None), (None, 1), (902, 7)], "doc_id bigint, quality int")
    model, table = quality.train(docs, labels, quality.F.col("doc_id") % 4 != 2)
    assert model.rules
    scored = table.withColumn("score", model.score()).collect()
    assert len(scored) == 304
    truth = {i: q for i, _, q in rows}
    held = [r for r in scored if r["doc_id"] in truth and r["doc_id"] % 4 == 2]
    assert sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    for r in scored:
        total = model.intercept + sum(w for rule, w in model.rules if all(low < r[model.names[f]] <= high for f, low, high in rule))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9 and 0 <= r["score"] <= 1
    kept = quality.keep_good(docs, labels, quality.F.lit(True))
    assert kept.columns == docs.columns and 0 < kept.count() < 304


def test_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(1, "some text", ""), (2, "more", "")], DOCS)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    for known, want in ((labels, 1.0), (labels.limit(0), 0.5)):
        model, table = quality.train(docs, known, quality.F.lit(True))
        assert [round(r[0], 6) for r in table.select(model.score()).collect()] == [want, want]
    assert quality.keep_good(docs.limit(0), labels, quality.F.lit(True)).count() == 0
