from pyspark.sql import functions as F

from lodemine.operators import explore


def reviews(spark):
    rows = [("u1", "b1", "2018-01-01", 5.0), ("u1", "b2", "2018-12-31", 3.0), ("u2", "b1", "2017-12-31", 1.0),
            ("u2", "b3", "2019-01-01", 4.0), ("u3", "b1", "2018-06-01", 2.0)]
    return spark.createDataFrame(rows, "user string, item string, date string, stars double").withColumn("date", F.to_timestamp("date"))


def test_summary_counts_and_ties(spark):
    s = explore.summary(reviews(spark), "user", "item", "date", 2018, k=2).first()
    assert (s.n_review, s.n_review_year, s.n_user, s.n_item) == (5, 3, 3, 3)
    assert [(x.key, x.cnt) for x in s.top_users] == [("u1", 2), ("u2", 2)]
    assert [(x.key, x.cnt) for x in s.top_items] == [("b1", 3), ("b2", 1)]


def test_year_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    reviews(spark).write.parquet(path)
    plan = explore.in_year(spark.read.parquet(path), "date", 2018)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan


def test_group_mean_keeps_unknown_group_and_duplicates(spark):
    dim = spark.createDataFrame([("b1", "X"), ("b2", "Y"), ("b2", "Z")], "item string, city string")
    means = explore.group_mean(reviews(spark), dim, "item", "city", "stars")
    got = [(r.city, r.avg_value) for r in explore.ranked_groups(means, "city").collect()]
    assert got == [(None, 4.0), ("Y", 3.0), ("Z", 3.0), ("X", 8.0 / 3)]
    assert [r.city for r in explore.top_groups(means, "city", 2).collect()] == [None, "Y"]


def test_repartitioning_changes_layout_not_result(spark):
    r = reviews(spark)
    assert explore.top_k(r, "item").collect() == explore.top_k(r.repartition(2), "item").collect()
    layout = explore.partition_layout(r, 2).collect()
    assert len(layout) == 2 and sum(x.n_items for x in layout) == 5


def test_map_values_sum_skips_malformed_json(spark):
    df = spark.createDataFrame([("a", '{"x":1,"y":2}'), ("a", "{broken"), ("b", '{"x":5}')], "k string, j string")
    assert {r.k: r.total for r in explore.map_values_sum(df, "k", "j").collect()} == {"a": 3, "b": 5}
