import json

from pyspark.sql import functions as F

from lodemine.operators import graph
from lodemine.sources import readers, sinks


def write(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def test_json_entities_with_a_malformed_line(spark, tmp_path):
    lines = [json.dumps({"business_id": "b1", "city": "Brno", "stars": 4.5, "review_count": 3, "categories": None, "state": "CZ", "extra": 1}), "{oops"]
    write(tmp_path / "business.json", "\n".join(lines))
    write(tmp_path / "checkin.json", '{"business_id":"b1","time":{"Fri-0":2,"Sat-1":3}}\n')
    rows = readers.entity_folder(spark, str(tmp_path), "business").orderBy(F.asc_nulls_last("business_id")).collect()
    assert (rows[0].business_id, rows[0].city, rows[0].categories) == ("b1", "Brno", None) and rows[1].business_id is None
    assert readers.entity_folder(spark, str(tmp_path), "checkin").first().time == {"Fri-0": 2, "Sat-1": 3}


def test_csv_shapes(spark, tmp_path):
    ratings = write(tmp_path / "train.csv", "user_id,business_id,stars\nu1,b1,4.0\nu2,b1,x\n")
    got = {(r.user, r.item, r.rating) for r in readers.ratings_folder(spark, ratings).collect()}
    assert got == {("u1", "b1", 4.0), ("u2", "b1", None)}
    retail = write(tmp_path / "retail.csv", '"DATE","CUST","AGE","PIN","SUB","PRODUCT_ID","N"\n"11/1/2000","01","A","B","C","4710","1"\n')
    row = readers.retail_transactions(spark, retail).first()
    assert tuple(row) == ("11/1/2000", "01", 4710)
    points = write(tmp_path / "points.csv", "0,-1,1.5,2\n1,3,0,-4.25\n")
    assert [tuple(r) for r in readers.numeric_points(spark, points).orderBy("id").collect()] == [(0, -1, [1.5, 2.0]), (1, 3, [0.0, -4.25])]
    ids = write(tmp_path / "ids.txt", "u1\nu2\n")
    assert [r.id for r in readers.id_lines(spark, ids).collect()] == ["u1", "u2"]


def test_sinks(spark, tmp_path):
    scores = graph.edge_betweenness(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    assert [r.line for r in sinks.betweenness_lines(scores).collect()] == ["('1', '2'),2.0", "('2', '3'),2.0"]
    sinks.write_lines(sinks.betweenness_lines(scores), str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).count() == 2
    rounds = spark.createDataFrame([(2, 9, 1, 2, 0), (1, 5, 0, 0, 1)], "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
    assert [r.line for r in sinks.round_lines(rounds).collect()] == ["Round 1: 5,0,0,1", "Round 2: 9,1,2,0"]
    labels = spark.createDataFrame([(2, -1), (1, 0)], "id long, cluster long")
    assert [r.line for r in sinks.label_lines(labels).collect()] == ["1,0", "2,-1"]
    sinks.write_csv(labels, str(tmp_path / "c"), ["user_id", "prediction"])
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True).collect())) == [("1", "0"), ("2", "-1")]
    report = spark.range(1).select(F.lit(3).alias("n"), F.array(F.struct(F.lit("a").alias("key"), F.lit(1).alias("cnt"))).alias("top"))
    sinks.write_report(report, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value) == {"n": 3, "top": [{"key": "a", "cnt": 1}]}
