import os

import pytest

from lodemine.llm.common import held_out
from lodemine.llm.oracle import ORACLE
from lodemine.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    got = REGISTRY[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {','.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_models_hold_out_a_quarter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = {r["doc_id"] for r in docs.where(held_out()).collect()}
    for name, truth, right in (("op1_language_id", langs, lambda r: r["lang_pred"] == langs[r["doc_id"]]), ("op3_quality", labels, lambda r: r["predicted"] == labels[r["doc_id"]])):
        rows = REGISTRY[name](spark, FOLDER).collect()
        assert {r["doc_id"] for r in rows if r["held_out"]} == out and len(rows) == len(langs)
        held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
        assert sum(map(right, held)) >= 0.9 * len(held)
