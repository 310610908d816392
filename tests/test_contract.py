import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", ["review_summary", "city_avg_stars", "son_frequent", "graph_edges", "bloom_seen", "reservoir_sample"])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    got = contract.queries()[name](spark, FOLDER)
    want = con.sql(contract.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r) for r in con.sql(f"SELECT {','.join(chr(34) + c + chr(34) for c in columns)} FROM ({contract.oracle_sql()[name]})").fetchall()]
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("absent", ["lodemine.llm", "corpus_pipeline", "ahocorasick", "tiktoken", "tokenizers", "regex"])
def test_other_queries_register_without_an_optional_module(absent):
    """A module that can't be imported costs at most the queries that need it."""
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as c; print(len(c.queries()), 'son_frequent' in c.queries(), len(c.oracle_sql()) > 40)"
    root = os.path.dirname(os.path.abspath(contract.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 60 and out[1:] == ["True", "True"]
