import os

import pytest

import corpus_pipeline
from lodemine.llm import decontaminate, ngram_join, quality
from lodemine.llm.common import learnable

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids, columns = {r[0] for r in docs.select("doc_id").collect()}, docs.columns
    sizes = [len(ids)]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER))
        kept = [r[0] for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids, name
        if name == "quality":
            model, table = quality.train(before, spark.read.parquet(f"{FOLDER}/labels.parquet"), learnable())
            assert set(kept) == {r[0] for r in table.where(model.score() >= 0.7).select("doc_id").collect()}
        if name == "near_copies":
            groups = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(before).collect()}
            assert set(kept) == set(groups.values())
        if name == "decontamination":
            bad = decontaminate.find_overlaps(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet"), ["doc_id"]).where("contaminated")
            assert set(kept) == ids - {r["doc"]["doc_id"] for r in bad.collect()}
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
        ids = set(kept)
        sizes.append(len(ids))
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and 0 < sizes[4] < sizes[3] and sizes[5] == sizes[4]


def test_odd_rows_and_empty_tables_pass_all_stages(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text + f" {i} {i} {i} {i} {i} {i}" * 5, None, None, None, "x", i) for i in range(20)]
    rows += [(None, None, None, None, None, None, None), (30, "", "en", "s", 0, "x", 1), (31, text, "en", "s", 1, "x", 1), (31, text, "en", "s", 1, "x", 1), (32, "tail " * 100_000, "en", "s", 1, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, row int")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = corpus_pipeline.materialize(stage(spark, frame, FOLDER))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "shard", "slot"]


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
