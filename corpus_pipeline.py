"""The corpus pipeline: quality, near copies, benchmark overlap, mixing and sharding, each on what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next stage. All but
the last return the columns of ``docs``; the last adds ``shard`` and ``slot`` (replacing columns of those names).
Defined results for odd rows are those of the operators; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm import decontaminate, mixing, ngram_join, quality, sharding
from lodemine.llm.common import learnable
from lodemine.session import materialize
from lodemine.sources.readers import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), learnable())


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without words all stay."""
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights; a document taken several times is as many rows."""
    taken = mixing.mix_documents(docs).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows dealt at random to eight shards of equal size, with their places."""
    dealt = sharding.shuffle_into_shards(docs, 8)
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_copies", without_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the fitted rules of the first stage or the random draws of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
