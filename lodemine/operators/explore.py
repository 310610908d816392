"""Exploratory summaries: counts, distinct counts, top-k, means over a dimension, partition layout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemine.session import materialize


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent keys by (count descending, key ascending)."""
    return key_counts(df, key).orderBy(F.desc("cnt"), F.asc(key)).limit(k)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def in_year(df: DataFrame, date: str, year: int) -> DataFrame:
    """Rows dated in ``year``, as a range predicate that the parquet reader can use."""
    start, end = dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    kind = df.schema[date].dataType.simpleString()
    return df.where((F.col(date) >= F.lit(str(start)).cast(kind)) & (F.col(date) < F.lit(str(end)).cast(kind)))


def summary(df: DataFrame, user: str, item: str, date: str, year: int = 2018, k: int = 10) -> DataFrame:
    """One row: row counts, distinct users and items, and the top-k of each as arrays of (key, cnt).

    The rows are read once: counts per user and per item come from one aggregation over both grouping sets, reduced before the shuffle.
    """
    kind = df.schema[date].dataType.simpleString()
    start, end = (F.lit(str(dt.datetime(y, 1, 1))).cast(kind) for y in (year, year + 1))
    inside = F.count(F.when((F.col(date) >= start) & (F.col(date) < end), 1))
    sets = df.select(user, item, date).groupingSets([[F.col(user)], [F.col(item)]], F.col(user), F.col(item))
    counts = materialize(sets.agg(F.count(F.lit(1)).alias("cnt"), inside.alias("_in_year"), F.grouping(user).alias("_of_item")))

    def side(key: str, name: str, of_item: int) -> tuple[Column, Column]:
        """Number of non-null keys and the top-k, from one row per key."""
        per_key = counts.where(F.col("_of_item") == of_item)
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), F.col(key).alias("key"))))
        first = per_key.orderBy(F.desc("cnt"), F.asc(key)).limit(k)
        top = first.agg(F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), (-x["neg"]).alias("cnt"))))
        number = per_key.agg(F.count(F.col(key)))
        return number.scalar().alias(f"n_{name}"), top.scalar().alias(f"top_{name}s")

    n_user, top_users = side(user, "user", 0)
    n_item, top_items = side(item, "item", 1)
    totals = counts.where("_of_item = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_review"), F.coalesce(F.sum("_in_year"), F.lit(0)).alias("n_review_year"))
    return totals.select("n_review", "n_review_year", n_user, top_users, n_item, top_items)


def group_mean(facts: DataFrame, dim: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """Mean of ``value`` per dimension attribute ``group``; facts without a dimension row keep a NULL group.

    Facts are reduced to (sum, count) per join key first, so the join sees one row per key however hot the key.
    """
    partial = facts.groupBy(on).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    return (
        partial.join(dim.select(on, group), on, "left")
        .groupBy(group)
        .agg((F.sum("_sum") / F.sum("_n")).alias("avg_value"))
    )


def top_groups(means: DataFrame, group: str, k: int = 10) -> DataFrame:
    return means.orderBy(F.desc_nulls_last("avg_value"), F.asc_nulls_last(group)).limit(k)


def ranked_groups(means: DataFrame, group: str) -> DataFrame:
    return means.orderBy(F.desc_nulls_last("avg_value"), F.asc_nulls_last(group))


def partition_layout(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows per partition, of the frame as it is or after a key-ignoring repartition into ``n``."""
    laid_out = df.repartition(n) if n else df
    return laid_out.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("n_items"))


def map_values_sum(df: DataFrame, key: str, json_map: str, name: str = "total") -> DataFrame:
    """Sum of all values of a JSON map column, per key."""
    values = F.map_values(F.from_json(F.col(json_map), "map<string,bigint>"))
    per_row = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return df.groupBy(key).agg(F.sum(per_row).alias(name))
