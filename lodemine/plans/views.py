"""The test tables seen as the roles the operators work on: reviews, baskets, graph, ratings, points, streams.

These are fact-to-dimension joins on a key that is unique on the dimension side; adaptive execution splits a hot
key's partition on the fact side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.operators.skew import positions
from lodemine.sources.readers import table


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item, stars, date, order_key, price): order lines, one review each; stars 1..5 from the quantity."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("date"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_suppkey").alias("item"),
        (F.lit(1) + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.col("l_extendedprice").alias("price"),
    )
    return lines.join(orders, "order_key").select("user", "item", "stars", "date", "order_key", "price")


def priced(rows: DataFrame) -> DataFrame:
    """The reviews with stars of which three quarters follow from the price: the dearer, the fewer."""
    worth = 5 - F.least(F.floor(F.col("price") / 20_000), F.lit(4))
    return rows.withColumn("stars", (F.col("stars") + 3 * worth) / 4)


def cities(spark: SparkSession, folder: str) -> DataFrame:
    """(item, city, state): supplier with its nation and region."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("state"))
    supplier = table(spark, folder, "supplier")
    return supplier.join(nation, "s_nationkey").join(region, "r_regionkey").select(F.col("s_suppkey").alias("item"), "city", "state", F.col("s_name").alias("categories"))


def rating_facts(spark: SparkSession, folder: str, with_price: bool = False) -> DataFrame:
    """(user, item, n_train, s_train, n_test, s_test), one row per pair: number and sum of the stars on either side.

    Every fifth order is held out as the test part. This is the one pass over the reviews for all rating queries. ``with_price``
    takes the stars of :func:`priced` and adds the cents spent, c_train and c_test.
    """
    held_out = F.col("order_key") % 5 == 0

    def side(name: str, mine: Column) -> list[Column]:
        out = [F.count(F.when(mine, 1)).alias(f"n_{name}"), F.sum(F.when(mine, F.col("stars")).otherwise(0.0)).alias(f"s_{name}")]
        cents = F.sum(F.when(mine, F.round(F.col("price") * 100).cast("bigint")).otherwise(0)).alias(f"c_{name}")
        return [*out, cents] if with_price else out

    rows = reviews(spark, folder)
    return (priced(rows) if with_price else rows).groupBy("user", "item").agg(*side("train", ~held_out), *side("test", held_out))


def ratings(facts: DataFrame, part: str) -> DataFrame:
    """(user, item, rating): the mean rating of each pair in the ``train`` or ``test`` part."""
    return facts.where(F.col(f"n_{part}") > 0).select("user", "item", (F.col(f"s_{part}") / F.col(f"n_{part}")).alias("rating"))


def spending(facts: DataFrame, part: str) -> DataFrame:
    """(user, item, spend): what a pair's order lines cost on average in the ``train`` or ``test`` part, in cents."""
    return facts.where(F.col(f"n_{part}") > 0).select("user", "item", (F.col(f"c_{part}") / F.col(f"n_{part}")).alias("spend"))


def brand_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(order, brand) rows: the brands of an order's parts."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("p_partkey"))
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return lines.join(part, "p_partkey").select("order", "brand")


def retail_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(day, customer, product) rows."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_custkey").alias("customer")
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("product"))
    return lines.join(orders, "l_orderkey").select("day", "customer", "product")


def part_customers(spark: SparkSession, folder: str) -> DataFrame:
    """(part, customer) rows: who ordered a part."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"))
    return lines.join(orders, "l_orderkey").select("part", "customer")


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item): what kind of event a user caused in which hour."""
    events = table(spark, folder, "events")
    hour = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH")
    return events.select(F.col("user_id").alias("user"), F.concat_ws("|", "event_type", hour).alias("item"))


# Shared items that an edge of the activity graph needs, at every scale.
ACTIVITY_THRESHOLD = 6


def points(spark: SparkSession, folder: str) -> DataFrame:
    """(id, truth, features)."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), F.col("embedding").cast("array<double>").alias("features"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, id): event user ids in arrival order."""
    return table(spark, folder, "events").select((F.col("event_id") + 1).alias("seq"), F.col("user_id").cast("string").alias("id"))


def part_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, id): part keys of all order lines, numbered in (order, line) order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return positions(lines, [], ["l_orderkey", "l_linenumber", "l_partkey"], name="seq").select("seq", F.col("l_partkey").cast("string").alias("id"))
