"""Readers for the input shapes: JSON lines, CSV with header, quoted CSV, headerless points, id streams, folders.

Schemas are declared, so no reader makes an inference pass. Malformed fields become NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared schemas of the JSON-lines entities (fixed field names of the input files).
REVIEW = "review_id string, user_id string, business_id string, stars double, date string"
BUSINESS = "business_id string, city string, state string, stars double, review_count bigint, categories string"
USER = "user_id string, review_count bigint, average_stars double, useful bigint"
PHOTO = "business_id string"
TIP = "business_id string, user_id string"
CHECKIN = "business_id string, time map<string,bigint>"
# Declared schemas of the CSV inputs.
RATING = "user_id string, business_id string, stars double"
PAIR = "user_id string, business_id string"

ENTITIES = {"review": REVIEW, "business": BUSINESS, "user": USER, "photo": PHOTO, "tip": TIP, "checkin": CHECKIN}


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; only the fields of ``schema`` are parsed."""
    return spark.read.schema(schema).json(path)


def csv_with_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def retail_transactions(spark: SparkSession, path: str) -> DataFrame:
    """(date, customer, product) from a quoted CSV with header: columns 0, 1 and 5."""
    raw = spark.read.option("header", True).option("quote", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
    date, customer, product = raw.columns[0], raw.columns[1], raw.columns[5]
    return raw.select(
        F.col(f"`{date}`").alias("date"), F.col(f"`{customer}`").alias("customer"), F.col(f"`{product}`").try_cast("bigint").alias("product")
    )


def numeric_points(spark: SparkSession, path: str) -> DataFrame:
    """(id, truth, features[]) from headerless lines ``id,truth,x1,...,xd``; truth -1 marks an outlier."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p"))
    features = F.transform(F.expr("slice(p, 3, size(p))"), lambda x: x.try_cast("double"))
    return parts.select(
        F.element_at("p", 1).try_cast("bigint").alias("id"), F.try_element_at("p", F.lit(2)).try_cast("bigint").alias("truth"), features.alias("features")
    )


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id) one per text line; read the folder with streaming.read_stream for the unbounded form."""
    return spark.read.text(path).select(F.col("value").alias("id"))


def entity_folder(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named JSON entity (review, business, user, photo, tip, checkin) of a dataset folder."""
    return json_lines(spark, f"{folder}/{name}.json", ENTITIES[name])


def ratings_folder(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, rating) from a rating CSV."""
    raw = csv_with_header(spark, path, RATING)
    return raw.select(F.col("user_id").alias("user"), F.col("business_id").alias("item"), F.col("stars").alias("rating"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table ``<folder>/<name>.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
