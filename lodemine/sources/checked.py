"""Readers that keep what they can't parse: good rows beside a reject channel of (file, line, reason), and counts per file.

Every reader goes over the lines of a text file or folder once; a line is either a good row or a reject, never both and never lost.
Blank lines are no lines, as for Spark's own readers. A record is one line, so quoted line feeds are not supported here. Fields that are
absent (JSON) or empty (CSV) are null, not rejects. The checks are built-in expressions; no Python runs on a line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.session import materialize

NOT_JSON, WRONG_TYPE, FIELD_COUNT = "not json", "wrong type", "field count"
BAD = "_bad"


@dataclass
class Checked:
    """All lines of a source: (file, line, reason, row); ``reason`` is null for good rows, ``row`` for the others."""

    lines: DataFrame

    def stored(self) -> "Checked":
        """The same, parsed once and stored, for callers that want several of the parts."""
        return Checked(materialize(self.lines))

    def good(self) -> DataFrame:
        return self.lines.where("reason IS NULL").select("row.*")

    def rejects(self) -> DataFrame:
        return self.lines.where("reason IS NOT NULL").select("file", "line", "reason")

    def counts(self) -> DataFrame:
        """(file, n_lines, n_rejected), one row per file with a line."""
        return self.lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count("reason").alias("n_rejected"))


def text_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(file, line) of all lines that aren't blank; with ``header`` every line equal to a file's first line is left out.

    All files of a folder have the same header, so the first line of any of them is taken.
    """
    raw = spark.read.text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("value") != "")
    if header and (first := raw.where(F.trim("value") != "").first()):
        lines = lines.where(F.col("line") != first.value)
    return lines


def _split(lines: DataFrame, parsed: Column, reason: Column) -> Checked:
    """``parsed`` is a struct with the field BAD, set where the line does not fit the schema."""
    read = lines.withColumn("_row", parsed)
    bad = F.col(f"_row.{BAD}").isNotNull() | F.col("_row").isNull()
    read = read.withColumn("reason", F.when(bad, reason))
    return Checked(read.select("file", "line", "reason", F.when(F.col("reason").isNull(), F.col("_row").dropFields(BAD)).alias("row")))


def json_lines(spark: SparkSession, path: str, schema: str) -> Checked:
    """One JSON object per line; rejects are lines that are no JSON object and such with a field of another type."""
    lines = text_lines(spark, path)
    parsed = F.from_json("line", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    whole = F.try_parse_json("line")
    no_object = whole.isNull() | ~F.coalesce(F.schema_of_variant(whole), F.lit("")).startswith("OBJECT")
    return _split(lines, parsed, F.when(no_object, NOT_JSON).otherwise(WRONG_TYPE))


def csv_lines(spark: SparkSession, path: str, schema: str, header: bool = True) -> Checked:
    """Comma-separated lines with optional quotes; rejects have another number of fields or a field of another type."""
    lines = text_lines(spark, path, header)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "quote": '"', "escape": '"'}
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    texts = F.from_csv("line", f"{', '.join(f'{n} string' for n in names)}, {BAD} string", options)
    parsed = F.from_csv("line", f"{schema}, {BAD} string", options)
    return _split(lines, parsed, F.when(texts.getField(BAD).isNotNull(), FIELD_COUNT).otherwise(WRONG_TYPE))


def points(spark: SparkSession, path: str, dimensions: int) -> Checked:
    """Lines ``id,truth,x1,...,xd`` as (id, truth, features[]); rejects have another number of fields or a field that is no number."""
    parts = F.split("line", ",")
    features = F.transform(F.slice(parts, 3, dimensions), lambda x: x.try_cast("double"))
    id, truth = F.get(parts, F.lit(0)).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")
    counted = F.size(parts) == dimensions + 2
    numbers = id.isNotNull() & truth.isNotNull() & F.forall(features, lambda x: x.isNotNull())
    bad = F.when(counted & numbers, F.lit(None).cast("string")).otherwise(F.lit(""))
    row = F.struct(id.alias("id"), truth.alias("truth"), features.alias("features"), bad.alias(BAD))
    return _split(text_lines(spark, path), row, F.when(counted, WRONG_TYPE).otherwise(FIELD_COUNT))
