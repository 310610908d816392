"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the native operators: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that may teach a model: a known id outside the held-out quarter."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; other files are given by their path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(df: DataFrame, name: str = "row") -> Column:
    """All columns of a frame as one struct, so that helper columns can never clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpack(df: DataFrame, name: str = "row") -> list[Column]:
    return [F.col(f"`{name}`.`{f}`").alias(f) for f in df.schema[name].dataType.fieldNames()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start)
