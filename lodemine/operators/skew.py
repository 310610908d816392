"""Building blocks that keep a hot key, which may hold a third of all rows, off a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.session import materialize

# A key with more rows than this is split over several tasks.
ROWS_PER_SPLIT = 1_000_000


def hot_keys(df: DataFrame, on: Sequence[str], rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Keys above ``rows_per_split`` rows with their number of splits; at most rows/rows_per_split keys exist."""
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_split)
        .select(*on, F.ceil(F.col("_rows") / rows_per_split).cast("int").alias("_splits"))
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    rows_per_split: int = ROWS_PER_SPLIT,
    hot: DataFrame | None = None,
    hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join with hot keys of ``left`` salted and the matching rows of ``right`` repeated per salt.

    Hot keys are looked for first, by a count over the key columns of ``left``, stored; without any, this is a plain join.
    The salt is a hash of the left row, so a retried task salts alike. The hot-key table has at most
    (left rows / rows_per_split) rows; whether to broadcast it is left to the planner. ``how`` may be inner, left, left_semi or left_anti. A caller that
    knows the hot keys passes them as ``hot``, over the columns ``hot_on`` (part of the join key, default all).
    """
    keys = [on] if isinstance(on, str) else list(on)
    hot_on = list(hot_on) if hot_on else keys
    if hot is None:
        hot = materialize(hot_keys(left, hot_on, rows_per_split), small=True)
    if hot.isEmpty():
        return left.join(right, keys, how)
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    spread = F.xxhash64(*[F.col(c) for c in left.columns])
    salt = F.when(any_null, F.pmod(spread, F.lit(1024))).otherwise(F.pmod(spread, F.coalesce(F.col("_splits"), F.lit(1))))
    salted = left.join(hot, hot_on, "left").withColumn("_salt", salt.cast("int")).drop("_splits")
    repeated = (
        right.join(hot, hot_on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1)))
        .drop("_splits")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    name: str = "pos",
    total: str | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Add the 1-based rank of each row within its group (and the group's row count as ``total``).

    Groups of up to ``rows_per_split`` rows are ranked by a window. Larger ones, and a global rank without group
    columns, are ranked over many tasks by :func:`_range_positions`.
    """
    group = list(group)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if not group:
        return _range_positions(df, group, order, name, total)
    large = materialize(hot_keys(df, group, rows_per_split).select(*[F.col(g).alias(f"_large_{g}") for g in group]), small=True)
    if large.isEmpty():
        return _window_positions(df, group, order, name, total)
    same = _same({g: f"_large_{g}" for g in group})
    return _window_positions(df.join(large, same, "left_anti"), group, order, name, total).unionByName(
        _range_positions(df.join(large, same, "left_semi"), group, order, name, total)
    )


def _same(columns: dict[str, str]) -> Column:
    """Equality of column pairs under which NULL equals NULL, so that a NULL group is a group like others."""
    out = F.lit(True)
    for left, right in columns.items():
        out = out & F.col(left).eqNullSafe(F.col(right))
    return out


def _window_positions(df: DataFrame, group: list[str], order: list[Column], name: str, total: str | None) -> DataFrame:
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    return ranked.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*group))) if total else ranked


def _range_positions(df: DataFrame, group: list[str], order: list[Column], name: str, total: str | None) -> DataFrame:
    """Ranks without a task per group.

    Rows are range-partitioned and sorted by (group, order), numbered inside each range, and shifted by the
    number of rows the group has in earlier ranges. A group of any size is spread over many ranges.
    """
    sort = [*[F.col(g) for g in group], *order]
    numbered = materialize(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_row", 33).cast("int"))
    )
    starts = numbered.groupBy(*group, "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A window partition holds one row per range, never the rows themselves.
    per_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = per_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = starts.select(
        *group,
        "_range",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_n").over(per_group).alias("_total"),
    )
    shifts = shifts.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_range").alias("_of_range"), "_shift", "_total")
    out = numbered.join(shifts, _same({**{g: f"_of_{g}" for g in group}, "_range": "_of_range"}))
    columns = [*[F.col(f"`{c}`") for c in df.columns], (F.col("_row") + F.col("_shift")).alias(name)]
    if total:
        columns.append(F.col("_total").alias(total))
    return out.select(*columns)


def segment_lines(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], text: str, separator: str = ", ", per_segment: int = 10_000
) -> DataFrame:
    """Join the ``text`` values of each group, in order, into lines cut into segments of ``per_segment`` values.

    The concatenation of a group's segments is the whole line; no task ever holds more than one segment.
    """
    ranked = positions(df, group, order)
    return (
        ranked.withColumn("segment", F.floor((F.col("pos") - 1) / per_segment).cast("int"))
        .groupBy(*group, "segment")
        .agg(F.array_sort(F.collect_list(F.struct("pos", text))).alias("_parts"))
        .select(*group, "segment", F.array_join(F.col(f"_parts.{text}"), separator).alias("line"))
    )
