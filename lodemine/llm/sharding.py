"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes.

1. Rows are numbered within the partitions they are read in, and written once to the shared folder, so that
   retried tasks see the same numbering.
2. How many rows of each partition go to each shard is drawn exactly. The matrix is never built as a whole: partitions
   form a binary tree; at each node the shard counts of its left half are a multivariate hypergeometric draw from
   the node's own counts, seeded by the node. A task walks from the root to its own partition and so computes its own
   row of the one matrix that all tasks agree on. Only the partition sizes, one number per input partition, are sent around.
3. In each partition the shard labels, repeated as the matrix says, are permuted and given to the rows; rows move
   once; inside each shard a second random order gives the slots. Shards are cut into random buckets that are ordered in
   separate tasks, with bucket sizes added up to slot offsets, so that no task holds a whole shard.

Defined results: every row gets exactly one (shard, slot); shard sizes differ by at most one, the first
shards being the larger; slots of a shard run from 0 without gaps. Null ids, null texts and repeated rows are rows like others.
An empty table gives an empty result. The columns of the input are carried in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemine.llm.common import pack
from lodemine.session import materialize


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; inversion around the mode, for populations of any size.

    The support is cut at 12 standard deviations (and 50 more), beyond which lies less than 1e-30 of the mass.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = int(12 * (n * good / total * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5) + 50
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split(rng: np.random.Generator, counts: list[int], n: int) -> list[int]:
    """A multivariate hypergeometric draw: ``n`` of the items of which there are ``counts``."""
    out, rest = [], sum(counts)
    for c in counts:
        got = hypergeometric(rng, c, rest - c, n)
        out.append(got)
        rest -= c
        n -= got
    return out


def shard_sizes(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def matrix_row(sizes_before: np.ndarray, at: int, n_shards: int, seed: int) -> list[int]:
    """How many rows of partition number ``at`` go to each shard; ``sizes_before`` are cumulated sizes from 0."""
    low, high = 0, len(sizes_before) - 1
    counts = shard_sizes(int(sizes_before[-1]), n_shards)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), counts, int(sizes_before[middle] - sizes_before[low]))
        if at < middle:
            counts, high = left, middle
        else:
            counts, low = [c - x for c, x in zip(counts, left, strict=True)], middle
    return counts


def shuffle_into_shards(rows: DataFrame, n_shards: int, seed: int = 17, rows_per_bucket: int = 20_000) -> DataFrame:
    """(row, shard, slot) for every row: a uniformly random arrangement into ``n_shards`` shards."""
    numbered = materialize(
        rows.select(pack(rows), F.monotonically_increasing_id().alias("_id")).select(
            "row", F.shiftright("_id", 33).alias("part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("idx")
        )
    )
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(sizes)
    before = np.concatenate([[0], np.cumsum([sizes[p] for p in parts], dtype=np.int64)]).astype(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((np.asarray(parts, dtype=np.int64), before))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, before = shared.value
        current, labels = None, None
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            idx = batch.column("idx").to_numpy(zero_copy_only=False)
            shard = np.zeros(len(part), dtype=np.int32)
            for p in np.unique(part).tolist():
                if p != current:
                    at = int(np.searchsorted(parts, p))
                    counts = matrix_row(before, at, n_shards, seed)
                    labels = np.repeat(np.arange(n_shards, dtype=np.int32), counts)
                    np.random.default_rng([seed, 1, p]).shuffle(labels)
                    current = p
                mine = part == p
                shard[mine] = labels[idx[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    def dealt(frame: DataFrame) -> DataFrame:
        out = frame.mapInArrow(deal, frame.withColumn("shard", F.lit(0)).schema)
        # A random 63-bit order; its leading share picks the bucket, so buckets are ranges of the order.
        order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("part"), F.col("idx")), 1)
        return out.withColumn("order", order).withColumn("bucket", F.floor(F.col("order") / (2.0**63) * n_buckets).cast("int"))

    n_buckets = max(1, -(-int(before[-1]) // (n_shards * rows_per_bucket)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt(numbered.select("part", "idx"))
        .groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("order", "part", "idx")
    ranked = dealt(numbered).withColumn("rank", F.row_number().over(within))
    return ranked.join(materialize(offsets, small=True), ["shard", "bucket"]).select("row", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))
