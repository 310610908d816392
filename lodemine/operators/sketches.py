"""Stream sketches over a numbered id stream, in relational form: Bloom membership, Flajolet-Martin, reservoir.

``seq`` is the 1-based position of each row in the stream; ``batch = floor((seq - 1) / batch_size)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.functions.hashing import (
    POSITION_PRIME,
    affine,
    affine_family,
    family_rows,
    position_hash,
    string_residue,
    trailing_zeros,
)


# Hash functions whose maxima share one aggregation row.
HASHES_PER_PART = 10


def batch_number(seq: Column | str, batch_size: int) -> Column:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor((seq - 1) / batch_size).cast("bigint")


def bloom_hash_count(n_bits: int, n_inserts: int) -> int:
    """Best number of hash functions, round(bits / inserts * ln 2), at least one."""
    return max(1, round(n_bits / n_inserts * math.log(2)))


def bloom_expected_fpr(n_bits: int, n_inserts: int, n_hash: int) -> float:
    return (1 - math.exp(-n_hash * n_inserts / n_bits)) ** n_hash


def bit_setters(firsts: DataFrame, id: str, first: str, n_bits: int, family: list[tuple[int, int, int]]) -> DataFrame:
    """(bit, setter): the earliest ``first`` value that reaches each bit; one row per set bit.

    Bits depend only on the residue of the id, so ids collapse to at most ``n_bits`` residues before the
    hash functions multiply the rows.
    """
    residues = firsts.groupBy(string_residue(F.col(id).cast("string"), n_bits).alias("residue")).agg(F.min(first).alias("setter"))
    return (
        residues.where(F.col("residue").isNotNull())
        .select("setter", "residue", F.explode(family_rows(family)).alias("h"))
        .select("setter", affine(F.col("residue"), F.col("h.a"), F.col("h.b"), n_bits).alias("bit"))
        .groupBy("bit")
        .agg(F.min("setter").alias("setter"))
    )


def _new_rows(df: DataFrame, id: str, seq: str, n_bits: int, family: list[tuple[int, int, int]]) -> DataFrame:
    """Sequence numbers of the rows that set at least one bit, i.e. that the filter calls new."""
    firsts = df.groupBy(id).agg(F.min(seq).alias("_first"))
    return bit_setters(firsts, id, "_first", n_bits, family).select(F.col("setter").alias(seq)).distinct()


def _bloom_family(df: DataFrame, n_bits: int, n_hash: int | None, seed: int) -> list[tuple[int, int, int]]:
    return affine_family(n_hash if n_hash else bloom_hash_count(n_bits, df.count()), seed)


def bloom_seen(df: DataFrame, id: str, seq: str, n_bits: int = 69997, n_hash: int | None = None, seed: int = 11) -> DataFrame:
    """Per stream row, whether a Bloom filter filled in stream order takes its id for a new one."""
    family = _bloom_family(df, n_bits, n_hash, seed)
    new = _new_rows(df, id, seq, n_bits, family).withColumn("_new", F.lit(True))
    return df.join(new, seq, "left").select(seq, id, F.coalesce("_new", F.lit(False)).alias("is_new"))


def bloom_fpr(
    df: DataFrame, id: str, seq: str, batch_size: int, n_bits: int = 69997, n_hash: int | None = None, seed: int = 11
) -> DataFrame:
    """Per batch, ids unseen in earlier batches that the filter calls seen, over the batch size.

    After its first row an id has all its bits set, so only first rows can count: an id is a false positive of
    the batch it first occurs in when that first row sets no bit.
    """
    family = _bloom_family(df, n_bits, n_hash, seed)
    firsts = df.groupBy(id).agg(F.min(seq).alias(seq))
    wrong = (
        firsts.join(_new_rows(df, id, seq, n_bits, family), seq, "left_anti")
        .groupBy(batch_number(seq, batch_size).alias("batch"))
        .agg(F.count(F.lit(1)).alias("_wrong"))
    )
    batches = df.select(batch_number(seq, batch_size).alias("batch")).distinct()
    return batches.join(wrong, "batch", "left").select(
        "batch", (F.coalesce("_wrong", F.lit(0)) / F.lit(batch_size)).alias("fpr")
    )


def fm_max_zeros(df: DataFrame, id: str, window: Sequence[str], modulus: int, family: list[tuple[int, int, int]]) -> DataFrame:
    """(window, hash_no, max_zeros): mergeable state.

    Ids collapse to residues first; each residue is then repeated once per HASHES_PER_PART hash functions, whose maxima share
    one aggregation row.
    """
    residues = df.select(*window, string_residue(F.col(id).cast("string"), modulus).alias("residue")).distinct()
    numbers = range(HASHES_PER_PART)

    def part(start: int) -> Column:
        rows = family[start : start + HASHES_PER_PART]
        rows += [rows[-1]] * (HASHES_PER_PART - len(rows))
        factors = [F.lit(x).cast("bigint").alias(f"{n}{i}") for i, r in enumerate(rows) for n, x in (("a", r[1]), ("b", r[2]))]
        return F.struct(F.lit(start // HASHES_PER_PART).alias("part"), *factors)

    parts = F.array(*[part(start) for start in range(0, len(family), HASHES_PER_PART)])
    zeros = [F.max(trailing_zeros(affine(F.col("residue"), F.col(f"h.a{i}"), F.col(f"h.b{i}"), modulus))).alias(f"m{i}") for i in numbers]
    maxima = residues.where(F.col("residue").isNotNull()).select(*window, "residue", F.explode(parts).alias("h")).groupBy(*window, F.col("h.part").alias("part")).agg(*zeros)
    out = maxima.select(*window, "part", F.posexplode(F.array(*[f"m{i}" for i in numbers])).alias("at", "max_zeros"))
    out = out.select(*window, (F.col("part") * HASHES_PER_PART + F.col("at")).alias("hash_no"), "max_zeros")
    return out.where(F.col("hash_no") < len(family))


def fm_combine(maxima: DataFrame, window: Sequence[str], n_hash: int, groups: int) -> DataFrame:
    """Mean of the maxima per hash group, median over groups, two to that power, rounded half to even."""
    size = n_hash // groups
    return (
        maxima.where(F.col("hash_no") < size * groups)
        .groupBy(*window, F.floor(F.col("hash_no") / size).alias("_group"))
        .agg(F.avg("max_zeros").alias("_mean"))
        .groupBy(*window)
        .agg(F.bround(F.pow(F.lit(2.0), F.median("_mean")), 0).cast("bigint").alias("estimate"))
    )


def fm_distinct(
    df: DataFrame, id: str, window: str, n_hash: int = 200, groups: int = 5, modulus: int = 69997, seed: int = 23
) -> DataFrame:
    """Flajolet-Martin estimate beside the exact distinct count, per window value."""
    maxima = fm_max_zeros(df, id, [window], modulus, affine_family(n_hash, seed))
    exact = df.groupBy(window, id).agg(F.lit(1).alias("_one")).groupBy(window).agg(F.count(id).alias("exact"))
    return exact.join(fm_combine(maxima, [window], n_hash, groups), window).select(window, "exact", "estimate")


def reservoir_kept(df: DataFrame, id: str, seq: str, size: int, seed: int) -> DataFrame:
    """Rows that enter the reservoir, with the slot they take; about size * ln(rows / size) of them pass."""
    n = F.col(seq)
    keep = position_hash(n, seed) / F.lit(float(POSITION_PRIME)) < F.lit(float(size)) / n
    slot = F.when(n <= size, n - 1).otherwise(position_hash(n, seed + 1) % size)
    return df.where((n <= size) | keep).select(slot.cast("bigint").alias("slot"), seq, id)


def reservoir(df: DataFrame, id: str, seq: str, size: int = 100, seed: int = 553) -> DataFrame:
    """Reservoir sample after the whole stream: the last row kept in each slot."""
    return (
        reservoir_kept(df, id, seq, size, seed)
        .groupBy("slot")
        .agg(F.max(F.struct(seq, id)).alias("_last"))
        .select("slot", f"_last.{seq}", f"_last.{id}")
    )


def reservoir_snapshots(
    df: DataFrame,
    id: str,
    seq: str,
    batch_size: int,
    slots: Sequence[int] = (0, 20, 40, 60, 80),
    size: int = 100,
    seed: int = 553,
    block: int = 1024,
) -> DataFrame:
    """Content of chosen slots at the end of every batch, one row per batch.

    Each kept row is valid from its batch up to the batch before the next one kept in the same slot. These
    few intervals meet the batches through blocks of ``block`` batches.
    """
    batch = batch_number(seq, batch_size)
    kept = (
        reservoir_kept(df, id, seq, size, seed)
        .where(F.col("slot").isin(list(slots)))
        .groupBy("slot", batch.alias("_from"))
        .agg(F.max(F.struct(seq, id)).alias("_last"))
    )
    batches = df.select(batch.alias("_batch")).distinct().withColumn("_block", F.floor(F.col("_batch") / block))
    last_batch = df.agg(batch_number(F.max(seq), batch_size)).scalar()
    # The window holds only kept rows: size-in-log(stream) many per slot.
    following = Window.partitionBy("slot").orderBy("_from")
    intervals = kept.select(
        "slot",
        "_from",
        F.coalesce(F.lead("_from").over(following), last_batch + 1).alias("_until"),
        F.col(f"_last.{id}").alias("_id"),
    ).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_until") - 1) / block))))
    joined = batches.join(
        intervals.select("slot", "_block", "_from", "_until", "_id"),
        "_block",
        "left",
    ).withColumn("_valid", (F.col("_batch") >= F.col("_from")) & (F.col("_batch") < F.col("_until")))
    content = [F.max(F.when(F.col("_valid") & (F.col("slot") == s), F.col("_id"))).alias(f"id_{s}") for s in slots]
    return joined.groupBy("_batch").agg(*content).select(((F.col("_batch") + 1) * batch_size).alias("seqnum"), *[f"id_{s}" for s in slots])
