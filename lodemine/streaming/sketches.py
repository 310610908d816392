"""The sketches on Structured Streaming: mergeable aggregates as state, micro-batches written by batch id.

Each writer stores what a micro-batch changed under ``batch_id=<n>`` in the shared folder and overwrites that
folder when the batch is replayed, so results are the same after a failure. Readers merge the stored parts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemine.functions.hashing import affine_family
from lodemine.operators.sketches import batch_number, bit_setters, fm_combine, fm_max_zeros, reservoir_kept


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", files_per_batch: int = 1, only: str | None = None
) -> DataFrame:
    """A folder of files as a stream; ``only`` is a file-name pattern inside the folder."""
    reader = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return reader.load(path)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], state_dir: str, mode: str = "append") -> None:
    """Process what the source holds now in micro-batches, then stop; progress is kept in ``state_dir``."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{state_dir}/progress")
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    query.awaitTermination()


def _write_part(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")



def stream_fm_windows(
    stream: DataFrame,
    id: str,
    state_dir: str,
    window: Sequence[str] = ("window",),
    n_hash: int = 200,
    groups: int = 5,
    modulus: int = 69997,
    seed: int = 23,
) -> DataFrame:
    """Flajolet-Martin estimate per window of an unbounded stream: (window, estimate).

    Each micro-batch stores its maxima; the estimate merges them, since the maximum of maxima is the maximum.
    """
    family = affine_family(n_hash, seed)
    names = list(window)

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_part(fm_max_zeros(batch, id, names, modulus, family), f"{state_dir}/maxima", batch_id)

    run_available(stream, handle, state_dir)
    stored = stream.sparkSession.read.parquet(f"{state_dir}/maxima")
    merged = stored.groupBy(*names, "hash_no").agg(F.max("max_zeros").alias("max_zeros"))
    return fm_combine(merged, names, n_hash, groups)


def event_time_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Tumbling event-time windows with a watermark: rows and approximate distinct keys per window."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return (
        timed.groupBy(F.window("_ts", width).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key).alias("approx_ids"))
        .select(F.col("_w.start").alias("window_start"), "n", "approx_ids")
    )


def stream_event_windows(stream: DataFrame, ts: str, key: str, state_dir: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Run :func:`event_time_counts` over what is available; the latest stored count of each window stands."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_part(batch, f"{state_dir}/windows", batch_id)

    run_available(event_time_counts(stream, ts, key, width, delay), handle, state_dir, mode="update")
    stored = stream.sparkSession.read.parquet(f"{state_dir}/windows")
    latest = stored.groupBy("window_start").agg(F.max(F.struct("batch_id", "n", "approx_ids")).alias("_v"))
    return latest.select("window_start", "_v.n", "_v.approx_ids")


def stream_bloom_seen(
    stream: DataFrame, id: str, seq: str, state_dir: str, n_bits: int = 69997, n_hash: int = 1, seed: int = 11
) -> DataFrame:
    """(seq, id, is_new) of a stream whose micro-batches arrive in ``seq`` order.

    State is the table of set bits, at most ``n_bits`` rows: each micro-batch reads that of the batch before and writes its own, so
    the work of a batch does not grow with the age of the stream. A row is new when it is the first of its batch to
    reach a bit that no earlier batch has set.
    """
    spark = stream.sparkSession
    family = affine_family(n_hash, seed)
    bits_schema = f"bit bigint, setter {stream.schema[seq].dataType.simpleString()}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        firsts = batch.groupBy(id).agg(F.min(seq).alias("_first"))
        reached = bit_setters(firsts, id, "_first", n_bits, family)
        earlier = None
        if batch_id > 0:
            earlier = spark.read.schema("bit bigint").parquet(f"{state_dir}/bits/batch_id={batch_id - 1}")
            reached = reached.join(earlier, "bit", "left_anti")
        _write_part(reached, f"{state_dir}/fresh", batch_id)
        fresh = spark.read.schema(bits_schema).parquet(f"{state_dir}/fresh/batch_id={batch_id}")
        bits = fresh.select("bit")
        _write_part(bits if earlier is None else bits.unionByName(earlier), f"{state_dir}/bits", batch_id)
        new = fresh.select(F.col("setter").alias(seq)).distinct()
        flags = batch.select(seq, id).join(new.withColumn("_new", F.lit(True)), seq, "left")
        _write_part(flags.select(seq, id, F.coalesce("_new", F.lit(False)).alias("is_new")), f"{state_dir}/flags", batch_id)

    run_available(stream, handle, state_dir)
    return spark.read.parquet(f"{state_dir}/flags").drop("batch_id")


def stream_reservoir(stream: DataFrame, id: str, seq: str, state_dir: str, size: int = 100, seed: int = 553) -> DataFrame:
    """(slot, seq, id): reservoir over a stream, in any arrival order; each micro-batch stores one row per slot."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        last = reservoir_kept(batch, id, seq, size, seed).groupBy("slot").agg(F.max(F.struct(seq, id)).alias("_last"))
        _write_part(last, f"{state_dir}/slots", batch_id)

    run_available(stream, handle, state_dir)
    stored = stream.sparkSession.read.parquet(f"{state_dir}/slots")
    merged = stored.groupBy("slot").agg(F.max("_last").alias("_last"))
    return merged.select("slot", f"_last.{seq}", f"_last.{id}")
