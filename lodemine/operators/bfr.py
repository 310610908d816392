"""Chunked clustering with discard, compression and retained sets, over cluster summaries (n, sum, sum of squares).

Points stay distributed; cluster summaries, whose number is bounded by the parameters, travel through the
driver. Points are (id, features array<double>).

Centres are found by Lloyd steps from given first centres. A step is one pass over the points that are nowhere shuffled: each task sums
its points per nearest centre, and only these sums, one per task and centre, are added up. First centres are chosen among the points of the
least hashes, so that whoever knows the points can follow the whole run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.operators.skew import positions
from lodemine.session import materialize

# Summaries are held in every task: clusters times dimensions is checked against this many values.
MAX_SUMMARY_VALUES = 20_000_000


def cluster_stats(points: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """(cluster, n, sum[], sumsq[]) by one mergeable aggregation over (cluster, dimension)."""
    long = points.select(F.col(cluster).alias("cluster"), F.posexplode(features).alias("dim", "x"))
    per_dim = long.groupBy("cluster", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "s", "ss")))
    return per_dim.groupBy("cluster").agg(F.max("n").alias("n"), ordered.alias("_v")).select(
        "cluster", "n", F.col("_v.s").alias("sum"), F.col("_v.ss").alias("sumsq")
    )


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Summaries of both frames added per cluster."""
    rows = a.unionByName(b).select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "v"))
    per_dim = rows.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.sum").alias("s"), F.sum("v.sumsq").alias("ss"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "s", "ss")))
    return per_dim.groupBy("cluster").agg(F.max("n").alias("n"), ordered.alias("_v")).select(
        "cluster", "n", F.col("_v.s").alias("sum"), F.col("_v.ss").alias("sumsq")
    )


@dataclass
class Summaries:
    """Cluster summaries on the driver, keyed in ascending order."""

    keys: list[int]
    n: np.ndarray
    sum: np.ndarray
    sumsq: np.ndarray

    @staticmethod
    def empty(dims: int) -> "Summaries":
        return Summaries([], np.zeros(0), np.zeros((0, dims)), np.zeros((0, dims)))

    @staticmethod
    def collect(stats: DataFrame, dims: int) -> "Summaries":
        most = max(1, MAX_SUMMARY_VALUES // max(dims, 1))
        rows = stats.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} clusters of {dims} dimensions: lower the number of clusters")
        if not rows:
            return Summaries.empty(dims)
        rows.sort(key=lambda r: r["cluster"])
        return Summaries(
            [r["cluster"] for r in rows],
            np.array([r["n"] for r in rows], dtype=float),
            np.array([r["sum"] for r in rows]),
            np.array([r["sumsq"] for r in rows]),
        )

    @staticmethod
    def gather(partial: DataFrame, dims: int) -> "Summaries":
        """Partial sums (cluster, n, sum[], sumsq[]), several rows per cluster, added up; their number of clusters is known to be bounded."""
        rows = partial.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "v"))
        sums = rows.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.sum").alias("s"), F.sum("v.sumsq").alias("ss")).collect()
        keys = sorted({r["cluster"] for r in sums})
        at = {k: i for i, k in enumerate(keys)}
        out = Summaries(keys, np.zeros(len(keys)), np.zeros((len(keys), dims)), np.zeros((len(keys), dims)))
        for r in sums:
            i = at[r["cluster"]]
            out.n[i], out.sum[i, r["dim"]], out.sumsq[i, r["dim"]] = r["n"], r["s"], r["ss"]
        return out

    def add(self, other: "Summaries") -> "Summaries":
        keys = sorted(set(self.keys) | set(other.keys))
        at = {k: i for i, k in enumerate(keys)}
        out = Summaries(keys, np.zeros(len(keys)), np.zeros((len(keys), self.sum.shape[1])), np.zeros((len(keys), self.sum.shape[1])))
        for part in (self, other):
            rows = [at[k] for k in part.keys]
            out.n[rows] += part.n
            out.sum[rows] += part.sum
            out.sumsq[rows] += part.sumsq
        return out

    def absorb(self, i: int, other: "Summaries", j: int) -> None:
        self.n[i] += other.n[j]
        self.sum[i] += other.sum[j]
        self.sumsq[i] += other.sumsq[j]

    def drop(self, i: int) -> None:
        del self.keys[i]
        self.n, self.sum, self.sumsq = (np.delete(x, i, axis=0) for x in (self.n, self.sum, self.sumsq))

    def distances(self, i: int, other: "Summaries") -> np.ndarray:
        """Distance of cluster i to every cluster of ``other``, scaled by the variance of the two pooled."""
        n = self.n[i] + other.n
        variance = (self.sumsq[i] + other.sumsq) / n[:, None] - ((self.sum[i] + other.sum) / n[:, None]) ** 2
        gap = self.sum[i] / self.n[i] - other.sum / other.n[:, None]
        return _scaled_norm(gap, variance)


def _scaled_norm(gap: np.ndarray, variance: np.ndarray) -> np.ndarray:
    """Root of the summed squares of gap over standard deviation; infinite where a dimension has no variance."""
    usable = variance > 0
    squares = np.divide(gap**2, variance, out=np.zeros_like(gap), where=usable)
    return np.where(usable.all(axis=-1), np.sqrt(squares.sum(axis=-1)), np.inf)


def assign_nearest(
    points: DataFrame, summaries: Summaries, radius: float = 2.0, id: str = "id", features: str = "features", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, cluster, distance): the nearest cluster closer than radius * sqrt(dimensions), else cluster -1.

    Distances are to the centroid in units of the cluster's standard deviation per dimension; among equally near
    clusters the smallest wins. ``distance`` is NULL where no cluster has variance in every dimension.
    """
    sc = points.sparkSession.sparkContext
    dims = summaries.sum.shape[1]
    if summaries.sum.size > MAX_SUMMARY_VALUES:
        raise ValueError("too many cluster summaries to hold in a task")
    if not summaries.keys:
        none = [F.lit(-1).cast("bigint").alias("cluster"), F.lit(None).cast("double").alias("distance")]
        return points.select(F.col(id).alias("id"), *none, *keep)
    centres = summaries.sum / summaries.n[:, None]
    variances = summaries.sumsq / summaries.n[:, None] - centres**2
    shared = sc.broadcast((np.array(summaries.keys, dtype=np.int64), centres, variances))
    limit = radius * dims**0.5

    @F.pandas_udf("cluster bigint, distance double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keys, centre, variance = shared.value
        for batch in batches:
            x = np.array(batch.tolist(), dtype=float).reshape(len(batch), -1)
            best = np.full(len(batch), np.inf)
            label = np.full(len(batch), -1, dtype=np.int64)
            for k in range(len(keys)):
                d = _scaled_norm(x - centre[k], variance[k])
                closer = d < best
                best[closer], label[closer] = d[closer], keys[k]
            label[~(best < limit)] = -1
            yield pd.DataFrame({"cluster": label, "distance": np.where(np.isfinite(best), best, np.nan)})

    near = points.select(F.col(id).alias("id"), nearest(F.col(features)).alias("_a"), *keep)
    distance = F.when(F.isnan("_a.distance"), None).otherwise(F.col("_a.distance"))
    return near.select("id", "_a.cluster", distance.alias("distance"), *keep)


def cluster_distance(stats_a: DataFrame, stats_b: DataFrame) -> DataFrame:
    """(a, b, distance) between clusters of two summary frames, a < b when both are the same frame.

    The distance is a sum over dimensions, so summaries meet per dimension; a pair with a dimension of no pooled
    variance gets NULL. Summary frames hold one row per cluster, a number set by the parameters.
    """

    def long(stats: DataFrame, side: str) -> DataFrame:
        return stats.select(
            F.col("cluster").alias(side), F.col("n").alias(f"n_{side}"), F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", f"v_{side}")
        )

    met = long(stats_a, "a").join(long(stats_b, "b"), "dim")
    if stats_a is stats_b:
        met = met.where(F.col("a") < F.col("b"))
    n = F.col("n_a") + F.col("n_b")
    mean = (F.col("v_a.sum") + F.col("v_b.sum")) / n
    variance = (F.col("v_a.sumsq") + F.col("v_b.sumsq")) / n - mean * mean
    gap = F.col("v_a.sum") / F.col("n_a") - F.col("v_b.sum") / F.col("n_b")
    term = F.when(variance > 0, F.try_divide(gap * gap, variance))
    sums = met.select("a", "b", term.alias("t")).groupBy("a", "b").agg(F.sum("t").alias("t"), F.min(F.col("t").isNotNull()).alias("ok"))
    return sums.select("a", "b", F.when(F.col("ok"), F.sqrt("t")).alias("distance"))


def merge_close(summaries: Summaries, limit: float) -> dict[int, int]:
    """Merge clusters nearer than ``limit`` until none are; the first close pair in key order goes first.

    Changes ``summaries`` and returns the moves {absorbed key: absorbing key} in the order they happened.
    """
    moves: dict[int, int] = {}
    count = len(summaries.keys)
    close = np.zeros((count, count), dtype=bool)
    for i in range(count):
        close[i, i + 1 :] = (summaries.distances(i, summaries) < limit)[i + 1 :]
    while close.any():
        i, j = np.unravel_index(np.argmax(close), close.shape)
        moves[summaries.keys[j]] = summaries.keys[i]
        summaries.absorb(i, summaries, j)
        summaries.drop(j)
        close = np.delete(np.delete(close, j, axis=0), j, axis=1)
        fresh = summaries.distances(i, summaries) < limit
        close[i, i + 1 :], close[:i, i] = fresh[i + 1 :], fresh[:i]
    return moves


def merge_into(targets: Summaries, sources: Summaries, limit: float) -> dict[int, int]:
    """Merge source clusters into targets nearer than ``limit``, first close pair in key order first, to a fixpoint."""
    moves: dict[int, int] = {}
    while True:
        hit = None
        for i in range(len(targets.keys)):
            near = targets.distances(i, sources) < limit
            if near.any():
                hit = (i, int(np.argmax(near)))
                break
        if hit is None:
            return moves
        i, j = hit
        moves[sources.keys[j]] = targets.keys[i]
        targets.absorb(i, sources, j)
        sources.drop(j)


@dataclass
class Clustering:
    labels: DataFrame  # (id, cluster): -1 for points outside the discard set
    rounds: DataFrame  # (round, n_ds, n_cs_clusters, n_cs, n_rs)
    discard: Summaries = field(repr=False)


def hash_order(seed: int = 0) -> list[Column]:
    """A pseudo-random order of points that depends on their ids only."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), F.col("id")]


def first_points(points: DataFrame, k: int, seed: int = 0, per_centre: int = 4) -> tuple[list[int], np.ndarray]:
    """(keys, centres): ``k`` points far from each other, numbered from 0.

    Candidates are the ``per_centre`` * ``k`` points that come first in hash order. The first of them is taken, then again
    and again the one farthest from those taken, the earlier of equally far ones; copies of taken points are not.
    """
    rows = points.select("id", "features").orderBy(*hash_order(seed)).limit(per_centre * k).collect()
    x = np.array([row["features"] for row in rows], dtype=float)
    apart = np.full(len(x), np.inf)
    taken: list[int] = []
    while len(taken) < k and len(x) and apart.max() > 0:
        taken.append(int(np.argmax(apart)))
        apart = np.minimum(apart, np.sqrt(((x - x[taken[-1]]) ** 2).sum(axis=1)))
    return list(range(len(taken))), x[taken]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre of each row, the first of equally near ones."""
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


def nearest_stats(points: DataFrame, keys: list[int], centres: np.ndarray) -> DataFrame:
    """(cluster, n, sum[], sumsq[]) of the points nearest to each centre, a row per task and centre that has points there."""
    if centres.size > MAX_SUMMARY_VALUES:
        raise ValueError("too many centres to hold in a task")
    shared = points.sparkSession.sparkContext.broadcast((np.array(keys, dtype=np.int64), centres))
    schema = "cluster bigint, n bigint, sum array<double>, sumsq array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, centres = shared.value
        n, total, squares = np.zeros(len(keys), dtype=np.int64), np.zeros_like(centres), np.zeros_like(centres)
        for batch in batches:
            x = _matrix(batch.column(0), centres.shape[1])
            label = _nearest(x, centres)
            order = np.argsort(label, kind="stable")
            found, first = np.unique(label[order], return_index=True)
            if len(found):
                n[found] += np.diff(np.append(first, len(label)))
                total[found] += np.add.reduceat(x[order], first)
                squares[found] += np.add.reduceat(x[order] ** 2, first)
        used = np.flatnonzero(n)
        columns = [pa.array(keys[used]), pa.array(n[used]), *[pa.array(list(v[used]), pa.list_(pa.float64())) for v in (total, squares)]]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sum", "sumsq"])

    return points.select("features").mapInArrow(work, schema)


def lloyd(points: DataFrame, keys: list[int], centres: np.ndarray, steps: int) -> tuple[list[int], np.ndarray]:
    """Centres moved to the means of their points, ``steps`` times or until none moves; a centre without points is dropped."""
    for _ in range(steps):
        found = Summaries.gather(nearest_stats(points, keys, centres), centres.shape[1])
        moved = found.sum / found.n[:, None]
        if found.keys == keys and np.allclose(moved, centres, rtol=1e-12, atol=0):
            break
        keys, centres = found.keys, moved
    return keys, centres


def nearest_centre(points: DataFrame, keys: list[int], centres: np.ndarray) -> DataFrame:
    """(id, features, cluster): the key of the nearest centre, the smallest of equally near ones."""
    shared = points.sparkSession.sparkContext.broadcast((np.array(keys, dtype=np.int64), centres))
    rows = points.select("id", "features")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, centres = shared.value
        for batch in batches:
            label = keys[_nearest(_matrix(batch.column("features"), centres.shape[1]), centres)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label)], names=["id", "features", "cluster"])

    return rows.mapInArrow(work, rows.withColumn("cluster", F.lit(0).cast("bigint")).schema)


def k_means(points: DataFrame, k: int, seed: int = 0, steps: int = 20) -> DataFrame:
    """(id, features, cluster) by Lloyd steps from :func:`first_points`."""
    keys, centres = first_points(points, k, seed)
    if not keys:
        return points.select("id", "features", F.lit(None).cast("bigint").alias("cluster"))
    return materialize(nearest_centre(points, *lloyd(points, keys, centres, steps)))


def _split_singles(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of clusters with several points, and the points that are alone in theirs."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    # One row per cluster centre.
    sized = clustered.join(F.broadcast(sizes), "cluster")
    return sized.where("_n > 1").drop("_n"), sized.where("_n = 1").drop("_n", "cluster")


def bfr(
    points: DataFrame,
    k: int,
    chunks: int = 5,
    seed_factor: int = 10,
    rs_clusters: int | None = None,
    radius: float = 2.0,
    seed: int = 0,
    steps: int = 20,
) -> Clustering:
    """Cluster ``points`` chunk by chunk, keeping only summaries of settled clusters between chunks.

    Chunks are stretches of equal size (up to one point) of the points in hash order. The retained points of each round are clustered
    again with ``rs_clusters`` centres, five times ``k`` unless given (as many as there are points, if they are fewer). Every
    clustering takes up to ``steps`` Lloyd steps.
    """
    spark: SparkSession = points.sparkSession
    stored = materialize(points.select("id", F.col("features").cast("array<double>").alias("features")))
    ranked = positions(stored, [], hash_order(seed), name="_at")
    base = materialize(ranked.withColumn("_chunk", F.floor((F.col("_at") - 1) * chunks / F.lit(max(1, stored.count()))).cast("int")).drop("_at"))
    head = base.select(F.size("features")).first()
    if head is None:
        raise ValueError("no points to cluster")
    dims = head[0]
    limit = radius * dims**0.5
    settled: list[DataFrame] = []  # (id, cluster) of discard points
    members: list[DataFrame] = []  # (id, cs) of compression points, by the key their cluster was born with
    current: dict[int, int] = {}  # birth key -> current key of its compression cluster
    next_key = 0
    rounds: list[tuple[int, int, int, int, int]] = []

    first = base.where("_chunk = 0").drop("_chunk")
    several, retained = _split_singles(k_means(first, seed_factor * k, seed, steps))
    several = several.drop("cluster")
    if several.isEmpty():
        several, retained = first, first.limit(0)
    seeds = k_means(several, k, seed, steps)
    discard = Summaries.collect(cluster_stats(seeds), dims)
    settled.append(seeds.select("id", "cluster"))
    compressed = Summaries.empty(dims)

    def compress(retained: DataFrame) -> DataFrame:
        """Cluster the retained points; clusters of several points move to the compression set."""
        nonlocal compressed, next_key
        retained = materialize(retained.select("id", "features"))
        n = retained.count()
        if n < 2:
            return retained
        grouped, alone = _split_singles(k_means(retained, min(n, rs_clusters or 5 * k), seed, steps))
        grouped = materialize(grouped.withColumn("cluster", F.col("cluster") + next_key))
        fresh = Summaries.collect(cluster_stats(grouped), dims)
        if fresh.keys:
            current.update({key: key for key in fresh.keys})
            next_key = max(fresh.keys) + 1
            compressed = compressed.add(fresh)
            members.append(grouped.select("id", F.col("cluster").alias("cs")))
        return materialize(alone)

    def follow(moves: dict[int, int]) -> None:
        for birth, now in current.items():
            while now in moves:
                now = moves[now]
            current[birth] = now

    def note(number: int) -> None:
        rounds.append((number, int(discard.n.sum()), len(compressed.keys), int(compressed.n.sum()), retained.count()))

    retained = compress(retained)
    note(1)
    into_discard: dict[int, int] = {}
    for number in range(1, chunks):
        chunk = base.where(F.col("_chunk") == number).drop("_chunk")
        near_ds = materialize(assign_nearest(chunk, discard, radius, keep=("features",)))
        near_cs = materialize(
            assign_nearest(near_ds.where("cluster = -1").select("id", "features"), compressed, radius, keep=("features",))
        )
        to_ds, to_cs = near_ds.where("cluster <> -1"), near_cs.where("cluster <> -1")
        discard = discard.add(Summaries.collect(cluster_stats(to_ds), dims))
        compressed = compressed.add(Summaries.collect(cluster_stats(to_cs), dims))
        settled.append(to_ds.select("id", "cluster"))
        members.append(to_cs.select("id", F.col("cluster").alias("cs")))
        retained = compress(retained.unionByName(near_cs.where("cluster = -1").select("id", "features")))
        follow(merge_close(compressed, limit))
        if number == chunks - 1:
            into_discard = merge_into(discard, compressed, limit)
        note(number + 1)

    labels = settled[0]
    for more in settled[1:]:
        labels = labels.unionByName(more)
    if members:
        in_cs = members[0]
        for more in members[1:]:
            in_cs = in_cs.unionByName(more)
        moved = [(birth, int(into_discard[now])) for birth, now in current.items() if now in into_discard]
        final = F.broadcast(spark.createDataFrame(moved, "cs long, cluster long"))
        labels = labels.unionByName(in_cs.join(final, "cs", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster")))
    labels = labels.unionByName(retained.select("id", F.lit(-1).cast("bigint").alias("cluster")))
    log = spark.createDataFrame(rounds, "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")
    return Clustering(labels, log, discard)
