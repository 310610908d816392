"""Pairs of sets that share many elements, found without enumerating all pairs of a hot element's sets.

Sets are long-form rows (id, elem). Elements are ordered rare first, so a pair that must share ``need``
elements has its first l common elements among the first ``size - need + l`` of either set. Keys of
one element are enough while few sets hold them; the keys of crowded elements are lengthened, element by
element, until they are not crowded any more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.operators.skew import ROWS_PER_SPLIT, hot_keys, positions, skew_join
from lodemine.session import materialize, remove_scratch, scratch_path

# Above this many rows a key is crowded: its rows are not paired directly but get longer keys.
CROWDED = 1000
# Rows of one key that a single task pairs with the rest of the key, where crowded keys are paired after all.
PAIR_SPLIT = 50_000
# Keys still crowded at this length are paired after all, with the work salted over tasks.
MAX_KEY_LENGTH = 4
# Load of a block of sets (its elements, and SET_LOAD for each set), and load that is moved at a time.
LEAST_LOAD, MOST_LOAD, SET_LOAD, MOVED_LOAD = 500_000, 8_000_000, 50, 500_000_000
# Rows of sets that are given numbers at a time.
ROWS_PER_PASS = 40_000_000
# Pairs that a task counts at a time, and rows that it unfolds for that.
COUNTED_PAIRS, UNFOLDED_ROWS = 8_000_000, 4_000_000
# Ids of a block, and rows of crowded elements in it: a task counts the pairs between two blocks at a time.
BLOCK_IDS, BLOCK_ROWS = 4000, 1_000_000


def rare_first(sets: DataFrame, id: str, elem: str) -> DataFrame:
    """(id, elem, pos, size) with each set's elements, given as distinct rows, numbered from the globally rarest to the most common."""
    rows = sets.select(F.col(id).alias("id"), F.col(elem).alias("elem"))
    freq = rows.groupBy("elem").agg(F.count(F.lit(1)).alias("_freq"))
    ranked = positions(skew_join(rows, freq, "elem"), ["id"], ["_freq", "elem"], name="pos", total="size")
    return materialize(ranked.select("id", "elem", "pos", "size"))


class PairRule:
    """How many common elements a qualifying pair needs, given the sizes of its sets."""

    def __init__(
        self,
        least: Callable[[Column], Column],
        exact: Callable[[Column, Column], Column],
        partner_sizes: Callable[[Column], Column] | None,
    ):
        self.least = least  # fewest common elements with any allowed partner
        self.exact = exact  # common elements needed for two given sizes
        self.partner_sizes = partner_sizes  # (lowest, highest) partner size, or None when size does not matter

    @staticmethod
    def jaccard(threshold: float) -> "PairRule":
        slack = 1e-9

        def lowest(size: Column) -> Column:
            return F.greatest(F.lit(1), F.ceil(size * threshold - slack)).cast("bigint")

        def exact(s1: Column, s2: Column) -> Column:
            return F.greatest(F.lit(1), F.ceil((s1 + s2) * (threshold / (1 + threshold)) - slack)).cast("bigint")

        def partners(size: Column) -> Column:
            return F.sequence(lowest(size), F.floor(size / threshold + slack).cast("bigint"))

        return PairRule(lowest, exact, partners)

    @staticmethod
    def shared(at_least: int) -> "PairRule":
        def fixed(*_: Column) -> Column:
            return F.lit(at_least).cast("bigint")

        return PairRule(fixed, fixed, None)

    def reachable(self, length: int) -> Column:
        """Whether a pair that meets in a key of ``length`` elements can still share enough of them.

        If the key holds the pair's first common elements, all others come after ``pos`` in both sets; if it does
        not, the pair also meets in the key that does.
        """
        later = F.least(F.col("size_1") - F.col("pos_1"), F.col("size_2") - F.col("pos_2"))
        return later + length >= self.exact(F.col("size_1"), F.col("size_2"))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], rule: PairRule, length: int, salted: bool = False) -> DataFrame:
    a = left.select(*on, F.col("id").alias("id_1"), F.col("size").alias("size_1"), F.col("pos").alias("pos_1"))
    b = right.select(*on, F.col("id").alias("id_2"), F.col("size").alias("size_2"), F.col("pos").alias("pos_2"))
    joined = skew_join(a, b, on, rows_per_split=PAIR_SPLIT) if salted else a.join(b, on)
    return joined.where((F.col("id_1") < F.col("id_2")) & rule.reachable(length)).select("id_1", "size_1", "id_2", "size_2")


def first_keys(ranked: DataFrame, rule: PairRule) -> DataFrame:
    """Keys of one element: the rare prefix of every set."""
    prefix = ranked.where(F.col("pos") <= F.col("size") - rule.least(F.col("size")) + 1)
    return prefix.select(F.xxhash64("elem").alias("key"), "id", "size", "pos")


def candidate_pairs(
    keys: DataFrame,
    ranked: DataFrame,
    rule: PairRule,
    length: int = 1,
    crowded: int = CROWDED,
    max_length: int = MAX_KEY_LENGTH,
) -> DataFrame:
    """Distinct (id_1, size_1, id_2, size_2), id_1 < id_2: every qualifying pair that meets in a key of ``keys``.

    ``keys`` holds (key, id, size, pos): ``length`` elements went into the key, the last at ``pos``. Keys are
    64-bit hashes; a collision only adds a candidate, and candidates are verified by counting.
    """
    found: list[DataFrame] = []
    while True:
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        if length >= max_length:
            found.append(_pairs(keys, keys, ["key"], rule, length, salted=True))
            break
        if counts.where(F.col("_n") > crowded).isEmpty():
            found.append(_pairs(keys, keys, ["key"], rule, length))
            break
        sized = materialize(skew_join(keys, counts, "key"))
        cold = sized.where(F.col("_n") <= crowded)
        hot = sized.where(F.col("_n") > crowded).drop("_n")
        found.append(_pairs(cold, cold, ["key"], rule, length))
        if length > 0:
            found.append(_settled(hot, rule, length))
        keys = materialize(_lengthened(hot, ranked, rule, length))
        length += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _settled(hot: DataFrame, rule: PairRule, length: int) -> DataFrame:
    """Pairs in crowded keys that need no more common elements than the key holds: all of them qualify."""
    ready = hot.where(rule.least(F.col("size")) <= length)
    if rule.partner_sizes is None:
        return _pairs(ready, ready, ["key"], rule, length, salted=True)
    wanted = ready.withColumn("_other", F.explode(rule.partner_sizes(F.col("size")))).where(
        rule.exact(F.col("size"), F.col("_other")) <= length
    )
    low, high = F.least("size", "_other"), F.greatest("size", "_other")
    classed = wanted.withColumn("_low", low).withColumn("_high", high)
    smaller = classed.where(F.col("size") == F.col("_low"))
    larger = classed.where(F.col("size") == F.col("_high"))
    both = _pairs(smaller, larger, ["key", "_low", "_high"], rule, length, salted=True)
    swapped = _pairs(larger, smaller, ["key", "_low", "_high"], rule, length, salted=True)
    return both.unionByName(swapped)


def _lengthened(hot: DataFrame, ranked: DataFrame, rule: PairRule, length: int) -> DataFrame:
    """One more element in each crowded key, from the part of the set where it can still be a common one."""
    reach = F.col("size") - rule.least(F.col("size")) + length + 1
    tail = ranked.where(F.col("pos") <= F.least(reach, F.col("size")))
    tail = tail.select("id", F.col("elem").alias("_next"), F.col("pos").alias("_at"))
    return (
        skew_join(tail, hot, "id")
        .where(F.col("_at") > F.col("pos"))
        .select(F.xxhash64("key", "_next").alias("key"), "id", "size", F.col("_at").alias("pos"))
    )


def common_rows(pairs: DataFrame, rows: DataFrame, value: str | None = None) -> DataFrame:
    """One row per (pair, common element), with the values of both sides when ``value`` is named.

    Only the smaller set of each pair is unfolded; the larger one is probed by (id, elem).
    """
    kept = ["id", "elem", *([value] if value else [])]
    small_first = F.col("size_1") <= F.col("size_2")
    probes = pairs.select(
        "id_1",
        "size_1",
        "id_2",
        "size_2",
        small_first.alias("_straight"),
        F.when(small_first, F.col("id_1")).otherwise(F.col("id_2")).alias("_small"),
        F.when(small_first, F.col("id_2")).otherwise(F.col("id_1")).alias("_large"),
    )
    side = rows.select(*kept)
    unfolded = skew_join(probes, side.withColumnRenamed("id", "_small").withColumnRenamed(value or "_", "_v_small"), "_small")
    met = skew_join(
        unfolded,
        side.withColumnRenamed("id", "_large").withColumnRenamed(value or "_", "_v_large"),
        ["_large", "elem"],
        hot=hot_keys(probes, ["_large"]),
        hot_on=["_large"],
    )
    columns = ["id_1", "size_1", "id_2", "size_2", "elem"]
    if value:
        columns += [
            F.when(F.col("_straight"), F.col("_v_small")).otherwise(F.col("_v_large")).alias("v_1"),
            F.when(F.col("_straight"), F.col("_v_large")).otherwise(F.col("_v_small")).alias("v_2"),
        ]
    return met.select(*columns)


def _pair_aggregates(rows: DataFrame, with_values: bool, within: tuple[str, ...] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    if with_values:
        x, y = F.col("v_1"), F.col("v_2")
        aggs += [
            F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
            F.sum(x * y).alias("sxy"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
            F.min(y).alias("y_min"), F.max(y).alias("y_max"),
        ]
    return rows.groupBy("id_1", "id_2", *within).agg(*aggs).drop(*within)


def _merged(parts: DataFrame, with_values: bool) -> DataFrame:
    aggs = [F.sum("n").alias("n")]
    if with_values:
        aggs += [F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")]
        aggs += [F.min(c).alias(c) for c in ("x_min", "y_min")] + [F.max(c).alias(c) for c in ("x_max", "y_max")]
    return parts.groupBy("id_1", "id_2").agg(*aggs)


def shared_pairs(
    rows: DataFrame, id: str, elem: str, at_least: int, value: str | None = None, crowded: int = CROWDED
) -> DataFrame:
    """Pairs of ids with ``at_least`` elements in common, counted exactly (with moment sums of ``value`` if named).

    Elements held by up to ``crowded`` ids are unfolded into pairs (:func:`_light_pairs`). Pairs on crowded elements are never rows: without
    values they are counted block by block (:func:`_block_counts`). With values their share is counted only for pairs that already met
    on light elements and can still reach ``at_least``, and for pairs that share ``at_least`` crowded elements.
    """
    base = rows.select(F.col(id).alias("id"), F.col(elem).alias("elem"), *([F.col(value).alias("v")] if value else []))
    if value is None:
        base = base.distinct()
    base = materialize(base.where(F.col("id").isNotNull() & F.col("elem").isNotNull()))
    counts = base.groupBy("elem").agg(F.count(F.lit(1)).alias("_n"))
    if counts.where(F.col("_n") > crowded).isEmpty():
        return _light_pairs(base, bool(value)).where(F.col("n") >= at_least)

    sized = materialize(skew_join(base, counts, "elem"))
    light = sized.where(F.col("_n") <= crowded).drop("_n")
    heavy = sized.where(F.col("_n") > crowded).drop("_n")
    light_part = materialize(_light_pairs(light, bool(value)))
    if value is None:
        return _block_counts(heavy, light_part, at_least)

    heavy_ranked = rare_first(heavy, "id", "elem")
    rule = PairRule.shared(at_least)
    able = heavy_ranked.where(F.col("size") >= at_least)
    heavy_only = candidate_pairs(first_keys(able, rule), able, rule, crowded=crowded)

    sizes = heavy_ranked.groupBy("id").agg(F.max("size").alias("size"))
    side_1 = sizes.select(F.col("id").alias("id_1"), F.col("size").alias("size_1"))
    side_2 = sizes.select(F.col("id").alias("id_2"), F.col("size").alias("size_2"))
    started = light_part.select("id_1", "id_2", "n")
    with_1 = skew_join(started, side_1, "id_1")
    open_pairs = skew_join(with_1, side_2, "id_2", hot=hot_keys(started, ["id_2"])).where(
        F.col("n") + F.least("size_1", "size_2") >= at_least
    )
    asked = materialize(open_pairs.select("id_1", "size_1", "id_2", "size_2").unionByName(heavy_only).distinct())
    heavy_part = _pair_aggregates(common_rows(asked, heavy, "v"), True)
    return _merged(light_part.unionByName(heavy_part), True).where(F.col("n") >= at_least)


def _light_pairs(base: DataFrame, with_values: bool) -> DataFrame:
    """(id_1, id_2, n, moment sums): pairs within the elements of ``base``, whose holders fit one row each.

    Every holder of an element travels to the task of its id with the list of the holders after it; the pairs are unfolded and summed there, so
    that a pair is never a row of a shuffle. An id with very many elements is dealt over tasks, and its sums are merged.
    """
    held = F.struct("id", "v") if with_values else F.struct("id")
    lists = base.groupBy("elem").agg(F.sort_array(F.collect_list(held)).alias("_held")).where(F.size("_held") > 1)
    names = ["_ids", *(["_vs"] if with_values else [])]
    fields = F.col("_held.id").alias("_ids"), *([F.col("_held.v").alias("_vs")] if with_values else [])
    after = [F.slice(c, F.col("_at") + 2, F.size(c)).alias(c) for c in names]
    first = [F.col("_one.id").alias("id_1"), *([F.col("_one.v").alias("v_1")] if with_values else [])]
    sent = lists.select("elem", *fields, F.posexplode("_held").alias("_at", "_one")).where(F.col("_at") < F.size("_ids") - 1)
    sent = sent.select(F.xxhash64("elem").alias("_spread"), *first, *after)
    hot = materialize(hot_keys(base, ["id"], PAIR_SPLIT), small=True)
    split = not hot.isEmpty()
    if split:
        sent = sent.join(hot.withColumnRenamed("id", "id_1"), "id_1", "left").withColumn("_part", F.pmod("_spread", F.coalesce("_splits", F.lit(1))))
    within = ("_part",) if split else ()
    sent = sent.select("id_1", *within, *(["v_1"] if with_values else []), *names).repartition("id_1", *within)
    if with_values:
        rows = sent.select("id_1", *within, "v_1", F.explode(F.arrays_zip(*names)).alias("_two")).select(
            "id_1", *within, "v_1", F.col("_two._ids").alias("id_2"), F.col("_two._vs").alias("v_2")
        )
    else:
        rows = sent.select("id_1", *within, F.explode("_ids").alias("id_2"))
    parts = _pair_aggregates(rows.where(F.col("id_1") < F.col("id_2")), with_values, within)
    return _merged(parts, with_values) if split else parts


def _block_counts(heavy: DataFrame, started: DataFrame, at_least: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(id_1, id_2, n): pairs whose common rows of ``heavy`` and count n in ``started`` reach ``at_least`` together.

    Ids are dealt over blocks. Every pair of blocks is a group that gets the holders of each element in both, and adds up their
    pairs in a table of the size of a block squared. Work grows with the pairs that meet, as it must; what is moved are the rows, once per block.
    """
    n_rows, n_ids = heavy.agg(F.count(F.lit(1)), F.approx_count_distinct("id")).first()
    blocks = max(1, -(-n_ids // block_ids), -(-n_rows // BLOCK_ROWS))

    def block(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def cell(one: Column, other: Column) -> Column:
        return (F.least(one, other) * F.lit(blocks).cast("bigint") + F.greatest(one, other)).alias("_cell")

    lists = heavy.groupBy(block("id").alias("_block"), "elem").agg(F.collect_list("id").alias("ids"))
    cells = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    cells = cells.select(cell(F.col("_block"), F.col("_other")), (F.col("_block") > F.col("_other")).alias("later"), "elem", "ids")
    swapped = block("id_1") > block("id_2")
    ends = [F.when(swapped, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("id_2", "id_1", "low"), ("id_1", "id_2", "high"))]
    met = started.select(cell(block("id_1"), block("id_2")), *ends, "n")
    kind = heavy.schema["id"].dataType.simpleString()

    def count(held: pa.Table, met: pa.Table) -> pa.Table:
        one_block = (held if len(held) else met).column("_cell")[0].as_py() % (blocks + 1) == 0
        lists = held.column("ids").combine_chunks()
        given = [lists.flatten(), met.column("low").combine_chunks(), met.column("high").combine_chunks()]
        ids, place = np.unique(np.concatenate([g.to_numpy(zero_copy_only=False) for g in given]), return_inverse=True)
        members, low, high = np.split(place, np.cumsum([len(g) for g in given])[:2])
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        later = held.column("later").to_numpy()
        mine = np.repeat(later, sizes).astype(bool)
        rows, columns = np.union1d(members[~mine], low), np.union1d(members[mine], high)
        if one_block:
            rows = columns = np.arange(len(ids))
        total = np.zeros((len(rows), len(columns)), dtype=np.int32)
        of_elem: dict[object, dict[bool, np.ndarray]] = {}
        for elem, side, its in zip(held.column("elem").to_pylist(), later.tolist(), np.split(members, np.cumsum(sizes))[:-1], strict=True):
            of_elem.setdefault(elem, {})[side] = its
        for sides in of_elem.values():
            first, second = sides.get(False), sides.get(False if one_block else True)
            if first is not None and second is not None:
                total[np.ix_(np.searchsorted(rows, first), np.searchsorted(columns, second))] += 1
        np.add.at(total, (np.searchsorted(rows, low), np.searchsorted(columns, high)), met.column("n").to_numpy().astype(np.int32))
        row, column = np.nonzero(total >= at_least)
        one, two = rows[row], columns[column]
        kept = one < two if one_block else one != two
        names, ends = pa.array(ids, lists.type.value_type), (np.minimum(one, two)[kept], np.maximum(one, two)[kept])
        return pa.Table.from_arrays([*(names.take(pa.array(e)) for e in ends), pa.array(total[row, column][kept], pa.int64())], names=["id_1", "id_2", "n"])

    return cells.groupBy("_cell").cogroup(met.groupBy("_cell")).applyInArrow(count, f"id_1 {kind}, id_2 {kind}, n bigint")


def numbered_sets(sets: DataFrame, id: str, elem: str, folder: str | None = None) -> DataFrame:
    """(id, size, elems[]): a row for each set, given as distinct rows, with numbers for its elements from the globally rarest to the most common.

    Elements that come once in all are counted in ``size``, but not listed, as no two sets have them. Up to about ROWS_PER_PASS rows are moved at a
    time; the results are stored, in ``folder`` if given.
    """
    rows = sets.select(F.col(id).alias("id"), F.col(elem).alias("elem"))
    freq = materialize(rows.groupBy("elem").agg(F.count(F.lit(1)).alias("_freq")).where("_freq > 1"))
    hot = materialize(freq.where(F.col("_freq") > ROWS_PER_SPLIT).select("elem", F.ceil(F.col("_freq") / ROWS_PER_SPLIT).cast("int").alias("_splits")), small=True)
    numbers = materialize(positions(freq, [], ["_freq", "elem"], name="number").select("elem", F.col("number").cast("int").alias("number")))
    passes = max(1, -(-rows.count() // ROWS_PER_PASS))
    out: DataFrame | None = None
    for turn in range(passes):
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn) if passes > 1 else rows
        each = skew_join(some, numbers, "elem", "left", hot=hot).select("id", "number")
        # Null numbers count in the size only.
        listed = each.groupBy("id").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("number")).alias("elems"))
        listed = materialize(listed, folder=folder)
        out = listed if out is None else out.unionByName(listed)
    return out


def similar_sets(sets: DataFrame, id: str, elem: str, threshold: float, buckets: DataFrame | None = None) -> DataFrame:
    """(id_1, size_1, id_2, size_2, n_common), id_1 < id_2: every pair of sets with Jaccard similarity of at least ``threshold``.

    Tasks hold two blocks of sets each and count what they have in common, so no pair is a row before that. Blocks hold sets of like size, and those whose
    sizes rule out the threshold don't meet. With ``buckets`` (id, buckets[]) the pairs with an equal number at the same place are looked at, else those
    whose prefixes (rarest elements) share enough to leave a chance.
    """
    spark = sets.sparkSession
    folder = scratch_path(spark, "sets")
    listed = numbered_sets(sets, id, elem, folder)
    if buckets is None:
        listed = listed.withColumn("buckets", F.array().cast("array<bigint>"))
    else:
        listed = materialize(listed.join(materialize(buckets, folder=folder), "id"), folder=folder)
    load = (F.lit(SET_LOAD) + F.col("size")).alias("_load")
    of_size = listed.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).select("size", "_n", load)
    of_size = of_size.select("*", (F.sum(F.col("_n") * F.col("_load")).over(Window.orderBy("size")) - F.col("_n") * F.col("_load")).alias("_before"))
    of_size = materialize(of_size, small=True)
    total = of_size.agg(F.sum(F.col("_n") * F.col("_load"))).first()[0] or 0
    most = max(LEAST_LOAD, min(MOST_LOAD, total // 8))
    block = F.floor((F.col("_before") + F.col("_load") * F.pmod(F.xxhash64("id"), F.col("_n"))) / most).cast("int").alias("_block")
    placed = materialize(listed.join(of_size, "size").select("id", "size", "elems", "buckets", block))
    remove_scratch(spark, folder)
    held = placed.groupBy("_block").agg(F.min("size").alias("low"), F.max("size").alias("high")).orderBy("_block").collect()
    n_blocks = max([0, *(r["_block"] for r in held)]) + 1
    cells = [(x["_block"], y["_block"]) for x in held for y in held if x["_block"] <= y["_block"] and x["high"] >= threshold * y["low"] - 1e-9]
    strip = max(1, MOVED_LOAD // (2 * most))
    kind = sets.schema[id].dataType.simpleString()
    shape = f"id_1 {kind}, size_1 bigint, id_2 {kind}, size_2 bigint, n_common bigint"
    out = spark.createDataFrame([], shape)
    for begin in range(0, len(cells), strip):
        some = cells[begin : begin + strip]
        places = [(x, x * n_blocks + y, False) for x, y in some] + [(y, x * n_blocks + y, True) for x, y in some if x != y]
        sent = placed.join(spark.createDataFrame(places, "_block int, _cell int, later boolean"), "_block").drop("_block").repartition(2 * len(some), "_cell")
        found = materialize(sent.groupBy("_cell").applyInArrow(_similar_in_task(threshold, n_blocks, buckets is not None), shape))
        out = found if begin == 0 else out.unionByName(found)
    turn = F.col("id_1") > F.col("id_2")
    names = (("id_1", "id_2"), ("size_1", "size_2"), ("id_2", "id_1"), ("size_2", "size_1"))
    return out.select(*[F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in names], "n_common")


def _similar_in_task(threshold: float, n_blocks: int, in_buckets: bool) -> Callable[[pa.Table], pa.Table]:
    """The similar pairs between two blocks of sets, or within one."""
    counted, unfolded = COUNTED_PAIRS, UNFOLDED_ROWS

    def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers starts[i] to starts[i] + sizes[i], one after the other."""
        return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)

    def stretches(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
        """Cuts into stretches of up to ``most`` in all, or of a single one."""
        ends, begin, out = np.cumsum(sizes), 0, []
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
            out.append((begin, end))
            begin = end
        return out

    def similar(table: pa.Table) -> pa.Table:
        one_block = table.column("_cell")[0].as_py() % (n_blocks + 1) == 0
        table = table.combine_chunks()
        size = table.column("size").to_numpy().astype(np.int64)
        rest = np.maximum(1, np.ceil(size * threshold - 1e-9)).astype(np.int64) - 1  # elements behind the prefix
        lists = table.column("elems").combine_chunks()
        elems, n_elems = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        starts = np.cumsum(n_elems) - n_elems
        n_prefix = np.maximum(0, n_elems - rest)
        end = np.where(n_prefix > 0, elems[np.minimum(starts + n_prefix - 1, max(0, len(elems) - 1))], -1) if len(elems) else np.full(len(size), -1)
        # An element that a set has several times counts as often on the other side.
        again = np.diff(elems, prepend=-1) == 0
        again[starts[(n_elems > 0)]] = False
        repeated = np.bincount(np.repeat(np.arange(len(size)), n_elems)[again], minlength=len(size))
        times = np.where(repeated > 0, n_elems, 1)
        marked = np.zeros(int(elems.max()) + 1 if len(elems) else 1, dtype=np.int32)
        later = table.column("later").to_numpy(zero_copy_only=False).astype(bool)
        first, second = np.flatnonzero(~later), np.flatnonzero(later | one_block)
        kept: list[np.ndarray] = []

        def sizes_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            need = np.maximum(1, np.ceil((size[x] + size[y]) * (threshold / (1 + threshold)) - 1e-9)).astype(np.int64)
            fit = need <= np.minimum(size[x], size[y])
            return (fit & (x < y) if one_block else fit), need

        def keep(one: np.ndarray, two: np.ndarray, need: np.ndarray) -> None:
            """Count what the pairs, in order of ``one``, have in common."""
            common = np.zeros(len(one), dtype=np.int64)
            heads = np.flatnonzero(np.diff(one, prepend=-1))
            for head, tail in zip(heads.tolist(), np.append(heads, len(one))[1:].tolist(), strict=True):
                mine = elems[starts[one[head]] : starts[one[head]] + n_elems[one[head]]]
                np.add.at(marked, mine, 1)
                for a, b in stretches(n_elems[two[head:tail]], unfolded):
                    y = two[head + a : head + b]
                    sums = np.concatenate([[0], np.cumsum(marked[elems[spans(starts[y], n_elems[y])]], dtype=np.int64)])
                    ends = np.cumsum(n_elems[y])
                    common[head + a : head + b] = sums[ends] - sums[ends - n_elems[y]]
                # Repeated elements count several times, so a pair of sets with such must be in reach by the places of its first common element too.
                for i in [] if in_buckets else (head + np.flatnonzero((times[one[head]] > 1) | (times[two[head:tail]] > 1))).tolist():
                    its = elems[starts[two[i]] : starts[two[i]] + n_elems[two[i]]]
                    at = int(np.argmax(marked[its] > 0))
                    behind = min(len(its) - at, len(mine) - int(np.searchsorted(mine, its[at])))
                    common[i] = common[i] if behind >= need[i] else 0
                marked[mine] = 0
            good = common >= need
            kept.append(np.stack([one[good], two[good], common[good]]))

        def by_elements() -> None:
            mine = elems[spans(starts[second], n_prefix[second])]
            owner = np.repeat(np.arange(len(second)), n_prefix[second])
            order = np.argsort(mine, kind="stable")
            index, owner = mine[order], owner[order]
            width = max(1, counted // max(1, len(second)))
            for begin in range(0, len(first), width):
                x = first[begin : begin + width]
                asked = elems[spans(starts[x], n_prefix[x])]
                at = np.searchsorted(index, asked)
                met = np.searchsorted(index, asked, side="right") - at
                base = np.repeat(np.arange(len(x)) * len(second), n_prefix[x])
                total = np.zeros(len(x) * len(second), dtype=np.int32)
                for a, b in stretches(met, unfolded):
                    total += np.bincount(np.repeat(base[a:b], met[a:b]) + owner[spans(at[a:b], met[a:b])], minlength=len(total)).astype(np.int32)
                found = np.flatnonzero(total)
                one, two = x[found // len(second)], second[found % len(second)]
                fit, need = sizes_fit(one, two)
                one, two, need, shared = one[fit], two[fit], need[fit], total[found][fit]
                # All that is common up to the end of the prefix that ends first has been counted; behind it is at most the rest of that set.
                chance = shared + np.where(end[one] <= end[two], rest[one] * times[two], rest[two] * times[one]) >= need
                keep(one[chance], two[chance], need[chance])

        def by_buckets() -> None:
            held = table.column("buckets").combine_chunks()
            marks = held.flatten().to_numpy().reshape(len(held), -1)
            bands = []
            for band in marks.T:
                order = np.argsort(band[second], kind="stable")
                index = band[second][order]
                at = np.searchsorted(index, band[first])
                bands.append((second[order], at, np.searchsorted(index, band[first], side="right") - at))
            met = np.sum([n for _, _, n in bands], axis=0) if bands else np.zeros(len(first), dtype=np.int64)
            for begin, stop in stretches(met, unfolded):
                pairs = [np.repeat(first[begin:stop], n[begin:stop]) * len(size) + own[spans(at[begin:stop], n[begin:stop])] for own, at, n in bands]
                pairs = np.unique(np.concatenate(pairs))
                one, two = pairs // len(size), pairs % len(size)
                fit, need = sizes_fit(one, two)
                keep(one[fit], two[fit], need[fit])

        (by_buckets if in_buckets else by_elements)()
        one, two, common = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), dtype=np.int64)
        ids = table.column("id")
        columns = [ids.take(pa.array(one)), pa.array(size[one]), ids.take(pa.array(two)), pa.array(size[two]), pa.array(common)]
        return pa.Table.from_arrays(columns, names=["id_1", "size_1", "id_2", "size_2", "n_common"])

    return similar
