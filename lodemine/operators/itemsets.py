"""Frequent itemsets: two-phase mining over chunks of baskets, and one-phase FP-growth.

Baskets are distinct (basket, item) rows. Only frequent items are ever gathered into a basket's array, so its
length is at most the number of frequent items (rows / support), whatever the basket holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemine.operators.skew import ROWS_PER_SPLIT, segment_lines, skew_join
from lodemine.session import materialize


# Items of all candidates together that tasks may hold, and bytes of bitmaps that a task works on at once.
MAX_BITMAP_ITEMS = 1_000_000
BITMAP_BYTES = 32_000_000


def baskets(df: DataFrame, key: str | Sequence[str], item: str, min_rows: int = 0, count_distinct: bool = False) -> DataFrame:
    """Distinct (basket, item) rows; several key columns are joined by '-'.

    Baskets need more than ``min_rows`` input rows, or distinct items with ``count_distinct``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    basket = F.col(keys[0]) if len(keys) == 1 else F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    rows = df.select(basket.alias("basket"), F.col(item).alias("item"))
    pairs = rows.groupBy("basket", "item").agg(F.count(F.lit(1)).alias("_n"))
    if min_rows <= 0:
        return pairs.select("basket", "item")
    size = F.count(F.lit(1)) if count_distinct else F.sum("_n")
    large = pairs.groupBy("basket").agg(size.alias("_size")).where(F.col("_size") > min_rows).select("basket")
    return skew_join(pairs.select("basket", "item"), large, "basket", "left_semi")


def chunk_of(b: DataFrame, chunks: int) -> Column:
    """Chunk number of a basket: integer ids by remainder, others by hash."""
    if b.schema["basket"].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint"):
        return F.pmod(F.col("basket").cast("bigint"), F.lit(chunks)).cast("int")
    return F.pmod(F.xxhash64("basket"), F.lit(chunks)).cast("int")


def _fp_growth(arrays: DataFrame, min_count: int) -> DataFrame | None:
    n = arrays.count()
    if n == 0 or min_count > n:
        return None
    miner = FPGrowth(itemsCol="items", minSupport=max(min_count - 0.5, 0.0) / n)
    return miner.fit(arrays).freqItemsets.where(F.col("freq") >= min_count)


def _empty(b: DataFrame) -> DataFrame:
    kind = b.schema["item"].dataType.simpleString()
    return b.sparkSession.createDataFrame([], f"size int, itemset array<{kind}>, freq bigint")


def son_candidates(b: DataFrame, support: int, chunks: int = 4, max_k: int | None = None) -> DataFrame:
    """(size, itemset): union over chunks of the itemsets frequent at the chunk's share of ``support``.

    Chunk c with n_c of n baskets asks for count * n >= n_c * support. Items are tagged with their chunk, so that
    a single FP-growth run mines all chunks at once; baskets reach it stripped of locally infrequent items.
    """
    b = b.select("basket", "item", chunk_of(b, chunks).alias("chunk"))
    sizes = b.select("chunk", "basket").distinct().groupBy("chunk").agg(F.count(F.lit(1)).alias("n_c"))
    # One row per chunk: a number chosen by the caller.
    shares = {r["chunk"]: r["n_c"] for r in sizes.collect()}
    n = sum(shares.values())
    kind = b.schema["item"].dataType.simpleString()
    if not n:
        return _empty(b).select("size", "itemset")
    least = min(-(-n_c * support // n) for n_c in shares.values())
    bounds = F.broadcast(b.sparkSession.createDataFrame(list(shares.items()), "chunk int, n_c long"))

    def locally_frequent(counts: DataFrame) -> DataFrame:
        return counts.join(bounds, "chunk").where(F.col("freq") * n >= F.col("n_c") * support)

    singles = locally_frequent(b.groupBy("chunk", "item").agg(F.count(F.lit(1)).alias("freq"))).select("chunk", "item")
    kept = skew_join(b, singles, ["chunk", "item"], "left_semi")
    tagged = F.concat_ws(":", F.col("chunk").cast("string"), F.col("item").cast("string"))
    arrays = materialize(kept.groupBy("basket").agg(F.collect_list(tagged).alias("items")).select("items"))
    found = _fp_growth(arrays, least)
    if found is None:
        return _empty(b).select("size", "itemset")
    chunk = F.substring_index(F.element_at("items", 1), ":", 1).cast("int")
    plain = F.transform("items", lambda x: F.substring(x, F.instr(x, ":") + 1, F.length(x)).cast(kind))
    local = locally_frequent(found.withColumn("chunk", chunk)).select(F.array_sort(plain).alias("itemset")).distinct()
    out = local.select(F.size("itemset").alias("size"), "itemset")
    return out.where(F.col("size") <= max_k) if max_k else out


def count_itemsets(b: DataFrame, candidates: DataFrame, most: int = MAX_BITMAP_ITEMS) -> DataFrame:
    """(size, itemset, freq): exact counts of candidate itemsets that are closed under subsets.

    Up to ``most`` items in all candidates together are sent to the tasks, which count by bitmaps; more are counted by walking the candidates.
    """
    candidates = materialize(candidates.select("size", "itemset"))
    total = candidates.agg(F.sum("size")).first()[0]
    if total is None:
        return _empty(b)
    return count_by_bitmaps(b, candidates) if total <= most else count_by_walking(b, candidates)


def count_by_bitmaps(b: DataFrame, candidates: DataFrame) -> DataFrame:
    """(size, itemset, freq) from bitmaps of baskets per item.

    A task turns each Arrow batch of baskets into one bit row per candidate item; the count of an itemset in the batch is the number of
    bits left when its rows are combined by AND. A task sends one row per candidate it has seen. Candidates travel to the
    tasks, so their number must be bounded.
    """
    wanted = [tuple(r["itemset"]) for r in candidates.select("itemset").collect()]
    items = sorted({i for w in wanted for i in w})
    number = {item: at for at, item in enumerate(items)}
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(w) for w in wanted}:
        which = [k for k, w in enumerate(wanted) if len(w) == size]
        by_size[size] = np.array(which), np.array([[number[i] for i in wanted[k]] for k in which])
    spark = b.sparkSession
    shared = spark.sparkContext.broadcast((len(wanted), len(items), by_size))
    kind = b.schema["item"].dataType.simpleString()
    # The tables made from the bounded candidates are as bounded.
    places = F.broadcast(spark.createDataFrame(list(number.items()), f"item {kind}, _at int"))
    named = F.broadcast(spark.createDataFrame(list(enumerate(map(list, wanted))), f"_k bigint, itemset array<{kind}>"))
    baskets_of = b.join(places, "item").groupBy("basket").agg(F.collect_set("_at").alias("at")).select("at")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_wanted, n_items, by_size = shared.value
        rows = max(64, min(10_000, BITMAP_BYTES // n_items))
        total = np.zeros(n_wanted, dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                column = whole.slice(start, rows).column("at")
                n = len(column)
                held = np.zeros((n_items, n), dtype=bool)
                held[column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), pc.list_value_length(column).to_numpy(zero_copy_only=False))] = True
                bits = np.packbits(held, axis=1)
                block = max(1, BITMAP_BYTES // bits.shape[1])
                for which, places in by_size.values():
                    for at in range(0, len(which), block):
                        part = places[at : at + block]
                        both = bits[part[:, 0]]
                        for column_of in range(1, part.shape[1]):
                            both &= bits[part[:, column_of]]
                        total[which[at : at + block]] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["_k", "n"])

    counts = baskets_of.mapInArrow(count, "_k bigint, n bigint").groupBy("_k").agg(F.sum("n").alias("freq"))
    return counts.join(named, "_k").select(F.size("itemset").alias("size"), "itemset", "freq")


def count_by_walking(b: DataFrame, candidates: DataFrame) -> DataFrame:
    """(size, itemset, freq) for any number of candidates.

    Every basket walks the candidates as a prefix tree: a row holds a prefix found in a basket and the basket's
    later items, and is joined with the items that may follow that prefix. Only true occurrences of candidates
    become rows. The counts of one level tell which prefixes of the next join must be split.
    """
    deepest = candidates.agg(F.max("size")).first()[0]
    if deepest is None:
        return _empty(b)
    singles = candidates.where("size = 1").select(F.element_at("itemset", 1).alias("item"))
    kept = skew_join(b.select("basket", "item"), singles, "item", "left_semi")
    arrays = kept.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("_items")).groupBy("_items").agg(F.count(F.lit(1)).alias("_n"))

    def alike(rows: DataFrame) -> DataFrame:
        """Equal walk rows as one row with their number, so that no hot prefix is repeated basket by basket."""
        return materialize(rows.groupBy("prefix", "_rest").agg(F.sum("_n").alias("_n")))

    walk = alike(
        arrays.select(F.posexplode("_items").alias("_at", "item"), "_items", "_n").select(
            F.array("item").alias("prefix"), F.expr("slice(_items, _at + 2, size(_items))").alias("_rest"), "_n"
        )
    )
    counted = []
    for size in range(1, deepest + 1):
        if size > 1:
            follow = (
                candidates.where(F.col("size") == size)
                .groupBy(F.slice("itemset", 1, size - 1).alias("prefix"))
                .agg(F.collect_list(F.element_at("itemset", size)).alias("_next"))
            )
            hot = counted[-1].where(F.col("freq") > ROWS_PER_SPLIT).select(
                F.col("itemset").alias("prefix"), F.ceil(F.col("freq") / ROWS_PER_SPLIT).cast("int").alias("_splits")
            )
            met = skew_join(walk.where(F.size("_rest") > 0), follow, "prefix", hot=hot)
            walk = alike(
                met.select("prefix", "_rest", "_n", F.explode(F.array_intersect("_rest", "_next")).alias("item")).select(
                    F.concat("prefix", F.array("item")).alias("prefix"),
                    F.expr("slice(_rest, cast(array_position(_rest, item) as int) + 1, size(_rest))").alias("_rest"),
                    "_n",
                )
            )
        counts = walk.groupBy(F.col("prefix").alias("itemset")).agg(F.sum("_n").alias("freq"))
        counted.append(materialize(counts.select(F.lit(size).alias("size"), "itemset", "freq")))
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def frequent_itemsets(b: DataFrame, support: int, max_k: int | None = None, backend: str = "son", chunks: int = 4) -> DataFrame:
    """(size, itemset, freq) of all itemsets in at least ``support`` baskets, by 'son' or 'fpgrowth'."""
    if backend == "son":
        counts = count_itemsets(b, son_candidates(b, support, chunks, max_k))
        return counts.where(F.col("freq") >= support)
    items = b.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= support).select("item")
    kept = skew_join(b.select("basket", "item"), items, "item", "left_semi")
    found = _fp_growth(materialize(kept.groupBy("basket").agg(F.collect_list("item").alias("items")).select("items")), support)
    if found is None:
        return _empty(b)
    out = found.select(F.size("items").alias("size"), F.array_sort("items").alias("itemset"), "freq")
    return out.where(F.col("size") <= max_k) if max_k else out


def extend_candidates(frequent: DataFrame, size: int) -> DataFrame:
    """(size, itemset): itemsets one larger than ``size`` (two or more), all of whose subsets are in ``frequent``.

    Sets are joined on their common prefix with items ordered from the least to the most used, so that no prefix
    has many continuations (as in triangle counting); subsets not in ``frequent`` are pruned by a join.
    """
    if size < 2:
        raise ValueError("pairs are counted from the baskets; candidates are extended from size 2 on")
    sets = materialize(frequent.where(F.col("size") == size).select("itemset").distinct())
    used = sets.select("itemset", F.explode("itemset").alias("item"))
    uses = used.groupBy("item").agg(F.count(F.lit(1)).alias("_uses"))
    ordered = skew_join(used, uses, "item").groupBy("itemset").agg(F.array_sort(F.collect_list(F.struct("_uses", "item"))).alias("_o"))
    keyed = ordered.select(F.slice("_o", 1, size - 1).alias("_prefix"), F.element_at("_o", size).alias("_last"))
    pairs = keyed.join(keyed.withColumnRenamed("_last", "_more"), "_prefix").where(F.col("_last") < F.col("_more"))
    joined = F.concat("_prefix", F.array("_last"), F.array("_more"))
    grown = pairs.select(F.array_sort(F.transform(joined, lambda x: x["item"])).alias("_grown"))
    subsets = F.transform(
        F.sequence(F.lit(1), F.lit(size + 1)),
        lambda i: F.concat(F.slice("_grown", F.lit(1), i - 1), F.slice("_grown", i + 1, F.lit(size + 1))),
    )
    checked = grown.select("_grown", F.explode(subsets).alias("itemset")).join(sets, "itemset")
    complete = checked.groupBy("_grown").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size + 1)
    return complete.select(F.lit(size + 1).alias("size"), F.col("_grown").alias("itemset"))


def itemset_lines(sections: dict[str, DataFrame], by_text: bool = False, per_segment: int = 10_000) -> DataFrame:
    """(section, size, segment, line): report lines of ('a', 'b') itemsets, one line per section and size.

    Itemsets are ordered as tuples, or by their text with ``by_text``. Long lines come in segments.
    """
    quoted = F.concat(F.lit("('"), F.array_join(F.col("itemset").cast("array<string>"), "', '"), F.lit("')"))
    rows = None
    for number, (name, sets) in enumerate(sections.items()):
        part = sets.select(F.lit(number).alias("_section"), F.lit(name).alias("section"), "size", "itemset", quoted.alias("_text"))
        rows = part if rows is None else rows.unionByName(part)
    order = ["_text"] if by_text else ["itemset"]
    lines = segment_lines(rows, ["_section", "section", "size"], order, "_text", ",", per_segment)
    return lines.orderBy("_section", "size", "segment").select("section", "size", "segment", "line")
