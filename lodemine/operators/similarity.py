"""Set similarity: MinHash signatures, banded LSH pairs and exact Jaccard pairs.

The (id, elem) rows given to the operators are distinct, as :func:`words` makes them. Items with identical element sets are folded into one representative first, so a mass of copies is one set in
every join. Results name representatives; :func:`expand_pairs` lists the pairs of the items themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemine.functions.hashing import affine_family, text_number
from lodemine.operators.overlap import CROWDED, PAIR_SPLIT, similar_sets
from lodemine.operators.skew import hot_keys, positions, skew_join
from lodemine.session import materialize

# Hashes of ids that are told apart where copies are taken out; fewer cost rows, not results.
COPY_PLACES = 2**21

def words(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, word): the distinct lower-case words of the whole text; ids are unique, so rows are distinct without a shuffle."""
    return docs.select(id, F.explode(F.array_distinct(F.split(F.lower(text), "[ \\t\\n\\r\\f]+"))).alias("word")).where("word <> ''")


def set_groups(sets: DataFrame, id: str, elem: str) -> DataFrame:
    """(id, rep, n_copies): items with the same element set share the smallest id as representative.

    Sets are compared by size and two independent 64-bit hashes xor-ed over the elements, which is a plain
    mergeable aggregation: no set is ever gathered in one place.
    """
    prints = (
        sets.groupBy(id)
        .agg(
            F.count(F.lit(1)).alias("_size"),
            F.bit_xor(F.xxhash64(elem)).alias("_h1"),
            F.bit_xor(F.xxhash64(F.lit("second"), elem)).alias("_h2"),
        )
    )
    marks = ["_size", "_h1", "_h2"]
    reps = prints.groupBy(*marks).agg(F.min(id).alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    return skew_join(prints, reps, marks).select(id, "rep", "n_copies")


def distinct_sets(sets: DataFrame, groups: DataFrame, id: str, elem: str) -> DataFrame:
    """Rows of the representatives only.

    The other items are taken out: rows whose id has the hash of none of them stay where they are, only the rest is joined. What is sent
    around are the hashes, at most COPY_PLACES numbers.
    """
    copies = groups.where(F.col(id) != F.col("rep")).select(id)
    place = F.pmod(F.xxhash64(id), F.lit(COPY_PLACES)).alias("_place")
    rows = sets.select(id, elem).where(F.col(id).isNotNull()).select("*", place)
    places = F.broadcast(copies.select(place).distinct())
    perhaps = rows.join(places, "_place", "left_semi").drop("_place")
    return rows.join(places, "_place", "left_anti").drop("_place").unionByName(skew_join(perhaps, copies, id, "left_anti"))


def numbered(sets: DataFrame, id: str, elem: str) -> DataFrame:
    """(id, idx) rows, an item's together: ``idx`` is the 0-based rank of the element among all distinct elements in order."""
    ranks = positions(sets.select(elem).distinct(), [], [elem], name="_at").select(elem, (F.col("_at") - 1).alias("idx"))
    return skew_join(sets.select(id, elem), ranks, elem).select(id, "idx").repartition(id).sortWithinPartitions(id)


def indexed(sets: DataFrame, id: str, elem: str) -> DataFrame:
    """(id, idx) rows; an integer element is its own index, another one's is a hash of its text, without any table of elements."""
    if sets.schema[elem].dataType.simpleString() in ("int", "bigint"):
        return sets.select(id, F.col(elem).cast("bigint").alias("idx"))
    return sets.select(id, text_number(F.col(elem).cast("string")).alias("idx"))


def partial_minima(sets: DataFrame, id: str, elem: str, n_hash: int, modulus: int, seed: int) -> DataFrame:
    """(id, minima[]): all hash minima of each stretch of rows of one item within an Arrow batch.

    Rows of an item that lie together become one row before anything is shuffled; minima of several rows of an item merge.
    """
    family = affine_family(n_hash, seed, modulus + 1, modulus)
    a, b = (np.array([row[k] for row in family], dtype=np.int64)[:, None] for k in (1, 2))
    rows = indexed(sets, id, elem).select(id, F.pmod("idx", F.lit(modulus)).alias("_x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").to_numpy(zero_copy_only=False)
            if not len(x):
                continue
            ids = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            minima = np.minimum.reduceat((a * x + b) % modulus, starts, axis=1).T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * n_hash, pa.int32()), pa.array(minima.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), lists], names=[id, "minima"])

    return rows.mapInArrow(work, f"`{id}` {rows.schema[id].dataType.simpleString()}, minima array<bigint>")


def minhash(sets: DataFrame, id: str, elem: str, n_hash: int = 80, modulus: int = 10000, seed: int = 80) -> DataFrame:
    """(id, hash_no, min_hash): the minimum of (a * index + b) mod ``modulus`` per item and hash function."""
    parts = partial_minima(sets, id, elem, n_hash, modulus, seed).select(id, F.posexplode("minima").alias("hash_no", "min_hash"))
    return parts.groupBy(id, "hash_no").agg(F.min("min_hash").alias("min_hash"))


def signature(sets: DataFrame, id: str, elem: str, n_hash: int = 80, modulus: int = 10000, seed: int = 80) -> DataFrame:
    """(id, sig): all ``n_hash`` minima of an item in one array."""
    minima = [F.min(F.get("minima", F.lit(j))).alias(f"m{j}") for j in range(n_hash)]
    return partial_minima(sets, id, elem, n_hash, modulus, seed).groupBy(id).agg(*minima).select(id, F.array(*[f"m{j}" for j in range(n_hash)]).alias("sig"))


def bands(sig: DataFrame, id: str, n_hash: int, n_bands: int) -> DataFrame:
    """(id, band, bucket): one row per band of the signature; items agreeing on a band share its bucket."""
    rows = n_hash // n_bands
    parts = [F.struct(F.lit(b).alias("band"), F.slice("sig", b * rows + 1, rows).alias("part")) for b in range(n_bands)]
    exploded = sig.select(id, F.explode(F.array(*parts)).alias("p"))
    return exploded.select(id, F.col("p.band").alias("band"), F.array_join(F.col("p.part").cast("array<string>"), ",").alias("bucket"))


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    share = F.col("n_common") / (F.col("size_1") + F.col("size_2") - F.col("n_common"))
    return pairs.select("id_1", "id_2", share.alias("similarity")).where(F.col("similarity") >= threshold)


def _named(pairs: DataFrame, id: str, groups: DataFrame) -> DataFrame:
    copies = groups.where(F.col(id) == F.col("rep")).select("rep", "n_copies")
    first = copies.select(F.col("rep").alias("id_1"), F.col("n_copies").alias("n_copies_1"))
    second = copies.select(F.col("rep").alias("id_2"), F.col("n_copies").alias("n_copies_2"))
    pairs = materialize(pairs)
    both = skew_join(skew_join(pairs, first, "id_1"), second, "id_2", hot=hot_keys(pairs, ["id_2"]))
    return both.select(F.col("id_1").alias("item_1"), F.col("id_2").alias("item_2"), "n_copies_1", "n_copies_2", "similarity")


def jaccard_pairs(
    sets: DataFrame, id: str, elem: str, threshold: float = 0.5, groups: DataFrame | None = None, crowded: int = CROWDED
) -> DataFrame:
    """Pairs of distinct sets with Jaccard similarity of at least ``threshold``, exactly.

    Output: item_1 < item_2 (representatives), the number of items each stands for, and the similarity. Pairs are counted in tasks, so elements
    that more than ``crowded`` sets hold need no treatment of their own any more.
    """
    groups = materialize(set_groups(sets, id, elem)) if groups is None else groups
    pairs = similar_sets(distinct_sets(sets, groups, id, elem), id, elem, threshold)
    return _named(_verified(pairs, threshold), id, groups)


def lsh_pairs(
    sets: DataFrame,
    id: str,
    elem: str,
    n_hash: int = 80,
    n_bands: int = 40,
    modulus: int = 10000,
    threshold: float = 0.5,
    seed: int = 80,
    groups: DataFrame | None = None,
    crowded: int = CROWDED,
) -> DataFrame:
    """Pairs of distinct sets that share an LSH bucket and have Jaccard similarity of at least ``threshold``.

    Sets meet in their buckets, in tasks that hold two blocks of sets, so crowded buckets need no longer keys (``crowded``) any more. Short bands over large sets, or a modulus that is small
    against the number of elements, put many unrelated pairs into a common bucket: use longer bands and a large prime modulus there.
    """
    groups = materialize(set_groups(sets, id, elem)) if groups is None else groups
    reps = distinct_sets(sets, groups, id, elem)
    in_bands = bands(signature(reps, id, elem, n_hash, modulus, seed), id, n_hash, n_bands)
    in_order = F.array_sort(F.collect_list(F.struct("band", F.xxhash64("band", "bucket").alias("key"))))
    buckets = in_bands.groupBy(id).agg(in_order.alias("_keys")).select(F.col(id).alias("id"), F.col("_keys.key").alias("buckets"))
    pairs = similar_sets(reps, id, elem, threshold, buckets)
    return _named(_verified(pairs, threshold), id, groups)


def expand_pairs(pairs: DataFrame, groups: DataFrame, id: str) -> DataFrame:
    """Every pair of items behind ``pairs``: members of similar sets, and copies of one set (similarity 1).

    The output has as many rows as there are similar pairs, which for a large group of copies is many; the
    (pairs, groups) form holds the same facts in linear space.
    """
    first = groups.select(F.col(id).alias("_m1"), F.col("rep").alias("item_1"))
    second = groups.select(F.col(id).alias("_m2"), F.col("rep").alias("item_2"))
    halfway = materialize(skew_join(pairs, first, "item_1"))
    across = skew_join(halfway, second, "item_2").select("_m1", "_m2", "similarity")
    within = skew_join(first, groups.select(F.col(id).alias("_m2"), F.col("rep").alias("item_1")), "item_1", rows_per_split=PAIR_SPLIT)
    within = within.where(F.col("_m1") < F.col("_m2")).select("_m1", "_m2", F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select(
        F.least("_m1", "_m2").alias("item_1"), F.greatest("_m1", "_m2").alias("item_2"), "similarity"
    )
