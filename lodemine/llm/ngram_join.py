"""Exact Jaccard join on word n-grams by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct n-grams (two sets differ in their hashes but for a chance of
about 1e-19 per pair of n-grams). All n-grams have one global order: those that a summary of the whole corpus names as
frequent come last, by rising frequency; the others are ordered by hash. The order decides costs, never results.

1. Documents with equal sets are one class, named by its smallest id; only classes are compared.
2. Two similar sets share an n-gram among the first n - ceil(t n) + 1 of each (the prefix). Prefix rows meet by n-gram.
   In each such group every member is paired with one hub, the member with the fewest infrequent n-grams; that
   is one row per prefix row, however large the group. Pairs whose prefixes rule out the threshold are dropped.
3. For the pairs that remain, sets are cut into fragments of the global order, at places of about equal load. Segments of one hub and one fragment
   meet, each overlap is counted separately, and the counts are summed per pair. A hub with many partners is
   repeated, and its partners are spread over the copies.
4. Links join classes into components. Members that are not in their hub's component are then paired with all members
   of their groups in other components, as far as the overlap of their prefixes leaves a chance, and counted the same way. Every pair of similar documents in
   different components would appear here, so the components are those of the full link graph, though pairs
   inside a component are never listed.

Defined results: a text with fewer words than an n-gram is its whole word sequence; null, empty and blank texts have an
empty set and are linked with nothing. Rows that share an id are one document: all their sets are in one component. Ids are of any type that has an order. A row without an id links
nothing; it takes the component of the rows with an equal set, or null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodemine.llm.common import pack, slices
from lodemine.session import materialize

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# Sets that a task remembers so as not to send copies again; forgetting some costs rows, not results.
REMEMBERED = 500_000
# Hashes of ids that are told apart where texts are picked; fewer cost rows, not results.
FILTER_PLACES = 2**21
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, one after the other, and the number of words of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    # Polynomial hash of each word, by one pass per byte position; the rare long words are hashed one by one.
    hashes = (ends - starts).astype(np.uint64)
    for i in np.flatnonzero(ends - starts > 64).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    left = np.flatnonzero(ends - starts <= 64)
    at = starts[left]
    while len(left):
        hashes[left] = hashes[left] * MULTIPLIER + data[at].astype(np.uint64) + np.uint64(1)
        at = at + 1
        more = at < ends[left]
        left, at = left[more], at[more]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    n_words = np.diff(np.concatenate([[0], np.searchsorted(starts, ends_of_texts)]))
    return mix(hashes), n_words


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes (as signed numbers) of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, n_words = word_hashes(raw)
    out, start = [], 0
    if len(hashes) >= n:
        grams = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for k in range(n):
            grams = grams * MULTIPLIER + hashes[k : k + len(grams)]
        grams = mix(grams).view(np.int64)
    for words in n_words.tolist():
        if words >= n:
            out.append(np.unique(grams[start : start + words - n + 1]))
        elif words:
            whole = np.uint64(words)
            with np.errstate(over="ignore"):
                for h in hashes[start : start + words]:
                    whole = whole * MULTIPLIER + h
            out.append(mix(np.asarray([whole])).view(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
        start += words
    return out


def fingerprint(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(grams.view(np.uint64) + MULTIPLIER).sum(dtype=np.uint64).view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class Frequent:
    """A mergeable summary of the most frequent numbers of a stream, in arrays of bounded size.

    Whenever more than ``held`` numbers are known, the count of the first one that is dropped is taken from all that stay, so a
    count is too low by at most total / held, and every number above that is known.
    """

    def __init__(self, held: int, buffer: int = 3_000_000) -> None:
        self.held, self.buffer = held, buffer
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.n_waiting += len(keys)
        if self.n_waiting >= self.buffer:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.n_waiting = [], 0
        both = np.concatenate([self.keys, keys])
        keys, place = np.unique(both, return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([self.counts, counts])).astype(np.int64)
        if len(keys) > self.held:
            counts = counts - np.partition(counts, -self.held - 1)[-self.held - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts


def summarize(docs: DataFrame, doc_id: str, text: str, n: int, held: int) -> DataFrame:
    """(doc_id, size, print) of every row, and, with a null size, (n-gram, count) pairs of each task's summary."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(held)
        for batch in slices(batches, "text"):
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            for s in sets:
                frequent.add(s)
            columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.nulls(len(sets), pa.int64())], names=["doc_id", "size", "print", "count"])
        frequent.flush()
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(frequent.keys), id_type), pa.nulls(len(frequent.keys), pa.int32()), pa.array(frequent.keys), pa.array(frequent.counts)],
            names=["doc_id", "size", "print", "count"],
        )

    return materialize(rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, size int, print bigint, count bigint"))


def ordered(grams: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the global order, and how many of its n-grams are infrequent."""
    if not len(frequent):
        return grams, len(grams)
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    known = frequent[at] == grams
    last = grams[known]
    return np.concatenate([grams[~known], last[np.argsort(ranks[at[known]], kind="stable")]]), int(len(grams) - known.sum())


def prefix_rows(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, print, size, rare, pos): the prefix of every set; equal sets met by one task are sent once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "text"):
            grams, prints, sizes, rares, lengths = [], [], [], [], []
            for s in ngram_sets(batch.column("text").to_pylist(), n):
                key = fingerprint(s), len(s)
                if not len(s) or key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                inorder, rare = ordered(s, keys, ranks)
                length = prefix_length(len(s), percent)
                grams.append(inorder[:length])
                prints.append(key[0])
                sizes.append(len(s))
                rares.append(rare)
                lengths.append(length)
            if not grams:
                continue
            columns = [np.concatenate(grams)]
            columns += [np.repeat(np.asarray(x, dtype=t), lengths) for x, t in ((prints, np.int64), (sizes, np.int32), (rares, np.int32))]
            columns += [np.concatenate([np.arange(x, dtype=np.int32) for x in lengths])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "print", "size", "rare", "pos"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(text).alias("text"))
    return rows.mapInArrow(scan, "gram bigint, print bigint, size int, rare int, pos int")


def needed(size_a, size_b, percent: int):
    """The least overlap of similar sets of these sizes."""
    return F.ceil(percent * (size_a + size_b) / (100 + percent))


def may_link(percent: int):
    """Whether the overlap within the prefixes leaves a chance to reach the threshold.

    The shorter-reaching of the two prefixes has met all of the other set up to its end; behind it at most the rest of one set
    and what lies behind the last match of the other can be shared.
    """
    a, b = F.col("a_size"), F.col("b_size")
    rest_a = F.least(a - (a - F.ceil(percent * a / 100) + 1), b - F.col("b_last") - 1)
    rest_b = F.least(b - (b - F.ceil(percent * b / 100) + 1), a - F.col("a_last") - 1)
    in_size = F.least(a, b) * 100 >= percent * F.greatest(a, b)
    return in_size & (F.col("shared") + F.greatest(rest_a, rest_b) >= needed(a, b, percent))


PAIR = ["a_print", "a_size", "b_print", "b_size"]


def pivots(total: int, keys: np.ndarray, ranks: np.ndarray, counts: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the global order is cut into fragments of about equal load: hashes among the infrequent n-grams, then ranks among the frequent ones.

    Infrequent n-grams are ordered by hash, so their load is spread evenly; the frequent ones have their counts.
    """
    total = max(total, 1)
    inorder = np.argsort(ranks)
    by_rank = np.cumsum(counts[inorder])
    front = max(total - int(by_rank[-1]), 0) if len(keys) else total
    goals = [total * k / fragments for k in range(1, fragments)]
    hashes = [max(-(2**63), min(2**63 - 1, int((g / front - 0.5) * 2**64))) for g in goals if g < front]
    places = [min(int(np.searchsorted(by_rank, g - front)), len(keys) - 1) for g in goals if g >= front]
    return np.array(hashes, dtype=np.int64), ranks[inorder][np.array(places, dtype=np.int64)]


def fragments_of(grams: np.ndarray, order: tuple[np.ndarray, np.ndarray], cuts: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The segments of a sorted set in the fragments of the global order, each sorted by hash."""
    keys, ranks = order
    if not len(keys):
        return np.split(grams, np.searchsorted(grams, cuts[0]))
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    known = keys[at] == grams
    front = np.split(grams[~known], np.searchsorted(grams[~known], cuts[0]))
    # Frequent n-grams before the first cut among them are in the last fragment of the infrequent ones.
    which = np.searchsorted(cuts[1], ranks[at[known]], side="right")
    back = [grams[known][which == k] for k in range(len(cuts[1]) + 1)]
    return [*front[:-1], np.sort(np.concatenate([front[-1], back[0]])), *back[1:]]


def texts_asked(docs: DataFrame, doc_id: str, text: str, asked: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents ``asked`` for, and of others that share a hash with them, which a join on the id drops: only these texts are moved.

    What is sent around are the hashes, at most FILTER_PLACES numbers.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_PLACES)).alias("place")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.select("*", place).join(F.broadcast(asked.select(place).distinct()), "place", "left_semi").drop("place")


def verified(
    docs: DataFrame, doc_id: str, text: str, n: int, percent: int, pairs: DataFrame, classes: DataFrame, order: tuple, cuts: tuple, per_copy: int = 250
) -> DataFrame:
    """The pairs (a, b) that reach the threshold, with their overlap; ``b`` is the side that meets many partners."""
    shared = docs.sparkSession.sparkContext.broadcast((order, cuts))
    a, b = ["a_print", "a_size"], ["b_print", "b_size"]
    copies = pairs.groupBy(*b).agg(F.ceil(F.count(F.lit(1)) / per_copy).cast("int").alias("copies"))
    partners = pairs.join(copies, b).select(
        F.col("a_print").alias("print"), F.col("a_size").alias("size"), *b, F.pmod(F.xxhash64(*a), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("side")
    )
    hubs = copies.select(
        F.col("b_print").alias("print"), F.col("b_size").alias("size"), *b, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("side")
    )
    # A document asks for at most one place per n-gram of its prefix.
    asked = materialize(
        partners.unionByName(hubs)
        .groupBy("print", "size")
        .agg(F.collect_list(F.struct("b_print", "b_size", "copy", "side")).alias("places"))
        .join(classes, ["print", "size"])
        .select(F.col("class").alias("doc_id"), "print", "size", "places")
    )
    texts = texts_asked(docs, doc_id, text, asked).join(asked, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["b_print", "b_size", "copy", "fragment", "side", "print", "size", "segment"]
        order, cuts = shared.value
        for batch in slices(batches, "text", 1_000_000):
            out: dict[str, list] = {x: [] for x in names}
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            for s, own, size, places in zip(sets, *[batch.column(c).to_pylist() for c in ("print", "size", "places")], strict=True):
                if len(s) != size or fingerprint(s) != own:
                    continue  # another text under the same id
                for f, segment in enumerate(fragments_of(s, order, cuts)):
                    for place in places:
                        row = (place["b_print"], place["b_size"], place["copy"], f, place["side"], own, size, segment)
                        for x, v in zip(names, row, strict=True):
                            out[x].append(v)
            if out["print"]:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(out[x], t) for x, t in zip(names, kinds, strict=True)], names=names)

    place = ["b_print", "b_size", "copy", "fragment"]
    segments = texts.mapInArrow(cut, "b_print bigint, b_size int, copy int, fragment int, side int, print bigint, size int, segment array<bigint>")
    segments = segments.repartition(*place).sortWithinPartitions(*place, "side")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hub = None, np.zeros(0, np.int64)
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in place], strict=True))
            column = batch.column("segment")
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sides = batch.column("side").to_pylist()
            overlap = np.zeros(len(keys), dtype=np.int32)
            for i, key in enumerate(keys):
                segment = values[ends[i] : ends[i + 1]]
                if sides[i] == 0:
                    current, hub = key, segment.copy()
                elif key == current and len(hub) and len(segment):
                    at = np.minimum(np.searchsorted(hub, segment), len(hub) - 1)
                    overlap[i] = int((hub[at] == segment).sum())
            found = np.flatnonzero(overlap)
            picked = batch.take(pa.array(found))
            columns = [picked.column(c) for c in ("print", "size", "b_print", "b_size", "fragment")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(overlap[found], pa.int32())], names=[*PAIR, "fragment", "overlap"])

    partial = segments.mapInArrow(count, "a_print bigint, a_size int, b_print bigint, b_size int, fragment int, overlap int")
    # A repeated row counts its segments again, so each fragment's count is taken once.
    once = partial.groupBy(*PAIR, "fragment").agg(F.max("overlap").alias("overlap"))
    summed = once.groupBy(*PAIR).agg(F.sum("overlap").alias("overlap"))
    return materialize(summed.where(100 * F.col("overlap") >= percent * (F.col("a_size") + F.col("b_size") - F.col("overlap"))))


def busier_second(pairs: DataFrame) -> DataFrame:
    """The pairs turned so that ``b`` is the side with more pairs; no set is then ``a`` in more than the square root of twice the pairs."""
    ends = [pairs.select(F.col(f"{s}_print").alias("print"), F.col(f"{s}_size").alias("size")) for s in "ab"]
    degree = ends[0].unionByName(ends[1]).groupBy("print", "size").agg(F.count(F.lit(1)).alias("degree"))
    for s in "ab":
        pairs = pairs.join(degree.select(F.col("print").alias(f"{s}_print"), F.col("size").alias(f"{s}_size"), F.col("degree").alias(f"{s}_degree")), [f"{s}_print", f"{s}_size"])
    turn = F.col("a_degree") > F.col("b_degree")
    swap = {"a": "b", "b": "a"}
    return materialize(pairs.select(*[F.when(turn, F.col(swap[c[0]] + c[1:])).otherwise(F.col(c)).alias(c) for c in PAIR]))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex: the smallest id it can reach over edges (src, dst).

    Each round takes the least label among neighbours and jumps to that label's own label, so rounds grow with the logarithm
    of the longest path. Labels are stored after each round.
    """
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.groupBy(F.col("src").alias("id")).agg(F.least(F.first("src"), F.min("dst")).alias("component"))
    labels = materialize(labels)
    while True:
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        moved = materialize(lower.join(jump, "next").select("id", "component", F.least("next", "beyond").alias("next")))
        if moved.where(F.col("next") != F.col("component")).isEmpty():
            break
        labels = moved.select("id", F.col("next").alias("component"))
    return vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def similar_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, fragments: int = 4, held: int = 100_000) -> DataFrame:
    """(doc_id, size, print, component), one row per row of ``docs``: its set, and the smallest id with a set reachable from it over links of sets.

    Sets are linked when 100 * intersection >= percent * union. ``component`` is null for empty sets and for those without any id. ``held``
    bounds the table of frequent n-grams (numbers and ranks, broadcast).
    """
    scanned = summarize(docs, doc_id, text, n, held)
    counted = scanned.where("size IS NULL").groupBy(F.col("print").alias("gram")).agg(F.sum("count").alias("count")).where("count > 1")
    top = counted.orderBy(F.desc("count"), "gram").limit(held).toPandas()
    order = np.argsort(top["gram"].to_numpy(dtype=np.int64))
    frequent = top["gram"].to_numpy(dtype=np.int64)[order], (len(top) - order).astype(np.int32)
    total = scanned.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = pivots(total, *frequent, top["count"].to_numpy(dtype=np.int64)[order], fragments)

    sizes = scanned.where("size IS NOT NULL")
    classes = materialize(sizes.where("size > 0 AND doc_id IS NOT NULL").groupBy("print", "size").agg(F.min("doc_id").alias("class")))

    group = Window.partitionBy("gram")
    member = F.struct("rare", "size", "print", "pos")
    met = prefix_rows(docs, doc_id, text, n, percent, frequent).withColumn("hub", F.min(member).over(group))
    met = met.where((F.col("print") != F.col("hub.print")) | (F.col("size") != F.col("hub.size")))
    pairs = materialize(
        met.groupBy(F.col("print").alias("a_print"), F.col("size").alias("a_size"), F.col("hub.print").alias("b_print"), F.col("hub.size").alias("b_size")).agg(
            F.collect_set(F.struct("gram", "pos", F.col("hub.pos").alias("hub_pos"))).alias("met")
        )
    )
    matched = pairs.select(
        *PAIR, F.size("met").alias("shared"), F.array_max(F.col("met.pos")).alias("a_last"), F.array_max(F.col("met.hub_pos")).alias("b_last")
    ).where(may_link(percent))
    links = verified(docs, doc_id, text, n, percent, matched.select(*PAIR), classes, frequent, cuts)

    def ids(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            named = classes.select(F.col("print").alias(f"{side}_print"), F.col("size").alias(f"{side}_size"), F.col("class").alias(side))
            pairs = pairs.join(named, [f"{side}_print", f"{side}_size"])
        return pairs

    edges = materialize(ids(links).where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    every = classes.select(F.col("class").alias("id"))
    label = materialize(components(every.distinct(), edges))

    # Members outside their hub's component, against all members of the same groups in other components.
    inside = materialize(classes.join(label.withColumnRenamed("id", "class"), "class").select("print", "size", F.col("component").alias("in")))

    def labelled(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(inside.select(F.col("print").alias(f"{side}_print"), F.col("size").alias(f"{side}_size"), F.col("in").alias(f"{side}_in")), [f"{side}_print", f"{side}_size"])

    apart = materialize(labelled(labelled(pairs.select(*PAIR), "a"), "b").where("a_in != b_in").select(*PAIR, "a_in"))
    flagged = pairs.join(apart, PAIR, "left").select(*PAIR, "a_in", F.explode("met").alias("m"))
    minor = materialize(flagged.where("a_in IS NOT NULL").select(F.col("m.gram").alias("gram"), "a_print", "a_size", "a_in", F.col("m.pos").alias("a_pos")))
    met_rows = flagged.withColumn("gram", F.col("m.gram")).join(minor.select("gram").distinct(), "gram", "left_semi")
    members = met_rows.select("gram", F.col("a_print").alias("b_print"), F.col("a_size").alias("b_size"), F.col("m.pos").alias("b_pos"), F.col("a_in").isNotNull().alias("b_minor")).unionByName(
        met_rows.select("gram", "b_print", "b_size", F.col("m.hub_pos").alias("b_pos"), F.lit(False).alias("b_minor"))
    )
    others = materialize(labelled(members.distinct(), "b"))
    # Of two sets in different components at least one is outside the hub's, so they meet here under every n-gram that their prefixes
    # share, and once: the same bound as for the hubs' pairs holds.
    sizes_fit = F.least("a_size", "b_size") * 100 >= percent * F.greatest("a_size", "b_size")
    turn = F.struct("a_print", "a_size") > F.struct(F.col("b_print").alias("a_print"), F.col("b_size").alias("a_size"))
    crossing = minor.join(others, "gram").where((F.col("a_in") != F.col("b_in")) & sizes_fit & ~(F.col("b_minor") & turn))
    swap = {"a": "b", "b": "a"}
    crossing = crossing.select(*[F.when(turn, F.col(swap[c[0]] + c[1:])).otherwise(F.col(c)).alias(c) for c in (*PAIR, "a_pos", "b_pos")])
    crossing = crossing.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("shared"), F.max("a_pos").alias("a_last"), F.max("b_pos").alias("b_last")).where(may_link(percent))
    turned = matched.select(F.col("b_print").alias("a_print"), F.col("b_size").alias("a_size"), F.col("a_print").alias("b_print"), F.col("a_size").alias("b_size"))
    crossing = crossing.select(*PAIR).join(matched.select(*PAIR).unionByName(turned), PAIR, "left_anti")
    crossing = materialize(crossing.select(*PAIR))
    if not crossing.isEmpty():
        crossing = busier_second(crossing)
        more = ids(verified(docs, doc_id, text, n, percent, crossing, classes, frequent, cuts)).where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        between = more.join(label.select(F.col("id").alias("src"), F.col("component").alias("s")), "src").join(label.select(F.col("id").alias("dst"), F.col("component").alias("d")), "dst")
        joined = components(label.select(F.col("component").alias("id")).distinct(), between.select(F.col("s").alias("src"), F.col("d").alias("dst")))
        label = label.join(joined.select(F.col("id").alias("component"), F.col("component").alias("joined")), "component").select("id", F.col("joined").alias("component"))
    of_class = classes.join(label.withColumnRenamed("id", "class"), "class").select("print", "size", "component")
    return sizes.join(of_class, ["print", "size"], "left").select("doc_id", "size", "print", "component")


def repeated_ids(found: DataFrame) -> DataFrame:
    """The ids of more than one row with words, stored."""
    return materialize(found.where("size > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``; options as for :func:`similar_sets`."""
    found = similar_sets(docs, doc_id, text, **options)
    repeated = repeated_ids(found := materialize(found))
    if not repeated.isEmpty():
        # All sets of one id are one document.
        held = materialize(found.where("size > 0").join(repeated, "doc_id", "left_semi").select("doc_id", "component").distinct())
        least = held.groupBy("doc_id").agg(F.min("component").alias("src"))
        edges = held.join(least, "doc_id").select("src", F.col("component").alias("dst")).where("src != dst")
        joined = components(held.select(F.col("component").alias("id")).distinct(), edges).withColumnRenamed("component", "joined")
        found = found.join(materialize(joined).withColumnRenamed("id", "component"), "component", "left").withColumn("component", F.coalesce("joined", "component"))
    return found.select(
        "doc_id",
        F.col("size").cast("bigint").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, **options: int) -> DataFrame:
    """One row of each component of sets: one with its smallest id, of several the one with the least text.

    A row goes only if its own set is linked to that of a row that stays, so of rows repeated under an id those with other
    texts stay. Rows without an id all stay, as no document is known to be theirs; so do rows without words.
    """
    found = materialize(similar_sets(docs, doc_id, text, n=n, **options))
    repeated = repeated_ids(found)
    single = found.where("size > 0 AND component != doc_id")
    # Stored, so that the planner knows its size and moves the texts only where the ids are too many to send around.
    dropped = materialize((single if repeated.isEmpty() else single.join(repeated, "doc_id", "left_anti")).select(F.col("doc_id").alias("_dropped")).distinct())
    rest = docs.join(dropped, F.col(doc_id) == F.col("_dropped"), "left_anti")
    if repeated.isEmpty():
        return rest
    again = repeated.withColumnRenamed("doc_id", "_repeated")
    rows = rest.join(again, F.col(doc_id) == F.col("_repeated"), "left_semi").select(pack(rest), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "size", "print"])

    rows = rows.mapInArrow(printed, rows.withColumn("size", F.lit(0)).withColumn("print", F.lit(0).cast("bigint")).schema)
    of_set = found.where("size > 0 AND doc_id = component").join(repeated, "doc_id", "left_semi").select("doc_id", "size", "print", "component").distinct()
    # Partial minima come first, so many rows under one id don't meet in one task.
    first = rows.join(of_set, ["doc_id", "size", "print"]).groupBy("component").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    kept = first.select("row").unionByName(rows.where("size = 0").select("row"))
    return rest.join(again, F.col(doc_id) == F.col("_repeated"), "left_anti").unionByName(kept.select("row.*"))
