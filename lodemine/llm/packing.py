"""Best-fit packing with exact-complement hashing: documents become token pieces, pieces fill sequences of a fixed capacity.

1. Texts are encoded by a given tokenizer, an end id is added, and documents above the capacity are cut into full pieces, the shorter one first. A byte-pair
   tokenizer never merges across the front of a space that a visible character follows, so a text is encoded unit by unit between such
   places, and units met before are looked up.
2. Only the number of pieces of each length goes to the driver, at most ``capacity`` numbers however large the corpus is. The plan works on these: for the
   longest length left, its gap is looked up among single lengths, then among sums of pairs, then of triples, and the combination is
   consumed as often as all its lengths are available. Lengths without any exact complement are left for best-fit decreasing, which
   handles equal bins together. Pattern counts so depend on the capacity and not on the corpus.
3. Each piece is numbered among those of its length: within its task while it is made (the numbers are stored with the piece), plus the
   pieces of that length in earlier partitions. Number and length name the place in the plan. No sorting, no group per length.

Defined results: a null text is empty, and an empty text is the end id alone. Every row is a document, repeated rows included. Columns
to keep travel in a struct, so no name clashes. An empty table gives no pieces. Very long texts are encoded whole.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.llm.common import slices
from lodemine.session import materialize

# Fixed values of byte-level tokenizers: how they split texts before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Such a split never crosses the front of a space that a letter, number, punctuation mark or symbol follows: units end there.
VISIBLE = r"\p{L}\p{N}\p{P}\p{S}"
ODD_SPACE = rf" (?:[^{VISIBLE}]|$)"
KNOWN_UNITS, KNOWN_UNIT_BYTES = 400_000, 40
FIRST = "\0"  # marks the unit at the front of a text, which has no space before it


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible ones stand for themselves, the others for 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ranks(file: dict) -> dict[bytes, int] | None:
    """The bytes of each id, for a plain byte-level BPE file whose merged ids follow the order of its merges; None for other files."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or file.get("normalizer"):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(p)) for p in pairs]
    if ids != list(range(256, 256 + len(ids))) or sorted(model["vocab"].values())[: 256 + len(ids)] != list(range(256 + len(ids))):
        return None
    code = byte_symbols()
    return {bytes(code[c] for c in word): i for word, i in model["vocab"].items() if i < 256 + len(ids)}


class Encoder:
    """Token ids of texts by a tokenizer file; the strings of special tokens are ordinary text.

    Files of plain byte-level BPE are applied unit by unit, with a bounded table of units met before, by the faster of two
    libraries that merge alike; all other files are applied to whole texts.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = ranks(json.load(f))
        if found:
            import tiktoken

            self.merge = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=found, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            self.merge, self.whole = None, Tokenizer.from_file(path)
            self.whole.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by ``end_id``, and the number of ids of each text."""
        if not self.merge:
            found = [[*e.ids, end_id] for e in self.whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for f in found for i in f], dtype=np.uint32), np.array([len(f) for f in found], dtype=np.int64)
        units = _units(texts)
        per_text = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = units.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_UNITS:
            self._forget()
        known, new, ids = self.known, [], []
        row = np.empty(len(words), dtype=np.int64)
        for i, word in enumerate(words):
            at = known.get(word)
            if at is None:
                at = len(self.sizes) + len(new)
                new.append(self.merge(word[1:] if word[:1] == FIRST else " " + word))
                if len(word) <= KNOWN_UNIT_BYTES:
                    known[word] = at
            row[i] = at
        self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in new], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.array([i for x in new for i in x], dtype=np.uint32)])
        starts = np.cumsum(self.sizes) - self.sizes
        unit = row[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[unit]
        text = np.repeat(np.arange(len(texts)), per_text)
        totals = np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(int(totals.sum()), end_id, dtype=np.uint32)
        # The ids of a unit go behind those of the units before it and one end id per text before it.
        to = np.cumsum(n) - n + text
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + shift] = self.ids[np.repeat(starts[unit], n) + shift]
        if len(self.ids) > 40 * KNOWN_UNITS:
            self._forget()
        return out, totals


def _units(texts: pa.Array) -> pa.ListArray:
    """The units of each text without the space in front, the first one marked."""
    marked = pc.binary_join_element_wise(pa.scalar(FIRST), texts, "")
    units = pc.split_pattern(marked, " ")
    odd = np.flatnonzero(pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False))
    if not len(odd):
        return units
    import regex

    sure = regex.compile(rf" (?=[{VISIBLE}])")
    mended = pa.array([sure.split(t) for t in marked.take(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
    at = np.arange(len(texts))
    at[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([units, mended]).take(pa.array(at))


def cut(total: int, capacity: int) -> list[int]:
    """The piece lengths of a document: full ones behind the remainder."""
    return [n for n in [total % capacity, *[capacity] * (total // capacity)] if n]


def pieces(docs: DataFrame, text: str, keep: list[Column], tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """A stored table of pieces: kept columns (struct ``doc``), piece, start, length, ids_crc32, ``ids`` if wanted, and the number among those of its length."""
    rows = docs.select(F.struct(*keep).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    columns = "part int, piece int, start bigint, length bigint, nth bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, "text"):
            ids, totals = encoder.encode(batch.column("text"), end_id)
            lengths = [cut(t, capacity) for t in totals.tolist()]
            per_doc = np.array([len(x) for x in lengths])
            length = np.array([n for x in lengths for n in x], dtype=np.int64)
            ends = np.cumsum(length)
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            piece = np.arange(len(length)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = ends - length - np.repeat(np.cumsum(totals) - totals, per_doc)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(seen[kinds], n)
            seen[kinds] += n
            out = [batch.column("doc").take(pa.array(doc)), batch.column("part").take(pa.array(doc)), pa.array(piece, pa.int32())]
            out += [pa.array(start), pa.array(length), pa.array(nth), pa.array(crc, pa.int64())]
            names = ["doc", "part", "piece", "start", "length", "nth", "ids_crc32"]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return materialize(rows.mapInArrow(work, f"doc {rows.schema['doc'].dataType.simpleString()}, {columns}"))


Pattern = tuple[int, ...]


class SumIndex:
    """Lengths with their availability, found by the sum of one, two or three of them."""

    def __init__(self, available: np.ndarray):
        self.left = available.copy()
        self.capacity = len(available) - 1
        there = (self.left > 0).astype(np.int64)
        #: How many ordered pairs of available lengths have each sum.
        self.pairs = np.rint(np.convolve(there.astype(float), there.astype(float)))[: self.capacity + 1].astype(np.int64)

    def take(self, combination: Pattern, times: int) -> None:
        for length, n in Counter(combination).items():
            self.left[length] -= n * times
            if not self.left[length]:
                # The pairs of this length go: with each other available one in both orders, and with itself.
                others = np.flatnonzero(self.left[: self.capacity + 1 - length] > 0)
                self.pairs[others + length] -= 2
                if 2 * length <= self.capacity:
                    self.pairs[2 * length] -= 1

    def times(self, combination: Pattern) -> int:
        return min(int(self.left[length]) // n for length, n in Counter(combination).items())

    def exact(self, length: int, most: int) -> Pattern | None:
        """The length and its complement of up to ``most`` of one, two or three lengths, fewer and more equal ones first; None without any."""
        gap = self.capacity - length
        for parts in (self._one, self._two, self._three)[:most]:
            for rest in parts(gap):
                if self.times((length, *rest)):
                    return (length, *rest)
        return None

    def _one(self, gap: int) -> Iterator[Pattern]:
        if gap > 0 and self.left[gap] > 0:
            yield (gap,)

    def _two(self, gap: int) -> Iterator[Pattern]:
        if gap > 1 and self.pairs[gap] > 0:
            large = np.arange((gap + 1) // 2, gap)
            for a in large[(self.left[large] > 0) & (self.left[gap - large] > 0)].tolist():
                yield (a, gap - a)

    def _three(self, gap: int) -> Iterator[Pattern]:
        if gap > 2:
            large = np.arange((gap + 2) // 3, gap - 1)
            for a in large[(self.left[large] > 0) & (self.pairs[gap - large] > 0)].tolist():
                for b, c in self._two(gap - a):
                    if b <= a:
                        yield (a, b, c)


def best_fit(left: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts of lengths, with equal bins handled together."""
    capacity = len(left) - 1
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                pattern, n = open_[gap].pop()
                used = min(todo, n)
                if n > used:
                    open_[gap].append((pattern, n - used))
                gaps[gap] = bool(open_[gap])
                added = [((*pattern, length), gap - length, used)]
                todo -= used
            else:
                per = capacity // length
                added = [((length,) * per, capacity - per * length, todo // per)] if todo >= per else []
                rest = todo % per
                if rest:
                    added.append(((length,) * rest, capacity - rest * length, 1))
                todo = 0
            for pattern, gap, n in added:
                open_[gap].append((pattern, n))
                gaps[gap] = True
        # Gaps below the shortest length to come stay open; they cost nothing.
    return [x for classes in open_.values() for x in classes]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of lengths with how many sequences have each; every length is used as often as it is counted.

    Exact complements can use up short lengths that would fill more bins later, so plans with sums of up to three, two, one and
    no lengths are made, and the one with the fewest sequences is taken, the first of equal ones.
    """
    return min((exact_plan(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda p: sum(n for _, n in p))


def exact_plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[Pattern, int]]:
    """One plan: exact complements of up to ``most`` lengths, then best fit."""
    available = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        available[length] = n
    out = [((capacity,), int(available[capacity]))] if available[capacity] else []
    available[capacity] = 0
    index = SumIndex(available)
    residual = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity - 1, 0, -1):
        while index.left[length]:
            found = index.exact(length, most)
            if found is None:
                residual[length] = index.left[length]
                index.take((length,), int(index.left[length]))
                break
            times = index.times(found)
            index.take(found, times)
            out.append((found, times))
    return out + best_fit(residual)


def places(patterns: list[tuple[Pattern, int]], capacity: int) -> tuple[np.ndarray, ...]:
    """(length * 2^44 + first number, sequence of that number, offset) of the pieces' places, in order."""
    next_number = [0] * (capacity + 1)
    sequence, rows = 0, []
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append(((length << 44) + next_number[length], sequence, offset))
            next_number[length] += n
            offset += length
        sequence += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))


def pack_pieces(made: DataFrame, capacity: int) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    per_part = materialize(made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = made.sparkSession.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    numbered = made.join(before, ["part", "length"]).withColumn("number", F.col("nth") + F.col("before")).drop("part", "nth", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            key = (length << 44) + number
            at = np.searchsorted(keys, key, side="right") - 1
            added = [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "sequence_id", "offset"])

    zero = F.lit(0).cast("bigint")
    return numbered.mapInArrow(place, numbered.withColumn("sequence_id", zero).withColumn("offset", zero).schema).drop("number")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of pieces with ids: ``ids``, and ``parts`` telling which document each stretch comes from."""
    part = F.struct("offset", "length", "piece", "start", "doc", "ids")
    gathered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return gathered.select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts")
    )
