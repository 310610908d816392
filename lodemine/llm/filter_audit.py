"""Filter interaction audit: what each of several filters removes, loses and repeats, in every order of application.

1. A table-driven byte transducer reads the UTF-8 bytes of a batch once. Its states are: in a gap, in a word, and inside a
   character with one, two or three bytes to come; its table of (state, class of byte) gives the next state and what to emit:
   word begins, word ended, code point, capital, symbol. The bytes are laid out as lanes that step together,
   a NumPy lookup per step. A lane starts from the state after the four bytes in front of it, which fix the state whatever was before.
2. The word spans go into one open-addressing hash table per batch, all at once per probe. A span that meets an occupied slot counts as known
   only if text, length and bytes are equal, so hash collisions cost probes and never change a count.
3. Each filter is a column expression over these figures; a document is then the set of filters it fails. Copies are found by the
   SHA-256 of the texts, in groups that are summed per set of failures before they meet.
4. Documents are counted per (part, set of failures, labels); all orders and steps, and Shapley shares, follow from these few rows.

Defined results: a null or empty text has all figures 0. A malformed byte counts as a character of a word; a character cut short counts as one.
A null part is the empty string. A row without a label is in none of the label counts; of several labels of a document the highest counts.
Rows that repeat an id are copies of smaller ids only; a null id is no copy and makes none. An empty table has no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.llm.common import BLANKS, slices

GAP, WORD, ONE_LEFT, TWO_LEFT, THREE_LEFT = range(5)
BLANK, CAPITAL, SYMBOL, PLAIN, CONTINUES, LEADS_TWO, LEADS_THREE, LEADS_FOUR = range(8)
BEGINS, ENDED, IS_POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
STEPS = 1024
FIGURES = ["n_words", "n_distinct", "n_points", "n_capitals", "n_symbols"]


def classes(symbols: str) -> np.ndarray:
    """The class of each of the 256 bytes."""
    out = np.full(256, PLAIN, dtype=np.uint8)
    out[0x80:0xC0] = CONTINUES
    out[0xC2:0xE0] = LEADS_TWO
    out[0xE0:0xF0] = LEADS_THREE
    out[0xF0:0xF5] = LEADS_FOUR
    out[ord("A") : ord("Z") + 1] = CAPITAL
    out[[ord(c) for c in symbols]] = SYMBOL
    out[[ord(c) for c in BLANKS]] = BLANK
    return out


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted flags of each (state, class), flattened."""
    to = np.empty((5, 8), dtype=np.uint8)
    emit = np.empty((5, 8), dtype=np.uint8)
    for state in range(5):
        begins = BEGINS if state == GAP else 0
        for kind in range(8):
            to[state, kind] = {BLANK: GAP, LEADS_TWO: ONE_LEFT, LEADS_THREE: TWO_LEFT, LEADS_FOUR: THREE_LEFT}.get(kind, WORD)
            emit[state, kind] = begins | IS_POINT
        emit[state, BLANK] = IS_POINT | (0 if state == GAP else ENDED)
        emit[state, CAPITAL] |= IS_CAPITAL
        emit[state, SYMBOL] |= IS_SYMBOL
    for state in (ONE_LEFT, TWO_LEFT, THREE_LEFT):
        to[state, CONTINUES] = state - 1
        emit[state, CONTINUES] = 0
    return to.ravel(), emit.ravel()


def transduce(data: np.ndarray, byte_class: np.ndarray) -> np.ndarray:
    """The flags emitted at each byte."""
    to, emit = transducer()
    lanes = -(-len(data) // STEPS)
    padded = np.full(lanes * STEPS, BLANK, dtype=np.uint8)
    padded[: len(data)] = byte_class[data]
    columns = np.ascontiguousarray(padded.reshape(lanes, STEPS).T)
    state = np.full(lanes, GAP, dtype=np.uint8)
    for step in range(STEPS - 4, STEPS):
        state[1:] = to[state[1:] * 8 + columns[step, :-1]]
    flags = np.empty((STEPS, lanes), dtype=np.uint8)
    at = np.empty(lanes, dtype=np.uint8)
    for step in range(STEPS):
        np.multiply(state, 8, out=at)
        np.add(at, columns[step], out=at)
        np.take(emit, at, out=flags[step])
        np.take(to, at, out=state)
    return np.ascontiguousarray(flags.T).ravel()[: len(data)]


def _eights(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offset: int) -> np.ndarray:
    """Up to eight bytes of each span from ``offset`` on, as one number; ``data`` has eight spare bytes at its end."""
    windows = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1))
    value = windows[starts + offset].view("<u8").ravel()
    rest = np.minimum(lengths - offset, 8).astype(np.uint64)
    keep = np.where(rest == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (rest * np.uint64(8))) - np.uint64(1))
    return value & keep


def _same_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the spans ``one`` and ``two`` (of equal lengths) hold the same bytes."""
    same = np.ones(len(one), dtype=bool)
    left = np.arange(len(one))
    offset = 0
    while len(left):
        a, b = one[left], two[left]
        same[left] = _eights(data, starts[a], lengths[a], offset) == _eights(data, starts[b], lengths[b], offset)
        offset += 8
        left = left[same[left] & (lengths[a] > offset)]
    return same


def distinct_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """The number of distinct byte strings among the spans of each text, by a verified hash table."""
    mix, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    key = (text.astype(np.uint64) + np.uint64(1)) * odd + lengths.astype(np.uint64)
    left, offset = np.arange(len(starts)), 0
    while len(left):
        mixed = (key[left] ^ _eights(data, starts[left], lengths[left], offset)) * mix
        key[left] = mixed ^ (mixed >> np.uint64(29))
        offset += 8
        left = left[lengths[left] > offset]
    size = 1 << max(4, int(2 * len(starts)).bit_length())
    slot = ((key * mix) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)
    table = np.full(size, -1, dtype=np.int64)
    open_ = np.arange(len(starts))
    while len(open_):
        at = slot[open_]
        free = table[at] < 0
        table[at[free]] = open_[free]  # of several, one stays; all look at it next
        holder = table[at]
        known = holder == open_
        check = np.flatnonzero(~known & (key[holder] == key[open_]) & (text[holder] == text[open_]) & (lengths[holder] == lengths[open_]))
        known[check] = _same_bytes(data, starts, lengths, holder[check], open_[check])
        open_ = open_[~known]
        slot[open_] = (slot[open_] + 1) & (size - 1)
    return np.bincount(text[table[table >= 0]], minlength=n_texts)


def figures(texts: list[bytes], byte_class: np.ndarray) -> dict[str, np.ndarray]:
    """The FIGURES of each text."""
    ends = np.cumsum([len(t) + 1 for t in texts])  # a blank closes each text
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), dtype=np.uint8)
    flags = transduce(data[:-8], byte_class)
    starts = np.flatnonzero(flags & BEGINS)
    lengths = np.flatnonzero(flags & ENDED) - starts
    text = np.searchsorted(ends, starts, side="right")
    first = ends - np.array([len(t) + 1 for t in texts])

    def total(flag: int) -> np.ndarray:
        return np.add.reduceat((flags & flag > 0).astype(np.int64), first)

    return {
        "n_words": np.bincount(text, minlength=len(texts)),
        "n_distinct": distinct_spans(data, starts, lengths, text, len(texts)),
        "n_points": total(IS_POINT) - 1,
        "n_capitals": total(IS_CAPITAL),
        "n_symbols": total(IS_SYMBOL),
    }


def text_figures(docs: DataFrame, text: str, keep: list[Column], symbols: str = "#$%&*|") -> DataFrame:
    """The kept columns and the FIGURES of each whole text; ``symbols`` are ASCII characters."""
    byte_class = classes(symbols)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = figures([t or b"" for t in part.column("text").to_pylist()], byte_class)
            yield pa.RecordBatch.from_arrays([part.column("kept"), *[pa.array(found[f], pa.int64()) for f in FIGURES]], names=["kept", *FIGURES])

    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("binary").alias("text"))
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, " + ", ".join(f"{f} bigint" for f in FIGURES)
    return rows.mapInArrow(work, schema).select("kept.*", *FIGURES)


def failing_sets(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str) -> DataFrame:
    """(part, fails, good, toxic, n): documents per part, set of failed filters and labels.

    ``filters`` gives for each letter when a document of :func:`text_figures` fails; the letter ``copies`` stands for texts equal to one of a smaller
    id. ``fails`` is a bit set, bit i for the i-th letter.
    """
    letters = [*filters, copies]
    keep = [F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")]
    read = text_figures(docs, "text", keep)
    bits = [F.when(failed, 1 << letters.index(letter)).otherwise(0) for letter, failed in filters.items()]
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("good"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = read.select("doc_id", "part", "digest", sum(bits, F.lit(0)).alias("fails")).join(known, "doc_id", "left")
    labelled = [F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("good", "toxic")]
    same = ["digest", "part", "fails", "good", "toxic"]
    # Copies of a text have equal figures, so a group of copies shrinks to a row per part and labels before it meets.
    per_id = rows.select("doc_id", "digest", "part", "fails", *labelled).groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    per_text = per_id.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = F.coalesce(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.lit(False))
    originals = F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0)
    counted = per_text.withColumn("originals", originals)
    states = F.array(
        F.struct(F.col("fails").alias("fails"), F.col("originals").alias("n")),
        F.struct((F.col("fails") + (1 << letters.index(copies))).alias("fails"), (F.col("n") - F.col("originals")).alias("n")),
    )
    split = counted.select("part", "good", "toxic", F.explode(states).alias("state"))
    return split.groupBy("part", "state.fails", "good", "toxic").agg(F.sum("state.n").alias("n"))


def audit(sets: DataFrame, letters: list[str]) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``sets`` has a few rows per part (see :func:`failing_sets`); each meets all steps of all orders, which are a literal array.
    """
    order_type = "array<struct<filter_order:string,step:int,bit:int,before:int>>"
    bit = {letter: 1 << i for i, letter in enumerate(letters)}
    steps = [
        ("".join(order), at + 1, bit[letter], sum(bit[b] for b in order[:at])) for order in permutations(letters) for at, letter in enumerate(order)
    ]
    literal = "array(" + ",".join(f"named_struct('filter_order','{o}','step',{s},'bit',{b},'before',{e})" for o, s, b, e in steps) + ")"
    met = sets.withColumn("at", F.explode(F.expr(f"cast({literal} as {order_type})"))).select("part", "fails", "good", "toxic", "n", "at.*")
    fails, earlier = F.col("fails").bitwiseAND(F.col("bit")) > 0, F.col("fails").bitwiseAND(F.col("before")) > 0
    n_failed = F.bit_count("fails")

    def count(condition: Column, value: Column = F.col("n")) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("bigint")

    # A document that fails k filters is removed by each of them in 1/k of all orders.
    share = F.lit(factorial(len(letters))) * F.col("n") / F.greatest(n_failed, F.lit(1))
    return met.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~earlier).alias("kept"),
        count(fails & ~earlier).alias("removed"),
        count(fails & earlier).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"),
        count(fails & ~earlier & F.col("good")).alias("good_lost"),
        count(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
        F.round(F.sum(F.when(fails, share).otherwise(0))).cast("bigint").alias("shapley"),
    )
