"""Periodic runs of words, found by recompression.

A run is a stretch of words with smallest period q, at least ``min_length`` words and two periods long, that no neighbouring
word extends. The words of a batch of texts are one sequence, with a separator of its own around each text.

1. Recompression turns the sequence into a run-length grammar, level by level. A block step replaces every maximal block of one
   symbol by a symbol for (symbol, length). A pair step splits the symbols at random into left and right ones and replaces each
   left-right neighbourhood by a symbol for the pair. Equal stretches are compressed alike except at their ends.
   The steps alternate until no symbol occurs twice.
2. A longest common extension (LCE) of two places climbs the levels while the symbols there agree, consuming at most one symbol or
   block a level so that both places begin a parent; where they disagree it walks back down to first children, consuming what
   still agrees. Both directions work alike. No suffix array is built. All queries of a batch are answered at once in NumPy.
3. For a period q, places on a grid of step max(q, min_length - q) are compared with the places q further on: every run holds
   such a grid place. That makes n/q places per period, n log n in all. The extensions in both directions
   give the whole run; what different places or multiples of a period find again is one run, kept with the smallest period.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text. Texts are whole and independent of
each other; repeated rows are rows like others. Columns to keep travel in a struct, so no name clashes. An empty table gives an
empty result. A task holds one slice of a batch at a time (4 MB of text, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemine.llm.common import slices

# Places compared at once.
PLACES = 2_000_000

RUN = "struct<start:bigint,length:bigint,period:bigint>"


@dataclass
class Level:
    """The sequence at one level, and how the next level groups it."""

    symbols: np.ndarray
    parent: np.ndarray  # place of each symbol's parent in the next level
    first: np.ndarray  # place of each parent's first child here, and the length of this level at the end
    right: np.ndarray | None  # of a pair step: which symbols are right ones; None for a block step


def _block_step(symbols: np.ndarray, used: int) -> tuple[Level, np.ndarray, int] | None:
    """Blocks of one symbol become one symbol; None if there are none."""
    begins = np.empty(len(symbols), dtype=bool)
    begins[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=begins[1:])
    if begins.all():
        return None
    first = np.append(np.flatnonzero(begins), len(symbols))
    size = np.diff(first)
    above = symbols[first[:-1]]
    long = np.flatnonzero(size > 1)
    names, which = np.unique(above[long] * (int(size.max()) + 1) + size[long], return_inverse=True)
    above[long] = used + which
    return Level(symbols, np.cumsum(begins) - 1, first, None), above, used + len(names)


def _pair_step(symbols: np.ndarray, used: int, rng: np.random.Generator) -> tuple[Level, np.ndarray, int]:
    """Neighbours of a left and a right symbol become one symbol; the sides are swapped if that makes more pairs."""
    right = rng.integers(0, 2, used).astype(bool)
    side = right[symbols]
    if np.count_nonzero(side[:-1] & ~side[1:]) > np.count_nonzero(~side[:-1] & side[1:]):
        right, side = ~right, ~side
    joined = np.zeros(len(symbols), dtype=bool)  # second symbols of pairs
    np.logical_and(~side[:-1], side[1:], out=joined[1:])
    first = np.append(np.flatnonzero(~joined), len(symbols))
    above = symbols[first[:-1]]
    pairs = np.flatnonzero(np.diff(first) == 2)
    names, which = np.unique(above[pairs] * used + symbols[first[pairs] + 1], return_inverse=True)
    above[pairs] = used + which
    return Level(symbols, np.cumsum(~joined) - 1, first, right), above, used + len(names)


def grammar(symbols: np.ndarray, seed: int = 7) -> list[Level]:
    """All levels of the recompression of a sequence of symbols from 0; the last one holds no symbol twice."""
    rng = np.random.default_rng(seed)
    symbols = symbols.astype(np.int64)
    used = int(symbols.max()) + 1
    levels: list[Level] = []
    while np.bincount(symbols).max() > 1:
        step = _block_step(symbols, used)
        if step:
            levels.append(step[0])
            symbols, used = step[1:]
        if len(symbols) > 1:
            level, symbols, used = _pair_step(symbols, used, rng)
            levels.append(level)
    none = np.empty(0, dtype=np.int64)
    return [*levels, Level(symbols, none, none, None)]


def _rest_of_block(level: Level, at: np.ndarray, ahead: bool) -> np.ndarray:
    """How many symbols the block has from a place on, that place included."""
    parent = level.parent[at]
    return level.first[parent + 1] - at if ahead else at - level.first[parent] + 1


def extension(levels: list[Level], one: np.ndarray, two: np.ndarray, ahead: bool) -> np.ndarray:
    """How many symbols agree from the places ``one`` and ``two`` on (each ``one`` unequal its ``two``), forwards or backwards.

    Both walks must end in front of a symbol that occurs once, which separators see to.
    """
    step = 1 if ahead else -1
    a, b = one.copy(), two.copy()
    climbing = np.arange(len(a))
    stopped: list[np.ndarray] = []
    for level in levels:
        x, y = a[climbing], b[climbing]
        agree = level.symbols[x] == level.symbols[y]
        if not agree.all():
            stopped.append(climbing[~agree])
            climbing, x, y = climbing[agree], x[agree], y[agree]
        else:
            stopped.append(climbing[:0])
        if not len(climbing):
            break
        if level.right is None:
            rest, other = _rest_of_block(level, x, ahead), _rest_of_block(level, y, ahead)
            px, py = level.parent[x], level.parent[y]
            whole = (rest == other) & (level.first[px + 1] - level.first[px] == rest) & (level.first[py + 1] - level.first[py] == rest)
            taken = np.where(whole, 0, np.minimum(rest, other))
            x, y = x + step * taken, y + step * taken
            ends = rest != other
            if ends.any():
                a[climbing], b[climbing] = x, y
                stopped[-1] = np.concatenate([stopped[-1], climbing[ends]])
                climbing, x, y = climbing[~ends], x[~ends], y[~ends]
        else:
            # Forwards a right symbol, backwards a left one, may be the far half of a pair: it is consumed here.
            taken = level.right[level.symbols[x]] == ahead
            x, y = x + step * taken, y + step * taken
        a[climbing], b[climbing] = level.parent[x], level.parent[y]
    falling = climbing[:0]
    for k in range(len(stopped) - 1, 0, -1):
        falling = np.concatenate([falling, stopped[k]]) if len(stopped[k]) else falling
        if not len(falling):
            continue
        level = levels[k - 1]
        x, y = a[falling], b[falling]
        x, y = (level.first[x], level.first[y]) if ahead else (level.first[x + 1] - 1, level.first[y + 1] - 1)
        agree = level.symbols[x] == level.symbols[y]
        if level.right is None:
            taken = np.where(agree, np.minimum(_rest_of_block(level, x, ahead), _rest_of_block(level, y, ahead)), 0)
        else:
            taken = agree.astype(np.int64)
        a[falling], b[falling] = x + step * taken, y + step * taken
    return (a - one) * step


def _grids(sizes: np.ndarray, starts: np.ndarray, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid places of all texts, about PLACES at a time."""
    most = sizes // 2
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = np.maximum(period, min_length - period)
    room = sizes[text] - period  # places that have a partner
    count = -(-room // step)
    ends = np.cumsum(count)
    low = 0
    while low < len(text):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + PLACES, side="right")))
        n = count[low:high]
        owner = np.repeat(np.arange(low, high), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        yield starts[text[owner]] + nth * step[owner], period[owner]
        low = high


def runs_of(sequence: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts at ``starts`` in a sequence with separators, in order of start and period."""
    levels: list[Level] = []
    found: list[np.ndarray] = []
    for place, period in _grids(sizes, starts, min_length):
        hit = np.flatnonzero(sequence[place] == sequence[place + period])
        if not len(hit):
            continue
        levels = levels or grammar(sequence)
        place, period = place[hit], period[hit]
        ahead = extension(levels, place, place + period, True)
        back = extension(levels, place - 1, place + period - 1, False)
        good = ahead + back >= np.maximum(period, min_length - period)
        found.append(np.stack([(place - back)[good], (ahead + back + period)[good], period[good]]))
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _analyse(batch: pa.RecordBatch, min_length: int) -> pa.RecordBatch:
    texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # a separator stands in front of each text, and one at the end
    names = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    kinds = len(names.dictionary)
    sequence = np.empty(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    separator = np.zeros(len(sequence), dtype=bool)
    separator[starts - 1] = separator[-1] = True
    sequence[separator] = kinds + np.arange(len(texts) + 1)
    sequence[~separator] = names.indices.to_numpy(zero_copy_only=False)
    start, length, period = runs_of(sequence, starts, sizes, min_length)

    kept = np.zeros(len(sequence) + 1, dtype=np.int64)
    np.add.at(kept, start + period, 1)
    np.add.at(kept, start + length, -1)
    kept = np.cumsum(kept) == 0
    owner = np.searchsorted(starts, start, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    collapsed = []
    for i, words in enumerate(texts):
        if bounds[i] < bounds[i + 1]:
            words = [words[j] for j in np.flatnonzero(kept[starts[i] : starts[i] + sizes[i]]).tolist()]
        collapsed.append(b" ".join(words))
    fields = [pa.array(start - starts[owner]), pa.array(length), pa.array(period)]
    runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    columns = [batch.column("kept"), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["kept", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str | Column, keep: list[Column], min_length: int = 12) -> DataFrame:
    """The kept columns, ``n_words``, all ``runs`` by start and period, and the text ``collapsed``: each run's words after its first period dropped.

    Words are runs of anything but ASCII blanks, numbered from 0; ``collapsed`` joins the kept ones by single spaces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield _analyse(part, min_length)

    rows = docs.select(F.struct(*keep).alias("kept"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string"
    return rows.mapInArrow(work, schema).select("kept.*", "n_words", "runs", "collapsed")
