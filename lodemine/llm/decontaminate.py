"""Benchmark decontamination: one Aho-Corasick automaton over the test items, run once over each text.

Texts and items are normalised alike: A-Z become a-z, and words are runs of a-z, 0-9 and characters beyond ASCII. The
automaton works on word numbers, so a match is a whole-word match. Its patterns are all windows of ``window``
consecutive words of an item; an item with fewer words, but not none, is one pattern. Found word ranges are merged
and, for texts with any, mapped back to code-point offsets of the original text.

The benchmark is read in blocks of at most ``block_words`` words (or one item), each broadcast as plain word lists and
compiled in the tasks, so memory does not grow with the benchmark. Ordinary benchmarks are one block and one pass;
with more blocks, each pass adds its findings to those of the passes before, stored in between.

Defined results: a null or empty text has no words and no hits and is not contaminated. Rows are treated one by one:
repeated rows give repeated results. Items with a null or empty text match nothing; items with a null id mark words but
are not listed. Ids are listed once, as strings in code-point order, also if several items share them. Empty
tables give empty results or no hits. Columns of the documents are carried in the struct ``doc``, so names never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import slices
from lodemine.session import materialize

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER_TO_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: Lower-cases A-Z and turns every byte outside of words into a space.
NORMAL = bytes(UPPER_TO_LOWER.get(b, b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def compile_items(items: list[tuple[str | None, list[bytes]]], window: int) -> tuple[dict[bytes, int], "ahocorasick.Automaton"]:  # noqa: F821
    """Numbers of the items' words, and the automaton; a pattern's value is its length and the ids of its items."""
    numbers: dict[bytes, int] = {}
    patterns: dict[tuple[int, ...], set[str]] = {}
    for item, words in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        for start in range(max(1, len(ids) - window + 1)):
            found = patterns.setdefault(tuple(ids[start : start + window]), set())
            if item is not None:
                found.add(item)
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, found in patterns.items():
        automaton.add_word(pattern, (len(pattern), tuple(found)))
    automaton.make_automaton()
    return numbers, automaton


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code-point offsets in the original text of word ranges (end exclusive)."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text.translate(NORMAL))]
    out, at, chars = [], 0, 0
    for first, last in spans:
        offsets = []
        for byte in (places[first][0], places[last - 1][1]):
            chars += len(text[at:byte].decode("utf-8", "surrogatepass"))
            at = byte
            offsets.append(chars)
        out.append({"start": offsets[0], "end": offsets[1]})
    return out


def blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items that have words, streamed to the driver a block at a time."""
    block: list[tuple[str | None, list[bytes]]] = []
    held = 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).toLocalIterator():
        words = item_words(row["text"])
        if not words:
            continue
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row["item"], words))
        held += len(words)
    yield block


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    min_share: int = 20,
    block_words: int = 100_000,
) -> DataFrame:
    """(doc, n_words, n_hit, items, spans, contaminated), one row per document.

    ``doc`` is a struct of the columns ``keep``; ``spans`` are the hit stretches of the original text; a document is
    contaminated when at least one in ``min_share`` of its words is hit.
    """
    spark: SparkSession = docs.sparkSession
    kept = [f"c{i}" for i in range(len(keep))]
    state = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)],
        F.col(text).alias("text"),
        F.lit(None).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("words"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = state.schema
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    passes = blocks(benchmark, item_id, item_text, block_words)
    block, following = next(passes), next(passes, None)
    while True:
        shared = spark.sparkContext.broadcast({"items": block, "compiled": None})
        last = following is None
        out = schema if not last else state.drop("text").withColumn("spans", F.col("words")).schema

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last, names=out.fieldNames()) -> Iterator[pa.RecordBatch]:
            state = shared.value
            if state["compiled"] is None:  # kept for the worker's later tasks
                state["compiled"] = compile_items(state["items"], window)
            numbers, automaton = state["compiled"]
            number = numbers.get
            some = len(automaton) > 0
            for batch in slices(batches, "text"):
                texts = batch.column("text").to_pylist()
                known = batch.column("words").to_pylist(), batch.column("items").to_pylist()
                n_words, words, items, spans = [], [], [], []
                for value, old, listed in zip(texts, *known, strict=True):
                    raw = (value or "").encode("utf-8", "surrogatepass")
                    parts = raw.translate(NORMAL).split()
                    n_words.append(len(parts))
                    found = [(s["start"], s["end"]) for s in old]
                    ids = set(listed)
                    if some and parts:
                        for end, (length, of) in automaton.iter(tuple([number(w, 0) for w in parts])):
                            found.append((end - length + 1, end + 1))
                            ids.update(of)
                    found = merged(found) if found else found
                    words.append([{"start": a, "end": b} for a, b in found])
                    items.append(sorted(ids))
                    if last:
                        spans.append(char_spans(raw, found) if found else [])
                columns = {
                    "text": batch.column("text"),
                    "n_words": pa.array(n_words, pa.int64()),
                    "words": pa.array(words, pair),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "spans": pa.array(spans, pair) if last else None,
                }
                yield pa.RecordBatch.from_arrays([columns[n] if n in columns else batch.column(n) for n in names], names=names)

        state = state.mapInArrow(scan, out)
        if last:
            break
        state = materialize(state)
        block, following = following, next(passes, None)
    n_hit = F.aggregate("words", F.lit(0).cast("bigint"), lambda total, w: total + w["end"] - w["start"])
    return state.select(
        F.struct(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)]).alias("doc"), "n_words", n_hit.alias("n_hit"), "items", "spans"
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * min_share >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = find_overlaps(docs, benchmark, docs.columns, **options)
    return found.where(~F.col("contaminated")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
