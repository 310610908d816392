"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs inside tasks that keep one counter row per language, so only non-zero (language, bucket) cells are
shuffled. The model is a languages x buckets matrix of log probabilities: its size is fixed by ``n_buckets`` and
``max_languages``, and it is broadcast. Texts are scored in batches: n-grams of a slice of documents are hashed at
once, their matrix rows looked up and summed per document.

Defined results: a null text, or one without a letter, gets ``und`` with score 0. Among equally likely languages the
first in alphabetical order wins. Rows are scored one by one, so repeated rows give repeated results; an empty
table gives an empty result; without any labelled text every document is ``und``. Columns other than the named ones are
ignored. Letters are what Unicode calls letters; texts are lower-cased; a run of non-letters counts as one
boundary. Texts of more than a million characters are read in pieces cut at spaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import slices

PIECE = 1_000_000
UNKNOWN = "und"


def only_letters(codes: np.ndarray) -> np.ndarray:
    """The code points with everything that is no letter set to 0."""
    present = np.flatnonzero(np.bincount(codes))
    kept = np.zeros(present[-1] + 1, dtype=np.uint64)
    kept[present] = [c if chr(c).isalpha() else 0 for c in present.tolist()]
    return kept[codes]


def pieces(text: str) -> Iterator[str]:
    """The text in parts of at most PIECE characters, cut after a space where there is one."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(" ", start + 1, start + PIECE)
        cut = cut if cut > start else start + PIECE
        yield text[start:cut]
        start = cut
    yield text[start:]


def ngrams(texts: list[str | None], max_n: int, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document index, bucket) arrays of the n-grams of up to ``max_n`` characters, some documents at a time."""
    owners: list[int] = []
    parts: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        for part in pieces((text or "").lower()):
            owners.append(i)
            parts.append(part)
            held += len(part)
            if held > PIECE:
                yield from _hashed(parts, owners, max_n, n_buckets)
                owners, parts, held = [], [], 0
    if parts:
        yield from _hashed(parts, owners, max_n, n_buckets)


def _hashed(parts: list[str], owners: list[int], max_n: int, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    codes = np.frombuffer(("\0" + "\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.asarray(owners, dtype=np.int64), [len(p) + 1 for p in parts])
    owner = np.append(owner, owner[-1])
    codes = only_letters(codes)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # one boundary between words
    codes, owner = codes[keep], owner[keep]
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max_n + 1):
        size = len(codes) - n + 1
        if size <= 0:
            return
        mixed = mixed[:size] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        inside = np.ones(size, dtype=bool)
        for k in range(n) if n == 1 else range(1, n - 1):
            inside &= codes[k : k + size] != 0
        if n == 2:
            inside &= (codes[:-1] != 0) | (codes[1:] != 0)
        spread = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(n)
        spread ^= spread >> np.uint64(29)
        spread *= np.uint64(0xBF58476D1CE4E5B9)
        # An n-gram belongs to the document of its letters: of a pair with a boundary, that of the letter.
        of = np.where(codes[1:] != 0, owner[1:], owner[:-1]) if n == 2 else owner[n // 2 : n // 2 + size]
        yield of[inside], ((spread >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int64)[inside]


@dataclass
class NaiveBayes:
    """Languages in alphabetical order, their log priors, and log probabilities (languages x buckets)."""

    languages: list[str]
    priors: np.ndarray
    table: np.ndarray
    max_n: int


def score_texts(texts: list[str | None], languages: list[str], priors: np.ndarray, table: np.ndarray, max_n: int) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior probability."""
    n = len(texts)
    if not languages:
        return [UNKNOWN] * n, [0.0] * n
    sums = np.zeros((n, len(languages)))
    letters = np.zeros(n, dtype=np.int64)
    for owner, bucket in ngrams(texts, max_n, table.shape[1]):
        letters += np.bincount(owner, minlength=n)
        for k in range(len(languages)):
            sums[:, k] += np.bincount(owner, weights=table[k][bucket], minlength=n)
    sums += priors
    best = sums.argmax(axis=1)
    top = sums[np.arange(n), best]
    posterior = 1.0 / np.exp(np.minimum(sums - top[:, None], 0.0)).sum(axis=1)
    known = letters > 0
    return [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0).tolist()


def train(
    docs: DataFrame, text: str, lang: str, learn: Column | None = None, max_n: int = 3, n_buckets: int = 1 << 16, smoothing: float = 0.1, max_languages: int = 100
) -> NaiveBayes:
    """Count the n-grams of all rows with a language for which ``learn`` holds.

    The driver receives languages x buckets counts, whatever the number of documents. More than
    ``max_languages`` distinct values of ``lang`` are an error, as the matrix would have no bound.
    """
    rows = docs.where(F.col(lang).isNotNull() & (learn if learn is not None else F.lit(True))).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in slices(batches, "text"):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            names = sorted(set(langs))
            code = np.asarray([names.index(x) for x in langs], dtype=np.int64)
            for name in names:
                n_docs[name] = n_docs.get(name, 0) + langs.count(name)
                if name not in counts:
                    counts[name] = np.zeros(n_buckets, dtype=np.int64)
            for owner, bucket in ngrams(texts, max_n, n_buckets):
                of = code[owner]
                for k, name in enumerate(names):
                    counts[name] += np.bincount(bucket[of == k], minlength=n_buckets)
        for name, row in counts.items():
            found = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [name] * (len(found) + 1), "bucket": [-1, *found.tolist()], "n": [n_docs[name], *row[found].tolist()]})

    cells = rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # Only the cells of as many languages as the matrix may hold, and one more to notice the excess, can reach the driver.
    found = cells.limit((max_languages + 1) * (n_buckets + 1)).toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    table = np.full((len(languages), n_buckets), smoothing)
    priors = np.zeros(len(languages))
    row = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64)
    cell = bucket >= 0
    table[row[cell], bucket[cell]] += n[cell]
    priors[row[~cell]] = n[~cell]
    return NaiveBayes(languages, np.log(priors / max(priors.sum(), 1.0)), np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32), max_n)


def predict(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, model: NaiveBayes, keep: list[Column] | None = None) -> DataFrame:
    """(doc_id, kept columns, lang_pred, score) for every row of ``docs``."""
    shared = spark.sparkContext.broadcast((model.languages, model.priors, model.table, model.max_n))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *(keep or []), F.col(text).alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            languages, scores = score_texts(batch.column("text").to_pylist(), *shared.value)
            kept = [batch.column(c) for c in schema.fieldNames()[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=schema.fieldNames())

    return rows.mapInArrow(score, schema)
