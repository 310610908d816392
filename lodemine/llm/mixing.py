"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

1. Documents are counted into cells, one per combination of the dimensions (say source, language and topic), with their tokens.
2. Cell weights start at 1. Each round rakes them to the target share of every value of one dimension after the other:
   a cell's weight is multiplied by target / current share of its value. Rounds end when all shares are
   within ``tolerance`` of their targets, or after ``max_rounds``. Only cells, never documents, take part; they are stored each round.
3. A document's rate is scale * weight of its cell, so that expected shares are the raked ones. Unless a token budget is given, the
   scale is the largest at which cells with at most ``REPEATED`` of the tokens have rates above 1, so that tiny cells with large
   weights don't thin out all others. A rate above 1 means whole copies plus a chance of one more. The draw is a hash of seed, id and
   text: a rerun draws the same.

Defined results: null is a value like others. Null and blank texts have 0 tokens; a cell without any keeps weight 1 (and rate at most 1).
Values without a target share get weight 0; target values without documents are ignored, and the other shares scaled up. Equal rows
draw alike. An empty table gives an empty result. The columns of the input are carried in the struct ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.llm.common import pack, words
from lodemine.session import materialize


#: The share of tokens that may be in cells with rates above 1 where no budget is given.
REPEATED = 0.005


def topic_by_pattern(text: str, patterns: dict[str, str], otherwise: str = "prose") -> Column:
    """The first topic whose pattern the text contains."""
    out = F.lit(None).cast("string")
    for topic, pattern in reversed(patterns.items()):
        out = F.when(F.col(text).rlike(pattern), F.lit(topic)).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def key(value: Column) -> Column:
    """A value as a non-null join key."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): target shares in proportion to a power of each value's tokens; 1 keeps the mix, 0 evens it out."""
    by = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    return by.select("value", F.pow("tokens", F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], max_rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """The cells (key columns named as the targets, ``tokens``) with a ``weight``.

    A target is a frame (value, share) over the keys of its dimension; shares need not sum up to 1.
    """
    state = cells.withColumn("weight", F.lit(1.0))
    for name, target in targets.items():
        state = state.join(target.select(F.col("value").alias(name), F.col("share").alias(f"{name}_target")), name, "left")
    present = {n: F.sum(F.col(f"{n}_target") / F.col(f"{n}_cells")).alias(f"{n}_sum") for n in targets}
    for name in targets:
        full = F.count(F.when(F.col("tokens") > 0, 1)).over(Window.partitionBy(name))
        state = state.withColumn(f"{name}_cells", F.when(F.col("tokens") > 0, full))
    state = materialize(state, small=True)
    # The shares of the values that have tokens, made to sum up to 1.
    sums = state.agg(F.sum("tokens").alias("all"), *present.values()).first()
    total = float(sums["all"] or 0)
    for name in targets:
        state = state.withColumn(f"{name}_target", F.coalesce(F.col(f"{name}_target"), F.lit(0.0)) / (sums[f"{name}_sum"] or 1.0)).drop(f"{name}_cells")
    if not total:
        return state.select(*cells.columns, "weight")
    for _ in range(max_rounds):
        before = state
        worst = F.lit(0.0)
        for i, name in enumerate(targets):
            share = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(name)) / total
            factor = F.when(share > 0, F.col(f"{name}_target") / share).otherwise(1.0)
            before = before.withColumn("_factor", factor).withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight") * F.col("_factor")).otherwise(F.col("weight")))
            before = before.withColumn(f"_off{i}", F.when((F.col("tokens") > 0) & (F.col("_factor") > 0), F.abs(F.log("_factor"))).otherwise(0.0)).drop("_factor")
            worst = F.greatest(worst, f"_off{i}")
        state = materialize(before.withColumn("_off", worst), small=True)
        off = state.agg(F.max("_off")).first()[0]
        state = state.drop("_off", *[f"_off{i}" for i in range(len(targets))])
        if off is None or off < tolerance:
            break
    return state.select(*cells.columns, "weight")


def mix(
    docs: DataFrame, dimensions: dict[str, Column], powers: dict[str, float], doc_id: str = "doc_id", text: str = "text", budget: float | None = None, seed: int = 11
) -> DataFrame:
    """(doc, tokens, <dimension keys>, rate, copies): every document with its sampling rate and how often it is taken.

    ``powers`` are the tempering powers that turn the corpus' own shares into targets; ``budget`` is in tokens.
    """
    names = list(dimensions)
    counted = docs.select(pack(docs, "doc"), F.size(words(F.col(text))).cast("bigint").alias("tokens"), *[key(c).alias(n) for n, c in dimensions.items()])
    cells = materialize(counted.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), small=True)
    raked = rake(cells, {n: tempered(cells, n, powers[n]) for n in names})
    top = F.percentile("weight", 1 - REPEATED, F.col("tokens"))
    top, spent = raked.where("tokens > 0").agg(F.coalesce(top, F.lit(1.0)), F.coalesce(F.sum(F.col("tokens") * F.col("weight")), F.lit(0.0))).first()
    scale = budget / spent if budget and spent else 1.0 / (top or 1.0)
    rates = materialize(raked.select(*names, F.when(F.col("tokens") > 0, F.col("weight") * scale).otherwise(1.0).alias("rate")))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"doc.`{doc_id}`"), F.col(f"doc.`{text}`")), 11) / float(1 << 53)
    return counted.join(rates, names).withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


#: Fixed patterns of the topics of the test tables, in order.
TOPICS = {"table": r"\|", "licence": "[Ll]icen[sc]e", "record": "[0-9]"}


def mix_documents(docs: DataFrame) -> DataFrame:
    """:func:`mix` for the columns of ``documents``: large sources and languages are taken less often, topics as they come."""
    dimensions = {"source_key": F.col("source"), "lang_key": F.col("lang"), "topic_key": topic_by_pattern("text", TOPICS)}
    return mix(docs, dimensions, {"source_key": 0.8, "lang_key": 0.8, "topic_key": 1.0})
