"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Each rule rejects texts whose statistic exceeds a cutoff. Cutoffs are chosen per stratum (a language, say) from a fixed grid, so
that among good documents of the stratum at most a share ``risk`` is rejected by the rule, with confidence: on
labelled good documents a cutoff that rejects k of n is admitted only if the exact (Clopper-Pearson) upper bound of its rejection rate is at
most ``risk``, that is if P(Binomial(n, risk) <= k) is at most the test's level. The total error level is divided by the number of rules and
strata (Bonferroni); within a rule and stratum the cutoffs are tested from the most lenient on and testing stops at the
first failure (fixed sequence), which needs no further division as rejections only grow. With probability 1 - ``level`` every chosen
cutoff keeps its promise. Strata whose labels alone can't show that even a cutoff without rejections is safe are pooled: their labels
are tested together, as one stratum, and the promise then holds for the pooled strata as a whole. As a guard for each of them, its cutoff
stops in the pool's sequence where more than ``risk`` of its own labels would be rejected. Which strata are pooled depends on numbers of labels only.
A stratum without any labelled good document, and a pool with too few, get no cutoff, and the rules reject nothing there.

Defined results: null, empty and blank texts have no words (all counts 0) and fail the base rules. A null stratum is a stratum like
others. Rows with a null label, or without one, are no evidence; each of several labels of a document is a trial. Rows are judged one by one. Empty tables
give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemine.llm.common import BLANKS, words
from lodemine.session import materialize

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The kept columns, COUNTS and n_lines (lines with a word) of each text.

    Repeated three-word windows are found by sorting the windows' 64-bit hashes with their positions.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    step = docs.select(*keep, value.alias("_text"), words(value).alias("_words"), lines.alias("_lines"))
    kept = [c for c in step.columns if not c.startswith("_")]
    n = F.size("_words")
    window = F.transform("_words", lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))
    step = step.select(
        *kept,
        n.cast("bigint").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.sort_array(F.slice(window, F.lit(1), F.greatest(n - 2, F.lit(0)))).alias("_windows"),
    )

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(x["h"] == F.get("_windows", other)["h"], F.lit(False))

    twice = F.filter("_windows", lambda x, j: same(x, j - 1) | same(x, j + 1))
    step = step.select(*[c for c in step.columns if c != "_windows"], F.transform(twice, lambda x: x["i"]).alias("_starts"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2)))))
    return step.select(*[c for c in step.columns if c != "_starts"], covered.cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def default_rules() -> dict[str, tuple[Column, list[float]]]:
    """By name, a statistic and its cutoffs from lenient to strict."""
    shares = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]
    return {
        "symbols": (share("n_symbols", "word_chars"), shares),
        "same_lines": (share("n_dup_lines", "n_lines"), shares),
        "repeats": (share("n_repeat_words", "n_words"), [s for s in shares if s < 0.5]),
        "long_words": (share("word_chars", "n_words"), [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0]),
    }


def most_rejections(n: Column, risk: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= level, or -1; summed in logarithms, term by term, up to n * risk."""
    odds = math.log(risk / (1 - risk))
    start = F.struct((n * math.log(1 - risk)).alias("term"), F.lit(-1e300).alias("sum"), F.lit(-1).cast("bigint").alias("most"))

    def add(state: Column, k: Column) -> Column:
        high, low = F.greatest(state["sum"], state["term"]), F.least(state["sum"], state["term"])
        total = high + F.log1p(F.exp(low - high))
        return F.struct(
            (state["term"] + F.log((n - k) / (k + 1.0)) + odds).alias("term"),
            total.alias("sum"),
            F.when(total <= F.log(level), k).otherwise(state["most"]).alias("most"),
        )

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(F.ceil(n * risk), n - 1)), start, add, lambda state: state["most"])


def cutoffs(good: DataFrame, stratum: str, rules: dict[str, tuple[Column, list[float]]], risk: float, level: float) -> DataFrame:
    """(stratum, n_good, one cutoff or null per rule) from the statistics of labelled good documents."""
    rejected = [F.count(F.when(value > cut, 1)).alias(f"{rule}_{i}") for rule, (value, grid) in rules.items() for i, cut in enumerate(grid)]
    counted = materialize(good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *rejected), small=True)
    n_strata = counted.count()
    alone = most_rejections(F.col("n_good"), risk, F.lit(level / max(1, n_strata * len(rules)))) >= 0
    counted = materialize(counted.withColumn("_alone", alone), small=True)
    n_alone = counted.where("_alone").count()
    tests = max(1, (n_alone + (n_alone < n_strata)) * len(rules))
    tested = Window.partitionBy("_alone", F.when(F.col("_alone"), F.col(stratum)))
    names = ["n_good", *[f"{rule}_{i}" for rule, (_, grid) in rules.items() for i in range(len(grid))]]
    allowed = counted.select("*", *[F.sum(n).over(tested).alias(f"_all_{n}") for n in names])
    allowed = allowed.withColumn("_most", most_rejections(F.col("_all_n_good"), risk, F.lit(level / tests)))
    chosen = []
    for rule, (_, grid) in rules.items():
        strict = F.lit(None).cast("double")
        for i, cut in enumerate(grid):  # rejections grow with i, so the last that passes ends the sequence
            own = F.col("_alone") | (F.col(f"{rule}_{i}") <= risk * F.col("n_good"))
            strict = F.when((F.col(f"_all_{rule}_{i}") <= F.col("_most")) & own, F.lit(cut)).otherwise(strict)
        chosen.append(strict.alias(f"{rule}_cutoff"))
    return allowed.select(stratum, "n_good", *chosen)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    rules: dict[str, tuple[Column, list[float]]] | None = None,
    risk: float = 0.005,
    level: float = 0.05,
) -> DataFrame:
    """(doc_id, stratum, COUNTS, n_lines, base_failed, <rule>_cutoff ..., kept) for every document.

    ``risk`` holds for each rule, so all rules together reject at most len(rules) * risk of the good documents of a stratum,
    or of the pooled small strata together.
    """
    rules = rules or default_rules()
    key = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    counted = materialize(statistics(docs, text, [F.col(doc_id).alias("doc_id"), key.alias("stratum")]))
    good = counted.join(labels.where(F.col(label) == 1).select(F.col("doc_id").alias("doc_id")), "doc_id")
    chosen = materialize(cutoffs(good, "stratum", rules, risk, level))
    passes = F.lit(True)
    for rule, (value, _) in rules.items():
        passes = passes & F.coalesce(value <= F.col(f"{rule}_cutoff"), F.lit(True))
    joined = counted.join(chosen.drop("n_good"), "stratum", "left").withColumn("base_failed", base_failed())
    return joined.withColumn("kept", ~F.col("base_failed") & passes)
