"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. Statistics of each text are column expressions.
2. A small random forest is fitted to the labelled rows. Every path from a root to a node is a rule, the conjunction of
   its comparisons; paths with equal bounds are one rule.
3. A logistic regression with a lasso penalty weighs the rules; those with weight 0 are dropped.
4. What remains is compiled into one column expression, the score. Scoring therefore needs no model at run time.

Defined results: null, empty and blank texts have all statistics 0 and get the score of that point. Rows are scored one by one.
Rows without a label, or with a label other than 0 and 1, teach nothing; each of several labels of a document is an example. If the
labelled rows are none, or all alike, the score is the share of label 1 (0.5 without any).
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemine.llm.common import pack, words
from lodemine.session import materialize

SYMBOLS = "#*$%&|<>"
STATISTICS = [
    "n_words", "word_length", "symbol_share", "bar_share", "bang_share", "capital_share", "repeat_share", "distinct_share",
    "same_line_share", "line_words", "stop_share", "digit_share",
]


def statistics(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The kept columns and the STATISTICS of each text; shares are per word, line or character."""
    value = F.coalesce(F.col(text), F.lit(""))

    def count(characters: str) -> Column:
        return F.length("_text") - F.length(F.translate("_text", characters, ""))

    # Two steps, so that the split words are computed once.
    parts = docs.select(*keep, value.alias("_text"), words(value).alias("_words"), F.filter(F.split(value, "\n"), lambda line: F.btrim(line) != "").alias("_lines"))
    n, lines, chars = F.size("_words"), F.size("_lines"), F.length("_text")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    capital = F.size(F.filter("_words", lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    repeat = F.size(F.filter("_words", lambda w, i: (i > 0) & (w == F.get("_words", i - 1))))
    kept = [c for c in parts.columns if c not in ("_text", "_words", "_lines")]
    values = F.struct(
        n.cast("double").alias("n_words"),
        share(chars, n).alias("word_length"),
        share(count(SYMBOLS), chars).alias("symbol_share"),
        share(count("|"), n).alias("bar_share"),
        share(count("!"), n).alias("bang_share"),
        share(capital, n).alias("capital_share"),
        share(repeat, n).alias("repeat_share"),
        share(F.size(F.array_distinct("_words")), n).alias("distinct_share"),
        share(lines - F.size(F.array_distinct("_lines")), lines).alias("same_line_share"),
        share(n, lines).alias("line_words"),
        share(count("."), n).alias("stop_share"),
        share(count("0123456789"), chars).alias("digit_share"),
    )
    # Made in one step of their own: a filter on a score of many rules would else be pushed below, with every statistic
    # written out in every rule, which the optimizer takes minutes over.
    return parts.select(*kept, F.explode(F.array(values)).alias("_values")).select(*kept, "_values.*")


Rule = tuple[tuple[int, float, float], ...]  # (statistic, above, up to) bounds, by statistic


def tree_rules(description: str) -> list[Rule]:
    """The paths from the root to every other node, read from Spark's description of a tree."""
    rules: list[Rule] = []
    path: list[tuple[int, int, str, float]] = []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, int(found[2]), found[3], float(found[4])))
        bounds: dict[int, tuple[float, float]] = {}
        for _, feature, sign, value in path:
            low, high = bounds.get(feature, (-math.inf, math.inf))
            bounds[feature] = (max(low, value), high) if sign == ">" else (low, min(high, value))
        rules.append(tuple(sorted((f, low, high) for f, (low, high) in bounds.items())))
    return rules


def rule_column(rule: Rule, names: list[str]) -> Column:
    out = F.lit(True)
    for feature, low, high in rule:
        if low > -math.inf:
            out = out & (F.col(names[feature]) > low)
        if high < math.inf:
            out = out & (F.col(names[feature]) <= high)
    return out


@dataclass
class RuleEnsemble:
    """Weighted rules and the intercept; ``score`` is their column expression over the statistics."""

    names: list[str]
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule, self.names), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(labelled: DataFrame, label: str, names: list[str] = STATISTICS, trees: int = 20, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """Fit to the rows of ``labelled``, which holds the statistics ``names`` and a 0/1 ``label``."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("label"), *names)
    rows = materialize(rows)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleEnsemble(names, [], 0.0 if not n else 30.0 if ones else -30.0)
    points = rows.select("label", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed).fit(points)
    rules = sorted({rule for tree in forest.trees for rule in tree_rules(tree.toDebugString)})
    if not rules:
        share = ones / n
        return RuleEnsemble(names, [], math.log(share / (1 - share)))
    held = rows.select("label", array_to_vector(F.array(*[rule_column(r, names).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-5).fit(held)
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(names, [(r, w) for r, w in zip(rules, weights, strict=True) if w], float(lasso.intercept))


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[RuleEnsemble, DataFrame]:
    """The ensemble learnt from labelled rows for which ``learn`` holds, and the stored statistics of all rows."""
    table = materialize(statistics(docs, text, [F.col(doc_id).alias("doc_id"), learn.alias("_learn")]))
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("_label"))
    return fit(table.where("_learn").join(known, "doc_id"), "_label"), table


def keep_good(
    docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", most_labelled: int = 50_000
) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``.

    The fit takes the rows of at most ``most_labelled`` labelled ids, those of the least hash, which are few enough to be sent around: no
    text moves, and statistics are computed for these rows only. Then all rows are scored in one pass.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label")).where("_label IN (0, 1)")
    ids = materialize(known.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(most_labelled))
    teaching = docs.where(learn).select(F.col(doc_id).alias("_id"), F.col(text).alias("_of")).join(F.broadcast(ids), "_id", "left_semi")
    told = known.join(F.broadcast(ids), "_id", "left_semi")
    model = fit(statistics(teaching, "_of", [F.col("_id")]).join(told, "_id"), "_label")
    return statistics(docs, text, [pack(docs)]).where(model.score() >= threshold).select("row.*")
