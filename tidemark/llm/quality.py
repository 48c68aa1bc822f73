"""Quality scores by a sparse rule ensemble over text statistics.

Small trees are grown on bootstrap samples of labelled statistics; every path of a tree is a
conjunctive rule. A logistic regression with an L1 penalty weighs the rules, most of them to zero,
and the rest becomes one Spark column expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import grow, paths

#: Names of the statistics, in the order of ``statistics``.
STATISTICS = ("chars", "words", "mean_word", "distinct", "repeats", "symbols", "digits", "upper",
              "pipes", "marks", "letters", "lines")


def repeated(text: Column, words: Column) -> Column:
    """Code points of words that equal the one before them, with the white space between.

    Neighbours are compared one by one: a regex with a backreference would recurse once for every
    repeat, and a few thousand would overflow a task's stack.
    """
    # The white space before each word; the array has one more at the end of the text.
    both = F.struct(words.alias("words"), F.split(text, r"\S+").alias("gaps"))
    return F.get(F.transform(F.array(both), lambda b: F.aggregate(
        F.transform(b["words"], lambda w, i: F.when(
            w == F.get(b["words"], i - 1), F.length(w) + F.length(F.get(b["gaps"], i)))
            .otherwise(0)),
        F.lit(0), lambda s, x: s + x)), F.lit(0))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; every one is defined for empty and null texts."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)

    def share(pattern):
        return (chars - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(
            chars, F.lit(1))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    return {
        "chars": F.log1p(chars.cast("double")), "words": F.log1p(n.cast("double")),
        "mean_word": chars / F.greatest(n, F.lit(1)),
        "distinct": F.size(F.array_distinct(words)) / F.sqrt(F.greatest(n, F.lit(1))),
        "repeats": repeated(text, words) / F.greatest(chars, F.lit(1)),
        "symbols": share(r"[#*$%&@^~_<>{}\[\]\\=+]+"), "digits": share("[0-9]+"),
        "upper": share(r"\p{Lu}+"), "pipes": share(r"\|+"), "marks": share("[!?]+"),
        "letters": share(r"\p{L}+"),
        "lines": F.size(F.split(text, "\n")) / F.greatest(n, F.lit(1)),
    }


def rules_of(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3,
             seed: int = 7) -> list[tuple]:
    """Distinct conjunctions (feature, threshold, above) from trees on bootstrap samples."""
    rng = np.random.default_rng(seed)
    positive, negative = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(positive) or not len(negative):
        return []
    found: dict[tuple, None] = {}
    for _ in range(trees):
        # Half of each label, so a rare one shapes the trees as well.
        n = max(1, min(len(y) // 2, 1500))
        at = np.r_[rng.choice(positive, n // 2 + 1), rng.choice(negative, n // 2 + 1)]
        some = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False))
        for path in paths(grow(x[at], y[at], depth, 5, some)):
            bounds: dict[tuple, float] = {}
            for f, t, above in path:
                t = float(f"{t:.4g}")
                key = (f, above)
                bounds[key] = t if key not in bounds else (max if above else min)(bounds[key], t)
            found[tuple(sorted((f, t, above) for (f, above), t in bounds.items()))] = None
    return list(found)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t)
                                  for f, t, above in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = 0.004,
          rounds: int = 600) -> tuple[float, np.ndarray]:
    """(intercept, weights) of an L1-penalised logistic regression, by accelerated gradients."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    step = 4.0 / (1 + (np.linalg.norm(z, 2) ** 2 / n if m else 0))
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        new = v - step * (z.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * error.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (before - 1) / t * (new - w), new_b + (before - 1) / t * (new_b - b)
        w, b = new, new_b
    return b, w


class RuleEnsemble:
    """Weighted conjunctions over STATISTICS."""

    def __init__(self, intercept: float, weighted: list[tuple[float, tuple]]):
        self.intercept, self.weighted = intercept, weighted

    def score(self, stats: dict[str, Column]) -> Column:
        """The ensemble as one column expression."""
        def one(weight, rule):
            tests = [stats[STATISTICS[f]] > t if above else stats[STATISTICS[f]] <= t
                     for f, t, above in rule]
            return F.when(reduce(lambda a, b: a & b, tests), weight).otherwise(0.0)

        total = reduce(lambda a, b: a + b, (one(w, r) for w, r in self.weighted),
                       F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> RuleEnsemble:
    """Fit on about ``sample`` labelled documents, chosen by a hash of doc_id; twice that at most.

    ``labels`` has doc_id and quality (0 or 1); rows with a null in either teach nothing, repeated
    rows and repeated documents of one id count once. With one label only the ensemble has no rules.
    """
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    sizes = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    total = sum(sizes.values())
    if not total:
        return RuleEnsemble(0.0, [])
    share = F.lit(0.0)
    for label, n in sizes.items():  # as many of either label, as far as there are
        share = F.when(F.col("quality") == label, min(1.0, sample / len(sizes) / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    # The draw leaves about ``sample`` rows; the limit makes the bound of the broadcast certain.
    chosen = (usable.filter(draw < share * (1 << 30)).select("doc_id", "quality").distinct()
              .orderBy(draw, "doc_id", "quality").limit(2 * sample))
    stats = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "quality",
        F.struct(*(c.alias(k) for k, c in statistics(F.col("text")).items())).alias("s"))
    rows = (stats.groupBy("doc_id", "quality").agg(F.min("s").alias("s"))
            .select("doc_id", "quality", "s.*").toPandas()  # at most 2 * sample rows
            .sort_values(["doc_id", "quality"]))
    if rows.empty:
        return RuleEnsemble(0.0, [])
    x, y = rows[list(STATISTICS)].to_numpy(float), rows["quality"].to_numpy(float)
    found = rules_of(x, y)
    if not found:
        return RuleEnsemble(6.0 if y.mean() > 0.5 else -6.0, [])
    z = np.column_stack([holds(r, x) for r in found]).astype(float)
    b, w = lasso(z, y)
    return RuleEnsemble(round(float(b), 6), [(round(float(v), 6), r) for v, r in zip(w, found)
                                             if abs(v) > 1e-4])


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """doc_id and score (0 to 1, higher: better quality) of every whole text.

    One row per input row, repeated ones and null ids included; a null text counts as empty.
    """
    stats = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(
        c.alias(k) for k, c in statistics(F.col("text").cast("string")).items()))
    return stats.select("doc_id", model.score({k: F.col(k) for k in STATISTICS}).alias("score"))
