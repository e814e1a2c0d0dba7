"""Quality classifier: a sparse ensemble of tree-path rules, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, held_out, let, symbol_count, whole, words

#: Labelled documents the ensemble is fitted on at most (those with the smallest id hashes).
MAX_LABELLED = 20_000
#: Boosted trees and their depth; every path is a rule.
TREES, DEPTH, BINS = 24, 3, 32
#: Weight of the lasso on standardised rules.
LASSO = 2e-3
THRESHOLD = 0.3


def statistics(text: str = "text") -> Column:
    """Struct of text statistics, all defined (0 where nothing can be counted) for empty and null texts."""
    t = whole(text)
    chars = F.greatest(F.length(F.translate(t, SPACE, "")), F.lit(1)).cast("double")
    ascii_text = lambda kept: (F.length(t) - F.length(F.translate(t, kept, ""))).cast("double")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def of_words(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        return F.struct(
            F.log1p(F.size(w).cast("double")).alias("log_words"), (F.size(F.array_distinct(w)) / n).alias("distinct_words"), (chars / n).alias("word_length"),
            (symbol_count(text) / n).alias("symbols"), (ascii_text("!?") / n).alias("shouts"), (ascii_text("|") / n).alias("bars"),
            (ascii_text(upper) / chars).alias("upper"), (ascii_text("0123456789") / chars).alias("digits"), (ascii_text(".,;:") / n).alias("stops"),
            (ascii_text("\n") / n).alias("line_ends"),
        )

    return let(words(text), of_words)


FEATURES = ("log_words", "distinct_words", "word_length", "symbols", "shouts", "bars", "upper", "digits", "stops", "line_ends")


# ------------------------------------------------------------------ fitting

@dataclass
class Rule:
    """Conjunction of ``(feature, above, cut)`` conditions with its weight."""

    conditions: tuple
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, above, cut in self.conditions:
            ok &= (x[:, f] > cut) == above
        return ok


@dataclass
class Ensemble:
    """Intercept and the rules that the lasso kept."""

    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule in self.rules:
            z += rule.weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """Probability as an expression over a struct column of statistics."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            holds = F.lit(True)
            for f, above, cut in rule.conditions:
                value = stats[FEATURES[f]]
                holds = holds & ((value > float(cut)) if above else (value <= float(cut)))
            total = total + F.when(holds, F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _tree_paths(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int):
    """Grow one tree on gradients; its paths (all nodes but the root) and its leaf values per row."""
    paths, value = [], np.zeros(len(x))

    def grow(rows: np.ndarray, conditions: tuple) -> None:
        if conditions:
            paths.append(conditions)
        best = (1e-9, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if len(conditions) < depth and len(rows) >= 10:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                code = np.searchsorted(c, x[rows, f])
                sum_g, sum_h = np.cumsum(np.bincount(code, g[rows], len(c) + 1))[:-1], np.cumsum(np.bincount(code, h[rows], len(c) + 1))[:-1]
                right = total_h - sum_h
                gain = sum_g**2 / (sum_h + 1) + (total_g - sum_g) ** 2 / (right + 1) - total_g**2 / (total_h + 1)
                gain[(sum_h < 0.5) | (right < 0.5)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, c[k]))
        if best[1] is None:
            value[rows] = -total_g / (total_h + 1)
            return
        f, at = best[1]
        above = x[rows, f] > at
        grow(rows[~above], (*conditions, (f, False, float(at))))
        grow(rows[above], (*conditions, (f, True, float(at))))

    grow(np.arange(len(x)), ())
    return paths, value


def _simplified(conditions: tuple) -> tuple:
    """Tightest cut per feature and side, in a fixed order, so that equal rules are equal tuples."""
    tight: dict = {}
    for f, above, cut in conditions:
        old = tight.get((f, above))
        tight[f, above] = cut if old is None else (max(old, cut) if above else min(old, cut))
    return tuple((f, above, cut) for (f, above), cut in sorted(tight.items()))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, steps: int = 400) -> Ensemble:
    """Rule ensemble on labelled statistics: boosted trees give the rules, proximal gradient steps their weights.

    Without a label the probability is 1/2, with labels of one kind a smoothed constant.
    """
    n, positive = len(y), float(y.sum())
    base = np.log((positive + 0.5) / (n - positive + 0.5))
    if n == 0 or positive in (0.0, float(n)):
        return Ensemble(float(base) if n else 0.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    margin, found = np.full(n, base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, value = _tree_paths(x, cuts, p - y, p * (1 - p) + 1e-6, depth)
        margin += 0.3 * value
        found.update(dict.fromkeys(_simplified(c) for c in paths))
    rules = [Rule(c) for c in found]
    held = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    keep = (held.mean(0) > 0) & (held.mean(0) < 1)
    rules, held = [r for r, k in zip(rules, keep) if k], held[:, keep]
    mean, spread = held.mean(0), held.std(0)
    z = (held - mean) / spread
    # Accelerated proximal gradient; the step is the inverse of the largest curvature.
    step = 1 / (0.25 * np.linalg.norm(z, 2) ** 2 / n)
    w, b, look, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ look + b))) - y
        b -= 4 * r.mean()
        new = look - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, w = new + (before - 1) / t * (new - w), new
    for rule, weight in zip(rules, w / spread):
        rule.weight = float(weight)
    intercept = b - float((w / spread * mean).sum())
    return Ensemble(float(intercept), [r for r in rules if r.weight != 0.0])


# ------------------------------------------------------------------ Spark

def labelled_sample(labels: DataFrame, label: str, doc_id: str = "doc_id", most: int = MAX_LABELLED, remainder: int = 0) -> DataFrame:
    """``doc_id, label`` of at most ``most`` training rows, those with the smallest id hashes.

    Rows without an id or label and held-out ids are left out; of several labels of an id the largest counts.
    """
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id, remainder))
    single = rows.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> Ensemble:
    """Fit the ensemble on the bounded sample; the driver sees its statistics, never a text."""
    sample = labelled_sample(labels, label, most=most)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The sample has at most ``most`` rows of two numbers.
    rows = own.join(F.broadcast(sample), "doc_id").select("doc_id", "label", statistics("text").alias("s")).select("doc_id", "label", *[f"s.{f}" for f in FEATURES])
    data = rows.orderBy("doc_id", *FEATURES).limit(2 * most).toPandas()
    return fit(data[list(FEATURES)].to_numpy(np.float64), data["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, ensemble: Ensemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (probability of quality 1) and ``predicted``.

    Null and empty texts have defined statistics and a score.  The names of the added
    columns and ``_stats`` are reserved; others pass through.  Empty tables give empty results.
    """
    return (
        docs.withColumn("_stats", F.explode(F.array(statistics(text)))).withColumn("score", ensemble.column(F.col("_stats"))).drop("_stats")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
