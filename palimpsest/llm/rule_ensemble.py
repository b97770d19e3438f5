"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics of a text are Spark columns. On a bounded labelled sample, boosted shallow trees
propose rules (the path to each node is a conjunction of thresholds), an L1-penalised
logistic regression weighs them and drops most, and the remaining rules are compiled to one
Spark expression, so scoring all documents runs in the JVM in a single pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HELD_OUT, fold

#: Labelled rows the model is fitted on at most: those of the least hashes of their ids.
SAMPLE = 20_000
TREES, DEPTH, BINS, PENALTY = 40, 3, 32, 0.002
THRESHOLD = 0.7

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLASSES = {"upper": _UPPER, "digit": "0123456789", "stop": ".,;:?", "shout": "!", "bar": "|", "mark": "*$%&#", "bracket": "<>{}[]()=_\"/\\", "space": " \t\r\n"}


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text (null: empty); never null."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    some = F.greatest(size, F.lit(1)).cast("double")
    share = {k: (size - F.length(F.translate(text, v, ""))) / some for k, v in _CLASSES.items()}
    words, lines = F.split(text, " "), F.split(text, "\n")
    return {
        "log_size": F.log1p(size.cast("double")),
        **share,
        "word_size": size / F.size(words).cast("double"),
        "new_words": F.size(F.array_distinct(words)) / F.size(words).cast("double"),
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_size": F.log1p(size / F.size(lines).cast("double")),
    }


NAMES = ["log_size", *_CLASSES, "word_size", "new_words", "new_lines", "line_size"]


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "__") -> DataFrame:
    """``docs`` and its statistics, computed once however often later columns use them."""
    made = statistics(F.col(text))
    return docs.select("*", F.inline(F.array(F.struct(*(made[n].alias(prefix + n) for n in NAMES)))))


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, above, threshold) each, ``above`` meaning greater than."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, at in self.terms:
            out &= (x[:, f] > at) == above
        return out

    def column(self, prefix: str = "__") -> Column:
        out = F.lit(True)
        for f, above, at in self.terms:
            c = F.col(prefix + NAMES[f])
            out = out & ((c > at) if above else (c <= at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{NAMES[f]} {'>' if above else '<='} {at:.6g}" for f, above, at in self.terms)


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str = "__") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[Rule]:
    """The distinct paths in TREES trees, each fitted to the residuals so far of half the rows."""
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # x > cuts[b] if bin > b
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve, rows = y - p, p * (1 - p) + 1e-6, np.flatnonzero(draw.random(len(y)) < 0.5)
        todo, step = [((), rows, np.arange(len(y)))], np.zeros(len(y))
        while todo:
            terms, own, all_ = todo.pop()
            best = None
            if len(terms) < DEPTH and len(own) >= 20:
                total_s, total_c = slope[own].sum(), curve[own].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    s = np.cumsum(np.bincount(binned[own, f], slope[own], BINS + 1))[: len(c)]
                    w = np.cumsum(np.bincount(binned[own, f], curve[own], BINS + 1))[: len(c)]
                    n = np.cumsum(np.bincount(binned[own, f], minlength=BINS + 1))[: len(c)]
                    gain = s**2 / (w + 1) + (total_s - s) ** 2 / (total_c - w + 1) - total_s**2 / (total_c + 1)
                    gain[(n < 5) | (len(own) - n < 5)] = 0
                    k = int(gain.argmax())
                    if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k)
            if best is None:
                step[all_] = slope[own].sum() / (curve[own].sum() + 1) if len(own) else 0
                continue
            _, f, k = best
            for above in (False, True):
                path = (*terms, (f, above, float(cuts[f][k])))
                rules[Rule(path)] = None
                todo.append((path, own[(binned[own, f] > k) == above], all_[(binned[all_, f] > k) == above]))
        margin += 0.3 * step
    return list(rules)


def lasso(holds: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Intercept (not penalised) and weights of an L1-penalised logistic regression, by FISTA."""
    a = np.concatenate([np.ones((len(y), 1)), holds], axis=1)
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / len(y) + 1e-9)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        step = z - rate * (a.T @ (1 / (1 + np.exp(-a @ z)) - y)) / len(y)
        new = np.concatenate([step[:1], np.sign(step[1:]) * np.maximum(np.abs(step[1:]) - rate * penalty, 0)])
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / further * (new - w), new, further
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The ensemble; without rows it scores 0.5, with one class nearly that class."""
    if not len(y):
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0, ())
    rules = tree_rules(x, y)
    intercept, weights = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0)), y)
    return Model(intercept, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that are not held out, at most ``sample``.

    Of the labels, ``sample`` are taken by the hash of their ids, and of the rows that these
    give, which are more only where ids repeat, again ``sample`` by the hash of id and text.
    Null labels, ids and duplicates are no obstacle.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold() != HELD_OUT)
    known = known.select("doc_id", F.col(label).cast("double").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = with_statistics(rows).select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "__y", *(f"__{n}" for n in NAMES))
    found = rows.orderBy("h", "doc_id", "__y").limit(sample).toPandas().sort_values(["doc_id", "__y", "h"])
    return fit(found[[f"__{n}" for n in NAMES]].to_numpy(float), found["__y"].to_numpy(float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on, else 0).

    Null texts score as empty ones. Columns of ``docs`` with the names of results are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in names):
        prefix += "_"
    out = with_statistics(docs.select(names), prefix=prefix).select(*names, model.score(prefix).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
