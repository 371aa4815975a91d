"""Predictive models on small per-set tables: closed-form ridge, coordinate-descent lasso, tree ensembles; leave-one-out folds.

Rows are forget sets or sampled texts (hundreds to thousands, ``MAX_ROWS`` at most); folds are dealt over tasks, so they run in
parallel, and each holds the one small table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Rows of a table that a model is fitted on.
MAX_ROWS = 100_000

Fit = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray], np.ndarray]]


def ridge(alpha: float = 1.0) -> Fit:
    """Least squares with an unpenalised intercept."""

    def fit(x, y):
        mx, my = x.mean(0), y.mean()
        w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
        return lambda z: (z - mx) @ w + my

    return fit


def lasso(alpha: float = 0.01, steps: int = 20_000, tol: float = 1e-8) -> Fit:
    """Minimises squared error / 2n + alpha * |w| by coordinate descent."""

    def fit(x, y):
        mx, my = x.mean(0), y.mean()
        a, r, n = x - mx, y - my, len(y)
        w, size = np.zeros(a.shape[1]), (a * a).sum(0) / n
        for _ in range(steps):
            moved = 0.0
            for j in np.flatnonzero(size > 0):
                rho = a[:, j] @ r / n + size[j] * w[j]
                new = np.sign(rho) * max(abs(rho) - alpha, 0) / size[j]
                if new != w[j]:
                    r -= a[:, j] * (new - w[j])
                    moved = max(moved, abs(new - w[j]))
                    w[j] = new
            if moved < tol:
                break
        return lambda z: (z - mx) @ w + my

    return fit


class Tree:
    """Regression tree by variance reduction, stored as arrays."""

    def __init__(self, x, y, leaf: int, depth: int, features: int, rng) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self.gain = np.zeros(x.shape[1])
        self._grow(x, y, leaf, depth, features, rng)

    def _grow(self, x, y, leaf, depth, features, rng) -> int:
        me = len(self.value)
        for store, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, float(y.mean()))):
            store.append(v)
        best = (1e-12, -1, 0.0)
        n = len(y)
        if depth and n >= 2 * leaf:
            base = y.sum() ** 2 / n
            for f in rng.permutation(x.shape[1])[:features]:
                order = np.argsort(x[:, f], kind="stable")
                v, c = x[order, f], np.cumsum(y[order])
                k = np.arange(1, n)
                score = c[:-1] ** 2 / k + (c[-1] - c[:-1]) ** 2 / (n - k) - base
                score[(v[1:] <= v[:-1]) | (k < leaf) | (n - k < leaf)] = -1
                i = int(score.argmax()) if n > 1 else 0
                if score[i] > best[0]:
                    best = (score[i], int(f), (v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            self.gain[best[1]] += best[0]
            go = x[:, best[1]] <= best[2]
            self.feature[me], self.cut[me] = best[1], best[2]
            self.left[me] = self._grow(x[go], y[go], leaf, depth - 1, features, rng)
            self.right[me] = self._grow(x[~go], y[~go], leaf, depth - 1, features, rng)
        return me

    def predict(self, x) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            f = feature[at[i]]
            at[i] = np.where(x[i, f] <= cut[at[i]], left[at[i]], right[at[i]])
        return np.array(self.value)[at]


def forest(trees: int = 200, leaf: int = 2, max_features: float = 1.0, seed: int = 0) -> Fit:
    def fit(x, y):
        rng = np.random.default_rng(seed)
        k = max(1, int(max_features * x.shape[1]))
        made = []
        for _ in range(trees):
            i = rng.integers(0, len(y), len(y))
            made.append(Tree(x[i], y[i], leaf, -1, k, rng))
        gain = sum(t.gain for t in made)
        out = lambda z: np.mean([t.predict(z) for t in made], 0)
        out.importance = gain / gain.sum() if gain.sum() else gain
        return out

    return fit


def boosting(trees: int = 200, depth: int = 3, rate: float = 0.05, seed: int = 0) -> Fit:
    def fit(x, y):
        rng, base = np.random.default_rng(seed), y.mean()
        f, made = np.full(len(y), base), []
        for _ in range(trees):
            t = Tree(x, y - f, 1, depth, x.shape[1], rng)
            f = f + rate * t.predict(x)
            made.append(t)
        return lambda z: base + rate * sum(t.predict(z) for t in made)

    return fit


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """The numeric columns in order, but for ids and labels."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def zscore(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Columns minus mean over (population deviation + 1e-12), of ``df`` itself or of a training table's ``zstats``."""
    s = zstats(df, cols) if stats is None else stats
    j = df.crossJoin(F.broadcast(s))
    return j.select(*(c for c in df.columns if c not in cols), *(((F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-12)).alias(c) for c in cols))


def zstats(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*(f(c).alias(f"{c}_{k}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))))


def small(df: DataFrame) -> pd.DataFrame:
    """A table of at most MAX_ROWS rows on the driver; a larger one fails."""
    data = df.limit(MAX_ROWS + 1).toPandas()
    if len(data) > MAX_ROWS:
        raise ValueError(f"models are fitted on tables of at most {MAX_ROWS} rows, one by forget set or sampled text")
    return data


def leave_out(df: DataFrame, key: str, features: list[str], target: str, fit: Fit, group: str | None = None) -> DataFrame:
    """(key, y, p): each row (or each group's rows) predicted by a model of all others.

    The table is small (``MAX_ROWS``) and travels with the function; folds are the parallel unit, dealt over tasks without a shuffle.
    """
    by = group or key
    data = small(df.select(key, *([group] if group and group != key else []), *features, target)).sort_values(key, kind="stable")
    x, y, g, k = data[features].to_numpy(np.float64), data[target].to_numpy(np.float64), data[by].to_numpy(), data[key].to_numpy()
    spark = df.sparkSession
    names, place = np.unique(g, return_inverse=True)
    shared = spark.sparkContext.broadcast((x, y, place, k))

    def run(batches):
        x, y, place, k = shared.value
        for pdf in batches:
            for f in pdf["id"]:
                out = place == f
                yield pd.DataFrame({"key": k[out], "y": y[out], "p": fit(x[~out], y[~out])(x[out])})

    kind = df.schema[key].dataType.simpleString()
    return spark.range(0, len(names), numPartitions=max(1, len(names))).mapInPandas(run, f"key {kind}, y double, p double")


def transfer(train: DataFrame, test: DataFrame, key: str, features: list[str], target: str, fit: Fit) -> DataFrame:
    """(key, y, p) of the test table by a model of the training table, scaled by the training table's statistics."""
    s = zstats(train, features).first()
    mean, std = (np.array([s[f"{c}_{k}"] for c in features]) for k in "ms")
    data = small(train.select(*features, target))
    model = fit((data[features].to_numpy(np.float64) - mean) / (std + 1e-12), data[target].to_numpy(np.float64))

    def run(batches):
        for pdf in batches:
            x = (pdf[features].to_numpy(np.float64) - mean) / (std + 1e-12)
            yield pd.DataFrame({"key": pdf[key], "y": pdf[target].astype(float), "p": model(x) if len(x) else []})

    return test.select(key, *features, target).mapInPandas(run, f"key {test.schema[key].dataType.simpleString()}, y double, p double")


def importances(df: DataFrame, features: list[str], target: str, **how) -> list[tuple[str, float]]:
    """Features by their share of a forest's variance reduction, largest first."""
    data = small(df.select(*features, target))
    model = forest(**how)(data[features].to_numpy(np.float64), data[target].to_numpy(np.float64))
    return sorted(zip(features, map(float, model.importance), strict=True), key=lambda t: (-t[1], t[0]))
