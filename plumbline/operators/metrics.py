"""Memorisation, privacy and utility metrics over token- and sample-level score tables.

Token tables have (idx, pos, label, lp) with lp the label's log probability, and where needed ``pred`` or ``dist``
(the distribution's log probabilities). Padding labels (-100) carry no loss.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


def probability(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, avg_loss, prob): loss summed over labels after the first position, divided by all labels."""
    live = F.col("label") != -100
    loss = F.sum(F.when(live & (F.col("pos") > 0), -F.col("lp")).otherwise(0.0))
    avg = loss / F.nullif(F.count_if(live), F.lit(0))
    return tokens.groupBy(*keys).agg(avg.alias("avg_loss"), F.exp(-avg).alias("prob"))


def mean_metric(scores: DataFrame, col: str = "score") -> DataFrame:
    return scores.filter(F.col(col).isNotNull()).agg(F.avg(col).alias("agg_value"))


def collapse_answers(scores: DataFrame, key: str, col: str) -> DataFrame:
    return scores.groupBy(key).agg(F.avg(col).alias(col))


def probability_with_options(right: DataFrame, wrong: DataFrame, key: str = "idx") -> DataFrame:
    """(idx, score): right / (right + sum of wrong probabilities)."""
    w = wrong.groupBy(key).agg(F.sum("prob").alias("wrong"))
    return right.join(w, key).select(key, (F.col("prob") / (F.col("prob") + F.col("wrong") + EPS)).alias("score"))


def truth_ratio(right: DataFrame, wrong: DataFrame, aggregator: str, key: str = "idx") -> DataFrame:
    """(idx, score) from average losses, several answers being averaged first."""
    r = collapse_answers(right, key, "avg_loss").withColumnRenamed("avg_loss", "r")
    w = collapse_answers(wrong, key, "avg_loss").withColumnRenamed("avg_loss", "w")
    rp, wp = F.exp(-F.col("r")), F.exp(-F.col("w"))
    score = rp / (rp + wp + EPS) if aggregator == "prob_mean" else wp / (rp + EPS)
    return r.join(w, key).select(key, score.alias("score"))


def aggregate_truth(scores: DataFrame, aggregator: str) -> DataFrame:
    s = F.col("score")
    value = {"closer_to_1_better": F.least(s, 1 / (s + EPS)), "true_better": F.greatest(F.lit(0.0), 1 - s), "prob_mean": s}[aggregator]
    return scores.agg(F.avg(value).alias("agg_value"))


def exact_memorization(tokens: DataFrame, key: str = "idx") -> DataFrame:
    return tokens.filter("label != -100").groupBy(key).agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("score"))


def extraction_strength(tokens: DataFrame, key: str = "idx") -> DataFrame:
    """1 - k/n, k being where the longest fully predicted suffix begins; with none, k is n - 1 (so never below 1/n)."""
    live = tokens.filter("label != -100").withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    n = F.count(F.lit(1))
    k = F.least(F.coalesce(F.max(F.when(F.col("pred") != F.col("label"), F.col("i"))) + 1, F.lit(0)), n - 1)
    return live.groupBy(key).agg((1 - k / n).alias("score"))


def harmonic_mean(values: DataFrame, col: str = "value") -> DataFrame:
    """0 where a value is 0."""
    zero = F.min(col) <= 0
    return values.agg(F.when(zero, 0.0).otherwise(F.count(col) / F.sum(1 / F.nullif(F.col(col), F.lit(0.0)))).alias("hm"))


def min_k(tokens: DataFrame, k: float = 0.4, key: str = "idx", col: str = "lp") -> DataFrame:
    """Minus the mean of the lowest max(1, int(n * k)) values."""
    lows = F.sort_array(F.collect_list(col))
    s = tokens.groupBy(key).agg(lows.alias("a"))
    take = F.slice("a", F.lit(1), F.greatest(F.lit(1), F.floor(F.size("a") * F.lit(k)).cast("int")))
    mean = F.aggregate(take, F.lit(0.0), lambda t, x: t + x) / F.size(take)
    return s.select(key, F.when(F.size("a") == 0, 0.0).otherwise(-mean).alias("score"))


def min_k_plus_plus(tokens: DataFrame, k: float = 0.4, key: str = "idx") -> DataFrame:
    """Min-k over log probabilities standardised by each position's distribution ``dist`` (log probabilities)."""
    p_sum = lambda f: F.aggregate("dist", F.lit(0.0), lambda s, x: s + F.exp(x) * f(x))
    mu = p_sum(lambda x: x)
    var = p_sum(lambda x: x * x) - mu * mu
    z = (F.col("lp") - mu) / F.sqrt(F.greatest(var, F.lit(1e-6)))
    return min_k(tokens.withColumn("lp", z), k, key)


def zlib_ratio(loss: Column, length: Column) -> Column:
    return loss / length


def p_norm(v: Column, p: float) -> Column:
    """p-norm of an array column, p being 1, 2 or infinity."""
    if math.isinf(p):
        return F.array_max(F.transform(v, F.abs))
    return F.pow(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(float(p)))), F.lit(1 / p))


Handler = Callable[[dict[str, DataFrame]], DataFrame]


class MetricGraph:
    """Named metrics that may read others' results; each is built once per name, in order of need."""

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[Handler, dict[str, str]]] = {}

    def add(self, name: str, handler: Handler, pre_compute: dict[str, str] | None = None) -> None:
        """``pre_compute`` maps a metric's name to the key under which ``handler`` finds its result."""
        self.nodes[name] = (handler, pre_compute or {})

    def evaluate(self, names: list[str], inputs: dict[str, DataFrame], done: dict[str, DataFrame] | None = None, overwrite: bool = False) -> dict[str, DataFrame]:
        """The named metrics' results; those in ``done`` are taken as they are unless ``overwrite``."""
        made: dict[str, DataFrame] = {} if overwrite else dict(done or {})
        open_: set[str] = set()

        def build(name: str) -> DataFrame:
            if name not in made:
                if name in open_:
                    raise ValueError(f"metrics need each other: {name}")
                open_.add(name)
                handler, needs = self.nodes[name]
                made[name] = handler(inputs | {key: build(n) for n, key in needs.items()})
            return made[name]

        return {n: build(n) for n in names}


def summary(results: dict[str, DataFrame]) -> DataFrame:
    """(metric, agg_value) in order of name, without missing values."""
    frames = [df.select(F.lit(n).alias("metric"), F.col("agg_value").cast("double")) for n, df in sorted(results.items()) if "agg_value" in df.columns]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.filter("agg_value IS NOT NULL").orderBy("metric")
