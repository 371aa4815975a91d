"""Ranking and evaluation statistics over (key, y, p) tables: true value y and prediction p."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.operators.prefix import sums_before
from plumbline.session import stored


def average_rank(x: str, *by: str) -> Column:
    """Rank from 1 with ties averaged, within groups."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


def ranked(df: DataFrame, x: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``x`` among all rows, from counts by distinct value and their running sums."""
    points = df.groupBy(x).agg(F.count(F.lit(1)).alias("_k"))
    place = sums_before(points, [x], _b=F.col("_k")).select(F.col(x).alias("_x"), (F.col("_b") + (F.col("_k") + 1) / 2).alias(out))
    return df.join(place, F.col(x).eqNullSafe(F.col("_x"))).drop("_x")


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where a side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """Spearman's rho and Pearson's r."""
    if by:
        both = df.withColumn("_ry", average_rank(y, *by)).withColumn("_rp", average_rank(p, *by))
    else:
        both = ranked(ranked(df, y, "_ry"), p, "_rp")
    return both.groupBy(*by).agg(pearson("_ry", "_rp").alias("spearman"), pearson(y, p).alias("pearson"))


def falls(x: np.ndarray) -> int:
    """Pairs of which the later is smaller, by merging sorted runs of doubling length."""
    x = np.unique(x, return_inverse=True)[1].astype(np.int64)
    n, width, out = len(x), 1, 0
    top = n + 1
    while width < n:
        run = np.arange(n) // (2 * width)
        right = (np.arange(n) // width) % 2 == 1
        left_keys = (run * top + x)[~right]  # sorted, as each half run is
        after = np.searchsorted(left_keys, (run * top + x)[right], "right")
        ends = np.searchsorted(left_keys, (run[right] + 1) * top)
        out += int((ends - after).sum())
        x = x[np.lexsort((x, run))]
        width *= 2
    return out


def discordant(df: DataFrame, y: str, p: str, parts: int = 64) -> DataFrame:
    """One row (d): pairs that ``y`` and ``p`` order in opposite ways; no pair is made.

    Rows are dealt into ranges of (y, p) and, apart from that, into ranges of p. Pairs of one p range are counted there; pairs of several p ranges
    and one (y, p) range there, by range number; pairs that differ in both from the counts of the grid, of at most parts ** 2 cells.
    """
    rows = stored(df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).filter("y IS NOT NULL AND p IS NOT NULL"), "rank-rows")
    by_p = stored(rows.repartitionByRange(parts, "p").withColumn("b", F.spark_partition_id()), "rank-by-p")
    grid = stored(by_p.repartitionByRange(parts, "y", "p").withColumn("a", F.spark_partition_id()), "rank-grid")

    def inside(order: list[str], x: str):
        return lambda pdf: pd.DataFrame({"d": [falls(pdf.sort_values(order, kind="stable")[x].to_numpy())]})

    in_p = grid.groupBy("b").applyInPandas(inside(["y", "p"], "p"), "d bigint")
    in_y = grid.groupBy("a").applyInPandas(inside(["y", "p"], "b"), "d bigint")
    cells = grid.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    before, after = cells.select("a", "b", "n"), cells.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    across = before.join(F.broadcast(after), (F.col("a") < F.col("a2")) & (F.col("b") > F.col("b2"))).select((F.col("n") * F.col("n2")).alias("d"))  # at most parts ** 2 rows
    return in_p.unionByName(in_y).unionByName(across).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"))


def kendall_concordance(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Kendall's tau-b, and the share of pairs with a true difference whose predicted sign agrees.

    Pairs are counted, not made: ties from counts by value, opposite ones by ``discordant``. Rows without a value count for nothing.
    """
    some = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    pairs = F.sum(F.col("k") * (F.col("k") - 1) / 2)
    tied = lambda *by: some.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("k")).agg(F.coalesce(pairs, F.lit(0.0)).alias("t_" + "".join(by)))
    n = some.agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = n
    for other in (tied(y), tied(p), tied(y, p).toDF("t_both"), discordant(some, y, p)):
        one = one.crossJoin(F.broadcast(other))  # one row each
    whole = F.col("n") * (F.col("n") - 1) / 2
    ny, np_ = whole - F.col(f"t_{y}"), whole - F.col(f"t_{p}")
    differ = whole - F.col(f"t_{y}") - F.col(f"t_{p}") + F.col("t_both")  # in both
    agree = differ - F.col("d")
    return one.select(F.try_divide(agree - F.col("d"), F.sqrt(ny) * F.sqrt(np_)).alias("kendall"), F.try_divide(agree, ny).alias("concordance"))


def first_k(df: DataFrame, x: str, key: str, k: int, out: str) -> DataFrame:
    """The ``k`` rows of largest ``x`` (ties by key) with their place from 1: the tasks' own first rows meet, never all rows."""
    top = df.orderBy(F.desc(x), key).limit(k)
    return top.withColumn(out, F.row_number().over(Window.orderBy(F.desc(x), key)))


def top_k(df: DataFrame, k: int, key: str = "key", y: str = "y", p: str = "p") -> DataFrame:
    """Hits among the top k, recall, what chance gives, and the lift over it."""
    both = first_k(df, y, key, k, "_y").select(key).join(first_k(df, p, key, k, "_p").select(key), key)
    one = both.agg(F.count(F.lit(1)).alias("hits")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n"))))
    return one.select(F.lit(k).alias("k"), "hits", (F.col("hits") / k).alias("recall"), (k / F.col("n")).alias("random_recall"), (F.col("hits") / k / (k / F.col("n"))).alias("lift"))


def share_to_k(n: int, percent: float) -> int:
    """k of a percentage, at least 1, halves rounded to even."""
    return max(1, round(n * percent / 100))


def ndcg(df: DataFrame, k: int, key: str = "key", y: str = "y", p: str = "p") -> DataFrame:
    """NDCG at k with min-max relevance and gain 2 ** rel - 1; 1 where all values are equal."""
    ends = df.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    rel = (F.col(y) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))

    def gain(x: str) -> DataFrame:
        top = first_k(df, x, key, k, "_at").crossJoin(F.broadcast(ends))
        return top.agg(F.sum((F.pow(F.lit(2.0), rel) - 1) / F.log2(F.col("_at") + 1)).alias(f"_{x}"))

    both = gain(p).crossJoin(F.broadcast(gain(y).select(F.col(f"_{y}").alias("_best"))))
    return both.select(F.coalesce(F.try_divide(F.col(f"_{p}"), F.col("_best")), F.lit(1.0)).alias("ndcg"))


def regression_scores(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    e = F.col(y) - F.col(p)
    one = df.groupBy(*by).agg(
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(F.col(y))).alias("mean_abs"),
    )
    return one.withColumn("mae_over_mean", F.col("mae") / F.col("mean_abs"))


def loo_mean(df: DataFrame, y: str = "y", group: str | None = None) -> DataFrame:
    """The mean of all other rows (or of all other groups' rows) as a prediction."""
    all_rows = df.agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    if group is None:
        return df.crossJoin(F.broadcast(all_rows)).withColumn("p", (F.col("_s") - F.col(y)) / (F.col("_n") - 1)).drop("_s", "_n")
    own = df.groupBy(group).agg(F.sum(y).alias("_gs"), F.count(y).alias("_gn"))
    both = own.crossJoin(F.broadcast(all_rows)).select(group, ((F.col("_s") - F.col("_gs")) / (F.col("_n") - F.col("_gn"))).alias("p"))
    return df.join(both, group)


def auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Mann-Whitney ROC-AUC, label 1 being the class that scores higher; ranks come from counts by distinct score."""
    points = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    ranked = sums_before(points, [score], _before=F.col("_pos") + F.col("_neg"))
    rank = F.col("_before") + (F.col("_pos") + F.col("_neg") + 1) / 2
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return ranked.agg(F.try_divide(F.sum(F.col("_pos") * rank) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def ks_statistic(df: DataFrame, x: str = "x", label: str = "label") -> DataFrame:
    """(n0, n1, d): sample sizes and the largest distance of the two distribution functions; no row if a sample is empty."""
    points = df.groupBy(x).agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b"))
    total = points.agg(F.sum("a").alias("n0"), F.sum("b").alias("n1")).filter("n0 > 0 AND n1 > 0")
    cum = sums_before(points, [x], ca=F.col("a"), cb=F.col("b")).crossJoin(F.broadcast(total))
    gap = (F.col("ca") + F.col("a")) / F.col("n0") - (F.col("cb") + F.col("b")) / F.col("n1")
    return cum.groupBy("n0", "n1").agg(F.max(F.abs(gap)).alias("d"))


def ks_p_value(d: float, n0: int, n1: int) -> float:
    """Two-sided p-value: exact by counting lattice paths for up to 10,000 observations in the larger sample, else asymptotic."""
    if max(n0, n1) > 10_000:
        z = d * math.sqrt(n0 * n1 / (n0 + n1))
        return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))))
    limit = d - 1e-9
    j = np.arange(n1 + 1) / n1
    inside = lambda i: np.abs(i / n0 - j) < limit
    # Probability that a random path has stayed inside: weights by the hypergeometric steps.
    prob = np.cumprod(np.append(1.0, inside(0)[1:].astype(float)))
    prob *= inside(0)
    for i in range(1, n0 + 1):
        ok = inside(i)
        new = np.zeros(n1 + 1)
        left = 0.0
        for k in range(n1 + 1):
            # scaled counts: mean of the two predecessors' shares, each weighted by the ways to reach it
            up = prob[k] * i / (i + k)
            side = left * k / (i + k)
            left = new[k] = (up + side) if ok[k] else 0.0
        prob = new
    return float(1 - prob[n1])


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n0: pd.Series, n1: pd.Series) -> pd.Series:
    return pd.Series([ks_p_value(float(a), int(b), int(c)) for a, b, c in zip(d, n0, n1, strict=True)])


def relative_difference(value: Column, ref: Column, default: float = 0.5) -> Column:
    """100 * (value - ref) / ref, the reference being ``default`` where there is none."""
    r = F.coalesce(ref, F.lit(default))
    return (value - r) / (r + 1e-10) * 100


def privleak(auc_value: Column, ref: Column, default: float = 0.5) -> Column:
    return relative_difference(1 - auc_value, 1 - F.coalesce(ref, F.lit(default)), 1 - default)


def draws(df: DataFrame, key: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(b, slot, row columns): ``n`` draws with replacement for each of ``n_boot`` resamples, by hash."""
    numbered = sums_before(df, [key], _i=F.lit(1)).withColumn("_i", F.col("_i").cast("int"))
    n = df.count()
    grid = df.sparkSession.range(n_boot * n).select((F.col("id") / n).cast("int").alias("b"), (F.col("id") % n).cast("int").alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "slot")), 1, 8), 16, 10).cast("bigint") % n
    return grid.withColumn("_i", pick.cast("int")).join(numbered, "_i").drop("_i")


def bootstrap_rho(df: DataFrame, key: str = "key", n_boot: int = 200, seed: int = 0) -> DataFrame:
    """Mean and 95 % interval of Spearman's rho over resamples that aren't degenerate."""
    rho = correlations(draws(df, key, n_boot, seed), "b").filter(F.col("spearman").isNotNull() & ~F.isnan("spearman"))
    return rho.agg(
        F.count(F.lit(1)).alias("n_boot"), F.avg("spearman").alias("rho_mean"), F.percentile("spearman", F.lit(0.025)).alias("ci_low"),
        F.percentile("spearman", F.lit(0.975)).alias("ci_high"),
    )


def bootstrap_recall(df: DataFrame, k: int, key: str = "key", n_boot: int = 200, seed: int = 0) -> DataFrame:
    d = draws(df, key, n_boot, seed)
    place = lambda x: F.row_number().over(Window.partitionBy("b").orderBy(F.desc(x), "slot"))
    r = d.withColumn("_y", place("y")).withColumn("_p", place("p"))
    per = r.groupBy("b").agg((F.count_if((F.col("_y") <= k) & (F.col("_p") <= k)) / k).alias("recall"))
    return per.agg(F.avg("recall").alias("recall_mean"), F.percentile("recall", F.lit(0.025)).alias("ci_low"), F.percentile("recall", F.lit(0.975)).alias("ci_high"))
