"""Corruption analytics over the long perplexity table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scoring import log_ratio
from plumbline.session import cut


def layer(model: Column, evaluated: Column, split: Column) -> Column:
    """L1: own train split; L2: own other splits; L3: another's test split; L3_other: the rest."""
    own = model == evaluated
    return F.when(own & (split == "train"), "L1").when(own, "L2").when(split == "test", "L3").otherwise("L3_other")


def long_table(scores: DataFrame) -> DataFrame:
    return scores.withColumn("layer", layer(F.col("model_triplet"), F.col("eval_triplet"), F.col("split"))).withColumn(
        "log_ppl_ratio", log_ratio(F.col("unlearn_ppl"), F.col("base_ppl"))
    )


def flatten_pairs(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """Nested metric pairs (maps of split -> array of {loss, ppl, n_tokens}) to one row per sample.

    Sides are zipped by position up to the shorter one; ``strict`` skips splits whose lengths differ.
    """
    e = pairs.select("model_triplet", "eval_triplet", F.explode("base").alias("split", "b"), "unlearn")
    e = e.withColumn("u", F.try_element_at("unlearn", F.col("split"))).filter((F.size("b") > 0) & (F.size("u") > 0))
    if strict:
        e = e.filter(F.size("b") == F.size("u"))
    z = e.select("model_triplet", "eval_triplet", "split", F.posexplode(F.arrays_zip("b", "u")).alias("sample_idx", "z")).filter("z.b IS NOT NULL AND z.u IS NOT NULL")
    return z.select(
        "model_triplet", "eval_triplet", "split", "sample_idx", F.col("z.b.loss").alias("base_loss"), F.col("z.b.ppl").alias("base_ppl"),
        F.col("z.u.loss").alias("unlearn_loss"), F.col("z.u.ppl").alias("unlearn_ppl"), F.col("z.b.n_tokens").alias("n_tokens"),
    )


def describe(df: DataFrame, *keys: str, x: str = "log_ppl_ratio") -> DataFrame:
    c = F.col(x)
    share = lambda cond: F.avg(cond.cast("int")) * 100
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.stddev_pop(x).alias("std"),
        F.exp(F.avg(x)).alias("geo"), share(c > math.log(1.1)).alias("pct_up_10"), share(c > math.log(2)).alias("pct_up_2x"),
        share(c < math.log(1 / 1.1)).alias("pct_down_10"),
    )


def headline(df: DataFrame) -> DataFrame:
    return describe(df.filter("layer != 'L3_other'"), "layer").select("layer", "n", "geo", "mean", "pct_up_10", "pct_up_2x")


def profile(df: DataFrame, layers: tuple[str, ...] = ("L1", "L2", "L3")) -> DataFrame:
    """Wide: geometric mean and count of each layer by model."""
    wide = df.groupBy(F.col("model_triplet").alias("forget_cluster")).pivot("layer", list(layers)).agg(F.exp(F.avg("log_ppl_ratio")).alias("geo"), F.count(F.lit(1)).alias("n"))
    return wide.select("forget_cluster", *(c for x in layers for c in (F.col(f"{x}_geo").alias(f"geo_{x}"), F.coalesce(f"{x}_n", F.lit(0)).alias(f"n_{x}"))))


def in_and_out(df: DataFrame) -> DataFrame:
    """By set: what its removal does to others (out) and what others' removals do to it (in), on L3."""
    l3 = df.filter("layer = 'L3'")
    geo = F.exp(F.avg("log_ppl_ratio"))
    return l3.groupBy(F.col("model_triplet").alias("triplet")).agg(geo.alias("l3_out")).join(l3.groupBy(F.col("eval_triplet").alias("triplet")).agg(geo.alias("l3_in")), "triplet", "full")


def pair_means(df: DataFrame) -> DataFrame:
    return df.filter("split = 'test'").groupBy("model_triplet", "eval_triplet").agg(F.avg("log_ppl_ratio").alias("pair_mean"))


def pair_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Models by evaluated sets, as one row per model; all sets of the table, in order of their names, unless some are named."""
    means = pair_means(df) if columns else cut(pair_means(df))
    return means.groupBy("model_triplet").pivot("eval_triplet", columns).agg(F.first("pair_mean"))


def self_vs_cross(df: DataFrame) -> DataFrame:
    """Geometric means of the diagonal and the rest of the pair matrix, and their quotient."""
    own = F.col("model_triplet") == F.col("eval_triplet")
    p = pair_means(df).agg(F.exp(F.avg(F.when(own, F.col("pair_mean")))).alias("self_geo"), F.exp(F.avg(F.when(~own, F.col("pair_mean")))).alias("cross_geo"))
    return p.withColumn("multiplier", F.col("self_geo") / F.col("cross_geo"))


def retained_damage(df: DataFrame) -> DataFrame:
    """Damage outside the forget set in per cent of that within, where the latter is above 1."""
    g = lambda x: F.exp(F.avg(F.when(F.col("layer") == x, F.col("log_ppl_ratio"))))
    one = df.agg(g("L1").alias("g1"), g("L2").alias("g2"), g("L3").alias("g3"))
    keep = lambda x: F.when(F.col("g1") > 1, (F.col(x) - 1) / (F.col("g1") - 1) * 100)
    return one.select(keep("g2").alias("l2_retained_pct"), keep("g3").alias("l3_retained_pct"))


def base_gap(df: DataFrame) -> DataFrame:
    """Geometric mean of the base perplexity by layer, and its distance from the mean of L1."""
    by = df.groupBy("layer").agg(F.exp(F.avg(F.log(F.greatest("base_ppl", F.lit(1e-6))))).alias("geo_base"))
    one = by.agg(F.max(F.when(F.col("layer") == "L1", F.col("geo_base"))).alias("l1"))
    return by.crossJoin(F.broadcast(one)).select("layer", "geo_base", (F.col("geo_base") / F.col("l1") - 1).alias("gap"))


def spread(prof: DataFrame, layers: tuple[str, ...] = ("L1", "L2", "L3")) -> DataFrame:
    stacked = prof.select(F.explode(F.array(*(F.struct(F.lit(x).alias("layer"), F.col(f"geo_{x}").alias("g")) for x in layers))).alias("s")).select("s.*")
    return stacked.groupBy("layer").agg((F.max("g") / F.min("g")).alias("spread"))


def traffic_light(x: Column) -> Column:
    return F.when(x < 1.20, "green").when(x < 1.32, "yellow").otherwise("red")


def bad_rows(df: DataFrame, *cols: str) -> DataFrame:
    """Missing or NaN, and non-positive values by column."""
    aggs = []
    for c in cols:
        miss = F.col(c).isNull() | F.isnan(c)
        aggs += [F.count_if(miss).alias(f"{c}_missing"), F.count_if(~miss & (F.col(c) <= 0)).alias(f"{c}_nonpositive")]
    return df.agg(*aggs)


def invariants(df: DataFrame) -> DataFrame:
    """One row of checks on the long table."""
    g = lambda x: F.avg(F.when(F.col("layer") == x, F.col("log_ppl_ratio")))
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 0))
    one = df.agg(
        g("L1").alias("a"), g("L2").alias("b"), g("L3").alias("c"), (bad("base_ppl") + bad("unlearn_ppl")).alias("n_bad"),
        F.count_distinct("model_triplet").alias("m"), F.count_distinct("eval_triplet").alias("e"), F.count_distinct("model_triplet", "eval_triplet").alias("p"),
    )
    return one.select(
        (F.col("n_bad") == 0).alias("no_bad_rows"), (F.col("p") == F.col("m") * F.col("e")).alias("all_pairs"),
        (F.col("a") > F.col("c")).alias("l1_above_l3"), (F.col("a") > F.col("b")).alias("l1_above_l2"), (F.col("a") > 0).alias("l1_damaged"),
    )
