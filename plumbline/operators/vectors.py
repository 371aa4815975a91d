"""Vector geometry: set statistics, similarities between sets, coverage, effective rank, PCA, cosine matrices.

Vectors are ``array<double>`` columns. Pairs are always made within a set or between two given sets,
keyed by the sets, never over a whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Numbers of all sets together up to which they are broadcast.
BROADCAST = 1 << 23


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def dim_stats(df: DataFrame, key: str, vec: str = "v") -> DataFrame:
    """(key, pos, mean, var) over the vectors of each set, with population variance."""
    return df.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def centroids(df: DataFrame, key: str, vec: str = "v") -> DataFrame:
    means = dim_stats(df, key, vec)
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centroid"))


def centroid_distances(df: DataFrame, label: str, vec: str = "v") -> DataFrame:
    """``df`` with each member's distance to its cluster's centroid; null for noise (-1)."""
    return df.join(centroids(df.filter(F.col(label) != -1), label, vec), label, "left").withColumn("distance_to_centroid", distance(F.col(vec), F.col("centroid"))).drop("centroid")


def inner_pairs(df: DataFrame, key: str, id_col: str, vec: str = "v") -> DataFrame:
    """Upper-triangle pairs within each set: cosine and Euclidean distance."""
    a = df.select(key, F.col(id_col).alias("i"), F.col(vec).alias("a"))
    b = df.select(key, F.col(id_col).alias("j"), F.col(vec).alias("b"))
    return a.join(b, key).filter("i < j").select(key, "i", "j", cosine(F.col("a"), F.col("b")).alias("cos"), distance(F.col("a"), F.col("b")).alias("dist"))


def set_geometry(df: DataFrame, key: str, id_col: str, vec: str = "v") -> DataFrame:
    """Eleven closed-form features of each set (``effective_rank`` has the twelfth)."""
    dims = dim_stats(df, key, vec).groupBy(key).agg(
        F.avg("var").alias("emb_variance_mean"), F.max("var").alias("emb_variance_max"),
        (F.min("var") / F.greatest(F.max("var"), F.lit(1e-12))).alias("isotropy"), F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("centroid_norm"),
    )
    norms = df.groupBy(key).agg(F.avg(norm(F.col(vec))).alias("emb_norm_mean"), F.stddev_pop(norm(F.col(vec))).alias("emb_norm_std"))
    pairs = inner_pairs(df, key, id_col, vec).groupBy(key).agg(
        F.avg("cos").alias("pairwise_sim_mean"), F.stddev_pop("cos").alias("pairwise_sim_std"),
        F.percentile("cos", F.lit(0.9)).alias("pairwise_sim_q90"), F.avg("dist").alias("pairwise_eucl_mean"),
    )
    return dims.join(norms, key).join(pairs, key).withColumn("spread_over_centroid", F.col("pairwise_eucl_mean") / F.greatest("centroid_norm", F.lit(1e-12)))


def effective_rank(df: DataFrame, key: str, vec: str = "v") -> DataFrame:
    """exp of the entropy of the normalised covariance eigenvalues of each set."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        x -= x.mean(0)
        gram = (x @ x.T if len(x) < x.shape[1] else x.T @ x) / max(1, len(x) - 1)
        eig = np.full(x.shape[1], 1e-12)
        small = np.linalg.eigvalsh(gram)
        eig[: len(small)] = np.clip(small, 1e-12, None)
        p = eig / eig.sum()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "effective_rank": [float(np.exp(-(p * np.log(p)).sum()))]})

    return df.select(key, vec).groupBy(key).applyInPandas(one, f"{key} {df.schema[key].dataType.simpleString()}, effective_rank double")


def between(targets: DataFrame, forget: DataFrame, target_keys: list[str], forget_key: str) -> DataFrame:
    """Per target vector and forget set: statistics of its similarities to the set's members.

    ``forget`` has (forget_key, v); its sets are gathered to one row each (a set is one sampled triplet split, of fixed
    size), so that pairs never become rows.
    """
    sets = forget.groupBy(forget_key).agg(F.collect_list("v").alias("vs"))
    sims = F.transform("vs", lambda f: cosine(F.col("v"), f))
    dists = F.transform("vs", lambda f: distance(F.col("v"), f))
    mean_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    top = lambda k: mean_of(F.slice("ss", 1, k))
    numbers = forget.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    # Every target meets every set, as the result has it; the sets travel whole only while they are few.
    base = targets.crossJoin(F.broadcast(sets) if numbers <= BROADCAST else sets).withColumn("ss", F.sort_array(sims, False)).withColumn("ds", F.array_min(dists)).withColumn("mu", mean_of(F.col("ss")))
    return base.select(
        forget_key, *target_keys, F.get("ss", F.lit(0)).alias("cos_sim_to_nearest"), top(3).alias("cos_sim_top3_mean"), top(5).alias("cos_sim_top5_mean"),
        F.col("mu").alias("cos_sim_mean"), F.sqrt(mean_of(F.transform("ss", lambda x: (x - F.col("mu")) * (x - F.col("mu"))))).alias("cos_sim_std"),
        F.col("ds").alias("eucl_to_nearest"), norm(F.col("v")).alias("target_emb_norm"), "v",
    )


def per_sample_geometry(targets: DataFrame, forget: DataFrame, target_keys: list[str], forget_key: str, forget_id: str) -> DataFrame:
    """The sixteen features of each target for each forget set."""
    b = between(targets, forget, target_keys, forget_key)
    geo = set_geometry(forget, forget_key, forget_id).select(
        forget_key, F.col("emb_variance_mean").alias("forget_emb_variance_mean"), F.col("pairwise_sim_mean").alias("forget_mean_pairwise_similarity"),
        F.col("centroid_norm").alias("forget_centroid_norm"), F.col("pairwise_eucl_mean").alias("forget_spread"),
    )
    full = b.join(geo.join(centroids(forget, forget_key), forget_key), forget_key)  # the planner broadcasts it if it is small
    c, v = F.col("centroid"), F.col("v")
    cosc = dot(v, c) / (norm(v) * norm(c) + 1e-12)
    return full.select(
        *(x for x in full.columns if x not in ("v", "centroid")), cosc.alias("cos_sim_to_centroid"), distance(v, c).alias("eucl_to_centroid"),
        (dot(v, c) / F.greatest(norm(c), F.lit(1e-12))).alias("proj_on_centroid"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosc)))).alias("angle_to_centroid_deg"),
    )


def radius(df: DataFrame, key: str, id_col: str, p: float = 0.95) -> DataFrame:
    return inner_pairs(df, key, id_col).groupBy(key).agg(F.percentile("dist", F.lit(p)).alias("forget_radius_p95"))


def coverage(forget: DataFrame, retain: DataFrame, forget_id: str) -> DataFrame:
    """(forget_cluster, retain_cluster): share of retained vectors within the forget set's radius, and mean nearest distance."""
    b = between(retain, forget, ["retain_cluster"], "forget_cluster").filter("forget_cluster != retain_cluster")
    r = radius(forget, "forget_cluster", forget_id)
    return b.join(F.broadcast(r), "forget_cluster").groupBy("forget_cluster", "retain_cluster").agg(
        F.max("forget_radius_p95").alias("forget_radius_p95"), F.avg((F.col("eucl_to_nearest") <= F.col("forget_radius_p95")).cast("int")).alias("frac_within_radius"),
        F.avg("eucl_to_nearest").alias("mean_min_dist"),
    )


def coverage_summary(cov: DataFrame) -> DataFrame:
    return cov.groupBy("forget_cluster").agg(F.avg("frac_within_radius").alias("mean_cov"), F.max("frac_within_radius").alias("max_cov"), F.max("forget_radius_p95").alias("radius"))


def cosine_matrix(df: DataFrame, key: str, vec: str = "v") -> DataFrame:
    """(a, b, cos) for a < b over one vector per key, in long form: joined on position, summed by pair."""
    long = df.select(key, F.posexplode(vec).alias("pos", "x"))
    norms = long.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    a = long.select(F.col(key).alias("a"), "pos", F.col("x").alias("xa"))
    b = long.select(F.col(key).alias("b"), "pos", F.col("x").alias("xb"))
    dots = a.join(b, "pos").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    na, nb = norms.select(F.col(key).alias("a"), F.col("n").alias("na")), norms.select(F.col(key).alias("b"), F.col("n").alias("nb"))
    return dots.join(F.broadcast(na), "a").join(F.broadcast(nb), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cos"))


def off_diagonal(cos: DataFrame) -> DataFrame:
    return cos.agg(F.avg("cos").alias("mean"), F.min("cos").alias("min"), F.max("cos").alias("max"), F.stddev_pop("cos").alias("std"))


def pca(df: DataFrame, id_col: str, k: int, vec: str = "v") -> tuple[DataFrame, float]:
    """Exact PCA: moments are summed in tasks (d + d * d numbers each), eigenvectors are found once, rows are projected."""

    def part(batches):
        n, s, q = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    rows = df.select(vec).mapInPandas(part, "n bigint, s array<double>, q array<double>")
    summed = rows.select("n", F.posexplode(F.concat("s", "q")).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("pos").toPandas()
    n, flat = float(summed["n"].iloc[0]), summed["x"].to_numpy()
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:d] / n
    cov = (flat[d:].reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)
    value, vector = np.linalg.eigh(cov)
    top = vector[:, ::-1][:, :k]
    top *= np.sign(top[np.abs(top).argmax(0), np.arange(k)])

    def project(batches):
        for pdf in batches:
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64) - mean if len(pdf) else np.empty((0, d))
            yield pd.DataFrame({id_col: pdf[id_col], "pc": list(x @ top)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, vec).mapInPandas(project, f"{id_col} {kind}, pc array<double>"), float(value[::-1][:k].sum() / value.sum())


def nearest(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Each member's nearest other member of its set (ties: the smaller id)."""
    p = inner_pairs(df, key, id_col)
    both = p.select(key, F.col("i").alias("id"), F.col("j").alias("other"), "dist").unionByName(p.select(key, F.col("j").alias("id"), F.col("i").alias("other"), "dist"))
    w = Window.partitionBy(key, "id").orderBy("dist", "other")
    return both.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
