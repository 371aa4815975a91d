"""Queries of the audit: set geometry, coverage, ranking statistics, predictive models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import clustering, models
from plumbline.operators import corruption as C
from plumbline.operators import ranking as R
from plumbline.operators import vectors as V
from plumbline.plans.common import LONG, TRIPLETS, cos_sql, long_table, rounded, triplet_vectors, vectors
from plumbline.session import cut, table

FEATURES = [
    "emb_variance_mean", "emb_variance_max", "isotropy", "centroid_norm", "emb_norm_mean", "emb_norm_std",
    "pairwise_sim_mean", "pairwise_sim_std", "pairwise_sim_q90", "pairwise_eucl_mean", "spread_over_centroid",
]


def forget_sets(spark, sf):
    return triplet_vectors(spark, sf).filter("split = 'train'").select(F.col("triplet").alias("forget_cluster"), "text_id", "v")


def geometry(spark, sf):
    return V.set_geometry(forget_sets(spark, sf), "forget_cluster", "text_id")


def targets(spark, sf):
    return triplet_vectors(spark, sf).filter("split = 'test'").select(F.col("triplet").alias("eval_triplet"), F.col("sample_idx").alias("sample_index"), "v")


def per_sample(spark, sf):
    f = forget_sets(spark, sf).withColumnRenamed("forget_cluster", "model_triplet")
    rows = V.per_sample_geometry(targets(spark, sf), f, ["eval_triplet", "sample_index"], "model_triplet", "text_id")
    return rounded(rows.withColumn("same_cluster", (F.col("model_triplet") == F.col("eval_triplet")).cast("int")))


def coverage(spark, sf):
    retain = triplet_vectors(spark, sf).filter("split <> 'train'").select(F.col("triplet").alias("retain_cluster"), "v")
    return V.coverage(forget_sets(spark, sf), retain, "text_id")


def eval_table(spark, sf):
    """(key, y, p, g): two correlated readings of each vector, rounded so that ties occur."""
    v = lambda i: F.get("v", F.lit(i))
    return vectors(spark, sf).select(
        F.col("text_id").alias("key"), F.round(2 + v(0) + v(1), 2).alias("y"), F.round(2 + v(0) + v(2), 2).alias("p"), F.col("cluster_label").alias("g")
    )


YP = """yp AS (SELECT vec_id AS key, round(2 + v[1] + v[2], 2) AS y, round(2 + v[1] + v[3], 2) AS p, label AS g
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""
RANKS = """rk AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp,
  row_number() OVER (ORDER BY y DESC, key) AS oy, row_number() OVER (ORDER BY p DESC, key) AS op FROM yp)"""
DRAWS = """no AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i FROM yp),
dr AS (SELECT b, slot, y, p FROM (SELECT b, slot, ('0x' || md5('0:' || b || ':' || slot)[1:8])::BIGINT % (SELECT count(*) FROM yp) AS i
  FROM range({n}) x(b), (SELECT unnest(range((SELECT count(*) FROM yp))) AS slot)) JOIN no USING (i))"""


def model_table(spark, sf):
    """Geometry of the forget sets joined to their damage; cut, as scaling, folds and fits all read it."""
    prof = C.profile(long_table(spark, sf)).select("forget_cluster", "geo_L1")
    return cut(geometry(spark, sf).join(prof, "forget_cluster"))


def scored(fit, spark, sf):
    t = models.zscore(model_table(spark, sf), FEATURES)
    return rounded(models.leave_out(t, "forget_cluster", FEATURES, "geo_L1", fit))


def logo(fit, spark, sf):
    t = model_table(spark, sf).withColumn("g", F.substring("forget_cluster", -1, 1))
    return rounded(models.leave_out(models.zscore(t, FEATURES), "forget_cluster", FEATURES, "geo_L1", fit, group="g"))


def ablation(spark, sf):
    fits = {"ridge": models.ridge(), "lasso": models.lasso(), "forest": models.forest(), "boosting": models.boosting()}
    t = models.zscore(model_table(spark, sf), FEATURES)
    out = None
    for name, fit in fits.items():
        s = R.regression_scores(models.leave_out(t, "forget_cluster", FEATURES, "geo_L1", fit)).withColumn("model", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return rounded(out)


def transfer(spark, sf):
    t = model_table(spark, sf)
    odd = F.regexp_extract("forget_cluster", r"(\d+)$", 1).cast("int") % 2 == 1
    return rounded(models.transfer(t.filter(odd), t.filter(~odd), "forget_cluster", FEATURES, "geo_L1", models.ridge()))


def importance(spark, sf):
    rows = models.importances(model_table(spark, sf), FEATURES, "geo_L1")
    return rounded(spark.createDataFrame(rows, "feature string, importance double"))


def holdout(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


def ks(spark, sf):
    s = R.ks_statistic(holdout(spark, sf), "score", "label")
    return rounded(s.withColumn("p_value", R.ks_p("d", "n0", "n1")))


def label_means(spark, sf):
    return V.cosine_matrix(V.centroids(vectors(spark, sf), "cluster_label"), "cluster_label", "centroid")


def pca(spark, sf):
    pc, share = V.pca(vectors(spark, sf), "text_id", 5)
    sq = F.aggregate("pc", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(pc.agg(F.avg(sq).alias("mean_sq"), F.count(F.lit(1)).alias("n")).withColumn("explained", F.lit(share)), 4)


def blobs(spark, sf):
    return rounded(clustering.hdbscan(vectors(spark, sf).select("text_id", "v"), "text_id", min_cluster_size=20, min_samples=5))


def reordered(spark, sf):
    w = Window.partitionBy("g").orderBy(F.desc("y"), "key")
    return eval_table(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 3").select("g", "r", "key", "y")


DIMS = """x AS (SELECT forget_cluster, text_id, unnest(v) AS x, unnest(range(len(v))) AS p FROM fs),
dm AS (SELECT forget_cluster, p, avg(x) AS m, var_pop(x) AS var FROM x GROUP BY 1, 2),
dg AS (SELECT forget_cluster, avg(var) AS vm, max(var) AS vx, min(var) / greatest(max(var), 1e-12) AS iso, sqrt(sum(m * m)) AS cn, list(m ORDER BY p) AS cent FROM dm GROUP BY 1),
nm AS (SELECT forget_cluster, avg(sqrt(list_inner_product(v, v))) AS nm, stddev_pop(sqrt(list_inner_product(v, v))) AS ns FROM fs GROUP BY 1),
""" + f"""pr AS (SELECT a.forget_cluster, {cos_sql('a.v', 'b.v')} AS cos, list_distance(a.v, b.v) AS dist FROM fs a JOIN fs b ON a.forget_cluster = b.forget_cluster AND a.text_id < b.text_id),
pg AS (SELECT forget_cluster, avg(cos) AS cm, stddev_pop(cos) AS cs, quantile_cont(cos, 0.9) AS cq, avg(dist) AS em, quantile_cont(dist, 0.95) AS r95 FROM pr GROUP BY 1)"""  # fmt: skip
VECTORS = """tv AS (SELECT t.*, CAST(e.embedding AS DOUBLE[]) AS v FROM trip t JOIN embeddings e ON e.vec_id = t.text_id),
fs AS (SELECT triplet AS forget_cluster, text_id, v FROM tv WHERE split = 'train')"""
SETS = f"{TRIPLETS},\n{VECTORS},\n{DIMS}"
COVERAGE = """rt AS (SELECT triplet AS retain_cluster, split, sample_idx, v FROM tv WHERE split <> 'train'),
nn AS (SELECT forget_cluster, retain_cluster, split, sample_idx, min(list_distance(rt.v, fs.v)) AS d FROM rt JOIN fs ON forget_cluster <> retain_cluster GROUP BY 1, 2, 3, 4),
cv AS (SELECT forget_cluster, retain_cluster, max(r95) AS r, avg((d <= r95)::INT) AS f FROM nn JOIN pg USING (forget_cluster) GROUP BY 1, 2)"""
#: Ridge regression for each fold: moments of the rows outside it, and Gauss-Jordan elimination of the normal equations.
FOLDS = """t AS (SELECT *, {{fold}} AS fold, {x} AS x FROM tz),
fo AS (SELECT DISTINCT fold FROM t WHERE {{tested}}),
ex AS (SELECT fo.fold, t.x, y, count(*) OVER (PARTITION BY fo.fold) AS n FROM fo JOIN t ON t.fold <> fo.fold WHERE {{trained}}),
dm2 AS (SELECT fold, d, avg(x[d]) AS m, avg(y) AS my FROM ex CROSS JOIN range(1, {k} + 1) r(d) GROUP BY 1, 2),
me AS (SELECT fold, list(m ORDER BY d) AS m, max(my) AS my FROM dm2 GROUP BY 1),
ce AS (SELECT ex.fold, list_transform(range(1, {k} + 1), lambda d: x[d] - m[d]) AS c, y - my AS e FROM ex JOIN me USING (fold)),
mo AS (SELECT fold, i, j, CASE WHEN j <= {k} THEN sum(c[i] * c[j]) + (i = j)::INT ELSE sum(c[i] * e) END AS v
  FROM ce CROSS JOIN range(1, {k} + 1) a(i) CROSS JOIN range(1, {k} + 2) b(j) GROUP BY 1, 2, 3),
ro AS (SELECT fold, i, list(v ORDER BY j) AS r FROM mo GROUP BY 1, 2), ma AS (SELECT fold, 1 AS k, list(r ORDER BY i) AS m FROM ro GROUP BY 1),
gj AS (SELECT fold, k, m FROM ma UNION ALL SELECT fold, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
  ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {k}),
so AS (SELECT fold, list_transform(m, lambda r: r[{k} + 1]) AS w FROM gj WHERE k = {k} + 1),
pd AS (SELECT t.forget_cluster AS key, y, my + list_sum(list_transform(range(1, {k} + 1), lambda d: (x[d] - m[d]) * w[d])) AS p FROM t JOIN me USING (fold) JOIN so USING (fold) WHERE {{tested}})
SELECT key, round(y, 6) AS y, round(p, 6) AS p FROM pd"""
_SHORT = ("vm", "vx", "iso", "cn", "nm", "ns", "cm", "cs", "cq", "em", "em / greatest(cn, 1e-12)")
_RAW = ", ".join(f"{e} AS f{i}" for i, e in enumerate(_SHORT))
_Z = "[" + ", ".join(f"(f{i} - avg(f{i}) OVER ({{w}})) / (stddev_pop(f{i}) OVER ({{w}}) + 1e-12)" for i in range(len(_SHORT))) + "]"


def ridge_sql(fold: str, tested: str = "true", trained: str = "true", scale: str | None = None) -> str:
    """Predictions of each fold by ridge regression on all others; ``scale`` is the rows whose statistics scale all, if not all do."""
    if scale:
        z = "[" + ", ".join(f"(f{i} - (SELECT avg(f{i}) FROM tz WHERE {scale})) / ((SELECT stddev_pop(f{i}) FROM tz WHERE {scale}) + 1e-12)" for i in range(len(_SHORT))) + "]"
    else:
        z = _Z.format(w="")
    folds = FOLDS.format(x=z, k=len(_SHORT)).format(fold=fold, tested=tested, trained=trained)
    return f"""WITH RECURSIVE {LONG}, {VECTORS}, {DIMS}, tz AS (SELECT forget_cluster, {_RAW}, y FROM dg JOIN nm USING (forget_cluster) JOIN pg USING (forget_cluster)
        JOIN (SELECT model_triplet AS forget_cluster, exp(avg(log_ppl_ratio)) AS y FROM long WHERE layer = 'L1' GROUP BY 1) USING (forget_cluster)), {folds}"""


#: The exact two-sided p-value by lattice paths, a list of probabilities by step.
KS_SQL = """WITH RECURSIVE h AS (SELECT n_chars AS x, quality AS l FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
s AS (SELECT count(*) FILTER (l = 0) AS n0, count(*) FILTER (l = 1) AS n1 FROM h),
c AS (SELECT x, sum(count(*) FILTER (l = 0)) OVER (ORDER BY x) / n0 - sum(count(*) FILTER (l = 1)) OVER (ORDER BY x) / n1 AS g FROM h CROSS JOIN s GROUP BY x, n0, n1),
d AS (SELECT n0, n1, max(abs(g)) AS d, max(abs(g)) - 1e-9 AS lim FROM c CROSS JOIN s GROUP BY 1, 2),
p AS (SELECT 0::BIGINT AS i, n0, n1, d, lim, list_transform(range(n1 + 1), lambda k: CASE WHEN k / n1 < lim THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM d
  UNION ALL SELECT i + 1, n0, n1, d, lim, list_reduce(range(n1 + 1), lambda a, k: list_append(a, CASE WHEN abs((i + 1) / n0 - k / n1) < lim
    THEN p[k + 1] * (i + 1) / (i + 1 + k) + (CASE WHEN k > 0 THEN a[k] ELSE 0.0 END) * k / (i + 1 + k) ELSE 0.0::DOUBLE END), []::DOUBLE[]) FROM p WHERE i < n0)
SELECT n0, n1, round(d, 6) AS d, round(1 - p[n1 + 1], 6) AS p_value FROM p WHERE i = n0"""
TOPK = 25
QUERIES = {
    "forget_geometry": (
        lambda s, sf: rounded(geometry(s, sf)),
        f"""WITH {SETS} SELECT forget_cluster, round(vm, 6) AS emb_variance_mean, round(vx, 6) AS emb_variance_max, round(iso, 6) AS isotropy, round(cn, 6) AS centroid_norm,
        round(nm, 6) AS emb_norm_mean, round(ns, 6) AS emb_norm_std, round(cm, 6) AS pairwise_sim_mean, round(cs, 6) AS pairwise_sim_std, round(cq, 6) AS pairwise_sim_q90,
        round(em, 6) AS pairwise_eucl_mean, round(em / greatest(cn, 1e-12), 6) AS spread_over_centroid FROM dg JOIN nm USING (forget_cluster) JOIN pg USING (forget_cluster)""",
    ),
    "effective_rank": (lambda s, sf: rounded(V.effective_rank(forget_sets(s, sf), "forget_cluster")), None),
    "per_sample_geometry": (
        per_sample,
        f"""WITH {SETS}, tg AS (SELECT triplet AS eval_triplet, sample_idx AS sample_index, v FROM tv WHERE split = 'test'),
        sm AS (SELECT f.forget_cluster AS model_triplet, eval_triplet, sample_index, any_value(t.v) AS v, list({cos_sql('t.v', 'f.v')} ORDER BY {cos_sql('t.v', 'f.v')} DESC) AS ss,
          min(list_distance(t.v, f.v)) AS dmin FROM tg t CROSS JOIN fs f GROUP BY 1, 2, 3),
        j AS (SELECT sm.*, cent, vm, cm, cn, em, list_inner_product(v, cent) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(cent, cent)) + 1e-12) AS cc
          FROM sm JOIN dg ON dg.forget_cluster = model_triplet JOIN pg ON pg.forget_cluster = model_triplet)
        SELECT model_triplet, eval_triplet, sample_index, round(ss[1], 6) AS cos_sim_to_nearest, round(list_avg(ss[1:3]), 6) AS cos_sim_top3_mean, round(list_avg(ss[1:5]), 6) AS cos_sim_top5_mean,
        round(list_avg(ss), 6) AS cos_sim_mean, round(list_stddev_pop(ss), 6) AS cos_sim_std, round(dmin, 6) AS eucl_to_nearest, round(sqrt(list_inner_product(v, v)), 6) AS target_emb_norm,
        round(vm, 6) AS forget_emb_variance_mean, round(cm, 6) AS forget_mean_pairwise_similarity, round(cn, 6) AS forget_centroid_norm, round(em, 6) AS forget_spread,
        round(cc, 6) AS cos_sim_to_centroid, round(list_distance(v, cent), 6) AS eucl_to_centroid, round(list_inner_product(v, cent) / greatest(sqrt(list_inner_product(cent, cent)), 1e-12), 6) AS proj_on_centroid,
        round(degrees(acos(greatest(-1, least(1, cc)))), 6) AS angle_to_centroid_deg, (model_triplet = eval_triplet)::INT AS same_cluster FROM j""",
    ),
    "retain_coverage": (
        lambda s, sf: rounded(coverage(s, sf)),
        f"""WITH {SETS}, rt AS (SELECT triplet AS retain_cluster, split, sample_idx, v FROM tv WHERE split <> 'train'),
        nn AS (SELECT forget_cluster, retain_cluster, split, sample_idx, min(list_distance(rt.v, fs.v)) AS d FROM rt JOIN fs ON forget_cluster <> retain_cluster GROUP BY 1, 2, 3, 4)
        SELECT forget_cluster, retain_cluster, round(max(r95), 6) AS forget_radius_p95, round(avg((d <= r95)::INT), 6) AS frac_within_radius, round(avg(d), 6) AS mean_min_dist
        FROM nn JOIN pg USING (forget_cluster) GROUP BY 1, 2""",
    ),
    "coverage_summary": (
        lambda s, sf: rounded(V.coverage_summary(coverage(s, sf))),
        f"""WITH {SETS}, rt AS (SELECT triplet AS retain_cluster, split, sample_idx, v FROM tv WHERE split <> 'train'),
        nn AS (SELECT forget_cluster, retain_cluster, split, sample_idx, min(list_distance(rt.v, fs.v)) AS d FROM rt JOIN fs ON forget_cluster <> retain_cluster GROUP BY 1, 2, 3, 4),
        cv AS (SELECT forget_cluster, retain_cluster, max(r95) AS r, avg((d <= r95)::INT) AS f FROM nn JOIN pg USING (forget_cluster) GROUP BY 1, 2)
        SELECT forget_cluster, round(avg(f), 6) AS mean_cov, round(max(f), 6) AS max_cov, round(max(r), 6) AS radius FROM cv GROUP BY 1""",
    ),
    "task_vector_cosine": (
        lambda s, sf: rounded(label_means(s, sf)),
        f"""WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS m FROM x GROUP BY 1, 2),
        c AS (SELECT label, list(m ORDER BY p) AS v FROM m GROUP BY 1) SELECT a.label AS a, b.label AS b, round({cos_sql('a.v', 'b.v')}, 6) AS cos FROM c a JOIN c b ON a.label < b.label""",
    ),
    "off_diagonal": (
        lambda s, sf: rounded(V.off_diagonal(label_means(s, sf))),
        f"""WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS m FROM x GROUP BY 1, 2),
        c AS (SELECT label, list(m ORDER BY p) AS v FROM m GROUP BY 1), d AS (SELECT {cos_sql('a.v', 'b.v')} AS cos FROM c a JOIN c b ON a.label < b.label)
        SELECT round(avg(cos), 6) AS mean, round(min(cos), 6) AS min, round(max(cos), 6) AS max, round(stddev_pop(cos), 6) AS std FROM d""",
    ),
    "nearest_in_set": (
        lambda s, sf: rounded(V.nearest(forget_sets(s, sf), "forget_cluster", "text_id")),
        f"""WITH {SETS} SELECT a.forget_cluster, a.text_id AS id, b.text_id AS other, round(list_distance(a.v, b.v), 6) AS dist FROM fs a JOIN fs b ON a.forget_cluster = b.forget_cluster AND a.text_id <> b.text_id
        QUALIFY row_number() OVER (PARTITION BY a.forget_cluster, a.text_id ORDER BY list_distance(a.v, b.v), b.text_id) = 1""",
    ),
    "spearman_pearson": (lambda s, sf: rounded(R.correlations(eval_table(s, sf))), f"WITH {YP}, {RANKS} SELECT round(corr(ry, rp), 6) AS spearman, round(corr(y, p), 6) AS pearson FROM rk"),
    "spearman_by_group": (
        lambda s, sf: rounded(R.correlations(eval_table(s, sf), "g")),
        f"""WITH {YP}, r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2 AS rp FROM yp)
        SELECT g, round(corr(ry, rp), 6) AS spearman, round(corr(y, p), 6) AS pearson FROM r GROUP BY 1""",
    ),
    "kendall_concordance": (
        lambda s, sf: rounded(R.kendall_concordance(eval_table(s, sf))),
        f"""WITH {YP}, s AS (SELECT sign(a.y - b.y) AS sy, sign(a.p - b.p) AS sp FROM yp a JOIN yp b ON a.key < b.key)
        SELECT round(sum(sy * sp) / sqrt(count(*) FILTER (sy <> 0)::DOUBLE * count(*) FILTER (sp <> 0)), 6) AS kendall, round(avg((sy = sp)::INT) FILTER (sy <> 0), 6) AS concordance FROM s""",
    ),
    "topk_recall": (
        lambda s, sf: rounded(R.top_k(eval_table(s, sf), TOPK)),
        f"""WITH {YP}, {RANKS}, h AS (SELECT count(*) FILTER (oy <= {TOPK} AND op <= {TOPK}) AS hits, count(*) AS n FROM rk)
        SELECT {TOPK} AS k, hits, round(hits / {TOPK}, 6) AS recall, round({TOPK} / n, 6) AS random_recall, round(hits / {TOPK} / ({TOPK} / n), 6) AS lift FROM h""",
    ),
    "ndcg": (
        lambda s, sf: rounded(R.ndcg(eval_table(s, sf), TOPK)),
        f"""WITH {YP}, {RANKS}, r AS (SELECT *, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS rel FROM rk)
        SELECT round(sum((pow(2, rel) - 1) / log2(op + 1)) FILTER (op <= {TOPK}) / sum((pow(2, rel) - 1) / log2(oy + 1)) FILTER (oy <= {TOPK}), 6) AS ndcg FROM r""",
    ),
    "top3_by_group": (reordered, f"WITH {YP} SELECT g, (row_number() OVER (PARTITION BY g ORDER BY y DESC, key))::INT AS r, key, y FROM yp QUALIFY r <= 3"),
    "r2_mae": (
        lambda s, sf: rounded(R.regression_scores(eval_table(s, sf), "g")),
        f"""WITH {YP} SELECT g, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y)), 6) AS mean_abs,
        round(avg(abs(y - p)) / avg(abs(y)), 6) AS mae_over_mean FROM yp GROUP BY 1""",
    ),
    "loo_mean_baseline": (
        lambda s, sf: rounded(R.loo_mean(eval_table(s, sf).drop("p")).select("key", "y", "p")),
        f"WITH {YP} SELECT key, y, round((sum(y) OVER () - y) / (count(*) OVER () - 1), 6) AS p FROM yp",
    ),
    "logo_mean_baseline": (
        lambda s, sf: rounded(R.loo_mean(eval_table(s, sf).drop("p"), group="g").select("key", "g", "p")),
        f"WITH {YP} SELECT key, g, round((sum(y) OVER () - sum(y) OVER (PARTITION BY g)) / (count(*) OVER () - count(*) OVER (PARTITION BY g)), 6) AS p FROM yp",
    ),
    "bootstrap_ci": (
        lambda s, sf: rounded(R.bootstrap_rho(eval_table(s, sf), n_boot=1000)),
        f"""WITH {YP}, {DRAWS.format(n=1000)}, r AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY b ORDER BY p) + (count(*) OVER (PARTITION BY b, p) - 1) / 2 AS rp FROM dr),
        c AS (SELECT b, corr(ry, rp) AS rho FROM r GROUP BY 1)
        SELECT count(*) AS n_boot, round(avg(rho), 6) AS rho_mean, round(quantile_cont(rho, 0.025), 6) AS ci_low, round(quantile_cont(rho, 0.975), 6) AS ci_high FROM c WHERE rho IS NOT NULL""",
    ),
    "bootstrap_recall": (
        lambda s, sf: rounded(R.bootstrap_recall(eval_table(s, sf), TOPK, n_boot=1000)),
        f"""WITH {YP}, {DRAWS.format(n=1000)}, r AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY y DESC, slot) AS oy, row_number() OVER (PARTITION BY b ORDER BY p DESC, slot) AS op FROM dr),
        c AS (SELECT b, count(*) FILTER (oy <= {TOPK} AND op <= {TOPK}) / {TOPK} AS rec FROM r GROUP BY 1)
        SELECT round(avg(rec), 6) AS recall_mean, round(quantile_cont(rec, 0.025), 6) AS ci_low, round(quantile_cont(rec, 0.975), 6) AS ci_high FROM c""",
    ),
    "holdout_auc": (
        lambda s, sf: rounded(R.auc(holdout(s, sf))),
        """WITH h AS (SELECT n_chars::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM h)
        SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r""",
    ),
    "ks_test": (ks, KS_SQL),
    "ridge_loo": (lambda s, sf: scored(models.ridge(), s, sf), ridge_sql("forget_cluster")),
    "ridge_logo": (lambda s, sf: logo(models.ridge(), s, sf), ridge_sql("right(forget_cluster, 1)")),
    "lasso_loo": (lambda s, sf: scored(models.lasso(), s, sf), None),
    "rf_loo": (lambda s, sf: scored(models.forest(), s, sf), None),
    "gbt_logo": (lambda s, sf: logo(models.boosting(trees=300), s, sf), None),
    "rf_logo": (lambda s, sf: logo(models.forest(trees=500, leaf=3, max_features=0.5, seed=42), s, sf), None),
    "model_ablation": (ablation, None),
    "model_transfer": (transfer, ridge_sql("right(forget_cluster, 1)::INT % 2", "fold = 0", "t.fold = 1", "right(forget_cluster, 1)::INT % 2 = 1")),
    "feature_importance": (importance, None),
    "pca": (pca, None),
    "hdbscan": (blobs, None),
}
