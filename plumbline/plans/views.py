"""Queries of dataset views, lookups and joins of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import corruption as C
from plumbline.operators import models
from plumbline.operators import ranking as R
from plumbline.operators import views as V
from plumbline.plans import audit
from plumbline.plans.common import LONG, TRIPLETS, assigned, long_table, rounded, triplets
from plumbline.session import table


def triplet_texts(spark, sf):
    """Sampled ids back to their texts and their cluster's metadata."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), F.md5("text").alias("digest"))
    meta = assigned(spark, sf).groupBy("cluster_label").agg(F.count(F.lit(1)).alias("cluster_size"))
    return triplets(spark, sf).join(docs, "text_id").join(F.broadcast(meta), "cluster_label", "left").select("triplet", "split", "sample_idx", "text_id", "digest", "cluster_size")


def split_modes(spark, sf):
    return V.collapse_splits(triplets(spark, sf)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def brands(spark, sf):
    p = table(spark, sf, "part")
    return V.union_distinct(p.select(F.col("p_brand").alias("name")), p.select(F.col("p_type").alias("name")))


def mentions(spark, sf):
    return V.first_mentions(table(spark, sf, "events").select("event_type", "event_id"), "event_type", "event_id")


def members(spark, sf):
    want = spark.createDataFrame([(1,), (3,), (99,)], "n_regionkey int")
    hit, missing = V.member_filter(table(spark, sf, "nation").select("n_regionkey"), want, "n_regionkey")
    return hit.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")).unionByName(missing.select("n_regionkey", F.lit(0).cast("bigint").alias("n")))


def weights(spark, sf):
    kinds = F.array(*map(F.lit, (*V.WEIGHTS, "norm", "embed")))
    n = table(spark, sf, "nation").select(F.concat(F.lit("layers."), F.col("n_nationkey").cast("string"), F.lit("."), F.get(kinds, F.col("n_nationkey") % 9)).alias("name"))
    return n.filter(V.is_weight(F.col("name")))


def scaled(spark, sf):
    cols = audit.FEATURES[:4]
    return rounded(models.zscore(audit.geometry(spark, sf).select("forget_cluster", *cols), cols), 4)


def normalised(spark, sf):
    return rounded(table(spark, sf, "supplier").select("s_suppkey", V.min_max("s_acctbal", "s_nationkey").alias("x")))


def sliced(spark, sf):
    """Scores by layer of the prediction that every sample's ratio is its layer's leave-one-out mean."""
    lt = long_table(spark, sf).filter("layer <> 'L3_other'").select("layer", F.col("log_ppl_ratio").alias("y"))
    n = lt.groupBy("layer").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    j = lt.join(F.broadcast(n), "layer").select("layer", "y", ((F.col("s") - F.col("y")) / (F.col("n") - 1)).alias("p"))
    return rounded(R.regression_scores(j, "layer").select("layer", "mae", "rmse"))


def coverage_vs_spillover(spark, sf):
    from plumbline.operators.vectors import coverage_summary

    cov = coverage_summary(audit.coverage(spark, sf))
    prof = C.profile(long_table(spark, sf)).select("forget_cluster", F.round("geo_L3", 6).alias("p"))
    return rounded(R.correlations(cov.select("forget_cluster", F.round("mean_cov", 6).alias("y")).join(prof, "forget_cluster")))


def references(spark, sf):
    m = table(spark, sf, "region").select(F.col("r_name").alias("metric"), F.col("r_regionkey").cast("double").alias("agg_value"))
    return V.with_reference(m, m.filter("agg_value > 1").withColumn("agg_value", F.col("agg_value") * 2))


def chats(spark, sf):
    tags = {"user": ("[U]", "[/U]"), "assistant": ("[A]", "[/A]")}
    c = V.chat(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", tags, "[S]be brief[/S]")
    return c.select("conv_id", F.md5("prompt").alias("prompt"))


def templates(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", T.fill("Name {a} of region {b}; {a}.", a=F.col("n_name"), b=F.col("n_regionkey").cast("string")).alias("prompt"))


def in_range(spark, sf):
    from plumbline.sources.io import select_triplets

    return select_triplets(triplets(spark, sf), first=3, last=7).groupBy("triplet").agg(F.count(F.lit(1)).alias("n"))


def chosen(spark, sf):
    from plumbline.sources.io import select_triplets

    return select_triplets(triplets(spark, sf), "2, triplet_005 triple_9_x").groupBy("triplet").agg(F.count(F.lit(1)).alias("n"))


def expanded(spark, sf):
    from plumbline.functions import sequences as S

    c = table(spark, sf, "customer").select("c_custkey", F.array(F.col("c_mktsegment"), F.col("c_name")).alias("answers"))
    return S.expand_answers(c, "answers")


def alternates(spark, sf):
    from plumbline.functions import sequences as S

    n = table(spark, sf, "nation").select("n_nationkey", S.with_alternate(F.col("n_name"), F.lit("yes"), F.concat(F.lit("no "), F.col("n_name"))).alias("v"))
    return n.select("n_nationkey", F.col("v.original.answer").alias("answer"), F.col("v.alternate.answer").alias("alternate"), F.col("v.alternate.question").alias("question"))


def tails(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.without_input(F.col("text"), F.substring("text", 1, 40))).alias("tail"))


def half_norms(spark, sf):
    from plumbline.operators.ports import half

    x = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10_000).alias("x"))
    return rounded(half(x, "x").select("s_suppkey", F.col("x").cast("double").alias("x")), 4)


KINDS = ", ".join(f"'{k}'" for k in ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj", "norm", "embed"))
Z = ", ".join(f"round((zx.{c} - avg(zx.{c}) OVER ()) / (stddev_pop(zx.{c}) OVER () + 1e-12), 4) AS {c}" for c in audit.FEATURES[:4])
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERIES = {
    "multi_answer_rows": (
        expanded,
        "SELECT c_custkey, 0 AS answer_idx, c_mktsegment AS answer FROM customer UNION ALL SELECT c_custkey, 1, c_name FROM customer",
    ),
    "alternate_pairs": (alternates, "SELECT n_nationkey, 'yes' AS answer, 'no ' || n_name AS alternate, n_name AS question FROM nation"),
    "ground_truth_tails": (tails, f"SELECT doc_id, md5(trim(replace(text, substr(text, 1, 40), ''), {SPACES})) AS tail FROM documents"),
    "half_precision": (
        half_norms,
        """WITH x AS (SELECT s_suppkey, (s_acctbal / 10000)::FLOAT::DOUBLE AS x FROM supplier), e AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE pow(2, greatest(floor(log2(abs(x))), -14) - 10) END AS u FROM x)
        SELECT s_suppkey, round(CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / u, 0) * u END, 4) AS x FROM e""",
    ),
    "triplet_texts": (
        triplet_texts,
        f"WITH {TRIPLETS} SELECT triplet, split, sample_idx, t.text_id, md5(text) AS digest, cluster_size FROM trip t JOIN documents ON doc_id = t.text_id JOIN (SELECT cluster_label, count(*) AS cluster_size FROM asg GROUP BY 1) USING (cluster_label)",
    ),
    "split_modes": (split_modes, f"WITH {TRIPLETS} SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM trip GROUP BY 1"),
    "union_distinct": (brands, "SELECT p_brand AS name FROM part UNION SELECT p_type FROM part"),
    "first_mentions": (mentions, "SELECT event_type, (row_number() OVER (ORDER BY min(event_id)) - 1)::INT AS pos FROM events GROUP BY 1"),
    "member_filter": (members, "SELECT k AS n_regionkey, count(n_nationkey) AS n FROM (VALUES (1), (3), (99)) t(k) LEFT JOIN nation ON n_regionkey = k GROUP BY 1"),
    "weight_names": (weights, f"SELECT name FROM (SELECT 'layers.' || n_nationkey || '.' || ([{KINDS}])[n_nationkey % 9 + 1] AS name FROM nation) WHERE regexp_matches(name, '(q|k|v|o|gate|up|down)_proj')"),
    "zscore_features": (
        scaled,
        f"WITH {audit.SETS}, zx AS (SELECT forget_cluster, vm AS emb_variance_mean, vx AS emb_variance_max, iso AS isotropy, cn AS centroid_norm FROM dg) SELECT forget_cluster, {Z} FROM zx",
    ),
    "min_max": (normalised, "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER w) / nullif(max(s_acctbal) OVER w - min(s_acctbal) OVER w, 0), 6) AS x FROM supplier WINDOW w AS (PARTITION BY s_nationkey)"),
    "layer_sliced_scores": (
        sliced,
        f"""WITH {LONG}, p AS (SELECT layer, log_ppl_ratio AS y, (sum(log_ppl_ratio) OVER (PARTITION BY layer) - log_ppl_ratio) / (count(*) OVER (PARTITION BY layer) - 1) AS p FROM long WHERE layer <> 'L3_other')
        SELECT layer, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse FROM p GROUP BY 1""",
    ),
    "coverage_vs_spillover": (
        coverage_vs_spillover,
        f"""WITH {LONG}, {audit.VECTORS}, {audit.DIMS}, {audit.COVERAGE}, p AS (SELECT model_triplet AS forget_cluster, round(exp(avg(log_ppl_ratio)), 6) AS p FROM long WHERE layer = 'L3' GROUP BY 1),
        j AS (SELECT forget_cluster, round(avg(f), 6) AS y, max(p) AS p FROM cv JOIN p USING (forget_cluster) GROUP BY 1),
        r AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp FROM j)
        SELECT round(corr(ry, rp), 6) AS spearman, round(corr(y, p), 6) AS pearson FROM r""",
    ),
    "reference_logs": (references, "SELECT r_name AS metric, r_regionkey::DOUBLE AS agg_value, CASE WHEN r_regionkey > 1 THEN r_regionkey * 2::DOUBLE END AS reference FROM region"),
    "chat_template": (
        chats,
        """SELECT conv_id, md5('[S]be brief[/S]' || string_agg(CASE role WHEN 'user' THEN '[U]' || text || '[/U]' WHEN 'assistant' THEN '[A]' || text || '[/A]' ELSE '' END, '' ORDER BY turn)) AS prompt FROM conversations GROUP BY 1""",
    ),
    "prompt_templates": (templates, "SELECT n_nationkey, 'Name ' || n_name || ' of region ' || n_regionkey || '; ' || n_name || '.' AS prompt FROM nation"),
    "triplet_range": (in_range, f"WITH {TRIPLETS} SELECT triplet, count(*) AS n FROM trip WHERE triplet BETWEEN 'triplet_003' AND 'triplet_007' GROUP BY 1"),
    "triplet_selection": (chosen, f"WITH {TRIPLETS} SELECT triplet, count(*) AS n FROM trip WHERE triplet IN ('triplet_002', 'triplet_005', 'triplet_009') GROUP BY 1"),
}
