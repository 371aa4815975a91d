"""Inputs that the queries share, in DataFrame and in SQL form.

The driver's tables stand in for the data of an audit run: an embedding's label is its text's cluster, texts and vectors meet on their id.
Triplets are 5 + 5 + 5 texts, 3 by cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import corpus, corruption, scoring
from plumbline.session import stored, table
from plumbline.sources.io import exists, fingerprint

SIZES, PER_DOMAIN, SEED = (5, 5, 5), 3, 42


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, so that engines that add in other orders agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """(text_id, cluster_label, text)"""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("text_id"), F.col("label").alias("cluster_label"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return e.join(d, "text_id")


def triplets(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.triplet_splits(assigned(spark, sf), "cluster_label", "text_id", SIZES, PER_DOMAIN, SEED)


#: Written long tables by session and state of the inputs.
_LONG: dict[tuple, str] = {}


def long_table(spark: SparkSession, sf: str) -> DataFrame:
    """The long table, written once for a session and read by every query on it; inputs of another size or time are scored anew."""
    state = (spark.sparkContext.applicationId, sf, *(fingerprint(spark, f"{sf}/{name}.parquet") for name in ("documents", "embeddings")))
    if state not in _LONG or not exists(spark, _LONG[state]):
        _LONG[state] = stored(scored_long(spark, sf), "long").stored_at
    return spark.read.parquet(_LONG[state])


def scored_long(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    scores = scoring.round_scores(scoring.score_pairs(triplets(spark, sf), texts))
    return corruption.long_table(scores)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(text_id, cluster_label, v)"""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("text_id"), F.col("label").alias("cluster_label"), F.col("embedding").cast("array<double>").alias("v")
    )


def triplet_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return triplets(spark, sf).join(vectors(spark, sf).select("text_id", "v"), "text_id")


ASG = """asg AS (SELECT e.vec_id AS text_id, e.label AS cluster_label, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"""

TRIPLETS = (
    ASG
    + """,
big AS (SELECT cluster_label, row_number() OVER (ORDER BY cluster_label) - 1 AS c FROM
        (SELECT cluster_label FROM asg WHERE cluster_label <> -1 GROUP BY 1 HAVING count(*) >= 15)),
ks AS (SELECT unnest([1, 2, 3]) AS k),
drawn AS (SELECT a.cluster_label, c, k, text_id, row_number() OVER (PARTITION BY a.cluster_label, k
          ORDER BY md5('42:' || a.cluster_label || ':' || k || ':' || text_id), text_id) AS r
          FROM asg a JOIN big USING (cluster_label) CROSS JOIN ks),
cut AS (SELECT *, CASE WHEN r <= 5 THEN 'train' WHEN r <= 10 THEN 'validation' ELSE 'test' END AS split FROM drawn WHERE r <= 15),
trip AS (SELECT 'triplet_' || lpad(CAST(c * 3 + k AS VARCHAR), 3, '0') AS triplet, cluster_label, k AS domain_triplet_index, split,
         row_number() OVER (PARTITION BY cluster_label, k, split ORDER BY text_id) - 1 AS sample_idx, text_id FROM cut)"""
)

LONG = (
    TRIPLETS
    + """,
tok AS (SELECT doc_id AS text_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1, 2),
voc AS (SELECT w, sum(n)::DOUBLE AS c FROM tok GROUP BY 1),
siz AS (SELECT sum(c) AS nn, count(*)::DOUBLE AS vv FROM voc),
sam AS (SELECT triplet, split, sample_idx, t.text_id, w, n, c FROM trip t JOIN tok USING (text_id) JOIN voc USING (w)),
bas AS (SELECT triplet, split, sample_idx, sum(n)::BIGINT AS n_tokens, sum(n * -ln(c + 1)) AS b FROM sam GROUP BY 1, 2, 3),
fgt AS (SELECT triplet AS model_triplet, w, sum(n)::DOUBLE AS cm, max(c) AS cw FROM sam WHERE split = 'train' GROUP BY 1, 2),
rem AS (SELECT model_triplet, sum(cm) AS nm FROM fgt GROUP BY 1),
sha AS (SELECT model_triplet, triplet, split, sample_idx, sum(n * (ln(cw + 1) - ln(cw - cm + 1))) AS d
        FROM sam JOIN fgt USING (w) GROUP BY 1, 2, 3, 4),
raw AS (SELECT r.model_triplet, b.triplet AS eval_triplet, b.split, b.sample_idx, n_tokens,
        b / n_tokens + ln(nn + vv) AS bl, (b + coalesce(d, 0)) / n_tokens + ln(nn - nm + vv) AS ul
        FROM bas b CROSS JOIN rem r CROSS JOIN siz
        LEFT JOIN sha s ON s.model_triplet = r.model_triplet AND s.triplet = b.triplet AND s.split = b.split AND s.sample_idx = b.sample_idx),
scored AS (SELECT model_triplet, eval_triplet, split, sample_idx, round(bl, 6) AS base_loss, round(exp(bl), 2) AS base_ppl,
         round(ul, 6) AS unlearn_loss, round(exp(ul), 2) AS unlearn_ppl, n_tokens FROM raw),
long AS (SELECT *, CASE WHEN model_triplet = eval_triplet AND split = 'train' THEN 'L1' WHEN model_triplet = eval_triplet THEN 'L2'
         WHEN split = 'test' THEN 'L3' ELSE 'L3_other' END AS layer,
         ln(greatest(unlearn_ppl, 1e-6) / greatest(base_ppl, 1e-6)) AS log_ppl_ratio FROM scored)"""
)

COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
DIST = "list_distance({a}, {b})"


def cos_sql(a: str, b: str) -> str:
    return COS.format(a=a, b=b)
