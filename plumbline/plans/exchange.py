"""Queries that send tables through readers, writers, checked joins, resume and outside functions, and read them again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import sequences as S
from plumbline.functions import text as T
from plumbline.operators import corruption as C
from plumbline.operators import models, ports
from plumbline.operators import views as V
from plumbline.plans import audit
from plumbline.plans.common import LONG, TRIPLETS, long_table, rounded, triplets
from plumbline.session import fresh_path, stored, table
from plumbline.sources import io
from plumbline.streaming import resume


def jsonl(spark, sf):
    path = fresh_path(spark, "jsonl")
    io.write_jsonl(table(spark, sf, "documents").select(F.col("doc_id").alias("source_row_id"), F.col("text").alias("content")), path)
    rows = io.read_jsonl(spark, path, "content")
    return rows.select("source_row_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


def json_arrays(spark, sf):
    path = fresh_path(spark, "triplets")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    io.write_triplets(triplets(spark, sf).join(texts, "text_id").select("triplet", "split", "sample_idx", "text"), path)
    rows = io.read_json_array(spark, f"{path}/triplet=*/split=*/*.txt")
    part = lambda k: F.regexp_extract("file", f"{k}=([^/]+)/", 1)
    return rows.select(part("triplet").alias("triplet"), part("split").alias("split"), "sample_idx", F.md5("text").alias("digest"))


def qa_arrays(spark, sf):
    """One JSON array of QA records per conversation."""
    from pyspark.sql import Window

    path = fresh_path(spark, "qa")
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    qa = c.select("conv_id", "turn", "text", F.lead("text").over(w).alias("answer")).filter("answer IS NOT NULL")
    record = F.struct(F.col("turn").cast("int").alias("source_train_index"), F.col("text"), F.col("text").alias("question"), "answer", T.closed_book_prompt(F.col("text")).alias("qa_prompt"))
    arrays = qa.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("value"))
    arrays.write.partitionBy("conv_id").text(path)
    rows = io.read_qa(spark, f"{path}/conv_id=*/*.txt")
    conv = F.regexp_extract("file", "conv_id=([^/]+)/", 1).cast("bigint")
    return rows.select(conv.alias("conv_id"), F.col("source_train_index").alias("turn"), F.md5("question").alias("question"), F.md5("answer").alias("answer"), F.md5("qa_prompt").alias("prompt"))


def csv_assignments(spark, sf):
    """Blank domains get their default as they are read."""
    path = fresh_path(spark, "assignments")
    e = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id"))
    label = F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int")
    rows = e.select(
        F.col("vec_id").alias("text_id"), label.alias("cluster_label"), F.when(label % 2 == 0, F.concat(F.lit("d"), label.cast("string"))).otherwise(" ").alias("domain"),
        (label == -1).alias("is_noise"), F.when(label != -1, F.col("vec_id") / 8).alias("distance_to_centroid"), "text",
    )
    io.write_assignments(rows, f"{path}/csv", f"{path}/json")
    return io.read_assignments(spark, f"{path}/csv").select("text_id", "cluster_label", "domain", "is_noise", "distance_to_centroid", F.md5("text").alias("digest"))


def cached_logs(spark, sf):
    """What an earlier evaluation stored is taken from there, and only the rest is computed."""
    path = fresh_path(spark, "logs")
    kind = "metric string, value double"
    metrics = table(spark, sf, "nation").select(F.col("n_name").alias("metric"), F.col("n_regionkey").cast("double").alias("value"))
    empty = io.read_if_exists(spark, path, kind)
    metrics.filter("value < 2").write.parquet(path)
    old = io.read_if_exists(spark, path, kind)
    new = io.resumable(metrics, old, "metric").withColumn("value", F.col("value") + 10)
    return old.unionByName(new).unionByName(empty)


def summary_object(spark, sf):
    path = fresh_path(spark, "object")
    d = table(spark, sf, "documents")
    io.write_object(d.agg(F.count(F.lit(1)).alias("n"), F.max("lang").alias("lang"), F.min_by("text", "doc_id").alias("first"), F.lit(None).cast("string").alias("none")), path)
    return io.read_object(spark, path, "n bigint, lang string, first string, none string").select("n", "lang", F.md5("first").alias("digest"), "none")


def invalidated(spark, sf):
    path = fresh_path(spark, "stages")
    stages = ["embed", "reduce", "cluster", "export"]
    for s in stages[:3]:
        table(spark, sf, "region").write.parquet(f"{path}/{s}")
    gone = io.invalidate(spark, path, stages, "embed")
    return spark.createDataFrame([(s, s in gone, io.exists(spark, f"{path}/{s}")) for s in stages], "stage string, removed boolean, there boolean")


def streamed(spark, sf):
    """Rows that arrive in two steps, some twice, are each processed once."""
    path = fresh_path(spark, "stream")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    run = lambda: resume.process_new(spark, f"{path}/in", d.schema, lambda x: x.withColumn("n_chars", F.col("n_chars") + 1), f"{path}/out", f"{path}/state", ("doc_id",))
    d.filter("doc_id % 3 <> 0").write.parquet(f"{path}/in")
    run()
    d.filter("doc_id % 2 = 0 OR doc_id % 3 = 0").write.mode("append").parquet(f"{path}/in")
    run()
    return spark.read.parquet(f"{path}/out")


def other_clusters(spark, sf):
    return audit.per_sample(spark, sf).filter("same_cluster = 0").groupBy("model_triplet").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_index").alias("index_sum"))


def complete_pairs(spark, sf):
    """Customers whose orders have both priorities, on the side of all orders and on that of finished ones."""
    o = table(spark, sf, "orders")
    sums = lambda p: F.map_from_entries(F.collect_list(F.struct("o_orderpriority", p)))
    by = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    maps = by.groupBy("o_custkey").agg(sums("n_all").alias("base"), F.map_filter(sums("n_done"), lambda _, v: v > 0).alias("done"))
    return V.complete(maps, ("base", "done"), ("1-URGENT", "2-HIGH")).select("o_custkey", F.size("base").alias("n"))


def old_names(spark, sf):
    """Pairs written with the old split names."""
    path = fresh_path(spark, "pairs")
    n = table(spark, sf, "nation")
    scores = F.array(F.struct((F.col("n_nationkey") / 4).alias("loss"), (F.col("n_nationkey") / 2).alias("ppl"), F.col("n_nationkey").alias("n_tokens")))
    side = F.map_from_arrays(F.array(F.when(F.col("n_regionkey") > 2, "forget").otherwise("train"), F.lit("retain"), F.lit("test")), F.array(scores, scores, scores))
    n.select(F.col("n_name").alias("model_triplet"), F.lit("e").alias("eval_triplet"), F.lit("d").alias("model_dir"), side.alias("base"), side.alias("unlearn")).write.json(path)
    rows = io.read_pairs(spark, path).select("model_triplet", F.explode("base").alias("split", "rows"))
    return rows.select("model_triplet", "split", F.get("rows", F.lit(0))["loss"].alias("loss"))


def selected_features(spark, sf):
    cols = models.feature_columns(audit.geometry(spark, sf).withColumn("geo_L1", F.lit(0.0)), exclude=("geo_L1", "emb_norm_std"))
    return spark.createDataFrame([*enumerate(cols)], "pos int, name string")


def features_labels(spark, sf):
    """Each sample's features with its label, on three keys."""
    f = audit.per_sample(spark, sf).select("model_triplet", "eval_triplet", "sample_index", "eucl_to_nearest")
    y = long_table(spark, sf).filter("split = 'test'").select("model_triplet", "eval_triplet", F.col("sample_idx").alias("sample_index"), "log_ppl_ratio")
    return rounded(V.checked_join(f, y, ["model_triplet", "eval_triplet", "sample_index"]))


def features_profile(spark, sf):
    """Set geometry with the damage profiles of two runs, whose columns get suffixes."""
    prof = stored(C.profile(long_table(spark, sf)).select("forget_cluster", "geo_L1", "geo_L2"))
    other = prof.withColumns({"geo_L1": F.col("geo_L1") * 2, "geo_L2": F.col("geo_L2") * 3})
    g = audit.geometry(spark, sf).select("forget_cluster", "centroid_norm")
    return rounded(V.checked_join(V.checked_join(g, prof, ["forget_cluster"]), other, ["forget_cluster"], ("_ga", "_npo")))


def coverage_profile(spark, sf):
    from plumbline.operators.vectors import coverage_summary

    prof = C.profile(long_table(spark, sf)).select("forget_cluster", "geo_L3")
    return rounded(V.checked_join(coverage_summary(audit.coverage(spark, sf)).select("forget_cluster", "mean_cov"), prof, ["forget_cluster"]))


def features_if_present(spark, sf):
    """Cluster sizes with a feature file that is there, and with one that isn't."""
    path = fresh_path(spark, "features")
    e = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    e.filter("label < 5").select("label", (F.col("n") * 2).alias("feature")).write.parquet(f"{path}/there")
    read = lambda name: io.read_if_exists(spark, f"{path}/{name}", "label int, feature bigint")
    return e.join(read("there"), "label", "left").join(read("missing").withColumnRenamed("feature", "other"), "label", "left")


def resumed_questions(spark, sf):
    q = table(spark, sf, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "text")
    done = q.filter("at < 40000")
    return V.resume_after(q, done, "at", "text").select("at", F.md5("text").alias("digest"))


def warmups(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    steps, warm = V.warmup_columns(F.col("n"), 8, 4, 2, 10.0, 1.5)
    return n.select("o_orderpriority", steps.alias("steps"), warm.alias("warmup"))


def stamped(spark, sf):
    now = io.manifest(spark, {}).select(F.col("manifest")["updated"].alias("t"))
    return now.select(F.col("t").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("iso"), (F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp("t"))) < 3600).alias("recent"))


def tokenized(spark, sf):
    """Code points as tokens, cut at 64 and padded to it on the left."""
    t = ports.tokenize(table(spark, sf, "documents").select("doc_id", "text"), "text", lambda s: [*map(ord, s)], 64)
    ids = S.pad(F.col("ids"), 64, 0, left=True)
    return t.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(ids, ",")).alias("digest"), F.aggregate(S.attention(ids, 0), F.lit(0), lambda s, x: s + x).alias("attended"))


def letter_counts(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(c) for c in "abcdefghij"] for t in texts], np.float32).reshape(-1, 10)


def embedded(spark, sf):
    e = ports.embed(table(spark, sf, "documents"), "doc_id", "text", letter_counts)
    return rounded(e.select("doc_id", F.size("embedding").alias("n"), F.get("embedding", F.lit(0)).cast("double").alias("first"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("sq")), 4)


def batch_scores(spark, sf):
    """Answers scored in batches by the model of their row, regrouped to one mean by item."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("m"), (F.col("c_nationkey") % 3).cast("string")).alias("model"), F.array("c_mktsegment", "c_name").alias("answers"))
    load = lambda m: lambda pdf: pdf[["c_custkey"]].assign(score=pdf["answer"].str.len() * (1.0 + int(m[1:])))
    scored = ports.apply_scorer(S.expand_answers(c, "answers"), "model", load, "c_custkey bigint, score double")
    return scored.groupBy("c_custkey").agg(F.avg("score").alias("score"))


def stop_marks(spark, sf):
    """Whether words taken as tokens end in a stop sequence that may be parted otherwise."""
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z])")).alias("ids"))
    return b.select("item_id", S.stopped(F.col("ids"), F.lit(3), F.array(F.lit("e"))).alias("done"), S.stopped(F.slice("ids", 1, 3), F.lit(3), F.array(F.lit("e"))).alias("given"))


KEPT = "SELECT doc_id, coalesce(text, '') AS t FROM documents"
QUERIES = {
    "jsonl_scan": (jsonl, f"SELECT doc_id AS source_row_id, length(t) AS n, md5(t) AS digest FROM ({KEPT})"),
    "json_array_scan": (json_arrays, f"WITH {TRIPLETS} SELECT triplet, split, sample_idx, md5(text) AS digest FROM trip JOIN documents ON doc_id = text_id"),
    "qa_json_scan": (
        qa_arrays,
        """WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations)
        SELECT conv_id, turn::INT AS turn, md5(text) AS question, md5(a) AS answer, md5('Question: ' || text || chr(10) || 'Answer:') AS prompt FROM n WHERE a IS NOT NULL""",
    ),
    "csv_assignments": (
        csv_assignments,
        """WITH e AS (SELECT vec_id AS text_id, CASE WHEN label = 9 THEN -1 ELSE label END AS c, text FROM embeddings JOIN documents ON doc_id = vec_id)
        SELECT text_id, c AS cluster_label, CASE WHEN c = -1 THEN 'noise' WHEN c % 2 = 0 THEN 'd' || c ELSE 'cluster_' || c END AS domain, c = -1 AS is_noise,
        CASE WHEN c <> -1 THEN text_id / 8 END AS distance_to_centroid, md5(text) AS digest FROM e""",
    ),
    "cached_logs": (cached_logs, "SELECT n_name AS metric, CASE WHEN n_regionkey < 2 THEN n_regionkey ELSE n_regionkey + 10 END::DOUBLE AS value FROM nation"),
    "summary_object": (summary_object, f"SELECT count(*) AS n, max(lang) AS lang, md5(arg_min(text, doc_id)) AS digest, NULL::VARCHAR AS none FROM documents"),
    "invalidate_stages": (invalidated, "SELECT * FROM (VALUES ('embed', false, true), ('reduce', true, false), ('cluster', true, false), ('export', false, false)) t(stage, removed, there)"),
    "stream_resume": (streamed, "SELECT doc_id, n_chars + 1 AS n_chars FROM documents"),
    "other_clusters": (
        other_clusters,
        f"""WITH {TRIPLETS}, m AS (SELECT DISTINCT triplet AS model_triplet FROM trip)
        SELECT model_triplet, count(*) AS n, sum(sample_idx)::BIGINT AS index_sum FROM m JOIN trip ON triplet <> model_triplet AND split = 'test' GROUP BY 1""",
    ),
    "complete_pairs": (
        complete_pairs,
        """SELECT o_custkey, count(DISTINCT o_orderpriority)::INT AS n FROM orders GROUP BY 1
        HAVING bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AND bool_or(o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')""",
    ),
    "old_split_names": (old_names, "SELECT n_name AS model_triplet, unnest(['train', 'validation', 'test']) AS split, n_nationkey / 4 AS loss FROM nation"),
    "feature_columns": (
        selected_features,
        "SELECT unnest(range(10))::INT AS pos, unnest([" + ", ".join(f"'{c}'" for c in audit.FEATURES if c != "emb_norm_std") + "]) AS name",
    ),
    "features_with_labels": (
        features_labels,
        f"""WITH {LONG}, {audit.VECTORS}, nn AS (SELECT f.forget_cluster AS model_triplet, t.triplet AS eval_triplet, t.sample_idx, min(list_distance(t.v, f.v)) AS d
          FROM tv t CROSS JOIN fs f WHERE t.split = 'test' GROUP BY 1, 2, 3)
        SELECT model_triplet, eval_triplet, nn.sample_idx AS sample_index, round(d, 6) AS eucl_to_nearest, round(log_ppl_ratio, 6) AS log_ppl_ratio
        FROM nn JOIN (SELECT model_triplet, eval_triplet, sample_idx, log_ppl_ratio FROM long WHERE split = 'test') USING (model_triplet, eval_triplet, sample_idx)""",
    ),
    "features_with_profile": (
        features_profile,
        f"""WITH {LONG}, {audit.VECTORS}, {audit.DIMS}, p AS (SELECT model_triplet AS forget_cluster, exp(avg(log_ppl_ratio) FILTER (layer = 'L1')) AS a, exp(avg(log_ppl_ratio) FILTER (layer = 'L2')) AS b FROM long GROUP BY 1)
        SELECT forget_cluster, round(cn, 6) AS centroid_norm, round(a, 6) AS "geo_L1_ga", round(b, 6) AS "geo_L2_ga", round(2 * a, 6) AS "geo_L1_npo", round(3 * b, 6) AS "geo_L2_npo" FROM dg JOIN p USING (forget_cluster)""",
    ),
    "coverage_with_profile": (
        coverage_profile,
        f"""WITH {LONG}, {audit.VECTORS}, {audit.DIMS}, {audit.COVERAGE}, p AS (SELECT model_triplet AS forget_cluster, exp(avg(log_ppl_ratio)) AS g FROM long WHERE layer = 'L3' GROUP BY 1)
        SELECT forget_cluster, round(avg(f), 6) AS mean_cov, round(max(g), 6) AS "geo_L3" FROM cv JOIN p USING (forget_cluster) GROUP BY 1""",
    ),
    "features_if_present": (features_if_present, "SELECT label, count(*) AS n, CASE WHEN label < 5 THEN count(*) * 2 END AS feature, NULL::BIGINT AS other FROM embeddings GROUP BY 1"),
    "resume_questions": (resumed_questions, "SELECT conv_id * 1000 + turn AS at, md5(text) AS digest FROM conversations WHERE role = 'user' AND conv_id * 1000 + turn >= 40000"),
    "warmup_steps": (
        warmups,
        """SELECT o_orderpriority, (greatest(1, count(*) // 64) * 10)::INT AS steps, floor(greatest(1, count(*) // 64) * 1.5)::INT AS warmup FROM orders GROUP BY 1""",
    ),
    "utc_stamp": (stamped, "SELECT true AS iso, true AS recent"),
    "padded_tokens": (
        tokenized,
        f"""WITH c AS (SELECT doc_id, list_transform(range(1, least(64, length(t)) + 1), lambda i: unicode(substr(t, i, 1))) AS ids FROM ({KEPT}))
        SELECT doc_id, len(ids)::INT AS n, md5(array_to_string(list_transform(range(64 - len(ids)), lambda i: 0) || ids, ',')) AS digest, len(list_filter(ids, lambda x: x <> 0))::INT AS attended FROM c""",
    ),
    "unit_embeddings": (
        embedded,
        f"""WITH c AS (SELECT doc_id, list_transform(string_split('abcdefghij', ''), lambda c: length(t) - length(replace(t, c, ''))) AS v FROM ({KEPT})),
        n AS (SELECT doc_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM c)
        SELECT doc_id, 10 AS n, round((v[1] / n)::DOUBLE, 4) AS first, CASE WHEN n > 1e-9 THEN 1.0 ELSE 0.0 END::DOUBLE AS sq FROM n""",
    ),
    "batch_scores": (batch_scores, "SELECT c_custkey, (length(c_mktsegment) + length(c_name)) / 2 * (1.0 + c_nationkey % 3)::DOUBLE AS score FROM customer"),
    "stop_sequences": (
        stop_marks,
        """WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]') AS ids FROM benchmark)
        SELECT item_id, contains(array_to_string(list_slice(ids, greatest(4, len(ids) - 2), len(ids)), ''), 'e') AND len(ids) > 3 AS done, false AS given FROM b""",
    ),
}
