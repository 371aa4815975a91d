"""Queries of the evaluation framework: sequence views, metrics, attacks, objectives, resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import sequences as S
from plumbline.functions import text as T
from plumbline.operators import metrics as M
from plumbline.operators import objectives as O
from plumbline.operators import ranking as R
from plumbline.operators import scoring
from plumbline.plans.common import LONG, long_table, rounded, triplets
from plumbline.session import table
from plumbline.sources import io

VOCAB = 1000


def words(c="text"):
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)


def token_id(w):
    return (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("bigint") % VOCAB).cast("int")


def token_table(spark, sf):
    """(idx, pos, label, lp, pred): words of the benchmark items; a bigram-free count model gives lp, a hash gives predictions.

    Predictions are right except where a hash of (idx, pos) says otherwise, and always near the end.
    """
    b = table(spark, sf, "benchmark")
    t = b.select(F.col("item_id").alias("idx"), F.posexplode(words()).alias("pos", "w"))
    c = t.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    n = c.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    j = t.join(c, "w").crossJoin(F.broadcast(n))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("idx").cast("string"), F.col("pos").cast("string"))), 1, 4), 16, 10).cast("int")
    label = F.when(F.col("pos") == 0, -100).otherwise(token_id(F.col("w")))
    return j.select("idx", "pos", label.alias("label"), F.log((F.col("c") + 1) / (F.col("n") + F.col("v"))).alias("lp"), F.when(h % 7 == 0, -1).otherwise(label).alias("pred"))


TOK = f"""bt AS (SELECT item_id AS idx, w, p - 1 AS pos FROM (SELECT item_id, unnest(x) AS w, unnest(range(1, len(x) + 1)) AS p FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS x FROM benchmark))),
bc AS (SELECT w, count(*) AS c FROM bt GROUP BY 1), bn AS (SELECT sum(c) AS n, count(*) AS v FROM bc),
tk AS (SELECT idx, pos, CASE WHEN pos = 0 THEN -100 ELSE (('0x' || md5(w)[1:6])::BIGINT % {VOCAB})::INT END AS label, ln((c + 1) / (n + v)) AS lp,
  ('0x' || md5(idx || ':' || pos)[1:4])::INT % 7 = 0 AS miss FROM bt JOIN bc USING (w) CROSS JOIN bn),
tp AS (SELECT *, CASE WHEN miss THEN -1 ELSE label END AS pred FROM tk),
pb AS (SELECT idx, sum(CASE WHEN label <> -100 AND pos > 0 THEN -lp ELSE 0 END) / count(*) FILTER (label <> -100) AS avg_loss FROM tp GROUP BY 1)"""


def answers(spark, sf):
    """Right answers: losses of the items; wrong ones: three variants each."""
    right = M.probability(token_table(spark, sf), "idx")
    wrong = right.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("idx", "k", (F.col("avg_loss") + (F.col("idx") % 5 - 2) * 0.1 * F.col("k")).alias("avg_loss"))
    return right, wrong.withColumn("prob", F.exp(-F.col("avg_loss")))


WRONG = "wr AS (SELECT idx, k, avg_loss + (idx % 5 - 2) * 0.1 * k AS avg_loss FROM pb CROSS JOIN (SELECT unnest([1, 2, 3]) AS k))"


def truth(aggregator):
    def run(spark, sf):
        return rounded(M.aggregate_truth(M.truth_ratio(*answers(spark, sf), aggregator), aggregator))

    return run


def utility(spark, sf):
    """Harmonic mean of three metrics that the graph computes from shared inputs."""
    g = M.MetricGraph()
    g.add("prob", lambda d: M.mean_metric(M.probability(d["tokens"], "idx"), "prob"))
    g.add("es", lambda d: M.mean_metric(M.extraction_strength(d["tokens"])))
    g.add("em", lambda d: M.mean_metric(M.exact_memorization(d["tokens"])))
    g.add("hm", lambda d: M.harmonic_mean(d["a"].unionByName(d["b"]).unionByName(d["c"]), "agg_value"), {"prob": "a", "es": "b", "em": "c"})
    return rounded(g.evaluate(["hm"], {"tokens": token_table(spark, sf)})["hm"])


def metric_summary(spark, sf):
    t = token_table(spark, sf)
    return rounded(M.summary({"em": M.mean_metric(M.exact_memorization(t)), "es": M.mean_metric(M.extraction_strength(t)), "prob": M.mean_metric(M.probability(t, "idx"), "prob")}))


def membership(scores):
    """Items 0, 2, 4 ... as forget set (label 0), the others as holdout (label 1)."""
    return rounded(R.auc(scores.withColumn("label", (F.col("idx") % 2).cast("int"))))


def mia_loss(spark, sf):
    return membership(M.probability(token_table(spark, sf), "idx").withColumn("score", F.round("avg_loss", 9)))


def mia_min_k(spark, sf):
    return rounded(M.min_k(token_table(spark, sf).filter("label <> -100"), 0.4))


def distributions(spark, sf):
    """Token table with small made-up distributions: log softmax of (lp, lp - 1, -3)."""
    t = token_table(spark, sf).filter("label <> -100")
    z = F.array(F.col("lp"), F.col("lp") - 1, F.lit(-3.0))
    return t.withColumn("logits", z).withColumn("lse", O.log_sum_exp(F.col("logits"))).withColumn("dist", F.transform("logits", lambda x: x - F.col("lse"))).withColumn("lp", F.get("dist", F.lit(0)))


DISTS = """ds AS (SELECT idx, pos, lp AS l0, lp - ln(exp(lp) + exp(lp - 1) + exp(-3)) AS a, lp - 1 - ln(exp(lp) + exp(lp - 1) + exp(-3)) AS b, -3 - ln(exp(lp) + exp(lp - 1) + exp(-3)) AS c FROM tp WHERE label <> -100)"""


def mia_reference(spark, sf):
    right, wrong = answers(spark, sf)
    ref = wrong.filter("k = 1").select("idx", F.col("avg_loss").alias("ref"))
    return rounded(right.join(ref, "idx").select("idx", (F.col("avg_loss") - F.col("ref")).alias("score")))


def mia_zlib(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("idx"), T.zlib_length("text").alias("z"))
    return rounded(M.probability(token_table(spark, sf), "idx").join(b, "idx").select("idx", M.zlib_ratio(F.col("avg_loss"), F.col("z")).alias("score")))


def privleak(spark, sf):
    a = mia_loss(spark, sf)
    return rounded(a.select(R.privleak(F.col("auc"), F.lit(None).cast("double")).alias("privleak"), R.relative_difference(F.col("auc"), F.lit(0.6)).alias("rel_diff")))


def sequences(spark, sf):
    """(idx, nll, ref_nll, n) on whole items."""
    t = token_table(spark, sf).filter("label <> -100").select("idx", "pos", (-F.col("lp")).alias("nll"))
    return t, O.sequence_nll(t).withColumn("ref_nll", F.col("nll") * 0.9 + F.col("idx") % 3)


def objective_losses(spark, sf):
    t, s = sequences(spark, sf)
    forget, retain = t.filter("idx % 2 = 0"), t.filter("idx % 2 = 1")
    win = s.select("idx", (F.col("nll") * 0.8).alias("nll"), (F.col("ref_nll") * 0.9).alias("ref_nll"))
    made = {
        "grad_ascent": O.grad_ascent(forget), "grad_diff": O.grad_diff(forget, retain, 1.0, 2.0), "npo": O.npo(s, 0.1), "dpo": O.dpo(win, s, 0.1),
        "simnpo": O.simnpo(s, 4.5, 0.5), "wga": O.wga(t, 0.5), "satimp": O.satimp(t, 2.0, 1.0),
    }
    out = None
    for name, df in made.items():
        row = df.select(F.lit(name).alias("objective"), "loss")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


def distribution_losses(spark, sf):
    d = distributions(spark, sf).withColumn("label", F.pmod("label", F.lit(3))).withColumn("teacher", F.transform("logits", lambda x: x * 0.5))
    made = {"undial": O.undial(d, 2.0), "ceu": O.ceu(d, 2), "pdu": O.pdu(d), "rmu": O.rmu(d.select(F.col("logits").alias("activation"), F.col("teacher").alias("control")))}
    made["kl"] = d.agg(F.avg(O.kl(F.col("dist"), F.transform("dist", lambda x: x * 1.1))).alias("loss"))
    out = None
    for name, df in made.items():
        row = df.select(F.lit(name).alias("objective"), "loss")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


def chunked(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.transform(words(), token_id).alias("ids"))
    c = S.chunks(b, "item_id", "ids", 64)
    return c.select("chunk", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0), lambda s, x: s + x).alias("id_sum"), F.get("tokens", F.lit(0)).alias("first_id"))


def prompts(spark, sf):
    """(item_id, prompt ids, answer ids): the first five words and the rest."""
    ids = F.transform(words(), token_id)
    return table(spark, sf, "benchmark").select("item_id", F.slice(ids, 1, 5).alias("p"), F.slice(ids, 6, F.greatest(F.size(ids) - 5, F.lit(0))).alias("a"))


def masked(spark, sf):
    p = prompts(spark, sf)
    ids, labels = S.chat_labels(F.col("p"), F.col("a"), 2)
    c_ids, c_labels = S.completion_labels(F.col("p"), F.col("a"), 8)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    return p.select(
        "item_id", F.size(ids).alias("n"), total(labels).alias("label_sum"), F.size(S.target_ids(labels)).alias("n_targets"), F.size(S.valid_labels(labels)).alias("n_valid"),
        total(S.shifted(labels)).alias("shifted_sum"), F.size(c_ids).alias("c_n"), total(c_labels).alias("c_sum"),
    )


def padded(spark, sf):
    p = prompts(spark, sf)
    p = p.crossJoin(F.broadcast(p.agg(F.max(F.size("a")).alias("longest"))))
    right, left = S.pad(F.col("a"), F.col("longest"), 0), S.pad(F.col("a"), F.col("longest"), 0, left=True)
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    return p.select("item_id", F.size(right).alias("n"), total(S.attention(right, 0)).alias("live"), F.get(left, F.lit(0)).alias("left_first"), F.get(right, F.size(right) - 1).alias("right_last"))


def pairing(spark, sf):
    """Every forget document with a drawn retain document, and every item with a drawn refusal."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    forget, retain = d.filter("doc_id % 10 = 0"), d.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("retain_id"))
    return S.pick(forget.select("doc_id"), "doc_id", retain, "retain_id", seed=1)


def idk(spark, sf):
    pool = table(spark, sf, "benchmark").filter("item_id < 7").select(F.col("item_id").alias("idk_id"))
    q = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("k"))
    return S.pick(q, "k", pool, "idk_id", seed=3, epoch=2).select("conv_id", "turn", "idk_id")


def few(spark, sf):
    b = table(spark, sf, "benchmark")
    p = S.few_shot(b.select("item_id"), b.filter("item_id % 2 = 0"), "item_id", "text", 3)
    return p.select("item_id", F.md5("prefix").alias("prefix"), F.length("prefix").alias("n"))


def rouge(spark, sf):
    """Item against item: the first half of the words as reference, all but every third as generated."""
    w = table(spark, sf, "benchmark").select("item_id", words().alias("ref"))
    return w.withColumn("gen", F.filter("ref", lambda x, i: i % 3 != 0))


def rouge1(spark, sf):
    return rounded(rouge(spark, sf).select("item_id", S.rouge1_recall(F.col("ref"), F.col("gen")).alias("recall")))


def rouge_l(spark, sf):
    r = rouge(spark, sf).select("item_id", S.rouge_l("ref", "gen").alias("s"))
    return rounded(r.select("item_id", "s.recall", "s.f1"))


def rouge_stemmed(spark, sf):
    """Both scores over stems, as overlap is scored where inflected forms count as hits."""
    r = rouge(spark, sf).select("item_id", S.stems("ref").alias("ref"), S.stems("gen").alias("gen"))
    r = r.select("item_id", S.rouge1_recall(F.col("ref"), F.col("gen")).alias("rouge1_recall"), S.rouge_l("ref", "gen").alias("l"))
    return rounded(r.select("item_id", "rouge1_recall", F.col("l.recall").alias("rougeL_recall"), F.col("l.f1").alias("rougeL_f1")))


def resume(spark, sf):
    t = triplets(spark, sf).select("triplet").distinct()
    todo = t.select(F.col("triplet").alias("model_triplet")).crossJoin(t.select(F.col("triplet").alias("eval_triplet")))
    done = long_table(spark, sf).filter("split = 'train' AND base_ppl > unlearn_ppl").select("model_triplet", "eval_triplet")
    return io.resumable(todo, done, "model_triplet", "eval_triplet")


def run_status(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def sections(spark, sf):
    old = table(spark, sf, "nation").select(F.col("n_name").alias("section"), F.col("n_regionkey").cast("string").alias("body"))
    new = old.filter("body IN ('0', '1')").select("section", F.concat(F.lit("new"), "body").alias("body")).unionByName(spark.createDataFrame([("extra", "x")], "section string, body string"))
    return io.merge_sections(old, new)


def metric_keys(spark, sf):
    rows = [("mmlu", "acc,none", 0.5), ("mmlu", "alias", 0.0), ("gsm", "exact_match,strict-match", 0.25)]
    d = spark.createDataFrame(rows, "task string, key string, value double")
    return d.select(T.metric_key(F.col("task"), F.col("key")).alias("metric"), "value").filter("metric IS NOT NULL")


def truncated(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.truncate_at(F.col("text"), ["\n", ". "])).alias("cut"))


def classifier(spark, sf):
    """Probability of the quality label from text length, by logistic regression, and its mean as a metric."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.log1p("n_chars").alias("a"), F.col("quality").cast("double").alias("label"))
    d = VectorAssembler(inputCols=["a"], outputCol="features").transform(d)
    p = LogisticRegression(maxIter=50).fit(d).transform(d)
    return rounded(p.select("doc_id", F.get(vector_to_array("probability"), F.lit(1)).alias("score")), 4)


def collapse(spark, sf):
    """Answers of an item as lists in order, and their mean."""
    _, wrong = answers(spark, sf)
    g = wrong.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("k", F.round("avg_loss", 6).alias("l")))).alias("ls"), F.avg("avg_loss").alias("mean"))
    return rounded(g.select("idx", F.array_join(F.transform("ls", lambda x: F.format_string("%.4f", x["l"])), ",").alias("losses"), "mean"))


def sane_scores(spark, sf):
    return rounded(scoring.weighted_loss(long_table(spark, sf), "model_triplet", loss="unlearn_loss"))


def tok(sql: str) -> str:
    return f"WITH {TOK}, {sql}" if sql.lstrip().startswith(("wr AS", "ds AS", "x AS", "q AS", "sq AS")) else f"WITH {TOK} {sql}"


ES = "q AS (SELECT idx, pred, label, row_number() OVER (PARTITION BY idx ORDER BY pos) - 1 AS i FROM tp WHERE label <> -100), es AS (SELECT idx, 1 - least(coalesce(max(i) FILTER (pred <> label) + 1, 0), count(*) - 1) / count(*) AS score FROM q GROUP BY 1)"
IDS = f"list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: (('0x' || md5(w)[1:6])::BIGINT % {VOCAB})::INT)"
SEQ = "sq AS (SELECT idx, sum(-lp) AS nll, count(*) AS n, sum(-lp) * 0.9 + idx % 3 AS ref FROM tp WHERE label <> -100 GROUP BY 1)"
LOGSIG = "(least({x}, 0) - ln(1 + exp(-abs({x}))))"
QUERIES = {
    "probability": (lambda s, sf: rounded(M.probability(token_table(s, sf), "idx")), tok("SELECT idx, round(avg_loss, 6) AS avg_loss, round(exp(-avg_loss), 6) AS prob FROM pb")),
    "prob_options": (
        lambda s, sf: rounded(M.probability_with_options(*answers(s, sf))),
        tok(f"{WRONG}, w AS (SELECT idx, sum(exp(-avg_loss)) AS w FROM wr GROUP BY 1) SELECT idx, round(exp(-avg_loss) / (exp(-avg_loss) + w + 1e-10), 6) AS score FROM pb JOIN w USING (idx)"),
    ),
    "truth_ratio": (
        truth("closer_to_1_better"),
        tok(f"{WRONG}, w AS (SELECT idx, avg(avg_loss) AS l FROM wr GROUP BY 1), s AS (SELECT exp(-l) / (exp(-avg_loss) + 1e-10) AS s FROM pb JOIN w USING (idx)) SELECT round(avg(least(s, 1 / (s + 1e-10))), 6) AS agg_value FROM s"),
    ),
    "truth_ratio_true_better": (
        truth("true_better"),
        tok(f"{WRONG}, w AS (SELECT idx, avg(avg_loss) AS l FROM wr GROUP BY 1), s AS (SELECT exp(-l) / (exp(-avg_loss) + 1e-10) AS s FROM pb JOIN w USING (idx)) SELECT round(avg(greatest(0, 1 - s)), 6) AS agg_value FROM s"),
    ),
    "truth_ratio_prob_mean": (
        truth("prob_mean"),
        tok(f"{WRONG}, w AS (SELECT idx, avg(avg_loss) AS l FROM wr GROUP BY 1), s AS (SELECT exp(-avg_loss) / (exp(-avg_loss) + exp(-l) + 1e-10) AS s FROM pb JOIN w USING (idx)) SELECT round(avg(s), 6) AS agg_value FROM s"),
    ),
    "multi_answer_collapse": (
        collapse,
        tok(f"{WRONG} SELECT idx, string_agg(printf('%.4f', round(avg_loss, 6)), ',' ORDER BY k) AS losses, round(avg(avg_loss), 6) AS mean FROM wr GROUP BY 1"),
    ),
    "exact_memorization": (lambda s, sf: rounded(M.exact_memorization(token_table(s, sf))), tok("SELECT idx, round(avg((pred = label)::INT), 6) AS score FROM tp WHERE label <> -100 GROUP BY 1")),
    "extraction_strength": (lambda s, sf: rounded(M.extraction_strength(token_table(s, sf))), tok(f"{ES} SELECT idx, round(score, 6) AS score FROM es")),
    "model_utility": (
        utility,
        tok(f"""{ES}, v AS (SELECT avg(exp(-avg_loss)) AS x FROM pb UNION ALL SELECT avg(score) FROM es UNION ALL
            SELECT avg(s) FROM (SELECT avg((pred = label)::INT) AS s FROM tp WHERE label <> -100 GROUP BY idx)) SELECT round(CASE WHEN min(x) <= 0 THEN 0 ELSE count(x) / sum(1 / x) END, 6) AS hm FROM v"""),
    ),
    "metric_summary": (
        metric_summary,
        tok(f"""{ES} SELECT 'prob' AS metric, round(avg(exp(-avg_loss)), 6) AS agg_value FROM pb UNION ALL SELECT 'es', round(avg(score), 6) FROM es UNION ALL
            SELECT 'em', round(avg(s), 6) FROM (SELECT avg((pred = label)::INT) AS s FROM tp WHERE label <> -100 GROUP BY idx)"""),
    ),
    "mia_loss_auc": (
        mia_loss,
        tok("""x AS (SELECT round(avg_loss, 9) AS score, idx % 2 AS label FROM pb), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM x)
            SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r"""),
    ),
    "mia_min_k": (
        mia_min_k,
        tok("""q AS (SELECT idx, list(lp ORDER BY lp) AS a FROM tp WHERE label <> -100 GROUP BY 1) SELECT idx, round(-list_avg(a[1:greatest(1, floor(len(a) * 0.4)::INT)]), 6) AS score FROM q"""),
    ),
    "mia_min_k_plus_plus": (
        lambda s, sf: rounded(M.min_k_plus_plus(distributions(s, sf)), 5),
        tok(f"""{DISTS}, m AS (SELECT idx, a, exp(a) * a + exp(b) * b + exp(c) * c AS mu, exp(a) * a * a + exp(b) * b * b + exp(c) * c * c AS m2 FROM ds),
            z AS (SELECT idx, list((a - mu) / sqrt(greatest(m2 - mu * mu, 1e-6)) ORDER BY (a - mu) / sqrt(greatest(m2 - mu * mu, 1e-6))) AS z FROM m GROUP BY 1)
            SELECT idx, round(-list_avg(z[1:greatest(1, floor(len(z) * 0.4)::INT)]), 5) AS score FROM z"""),
    ),
    "mia_reference": (mia_reference, tok(f"{WRONG} SELECT idx, round(pb.avg_loss - wr.avg_loss, 6) AS score FROM pb JOIN wr USING (idx) WHERE k = 1")),
    "mia_zlib": (mia_zlib, None),
    "grad_norms": (
        lambda s, sf: rounded(table(s, sf, "embeddings").select("vec_id", *(M.p_norm(F.col("embedding").cast("array<double>"), p).alias(n) for n, p in (("l1", 1), ("l2", 2), ("linf", float("inf")))))),
        """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS l1, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l2,
        round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS linf FROM embeddings""",
    ),
    "privleak": (
        privleak,
        tok("""x AS (SELECT round(avg_loss, 9) AS score, idx % 2 AS label FROM pb), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM x),
            a AS (SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r)
            SELECT round((1 - auc - 0.5) / (0.5 + 1e-10) * 100, 6) AS privleak, round((auc - 0.6) / (0.6 + 1e-10) * 100, 6) AS rel_diff FROM a"""),
    ),
    "objective_losses": (
        objective_losses,
        tok(f"""{SEQ}, t AS (SELECT idx, -lp AS nll FROM tp WHERE label <> -100)
            SELECT 'grad_ascent' AS objective, round(-avg(nll), 6) AS loss FROM t WHERE idx % 2 = 0
            UNION ALL SELECT 'grad_diff', round(-avg(nll) FILTER (idx % 2 = 0) + 2 * avg(nll) FILTER (idx % 2 = 1), 6) FROM t
            UNION ALL SELECT 'npo', round(-20 * avg({LOGSIG.format(x='(0.1 * (nll - ref))')}), 6) FROM sq
            UNION ALL SELECT 'dpo', round(-20 * avg({LOGSIG.format(x='(0.1 * (-(nll * 0.8 - ref * 0.9) + (nll - ref)))')}), 6) FROM sq
            UNION ALL SELECT 'simnpo', round(-2 / 4.5 * avg({LOGSIG.format(x='(4.5 * (nll / n - 0.5))')}), 6) FROM sq
            UNION ALL SELECT 'wga', round(-avg(sqrt(exp(-nll)) * nll), 6) FROM t
            UNION ALL SELECT 'satimp', round(-avg(exp(-nll) ** 2 * (1 - exp(-nll)) * nll), 6) FROM t"""),
    ),
    "distribution_losses": (
        distribution_losses,
        tok("""q AS (SELECT pos, label % 3 AS l, [lp, lp - 1, -3.0] AS z FROM tp WHERE label <> -100),
            e AS (SELECT *, ln(list_sum(list_transform(z, lambda x: exp(x)))) AS lse FROM q),
            s AS (SELECT *, list_transform(z, lambda x, i: exp(0.5 * x - CASE WHEN i - 1 = l THEN 2 ELSE 0 END)) AS t, list_transform(z, lambda x, i: CASE WHEN i - 1 = l THEN 0 ELSE exp(x) END) AS c FROM e)
            SELECT 'undial' AS objective, round(avg(-list_sum(list_transform(z, lambda x, i: t[i] / list_sum(t) * (x - lse)))), 6) AS loss FROM s
            UNION ALL SELECT 'ceu', round(avg(-list_sum(list_transform(z, lambda x, i: c[i] / list_sum(c) * (x - lse)))), 6) FROM s WHERE pos >= 2
            UNION ALL SELECT 'pdu', round(avg((list_max(z) - list_avg(z)) ** 2), 6) FROM s
            UNION ALL SELECT 'rmu', round(avg(list_avg(list_transform(z, lambda x: (0.5 * x) ** 2))), 6) FROM s
            UNION ALL SELECT 'kl', round(avg(list_sum(list_transform(z, lambda x: exp(x - lse) * -0.1 * (x - lse)))), 6) FROM s"""),
    ),
    "chunked_tokens": (
        chunked,
        f"""WITH i AS (SELECT item_id, {IDS} AS ids FROM benchmark), l AS (SELECT item_id, unnest(ids) AS t, unnest(range(len(ids))) AS p FROM i),
        o AS (SELECT t, row_number() OVER (ORDER BY item_id, p) - 1 AS place FROM l)
        SELECT floor(place / 64)::INT AS chunk, count(*)::INT AS n, sum(t)::INT AS id_sum, arg_min(t, place) AS first_id FROM o GROUP BY 1""",
    ),
    "masked_labels": (
        masked,
        f"""WITH i AS (SELECT item_id, {IDS} AS ids FROM benchmark), p AS (SELECT item_id, ids[1:5] AS p, ids[6:1005] AS a FROM i)
        SELECT item_id, (len(p) + len(a) + 1)::INT AS n, (-100 * len(p) + coalesce(list_sum(a), 0) + 2)::INT AS label_sum, (len(a) + 1)::INT AS n_targets, len(a)::INT AS n_valid,
        (-100 * (len(p) - 1) + coalesce(list_sum(a), 0) + 2)::INT AS shifted_sum, least(len(p) + len(a), len(p) + 8)::INT AS c_n,
        (-100 * len(p) + coalesce(list_sum(a[1:8]), 0))::INT AS c_sum FROM p""",
    ),
    "padded_batch": (
        padded,
        f"""WITH i AS (SELECT item_id, {IDS} AS ids FROM benchmark), p AS (SELECT item_id, ids[6:1005] AS a FROM i), m AS (SELECT *, max(len(a)) OVER () AS n FROM p)
        SELECT item_id, n::INT AS n, len(list_filter(a, lambda x: x <> 0))::INT AS live, CASE WHEN len(a) < n THEN 0 ELSE a[1] END AS left_first, CASE WHEN len(a) < n THEN 0 ELSE a[-1] END AS right_last FROM m""",
    ),
    "retain_pairing": (
        pairing,
        """WITH r AS (SELECT doc_id AS retain_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE doc_id % 10 <> 0)
        SELECT doc_id, retain_id FROM documents JOIN r ON i = ('0x' || md5('1:0:' || doc_id)[1:8])::BIGINT % (SELECT count(*) FROM r) WHERE doc_id % 10 = 0""",
    ),
    "idk_pairing": (
        idk,
        """WITH r AS (SELECT item_id AS idk_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark WHERE item_id < 7)
        SELECT conv_id, turn, idk_id FROM conversations JOIN r ON i = ('0x' || md5('3:2:' || conv_id || '-' || turn)[1:8])::BIGINT % (SELECT count(*) FROM r) WHERE role = 'user'""",
    ),
    "fewshot_prompts": (
        few,
        """WITH p AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY item_id) AS prefix FROM (SELECT * FROM benchmark WHERE item_id % 2 = 0 ORDER BY item_id LIMIT 3))
        SELECT item_id, md5(prefix) AS prefix, length(prefix)::INT AS n FROM benchmark CROSS JOIN p""",
    ),
    "rouge1_recall": (
        rouge1,
        """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS r FROM benchmark), a AS (SELECT item_id, unnest(r) AS w, unnest(range(len(r))) AS i, len(r) AS n FROM w),
        c AS (SELECT item_id, w, n, count(*) AS cr, count(*) FILTER (i % 3 <> 0) AS cg FROM a GROUP BY 1, 2, 3) SELECT item_id, round(sum(least(cr, cg)) / n, 6) AS recall FROM c GROUP BY item_id, n""",
    ),
    "rougeL": (
        rouge_l,
        """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS r FROM benchmark), g AS (SELECT item_id, r, list_filter(r, lambda x, i: (i - 1) % 3 <> 0) AS g FROM w),
        l AS (SELECT item_id, r, g, list_reduce(r, lambda row, x: list_reduce(range(1, len(g) + 1), lambda a, j: list_append(a, CASE WHEN g[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], a[j]) END), [0::BIGINT]),
          list_transform(range(len(g) + 1), lambda j: 0::BIGINT))[len(g) + 1] AS n FROM g),
        p AS (SELECT item_id, n, n / greatest(1, len(r)) AS rec, n / greatest(1, len(g)) AS pre FROM l)
        SELECT item_id, round(rec, 6) AS recall, CASE WHEN n > 0 THEN round(2 * rec * pre / (rec + pre), 6) ELSE 0.0 END AS f1 FROM p""",
    ),
    "rouge_stemmed": (rouge_stemmed, None),
    "resume_remaining": (
        resume,
        f"""WITH {LONG}, n AS (SELECT DISTINCT triplet FROM trip), d AS (SELECT DISTINCT model_triplet, eval_triplet FROM long WHERE split = 'train' AND base_ppl > unlearn_ppl)
        SELECT a.triplet AS model_triplet, b.triplet AS eval_triplet FROM n a CROSS JOIN n b ANTI JOIN d ON d.model_triplet = a.triplet AND d.eval_triplet = b.triplet""",
    ),
    "unlearned_loss_by_model": (
        sane_scores,
        f"""WITH {LONG} SELECT model_triplet, round(sum(unlearn_loss * n_tokens) / sum(n_tokens), 6) AS avg_loss, round(exp(sum(unlearn_loss * n_tokens) / sum(n_tokens)), 6) AS ppl,
        sum(n_tokens)::BIGINT AS n_tokens FROM long GROUP BY 1""",
    ),
    "run_status": (run_status, "SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "merge_sections": (
        sections,
        "SELECT n_name AS section, CASE WHEN n_regionkey IN (0, 1) THEN 'new' ELSE '' END || n_regionkey AS body FROM nation UNION ALL SELECT 'extra', 'x'",
    ),
    "metric_keys": (metric_keys, "SELECT * FROM (VALUES ('mmlu/acc', 0.5::DOUBLE), ('gsm/exact_match', 0.25::DOUBLE)) t(metric, value)"),
    "truncate_at_stops": (truncated, "SELECT doc_id, md5(string_split(string_split(text, chr(10))[1], '. ')[1]) AS cut FROM documents"),
    "classifier_prob": (classifier, None),
}
