"""Queries over the long perplexity table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import corruption as C
from plumbline.operators import scoring
from plumbline.plans.common import LONG, long_table, rounded
from plumbline.session import table


def on_long(fn):
    return lambda spark, sf: rounded(fn(long_table(spark, sf)))


def with_long(sql: str) -> str:
    return f"WITH {LONG}\n{sql}"


STATS = """count(*) AS n, round(avg({x}), 6) AS mean, round(quantile_cont({x}, 0.5), 6) AS median, round(stddev_pop({x}), 6) AS std,
 round(exp(avg({x})), 6) AS geo, round(avg(({x} > ln(1.1))::INT) * 100, 6) AS pct_up_10,
 round(avg(({x} > ln(2))::INT) * 100, 6) AS pct_up_2x, round(avg(({x} < ln(1 / 1.1))::INT) * 100, 6) AS pct_down_10"""


def bulk(spark, sf):
    """The same statistics on a large table of ratios."""
    li = table(spark, sf, "lineitem")
    ratio = (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    x = scoring.log_ratio(F.col("l_extendedprice") * ratio, F.col("l_extendedprice"))
    return rounded(C.describe(li.select(F.col("l_returnflag").alias("layer"), F.round(x, 9).alias("log_ppl_ratio")), "layer"))


def nested_pairs(spark, sf):
    """The long table nested as it is exchanged, and flattened again."""
    lt = long_table(spark, sf)
    side = lambda s: F.transform(
        F.sort_array(F.collect_list(F.struct("sample_idx", F.col(f"{s}_loss").alias("loss"), F.col(f"{s}_ppl").alias("ppl"), "n_tokens"))), lambda r: r.dropFields("sample_idx")
    )
    arrays = lt.groupBy("model_triplet", "eval_triplet", "split").agg(side("base").alias("b"), side("unlearn").alias("u"))
    maps = lambda c: F.map_from_entries(F.collect_list(F.struct("split", c)))
    pairs = arrays.groupBy("model_triplet", "eval_triplet").agg(maps("b").alias("base"), maps("u").alias("unlearn"))
    flat = C.flatten_pairs(pairs, strict=True)
    return rounded(flat.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("base_loss").alias("mean_base"), F.avg("unlearn_ppl").alias("mean_ppl"), F.max("sample_idx").alias("last_idx")))


def pair_matrix(spark, sf):
    """The corner that the SQL names; pair_matrix_full has all models and sets."""
    names = ["triplet_001", "triplet_002", "triplet_003", "triplet_004"]
    m = C.pair_matrix(long_table(spark, sf).filter(F.col("eval_triplet").isin(names) & F.col("model_triplet").isin(names)), names)
    return rounded(m)


def lights(spark, sf):
    p = C.profile(long_table(spark, sf)).select("forget_cluster", F.round("geo_L1", 6).alias("geo"))
    return p.withColumn("light", C.traffic_light(F.col("geo")))


GEO = "round(exp(avg(CASE WHEN layer = '{x}' THEN log_ppl_ratio END)), 6)"
QUERIES = {
    "ppl_long": (on_long(lambda d: d), with_long("SELECT * REPLACE (round(log_ppl_ratio, 6) AS log_ppl_ratio) FROM long")),
    "layer_summary": (on_long(lambda d: C.describe(d, "layer")), with_long(f"SELECT layer, {STATS.format(x='log_ppl_ratio')} FROM long GROUP BY 1")),
    "layer_headline": (
        on_long(C.headline),
        with_long("""SELECT layer, count(*) AS n, round(exp(avg(log_ppl_ratio)), 6) AS geo, round(avg(log_ppl_ratio), 6) AS mean,
            round(avg((log_ppl_ratio > ln(1.1))::INT) * 100, 6) AS pct_up_10, round(avg((log_ppl_ratio > ln(2))::INT) * 100, 6) AS pct_up_2x
            FROM long WHERE layer <> 'L3_other' GROUP BY 1"""),
    ),
    "forget_profile": (
        on_long(C.profile),
        with_long("SELECT model_triplet AS forget_cluster, " + ", ".join(f"{GEO.format(x=x)} AS geo_{x}, count(*) FILTER (layer = '{x}') AS n_{x}" for x in ("L1", "L2", "L3")) + " FROM long GROUP BY 1"),
    ),
    "layer_in_out": (
        on_long(C.in_and_out),
        with_long("""SELECT triplet, l3_out, l3_in FROM
            (SELECT model_triplet AS triplet, round(exp(avg(log_ppl_ratio)), 6) AS l3_out FROM long WHERE layer = 'L3' GROUP BY 1)
            FULL JOIN (SELECT eval_triplet AS triplet, round(exp(avg(log_ppl_ratio)), 6) AS l3_in FROM long WHERE layer = 'L3' GROUP BY 1) USING (triplet)"""),
    ),
    "pair_means": (on_long(C.pair_means), with_long("SELECT model_triplet, eval_triplet, round(avg(log_ppl_ratio), 6) AS pair_mean FROM long WHERE split = 'test' GROUP BY 1, 2")),
    "pair_matrix": (
        pair_matrix,
        with_long("SELECT model_triplet, " + ", ".join(f"round(avg(log_ppl_ratio) FILTER (eval_triplet = 'triplet_00{i}'), 6) AS triplet_00{i}" for i in range(1, 5)) + """
            FROM long WHERE split = 'test' AND model_triplet IN ('triplet_001', 'triplet_002', 'triplet_003', 'triplet_004') GROUP BY 1"""),
    ),
    "pair_matrix_full": (on_long(C.pair_matrix), None),
    "self_vs_cross": (
        on_long(C.self_vs_cross),
        with_long(""", pm AS (SELECT model_triplet = eval_triplet AS own, avg(log_ppl_ratio) AS m FROM long WHERE split = 'test' GROUP BY model_triplet, eval_triplet),
            g AS (SELECT exp(avg(m) FILTER (own)) AS a, exp(avg(m) FILTER (NOT own)) AS b FROM pm)
            SELECT round(a, 6) AS self_geo, round(b, 6) AS cross_geo, round(a / b, 6) AS multiplier FROM g""").replace("\n, pm", ", pm"),
    ),
    "retained_damage": (
        on_long(C.retained_damage),
        with_long(""", g AS (SELECT exp(avg(log_ppl_ratio) FILTER (layer = 'L1')) AS g1, exp(avg(log_ppl_ratio) FILTER (layer = 'L2')) AS g2,
            exp(avg(log_ppl_ratio) FILTER (layer = 'L3')) AS g3 FROM long)
            SELECT CASE WHEN g1 > 1 THEN round((g2 - 1) / (g1 - 1) * 100, 6) END AS l2_retained_pct,
                   CASE WHEN g1 > 1 THEN round((g3 - 1) / (g1 - 1) * 100, 6) END AS l3_retained_pct FROM g""").replace("\n, g ", ", g "),
    ),
    "base_ppl_gap": (
        on_long(C.base_gap),
        with_long(""", b AS (SELECT layer, exp(avg(ln(greatest(base_ppl, 1e-6)))) AS g FROM long GROUP BY 1)
            SELECT layer, round(g, 6) AS geo_base, round(g / (SELECT g FROM b WHERE layer = 'L1') - 1, 6) AS gap FROM b""").replace("\n, b ", ", b "),
    ),
    "layer_spread": (
        on_long(lambda d: C.spread(C.profile(d))),
        with_long(""", p AS (SELECT layer, model_triplet, exp(avg(log_ppl_ratio)) AS g FROM long WHERE layer <> 'L3_other' GROUP BY 1, 2)
            SELECT layer, round(max(g) / min(g), 6) AS spread FROM p GROUP BY 1""").replace("\n, p ", ", p "),
    ),
    "invariants": (
        on_long(C.invariants),
        with_long("""SELECT count(*) FILTER (base_ppl IS NULL OR base_ppl <= 0 OR unlearn_ppl IS NULL OR unlearn_ppl <= 0) = 0 AS no_bad_rows,
            count(DISTINCT model_triplet || eval_triplet) = count(DISTINCT model_triplet) * count(DISTINCT eval_triplet) AS all_pairs,
            avg(log_ppl_ratio) FILTER (layer = 'L1') > avg(log_ppl_ratio) FILTER (layer = 'L3') AS l1_above_l3,
            avg(log_ppl_ratio) FILTER (layer = 'L1') > avg(log_ppl_ratio) FILTER (layer = 'L2') AS l1_above_l2,
            avg(log_ppl_ratio) FILTER (layer = 'L1') > 0 AS l1_damaged FROM long"""),
    ),
    "bad_rows": (
        on_long(lambda d: C.bad_rows(d, "base_ppl", "unlearn_ppl")),
        with_long("""SELECT count(*) FILTER (base_ppl IS NULL OR isnan(base_ppl)) AS base_ppl_missing, count(*) FILTER (base_ppl <= 0) AS base_ppl_nonpositive,
            count(*) FILTER (unlearn_ppl IS NULL OR isnan(unlearn_ppl)) AS unlearn_ppl_missing, count(*) FILTER (unlearn_ppl <= 0) AS unlearn_ppl_nonpositive FROM long"""),
    ),
    "weighted_loss": (
        on_long(lambda d: scoring.weighted_loss(d.filter("model_triplet = eval_triplet"), "eval_triplet", "split")),
        with_long("""SELECT eval_triplet, split, round(sum(base_loss * n_tokens) / sum(n_tokens), 6) AS avg_loss,
            round(exp(sum(base_loss * n_tokens) / sum(n_tokens)), 6) AS ppl, sum(n_tokens)::BIGINT AS n_tokens
            FROM long WHERE model_triplet = eval_triplet GROUP BY 1, 2"""),
    ),
    "traffic_lights": (
        lights,
        with_long(""", p AS (SELECT model_triplet AS forget_cluster, round(exp(avg(log_ppl_ratio)), 6) AS geo FROM long WHERE layer = 'L1' GROUP BY 1)
            SELECT *, CASE WHEN geo < 1.2 THEN 'green' WHEN geo < 1.32 THEN 'yellow' ELSE 'red' END AS light FROM p""").replace("\n, p ", ", p "),
    ),
    "flatten_pairs": (
        nested_pairs,
        with_long("""SELECT split, count(*) AS n, round(avg(base_loss), 6) AS mean_base, round(avg(unlearn_ppl), 6) AS mean_ppl,
            max(sample_idx) AS last_idx FROM long GROUP BY 1"""),
    ),
    "bulk_ratio_describe": (
        bulk,
        f"""WITH b AS (SELECT l_returnflag AS layer, round(ln(greatest(l_extendedprice * ((1 - l_discount) * (1 + l_tax)), 1e-6) / greatest(l_extendedprice, 1e-6)), 9) AS x FROM lineitem)
            SELECT layer, {STATS.format(x='x')} FROM b GROUP BY 1""",
    ),
}
