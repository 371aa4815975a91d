"""Micro-checks of statistics, models and clustering against plain numpy or known values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import sequences as S
from plumbline.operators import clustering, corruption, metrics, models, ranking, scoring, vectors
from plumbline.plans import framework


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_layers_and_zero_tokens(spark):
    df = table(spark, [("a", "a", "train"), ("a", "a", "test"), ("a", "b", "test"), ("a", "b", "train")], "m string, e string, s string")
    assert [r[0] for r in df.select(corruption.layer(F.col("m"), F.col("e"), F.col("s"))).collect()] == ["L1", "L2", "L3", "L3_other"]
    w = scoring.weighted_loss(table(spark, [("x", 2.0, 1), ("x", 4.0, 3), ("y", 1.0, 0)], "k string, base_loss double, n_tokens int"), "k")
    got = {r["k"]: r["avg_loss"] for r in w.collect()}
    assert got == {"x": 3.5, "y": math.inf}


def test_flatten_truncates_or_skips(spark):
    a = {"loss": 1.0, "ppl": 2.0, "n_tokens": 3}
    schema = "model_triplet string, eval_triplet string, base map<string,array<struct<loss:double,ppl:double,n_tokens:int>>>, unlearn map<string,array<struct<loss:double,ppl:double,n_tokens:int>>>"
    df = table(spark, [("m", "e", {"test": [a, a, a], "train": [a]}, {"test": [a, a], "train": [a]})], schema)
    assert corruption.flatten_pairs(df).count() == 3
    assert corruption.flatten_pairs(df, strict=True).count() == 1


def test_ranking_degenerate_cases(spark):
    same = table(spark, [(i, 1.0, float(i)) for i in range(5)], "key int, y double, p double")
    assert ranking.ndcg(same, 3).first()[0] == 1.0
    r = ranking.correlations(same).first()
    assert r["spearman"] is None and r["pearson"] is None
    ties = table(spark, [(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 3.0, 6.0)], "key int, y double, p double")
    assert ranking.kendall_concordance(ties).first()["concordance"] == pytest.approx(2 / 3)
    assert ranking.kendall_concordance(ties).first()["kendall"] == pytest.approx(2 / math.sqrt(6))
    assert [ranking.share_to_k(n, p) for n, p in ((100, 10), (5, 1), (25, 10), (35, 10))] == [10, 1, 2, 4]


def test_ks_exact_by_enumeration():
    from itertools import combinations

    n0, n1 = 4, 5
    stats = []
    for pick in combinations(range(n0 + n1), n0):
        a = np.cumsum([i in pick for i in range(n0 + n1)]) / n0
        b = np.cumsum([i not in pick for i in range(n0 + n1)]) / n1
        stats.append(np.abs(a - b).max())
    for d in (0.3, 0.55, 0.8, 1.0):
        want = np.mean([s >= d - 1e-9 for s in stats])
        assert ranking.ks_p_value(d, n0, n1) == pytest.approx(want)


def test_extraction_strength_quirks(spark):
    rows = [(1, p, p + 1, p + 1) for p in range(4)] + [(2, p, p + 1, 0) for p in range(4)] + [(3, p, p + 1, 0 if p < 2 else p + 1) for p in range(4)]
    t = table(spark, rows, "idx int, pos int, label int, pred int")
    assert {r["idx"]: r["score"] for r in metrics.extraction_strength(t).collect()} == {1: 1.0, 2: 0.25, 3: 0.5}


def test_harmonic_mean_with_zero(spark):
    assert metrics.harmonic_mean(table(spark, [(0.0,), (1.0,)], "value double")).first()[0] == 0.0
    assert metrics.harmonic_mean(table(spark, [(1.0,), (0.5,)], "value double")).first()[0] == pytest.approx(2 / 3)


def test_metric_graph_builds_once_and_finds_cycles(spark):
    g, seen = metrics.MetricGraph(), []
    g.add("a", lambda d: seen.append("a") or d["x"])
    g.add("b", lambda d: d["first"], {"a": "first"})
    g.add("c", lambda d: d["first"], {"a": "first"})
    g.evaluate(["b", "c"], {"x": spark.range(1)})
    assert seen == ["a"]
    g.add("d", lambda d: d["e"], {"e": "e"})
    g.add("e", lambda d: d["d"], {"d": "d"})
    with pytest.raises(ValueError):
        g.evaluate(["d"], {})


def test_chunks_and_empty_tail(spark):
    df = table(spark, [(1, [1, 2, 3]), (2, [4]), (3, []), (4, [5, 6])], "k int, ids array<int>")
    got = {r["chunk"]: r["tokens"] for r in S.chunks(df, "k", "ids", 2).collect()}
    assert got == {0: [1, 2], 1: [3, 4], 2: [5, 6]}
    assert {r["chunk"]: r["tokens"] for r in S.chunks(df, "k", "ids", 3, keep_empty_tail=True).collect()} == {0: [1, 2, 3], 1: [4, 5, 6], 2: []}


def test_ridge_and_lasso_against_numpy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    y = x @ [1, 0, -2, 0, 0.5] + 3 + rng.normal(size=40) * 0.01
    a = np.c_[x - x.mean(0)]
    w = np.linalg.lstsq(np.r_[a, np.eye(5)], np.r_[y - y.mean(), np.zeros(5)], rcond=None)[0]
    assert np.allclose(models.ridge(1.0)(x, y)(x), a @ w + y.mean())
    p = models.lasso(0.01)(x, y)
    g = (x - x.mean(0)).T @ (y - p(x)) / 40
    assert np.all(np.abs(g) <= 0.01 + 1e-6)
    assert models.forest(trees=30)(x, y)(x).std() > 1 and np.corrcoef(models.boosting(trees=50)(x, y)(x), y)[0, 1] > 0.9


def test_leave_one_out_excludes_the_row(spark):
    df = table(spark, [(i, float(i % 2), float(i)) for i in range(6)], "key int, a double, y double")
    got = {r["key"]: r["p"] for r in models.leave_out(df, "key", ["a"], "y", lambda x, y: lambda z: np.full(len(z), y.mean())).collect()}
    assert got == {i: pytest.approx((15 - i) / 5) for i in range(6)}


def test_pair_matrix_has_every_model_and_set(spark):
    names = [f"triplet_{i:03d}" for i in range(1, 8)]
    df = table(spark, [(m, e, "test", float(i * 10 + j)) for i, m in enumerate(names) for j, e in enumerate(names)], "model_triplet string, eval_triplet string, split string, log_ppl_ratio double")
    got = corruption.pair_matrix(df)
    assert got.columns == ["model_triplet", *names]
    assert sorted(tuple(r) for r in got.collect()) == [(m, *(i * 10.0 + j for j in range(7))) for i, m in enumerate(names)]


def test_answers_of_long_items_are_whole(spark, tmp_path):
    table(spark, [(1, "a " * 1500), (2, "a b c"), (3, "")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["item_id"]: (len(r["p"]), len(r["a"])) for r in framework.prompts(spark, tmp_path).collect()} == {1: (5, 1495), 2: (3, 0), 3: (0, 0)}
    assert {r["item_id"]: r["n_valid"] for r in framework.masked(spark, tmp_path).collect()} == {1: 1495, 2: 0, 3: 0}
    assert {r["n"] for r in framework.padded(spark, tmp_path).collect()} == {1495}


def test_hdbscan_finds_planted_blobs():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.1, (40, 3)), rng.normal(5, 0.1, (40, 3)), rng.uniform(-20, 20, (10, 3))]
    labels = clustering.hdbscan_labels(x, 10, 5)
    assert len(set(labels[:40])) == 1 and len(set(labels[40:80])) == 1 and labels[0] != labels[40] and min(labels[0], labels[40]) >= 0
    assert (labels[80:] == -1).sum() >= 8
    assert (clustering.hdbscan_labels(rng.uniform(size=(5, 2)), 10, 5) == -1).all()


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in zip(a, b, strict=True))


def test_hdbscan_in_blocks_is_hdbscan_in_one(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.5, (90, 3)), rng.normal(4, 0.5, (90, 3)), rng.normal((0, 6, 0), 1, (90, 3)), rng.uniform(-20, 20, (30, 3))]
    df = table(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    want = clustering.hdbscan_labels(x, 10, 5)
    assert len(set(want)) >= 4
    for rows in (40, 4096):
        got = {r["id"]: r["cluster_label"] for r in clustering.hdbscan(df, "id", "v", 10, 5, block_rows=rows).collect()}
        assert same_groups([got[i] for i in range(len(x))], want.tolist())


def test_hdbscan_has_no_row_cap(spark):
    at = F.struct(*((F.pmod(F.xxhash64(F.col("id"), F.lit(s)), F.lit(1000003)) / 1000003).alias(s) for s in "ab"))
    df = spark.range(20_500).select("id", at.alias("u")).select("id", F.array(F.col("u.a") + F.col("id") % 3 * 10, F.col("u.b")).alias("v"))
    got = clustering.hdbscan(df, "id", "v", 2000, 5)
    found = got.groupBy(F.col("id") % 3).agg(F.count(F.lit(1)), F.min("cluster_label"), F.max("cluster_label"), F.avg((F.col("cluster_label") >= 0).cast("int"))).collect()
    assert sum(r[1] for r in found) == 20_500 and len({r[3] for r in found}) == 3
    assert all(r[4] > 0.9 for r in found)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)) * [3, 2, 1, 0.1]
    pc, share = vectors.pca(table(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>"), "id", 2)
    value = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert share == pytest.approx(value[:2].sum() / value.sum())
    z = np.array([r["pc"] for r in pc.collect()])
    assert np.allclose(sorted(z.var(0, ddof=1))[::-1], value[:2])


def test_effective_rank_of_a_line(spark):
    df = table(spark, [("a", [float(i), 0.0, 0.0]) for i in range(5)], "k string, v array<double>")
    assert vectors.effective_rank(df, "k").first()["effective_rank"] == pytest.approx(1.0, abs=1e-6)


def test_planted_topics_order_the_layers(spark):
    topics = ["alpha beta gamma delta", "red green blue white", "north south east west"]
    rows = [(i, i % 3, " ".join([topics[i % 3]] * 2) + f" word{chr(97 + i % 26)} common text") for i in range(90)]
    texts = table(spark, rows, "text_id long, cluster_label int, text string")
    from plumbline.operators import corpus

    t = corpus.triplet_splits(texts, "cluster_label", "text_id", (10, 5, 5), 1)
    lt = corruption.long_table(scoring.round_scores(scoring.score_pairs(t, texts)))
    geo = {r["layer"]: r["geo"] for r in corruption.headline(lt).collect()}
    assert geo["L1"] > 1 and geo["L2"] > geo["L3"]


def test_completeness_and_warmup(spark):
    from plumbline.operators import views

    rows = [("a", {"train": 1.0, "test": 2.0}, {"train": 1.0, "test": 2.0}), ("b", {"train": 1.0, "test": 2.0}, {"train": 1.0})]
    df = table(spark, rows, "k string, base map<string,double>, unlearn map<string,double>")
    assert [r["k"] for r in views.complete(df, ("base", "unlearn"), ("train", "test")).collect()] == ["a"]
    assert views.warmup_steps(400, 4, 2, 2, 10, 1) == (250, 25)
    assert views.warmup_steps(3, 8, 4, 1, 5, 1.0) == (5, 1)


def test_running_sums_brute_force(spark):
    from plumbline.operators.prefix import sums_before

    rows = [(i * 37 % 101, i) for i in range(101)]
    df = table(spark, rows, "k int, v int").repartition(5)
    got = {r["k"]: (r["s"], r["n"]) for r in sums_before(df, ["k"], s=F.col("v"), n=F.lit(1)).collect()}
    total = 0
    for n, (k, v) in enumerate(sorted(rows)):
        assert got[k] == (total, n)
        total += v


def test_objectives_on_known_values(spark):
    from plumbline.operators import objectives

    d = table(spark, [([0.0, 0.0], [0.0, 0.0], 0, 0)], "logits array<double>, teacher array<double>, label int, pos int")
    assert objectives.undial(d, 0.0).first()[0] == pytest.approx(math.log(2))
    assert objectives.ceu(d).first()[0] == pytest.approx(math.log(2))
    assert objectives.pdu(table(spark, [([3.0, 0.0, 0.0],)], "logits array<double>")).first()[0] == pytest.approx(4.0)
    s = table(spark, [(1, 2.0, 2.0, 4)], "idx int, nll double, ref_nll double, n int")
    assert objectives.npo(s, 0.5).first()[0] == pytest.approx(4 * math.log(2))
    assert objectives.dual_step(0.5, 1.0, 2.0, 1.0) == 0.0


def test_falls_brute_force():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 64, 100):
        x = rng.integers(0, max(1, n // 2) + 1, n)
        assert ranking.falls(x) == sum(x[i] > x[j] for i in range(n) for j in range(i + 1, n))


def test_kendall_and_ranks_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), strict=True))]
    rows += [(1000 + i, 5.0, float(i)) for i in range(100)] + [(2000 + i, float(i), 7.0) for i in range(100)]  # hot values
    df = spark.createDataFrame(rows, "key int, y double, p double")
    sy = sp = c = agree = 0
    for i, (_, y1, p1) in enumerate(rows):
        for _, y2, p2 in rows[i + 1 :]:
            a, b = np.sign(y1 - y2), np.sign(p1 - p2)
            sy, sp, c, agree = sy + abs(a), sp + abs(b), c + a * b, agree + (a != 0 and a == b)
    got = ranking.kendall_concordance(df).first()
    assert got["kendall"] == pytest.approx(c / math.sqrt(sy * sp)) and got["concordance"] == pytest.approx(agree / sy)
    want = pd.DataFrame(rows, columns=["key", "y", "p"])
    r = ranking.correlations(df).first()
    assert r["spearman"] == pytest.approx(want["y"].rank().corr(want["p"].rank())) and r["pearson"] == pytest.approx(want["y"].corr(want["p"]))
    one_task = "Exchange SinglePartition"
    plan = ranking.discordant(df, "y", "p")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and plan.count(one_task) <= 2  # sums of partial sums only


def test_stems():
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor hopping hop falling fall filing file happy happi relational relat rational ration conditional condit generalizations gener oscillators oscil sky sky sing sing controlling control adoption adopt".split()
    for w, s in zip(pairs[::2], pairs[1::2], strict=True):
        assert S.stem(w) == s, w


def test_stemmed_overlap(spark):
    df = spark.createDataFrame([(["relations", "the", "cats"], ["relational", "cat", "x"])], "r array<string>, g array<string>")
    s = df.select(S.stems("r").alias("r"), S.stems("g").alias("g"))
    assert s.select(S.rouge1_recall(F.col("r"), F.col("g"))).first()[0] == pytest.approx(2 / 3)
    assert df.select(S.rouge1_recall(F.col("r"), F.col("g"))).first()[0] == 0


def test_lcs_against_table():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = (rng.integers(0, 5, rng.integers(0, 30)).tolist() for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert S.lcs(a, b) == row[-1]


def test_checked_joins(spark):
    from plumbline.operators import views

    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (3, "z", 7)], "k int, v string, w int")
    got = views.checked_join(left, right, ["k"], ("_l", "_r")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x", 5), (2, "b", "y", 6)]
    with pytest.raises(Exception, match="missing"):
        views.checked_join(left, right.filter("k = 1"), ["k"]).collect()
    with pytest.raises(Exception, match="repeats"):
        views.checked_join(left, right.unionByName(right), ["k"]).collect()
    todo = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "at int, text string")
    assert sorted(r["at"] for r in views.resume_after(todo, todo.filter("at < 2"), "at", "text").collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="another text"):
        views.resume_after(todo, todo.filter("at < 2").withColumn("text", F.lit("other")), "at", "text").collect()


def test_shards(spark, tmp_path):
    import json
    import struct

    head = {"__metadata__": {"format": "pt"}, "a.q_proj": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "b.norm": {"dtype": "F16", "shape": [1], "data_offsets": [8, 10]}}
    body = json.dumps(head).encode()
    (tmp_path / "model.safetensors").write_bytes(struct.pack("<Q", len(body)) + body + struct.pack("<ff", 1.5, -2.0) + b"\x00\x3c")
    from plumbline.operators import views
    from plumbline.sources import io

    rows = {r["name"]: r for r in io.read_shards(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.q_proj", "b.norm"} and struct.unpack("<ff", rows["a.q_proj"]["data"]) == (1.5, -2.0) and rows["b.norm"]["shape"] == [1]
    assert [r["name"] for r in io.read_shards(spark, str(tmp_path), views.is_weight).collect()] == ["a.q_proj"]


def test_hdbscan_selection():
    """Two pairs of near blobs: leaves are the four, excess of mass may join them, and epsilon does."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in ((0, 0), (1, 0), (20, 0), (21, 0))])
    leaf = clustering.hdbscan_labels(x, 25, 5, method="leaf")  # a blob can't part in two of 25
    assert sorted(np.unique(leaf[leaf >= 0], return_counts=True)[0]) == [0, 1, 2, 3]
    wide = clustering.hdbscan_labels(x, 25, 5, method="leaf", epsilon=5.0)
    assert len(set(wide[:80])) == 1 and len(set(wide[80:])) == 1 and wide[0] != wide[80] and wide.min() >= 0
    one = clustering.hdbscan_labels(rng.normal(0, 1, (100, 2)), 60, 5, single=True)
    assert set(one) <= {-1, 0} and (one == 0).sum() > 50
    assert (clustering.hdbscan_labels(rng.normal(0, 1, (100, 2)), 60, 5, method="leaf") == -1).all()


def test_hdbscan_of_a_sample(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (150, 2)) for c in ((0, 0), (5, 0), (9, 9))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {r["id"]: r["cluster_label"] for r in clustering.hdbscan_of_sample(df, "id", sample_rows=150, min_cluster_size=10).collect()}
    assert len(got) == 450
    for a in range(0, 450, 150):
        own = [got[i] for i in range(a, a + 150) if got[i] >= 0]
        assert len(own) > 140 and len(set(own)) == 1
    assert {r["cluster_label"] for r in clustering.hdbscan_of_sample(df.limit(20), "id", min_cluster_size=500).collect()} == {-1}


def test_effective_rank_brute_force(spark):
    rng = np.random.default_rng(6)
    sets = {"a": rng.normal(size=(20, 4)), "b": rng.normal(size=(3, 6)), "c": np.ones((5, 3))}
    df = spark.createDataFrame([(k, row.tolist()) for k, x in sets.items() for row in x], "k string, v array<double>")
    for r in vectors.effective_rank(df, "k").collect():
        eig = np.clip(np.linalg.eigvalsh(np.cov(sets[r["k"]].T, ddof=1)), 1e-12, None)
        p = eig / eig.sum()
        assert r["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-4)


def test_folds_brute_force(spark):
    """Each fold's prediction is that of a model of all other rows, for every kind of model."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(12, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(0, 0.1, 12)
    df = spark.createDataFrame([(f"k{i:02d}", "g" + str(i % 4), *map(float, x[i]), float(y[i])) for i in range(12)], "key string, g string, a double, b double, c double, y double")
    for fit in (models.ridge(), models.lasso(), models.forest(trees=5), models.boosting(trees=5)):
        got = {r["key"]: r["p"] for r in models.leave_out(df, "key", ["a", "b", "c"], "y", fit).collect()}
        grouped = {r["key"]: r["p"] for r in models.leave_out(df, "key", ["a", "b", "c"], "y", fit, group="g").collect()}
        for i in range(12):
            out, group = np.arange(12) == i, np.arange(12) % 4 == i % 4
            assert got[f"k{i:02d}"] == pytest.approx(fit(x[~out], y[~out])(x[out])[0])
            assert grouped[f"k{i:02d}"] == pytest.approx(fit(x[~group], y[~group])(x[[i]])[0])


def test_large_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(models, "MAX_ROWS", 3)
    df = spark.range(5).select(F.col("id").alias("key"), F.rand(1).alias("a"), F.rand(2).alias("y"))
    with pytest.raises(ValueError, match="at most 3"):
        models.leave_out(df, "key", ["a"], "y", models.ridge())


def test_tree_takes_the_best_split():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    t = models.Tree(x, y, 2, 1, 2, np.random.default_rng(0))
    cost = {}
    for f in range(2):
        for v in np.sort(x[:, f])[1:-2]:
            low = x[:, f] <= v
            if low.sum() >= 2 and (~low).sum() >= 2:
                cost[f, v] = y[low].var() * low.sum() + y[~low].var() * (~low).sum()
    f, v = min(cost, key=cost.get)
    assert t.feature[0] == f and (x[:, f] <= t.cut[0]).sum() == (x[:, f] <= v).sum()
