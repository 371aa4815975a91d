"""Near dedup and the pipeline against all-pairs versions."""

import itertools
import random

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import near_dedup as nd
from plumbline.llm import quality, toxicity
from plumbline.session import MADE

random.seed(11)
WORDS = ["".join(random.choice("abcdefghij") for _ in range(4)) for _ in range(400)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edit(t, k):
    w = t.split()
    for _ in range(k):
        w[random.randrange(len(w))] = random.choice(WORDS) + "x"
    return " ".join(w)


def brute(rows, least=0.8):
    """Class by doc_id: smallest id of the components over all pairs."""
    shingles = {i: nd.labelled(nd.words_of(t)) for i, t in rows}
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, s), (b, t) in itertools.combinations(rows, 2):
        same = nd.words_of(s) == nd.words_of(t)
        if same or (len(shingles[a]) and len(shingles[b]) and nd.aligned_similarity(shingles[a], shingles[b], least) >= least):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i, _ in rows}


@pytest.fixture(scope="module")
def rows():
    base = [text(120) for _ in range(12)]
    out = [None, "", "  ", "one two", "one  TWO", "a b c d e"] + base
    out += [edit(b, k) for b in base[:6] for k in (1, 2, 3, 4, 6, 10)] + [base[0]] * 30 + [edit(base[1], random.randint(1, 5)) for _ in range(120)]
    shared = text(60)
    out += [f"{shared} {text(100)}" for _ in range(15)] + [" ".join(["rep eat"] * 60), " ".join(["rep eat"] * 61), text(3000)]
    return list(enumerate(out))


def test_classes_brute_force(spark, rows):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, class_id int, node string")
    got = {r["doc_id"]: r for r in nd.classes(df).collect()}
    want = brute(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    size = pd.Series(want).value_counts()
    assert all(r["class_size"] == size[want[i]] and r["kept"] == (want[i] == i) for i, r in got.items())


def test_strays_meet_in_blocks(spark, rows, monkeypatch):
    """With tiny blocks every follower outside the leader's component still meets all others."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in nd.classes(df).collect()} == brute(rows)


def test_repeated_ids_keep_one_row(spark):
    t = text(40)
    df = spark.createDataFrame([(1, t), (1, t), (1, text(40)), (2, t), (None, t)], "doc_id long, text string")
    got = nd.classes(df).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 2
    assert nd.classes(df.limit(0)).count() == 0


def test_alignment_against_dynamic_programme():
    for _ in range(200):
        a, b = text(random.randint(1, 60)), ""
        b = edit(a, random.randint(0, 3)) if random.random() < 0.8 else text(20)
        if random.random() < 0.3:
            w = b.split()
            b = " ".join(w[len(w) // 2 :] + w[: len(w) // 2])
        x, y = nd.labelled(a.split()), nd.labelled(b.split())
        row = [0] * (len(y) + 1)
        for u in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
        sim = row[-1] / (len(x) + len(y) - row[-1])
        got = nd.aligned_similarity(x, y, 0.8)
        assert (got >= 0.8) == (sim >= 0.8) and (got == 0 or abs(got - sim) < 1e-12)


def test_labels_are_distinct_and_ordered():
    s = nd.labelled(["a"] * 30)
    assert len(set(s.tolist())) == 26
    assert len(nd.labelled([])) == 0 and len(nd.labelled(["a"])) == 1


def test_pipeline_brute_force(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    left = [tuple(r) for r in docs.orderBy("doc_id").collect()]

    crf = quality.fit(docs, labels)
    kept = []
    for r in left:
        (n,), lines = quality.measure([r[1]])
        if n[0] >= 20 and 100 * n[4] <= 30 * n[0] and (crf is None or quality.content_shares(lines, 1, crf)[0] >= 0.5):
            kept.append(r)
    model = toxicity.fit(spark.createDataFrame(kept, docs.schema), labels, F.lit(True))
    score = toxicity.score_texts([r[1] for r in kept], model, model.table()) if model else [0.0] * len(kept)
    kept = [r for r, s in zip(kept, score, strict=True) if s < 0.5]
    first = {}
    for r in kept:
        first.setdefault(r[1], r)
    kept = list(first.values())
    cls = brute([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if cls[r[0]] == r[0]]
    assert 0 < len(kept) < len(left)
    assert {r["doc_id"] for r in out} == {r[0] for r in kept}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in out) == sum(len(tok.encode(r[1], add_special_tokens=False).ids) + 1 for r in kept)


def test_one_bucket_of_strays(spark):
    """A leader with 50,000 followers, most of which are like none: links between them are found without comparing all pairs."""
    rng = random.Random(3)
    passage = text(30)
    rows, links = [], set()
    for i in range(25_000):
        own = " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))
        rows += [(f"a{i}", f"{passage} {own}"), (f"b{i}", f"{passage} {own} tail" if i % 50 == 0 else f"{passage} x{i} " + " ".join(f"v{rng.randrange(10**9)}" for _ in range(40)))]
        if i % 50 == 0:
            links.add((f"a{i}", f"b{i}"))
    leader = passage + " " + text(40)
    made = spark.createDataFrame([("leader", leader), *rows], "id string, text string").select(F.encode("id", "utf-8").alias("node"), "text").repartition(8)
    star = made.filter(F.decode("node", "utf-8") != "leader").select(F.encode(F.lit("leader"), "utf-8").alias("leader"), "node")
    checked = nd._align(star, made, 0.8)
    assert checked.count() == 50_000 and checked.filter("linked").count() == 0
    none = spark.createDataFrame([], "node binary, comp binary")
    found = nd._beyond_leaders(checked, none, made, 0.8).collect()
    assert {tuple(sorted(bytes(x).decode() for x in r)) for r in found} == links


def test_prefixes_of_similar_texts_meet():
    for _ in range(300):
        leader = text(random.randint(1, 40))
        a = edit(leader, random.randint(0, 6))
        b = edit(a, random.randint(0, 3))
        x, y, h = (nd.labelled(t.split()) for t in (a, b, leader))
        if len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8:
            assert len(np.intersect1d(nd.first_shingles(x, np.sort(h), 0.8), nd.first_shingles(y, np.sort(h), 0.8)))


def test_recall_by_similarity(spark):
    """Queries with an id that 20 divides against all rows: pairs found in one class, by bucket of their similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    base = [t for _, t in rows if t and 60 < len(t.split()) < 400][:150]
    rng = random.Random(9)
    for n, t in enumerate(base):  # near copies of many degrees; each 20th id is a query
        for k in range(3):
            w = t.split()
            for _ in range(rng.randint(1, max(1, len(w) // 45))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((1_000_000 + 20 * (3 * n + k) + (0 if k == 0 else k), " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {i: nd.labelled(nd.words_of(t)) for i, t in rows}
    sizes = np.array([len(shingles[i]) for i, _ in rows])
    hits, total = [0, 0, 0], [0, 0, 0]
    for q, _ in rows:
        if q % 20 or not len(shingles[q]):
            continue
        near = np.flatnonzero((np.minimum(sizes, len(shingles[q])) >= 0.8 * np.maximum(sizes, len(shingles[q]))))
        for i in near:
            d = rows[i][0]
            if d != q and (s := nd.aligned_similarity(shingles[q], shingles[d], 0.8)) >= 0.8:
                k = 0 if s < 0.85 else 1 if s < 0.9 else 2
                total[k] += 1
                hits[k] += got[q] == got[d]
    assert min(total) > 20
    assert all(h >= 0.9 * t for h, t in zip(hits, total, strict=True)), (hits, total)


def write_tables(spark, path, docs, labels):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_keeps_clashing_columns(spark, sf, tmp_path):
    import corpus_pipeline

    own = {"kept": "mine", "score": "7.5", "group_size": "-1", "_h": "h", "_row": "r", "n_words": "w", "text_sha256": "x", "keep_id": "k", "row": "o", "node": "n", "class_id": "c"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({k: F.lit(v) for k, v in own.items()})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    path = write_tables(spark, tmp_path, docs, labels)
    left = spark.read.parquet(f"{path}/documents.parquet")
    before = {tuple(r) for r in left.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, path)
        assert out.columns == docs.columns
        rows = {tuple(r) for r in out.collect()}
        assert rows and rows < before
        left, before = spark.createDataFrame(list(rows), out.schema), rows
    spark.conf.set(corpus_pipeline.BATCH_CONF, "4321")
    made = len(MADE)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).select("doc_id").collect()} == {r[0] for r in before}
    assert spark.conf.get(corpus_pipeline.BATCH_CONF) == "4321" and len(MADE) == made
    spark.conf.unset(corpus_pipeline.BATCH_CONF)


def test_pipeline_edges(spark, sf, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long = text(60_000)
    odd = [(None, text(50), "x"), (1, None, "x"), (2, "", None), (3, " \n", "x"), (4, long, "x"), (5, long, "y"), (6, text(40), "x"), (6, text(40), "x"), (7, "few words", "x")]
    odd += [odd[6]] * 2
    path = write_tables(spark, tmp_path / "a", spark.createDataFrame(odd, schema), none)
    out = corpus_pipeline.run(spark, path).collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {t for _, t, _ in odd if t and len(t.split()) >= 20}
    assert {r["doc_id"] for r in out} == {None, 4, 6}
    assert sum(r["length"] for r in out) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in want)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, write_tables(spark, tmp_path / "b", spark.createDataFrame([], schema), labels)).count() == 0
