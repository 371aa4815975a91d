"""Trained operators: their parts against brute force, and held-out accuracy."""

import itertools
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, ngrams, quality, toxicity
from plumbline.llm.queries import fold

NASTY = [(1, None), (2, ""), (3, " \n "), (4, "123 !!"), (5, "a"), (6, "Ärger İı " * 200_000), (5, "a"), (None, "text with null id")]


def nasty(spark):
    return spark.createDataFrame([(i, t, "x", 0.5, 7) for i, t in NASTY], "doc_id long, text string, lang string, score double, n_words int")


def slow_slots(text, orders, bits):
    out = []
    t = text.lower()
    for n in orders:
        for i in range(len(t) - n + 1):
            h = 0
            for k, c in enumerate(t[i : i + n]):
                h = ord(c) if k == 0 else (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out.append((((h ^ (h >> 31)) * 0x9E3779B97F4A7C15) % 2**64) >> (64 - bits))
    return sorted(out)


def test_ngram_slots_brute_force(monkeypatch):
    texts = ["Hello, Wörld", "", None, "ab", "x" * 30, "the end. 中文 text that is longer than a block"]
    for block in (7, 1 << 20):
        monkeypatch.setattr(ngrams, "BLOCK", block)
        got = {i: [] for i in range(len(texts))}
        for slot, who, first in ngrams.slots(texts, (1, 3, 5), 12):
            owner = np.repeat(who, np.diff(np.append(first, len(slot))))
            for s, o in zip(slot, owner, strict=True):
                if s < 1 << 12:
                    got[int(o)].append(int(s))
        for i, t in enumerate(texts):
            assert sorted(got[i]) == slow_slots(t or "", (1, 3, 5), 12), (block, i)


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_toxicity_held_out(spark, larger):
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    s = toxicity.score(docs, model).join(labels, "doc_id").filter(fold("doc_id", 5) == 0)
    ok = s.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0]
    assert ok > 0.93
    got = toxicity.score(nasty(spark), model).collect()
    assert len(got) == len(NASTY) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    kept = toxicity.score_column(nasty(spark), model)
    assert set(kept.columns) == {"doc_id", "text", "lang", "score", "n_words"} and kept.count() == len(NASTY)


def test_toxicity_ignores_held_out_labels_and_needs_two_classes(spark, larger):
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    learn = fold("doc_id", 5) != 0
    a, b = toxicity.fit(docs, labels, learn), toxicity.fit(docs, flipped, learn)
    assert np.array_equal(a.slot, b.slot) and np.allclose(a.value, b.value, atol=1e-4)
    assert toxicity.fit(docs, labels.filter("toxic = 0"), learn) is None
    assert toxicity.fit(docs, labels.limit(0), learn) is None
    assert toxicity.score(docs.limit(3), None).filter("score = 0").count() == 3


def test_language_held_out(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    model = language.fit(docs, fold("doc_id", 4) != 2)
    r = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(fold("doc_id", 4) == 2)
    assert r.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    assert (model.weight[:-1] == 0).mean() > 0.3
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(nasty(spark), model).collect()]
    assert len(got) == len(NASTY)
    assert {(lang, s) for i, lang, s in got if i in (1, 2, 3, 4)} == {("und", 0.0)}
    assert all(lang in model.langs and 0 < s <= 1 for i, lang, s in got if i in (5, 6))


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")
    assert language.fit(df, F.lit(True)) is None
    assert language.identify(df, None).first()["lang_pred"] == "und"


def test_rare_language_is_learned(spark):
    df = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "el gato y el perro", "en" if i % 2 else "es") for i in range(300)] + [(1000, "čeština žije", "cs")], "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True), max_rows=20)
    assert model.langs == ["cs", "en", "es"]
    assert (model.weight[:, 0] > 0).any()  # not held back


def test_temperature_flattens_overconfidence():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    z = np.where(rng.random(2000) < 0.8, y, 1 - y)
    logits = np.eye(2)[z] * 10
    assert language.temperature(logits, y) > 5


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    marked = set()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marked |= set(range(i, i + 8))
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_base_counts_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", "\n", "a b c\na b c\n\na b c", "w " * 40, "one two three four five six seven eight", "a\x1cb \x1d\n\x85 c", "x y\rz\x0bq " * 9] + [
        " ".join(rng.choice(list("abc"), rng.integers(1, 60))).replace("a b", "a\nb") + "#$" * int(rng.integers(0, 3)) for _ in range(40)
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.judge(df, None).collect():
        want = slow_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r["kept"] == (not r["base_failed"])


BASE_SQL = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, t FROM d),
    i AS (SELECT doc_id, unnest(range(len(w) - 7)) AS i, w FROM w WHERE len(w) > 7),
    k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1 : i + 8]) AS k FROM i),
    r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k CROSS JOIN (SELECT unnest(range(8)) AS o) WHERE k > 1 GROUP BY 1),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
    u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM w LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id)"""


def test_base_counts_in_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), None).select("doc_id", *quality.BASE).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(BASE_SQL).fetchall())


def test_blocks_measure_as_one(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [None, "", "\n", " \n x", "x\x1cy x", "𝔘𝔘 ab. 12\n12\n12", "é" * 9] + ["\n".join(" ".join(rng.choice(list("abC1#!."), 4)) for _ in range(rng.integers(1, 9))) for _ in range(30)]
    want = [quality.measure([t]) for t in texts]
    for block in (1, 50, 1 << 20):
        monkeypatch.setattr(quality, "BLOCK", block)
        base, lines = quality.measure(texts)
        for i, (b, own) in enumerate(want):
            at = lines.text == i
            assert (base[i] == b[0]).all()
            assert all(np.array_equal(getattr(lines, k)[at], getattr(own, k)) for k in ("number", "start", "end", "chars", "x"))
            whole = (texts[i] or "").split("\n")
            assert [(texts[i] or "")[a:z] for a, z in zip(own.start, own.end, strict=True)] == [whole[k] for k in own.number]
    assert quality.measure([])[0].shape == (0, 5)


def slow_features(line, again):
    words = line.split()
    chars, letters = sum(map(len, words)), sum(c.isalpha() for c in line)
    return [
        1, min(1, 10 * sum(c in "#*$%&|<>" for c in line) / chars), sum(c.isupper() for c in line) / max(1, letters), min(1, 5 * sum(c.isdigit() for c in line) / chars),
        1 - len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1), min(1, 5 * (line.count("!") + line.count("?")) / len(words)),
        words[-1][-1] in '.!?"»”', min(1, len(words) / 20), again,
    ]


def test_line_features_brute_force():
    text = "One two two. 12 #\n\nÄÖ ß! ? |\nOne two two. 12 #\nend” \n𝔘 1"
    lines = [x for x in text.split("\n") if x]
    want = [slow_features(x, x in lines[:i]) for i, x in enumerate(lines)]
    assert np.allclose(quality.measure([text])[1].x, np.array(want, float))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    sizes = (1, 5, 0, 2, 8, 1)
    m = quality.Crf(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    x = rng.normal(size=(sum(sizes), quality.N_FEATURES))
    got = np.split(quality.viterbi(x, np.repeat(np.arange(len(sizes)), sizes), len(sizes), m), np.cumsum(sizes)[:-1])
    for n, rows, path in zip(sizes, np.split(x, np.cumsum(sizes)[:-1]), got, strict=True):
        e = rows @ m.emit
        score = lambda p: m.first[p[0]] + sum(e[t, s] for t, s in enumerate(p)) + sum(m.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731,B023
        assert not n or tuple(path) == max(itertools.product((0, 1), repeat=n), key=score)
    assert len(quality.viterbi(np.empty((0, quality.N_FEATURES)), np.empty(0, np.int64), 2, m)) == 0
    flat = quality.Crf(np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    assert (quality.viterbi(x, np.repeat(np.arange(len(sizes)), sizes), len(sizes), flat) == quality.CONTENT).all()  # ties


def test_field_gradient_reaches_a_minimum():
    """Brute force: no small step from the trained field lowers the penalised loss, summed over all label paths."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(1, 5):
        for _ in range(6):
            z = rng.integers(0, 2, k)
            texts.append((np.c_[np.ones(k), rng.normal(z[:, None] * 1.5 - 0.7, 1, (k, quality.N_FEATURES - 1))], z))
    share = [sum((z == c).sum() for _, z in texts) for c in (0, 1)]

    def loss(m):
        out = 0.0
        for x, z in texts:
            e = x @ m.emit
            score = lambda p: m.first[p[0]] + sum(e[t, s] for t, s in enumerate(p)) + sum(m.move[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: E731,B023
            weight = sum(0.5 / share[c] for c in z) / len(z)
            out += weight * (np.logaddexp.reduce([score(p) for p in itertools.product((0, 1), repeat=len(z))]) - score(z))
        return out + 1e-3 / 2 * sum((v**2).sum() for v in (m.emit, m.move, m.first))

    m = quality.train(texts, steps=1500)
    least = loss(m)
    for field in ("emit", "move", "first"):
        for at in np.ndindex(getattr(m, field).shape):
            for step in (-0.05, 0.05):
                moved = {k: getattr(m, k).copy() for k in ("emit", "move", "first")}
                moved[field][at] += step
                assert loss(quality.Crf(**moved)) > least - 1e-6


def test_lines_get_labels_from_documents():
    """A line of the other kind within a document is found, and half of each document keeps its label."""
    rng = np.random.default_rng(8)
    made, truth = [], []
    for i in range(120):
        z = np.full(10, i % 2)
        z[rng.integers(10)] = 1 - i % 2
        made.append(np.c_[np.ones(10), rng.normal(z[:, None] * 3 - 1.5, 0.6, (10, quality.N_FEATURES - 1))])
        truth.append(z)
    owner = np.repeat(np.arange(120), 10)
    got = quality.line_labels(np.concatenate(made), np.full(1200, 7), owner, np.arange(120) % 2)
    assert (got == np.concatenate(truth)).mean() > 0.99
    same = quality.line_labels(np.ones((40, quality.N_FEATURES)), np.ones(40, int), np.repeat([0, 1], 20), np.array([0, 1]))
    assert same[:20].mean() <= 0.5 <= same[20:].mean()


def pure(line):
    """A line whose kind shows at sight in the given tables: prose, or one of the junk forms."""
    words = line.split()
    if len(words) < 3:
        return None
    junk = sum(c in "#*$%&|<>" for c in line) >= len(words) / 2 or line.upper() == line or sum(a == b for a, b in itertools.pairwise(words)) > len(words) / 2
    return int(junk)


def test_held_out_splices_are_labelled_by_line(spark, larger):
    """Lines of held-out good and bad texts, in turns: the field finds where they change."""
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = quality.fit(docs.filter(learn), labels)
    held = docs.filter(~learn).join(labels, "doc_id").select("quality", "text").collect()
    pool = {q: [x for r in held if r["quality"] == q for x in [[y for y in r["text"].split("\n") if pure(y) == 1 - q]] if x] for q in (0, 1)}
    rng = np.random.default_rng(1)
    hits = total = 0
    shares = []
    for _ in range(200):
        c, parts, gold = int(rng.integers(2)), [], []
        for _ in range(int(rng.integers(2, 5))):
            lines = pool[1 - c][int(rng.integers(len(pool[1 - c])))]
            a = int(rng.integers(len(lines)))
            run = lines[a : a + int(rng.integers(1, 6))]
            parts += run
            gold += [c] * len(run)
            c = 1 - c
        _, own = quality.measure(["\n".join(parts)])
        hits += int((quality.viterbi(own.x, own.text, 1, model) == np.array(gold)).sum())
        total += len(gold)
        shares.append(float(quality.content_shares(own, 1, model)[0]))
    assert hits / total > 0.95
    histogram = np.histogram(shares, bins=10, range=(0, 1))[0]
    assert (histogram[1:9] > 0).all() and histogram[1:9].sum() > 100  # not two spikes
    states = quality.line_states(docs, model)
    assert states.columns == ["doc_id", "line", "start", "end", "boilerplate"]
    inside = states.join(docs, "doc_id").filter(F.length(F.trim(F.expr("substring(text, int(start) + 1, int(end - start))"))) == 0)
    assert inside.count() == 0


def test_quality_on_held_out_rows(spark, larger):
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    r = quality.judge(docs, quality.fit(docs.filter(learn), labels)).join(labels, "doc_id").filter(~learn & ~F.col("base_failed"))
    good = {x["quality"]: x["k"] for x in r.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert good[1] > 0.98 and good[0] < 0.1


def test_quality_edges(spark, larger):
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels, max_lines=3)
    assert quality.judge(nasty(spark), model).count() == len(NASTY)
    assert quality.judge_column(nasty(spark), model).columns.count("n_words") == 1
    assert quality.fit(docs, labels.filter("quality = 1")) is None and quality.fit(docs, labels.limit(0)) is None
    assert quality.fit(docs.limit(0), labels) is None
    assert quality.judge(docs.limit(0), model).count() == 0 and quality.line_states(docs.limit(0), model).count() == 0


def test_present_features_are_distinct(monkeypatch):
    texts = ["ababab abab", "", None, "x" * 40 + "ab" * 30]
    table = toxicity._all_slots()
    want = {i: {s + 1 for s in slow_slots(t or "", toxicity.ORDERS, toxicity.BITS)} for i, t in enumerate(texts)}
    for block in (16, 1 << 20):
        monkeypatch.setattr(ngrams, "BLOCK", block)
        who, f = toxicity.present(texts, table)
        assert sorted(zip(who.tolist(), f.tolist(), strict=True)) == sorted((i, s) for i, own in want.items() for s in own)


def slow_toxic(text, model):
    weight = dict(zip(model.slot.tolist(), model.value.tolist(), strict=True))
    z = model.bias + sum(weight.get(s, 0.0) for s in set(slow_slots(text or "", toxicity.ORDERS, toxicity.BITS)))
    return 1 / (1 + math.exp(-z))


def test_toxicity_brute_force(spark):
    """Counts, ratios and scores of a small table in plain Python."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(words[:20] if i % 3 else words[10:], 8)), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (1, None)], "doc_id long, toxic int")
    learn = F.col("doc_id") % 4 != 1
    model = toxicity.fit(docs, labels, learn, least_ratio=0.7, least_texts=3)
    seen = [(set(slow_slots(t, toxicity.ORDERS, toxicity.BITS)), y) for i, t, y in rows if i % 4 != 1]
    n = [sum(y == c for _, y in seen) for c in (0, 1)]
    ratio = {}
    for s in set().union(*(x for x, _ in seen)):
        k = [sum(s in x for x, y in seen if y == c) for c in (0, 1)]
        r = math.log((k[1] + 1) / (n[1] + 2)) - math.log((k[0] + 1) / (n[0] + 2))
        if sum(k) >= 3 and abs(r) >= 0.7:
            ratio[s] = r
    assert model.slot.tolist() == sorted(ratio)
    w = model.value / np.array([ratio[s] for s in sorted(ratio)])
    # The regression has come to rest: its gradient, over the scaled features, is nearly nothing.
    x = np.array([[ratio[s] if s in own else 0.0 for s in sorted(ratio)] for own, _ in seen])
    y = np.array([c for _, c in seen])
    e = np.where(y == 1, 0.5 / n[1], 0.5 / n[0]) * (1 / (1 + np.exp(-(x @ w + model.bias))) - y)
    assert np.abs(x.T @ e + 1e-3 * w).max() < 0.01 and abs(e.sum()) < 0.01
    odd = [(i, t) for i, (_, t) in enumerate([(0, None), (0, ""), (0, "Abcd " * 500), *[(i, t) for i, t, _ in rows[:20]]])]
    for r in toxicity.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect():
        assert r["score"] == pytest.approx(slow_toxic(odd[r["doc_id"]][1], model), abs=1e-9)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), labels, learn) is None
    assert toxicity.score_column(docs.limit(0), model).columns == ["doc_id", "text", "score"]


def test_language_features_and_classes_brute_force(monkeypatch):
    """TF shares, and the softmax of the weighted sums, in plain Python; ties go to the first language."""
    monkeypatch.setattr(language, "BITS", 9)
    texts = ["Hello, Wörld", "", None, "ab", "中文 a", "x" * 30, "12 !"]
    who, slot, value = language.features(texts)
    want = {}
    for i, t in enumerate(texts):
        own = slow_slots(t or "", language.ORDERS, 9)
        for s in own:
            want[i, s] = want.get((i, s), 0.0) + 1 / len(own)
    assert {(int(i), int(s)): v for i, s, v in zip(who, slot, value, strict=True)} == pytest.approx(want)
    rng = np.random.default_rng(1)
    model = language.Model(["de", "en", "fr"], np.vstack([rng.normal(size=(512, 3)), np.zeros((1, 3))]).astype(np.float32), rng.normal(size=3))
    got = language.classify(texts, model)
    for t, lang, score in zip(texts, *got, strict=True):
        if t is None or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        own = slow_slots(t, language.ORDERS, 9)
        z = [sum(float(model.weight[s, c]) for s in own) / len(own) + model.bias[c] for c in range(3)]
        p = [math.exp(a - max(z)) for a in z]
        assert lang == model.langs[int(np.argmax(p))] and score == pytest.approx(max(p) / sum(p), abs=1e-5)
    flat = language.Model(["a", "b"], np.zeros((513, 2), np.float32), np.zeros(2))
    assert language.classify(["xyz"], flat) == (["a"], [0.5])


def test_ftrl_brute_force(monkeypatch):
    """Follow the regularised leader one coordinate at a time, with the same batches."""
    monkeypatch.setattr(language, "BITS", 3)
    rng = np.random.default_rng(2)
    x = np.where(rng.random((20, 8)) < 0.4, rng.random((20, 8)), 0)
    y = rng.integers(0, 3, 20)
    who, slot = np.nonzero(x)
    w, b = language.ftrl(who, slot, x[who, slot], y, 3, alpha=0.5, beta=1.0, l1=0.05, l2=0.1, epochs=2, batch=4, seed=7)
    z, n = [[0.0] * 3 for _ in range(9)], [[0.0] * 3 for _ in range(9)]

    def weight(s, c):
        if abs(z[s][c]) <= 0.05:
            return 0.0
        return -(z[s][c] - math.copysign(0.05, z[s][c])) / ((1.0 + math.sqrt(n[s][c])) / 0.5 + 0.1)

    order = np.random.default_rng(7)
    for _ in range(2):
        for group in np.array_split(order.permutation(20), 5):
            used = sorted({s for d in group for s in range(8) if x[d, s]}) + [8]
            now = {(s, c): weight(s, c) for s in used for c in range(3)}
            g = dict.fromkeys(now, 0.0)
            for d in group:
                logit = [now[8, c] + sum(x[d, s] * now[s, c] for s in range(8) if x[d, s]) for c in range(3)]
                p = np.exp(logit) / np.exp(logit).sum()
                for s, c in g:
                    g[s, c] += (1.0 if s == 8 else x[d, s]) * (p[c] - (y[d] == c)) / len(group)
            for (s, c), v in g.items():
                sigma = (math.sqrt(n[s][c] + v * v) - math.sqrt(n[s][c])) / 0.5
                z[s][c] += v - sigma * now[s, c]
                n[s][c] += v * v
    want = np.array([[weight(s, c) for c in range(3)] for s in range(9)])
    assert np.allclose(w, want[:8]) and np.allclose(b, want[8]) and (want[:8] == 0).any()


def test_language_edges(spark):
    one = spark.createDataFrame([(i, "the cat", "en") for i in range(12)] + [(99, "x", None), (None, "y", "en")], "doc_id long, text string, lang string")
    model = language.fit(one, F.lit(True))
    got = language.identify(nasty(spark).withColumn("lang_pred", F.lit("clash")), model).collect()
    assert {r["lang_pred"] for r in got} == {"en", "und"} and len(got) == len(NASTY)
    assert language.fit(one.limit(0), F.lit(True)) is None
    assert language.identify(one.limit(0), model).count() == 0 and language.identify(one.limit(0), None).count() == 0
