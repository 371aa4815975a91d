"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Orders 1 to 3 of the lower-cased whole text are hashed; a feature's value is its share of the text's n-grams times its
inverse document frequency. Weights come from follow-the-regularised-leader with elastic-net penalties (most stay
exactly 0), over a sample of the first ``max_rows`` labelled texts in order of a hash of their id and the first ``each`` of every
language, so that rare ones are learned too; one in five of these is held back to fit the temperature that calibrates
the probabilities, but no language's only texts.

The driver holds the pairs of at most max_rows + each * languages texts, a text having at most 2 ** BITS of them.

Defined cases: ``und`` and score 0 where the text is null or has no letter, or nothing could be learned; with
one learned language that is always the answer; ties go to the alphabetically first language; a very long text is read whole, in blocks;
repeated rows each get a row; an empty table gives an empty result; columns that clash with the results, and all others, are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.batches import sliced
from plumbline.llm.ngrams import slots
from plumbline.session import cut

BITS = 15
ORDERS = (1, 2, 3)
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: idf * weight / temperature by slot and language, with a last row of zeros; bias / temperature.
    weight: np.ndarray
    bias: np.ndarray


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (text, slot) pairs as two arrays, and the share of the text's n-grams."""
    keys = []
    for slot, who, first in slots(texts, ORDERS, BITS):
        owner = np.repeat(who, np.diff(np.append(first, len(slot))))
        ok = slot < 1 << BITS
        keys.append((owner[ok] << BITS) + slot[ok])
    pairs, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    who, slot = pairs >> BITS, pairs & ((1 << BITS) - 1)
    total = np.bincount(who, n, minlength=len(texts))
    return who, slot, n / total[who]


def ftrl(who, slot, value, y, n_langs, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3, epochs=4, batch=16, seed=7) -> tuple[np.ndarray, np.ndarray]:
    """Weights [slots, languages] and bias, by FTRL-proximal steps on small batches."""
    size = 1 << BITS
    z, n = np.zeros((size + 1, n_langs)), np.zeros((size + 1, n_langs))
    rows = int(y.size)
    cut_at = np.searchsorted(who, np.arange(rows + 1))
    order = np.random.default_rng(seed)

    def weights(s):
        zs, ns = z[s], n[s]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for group in np.array_split(order.permutation(rows), max(1, rows // batch)):
            at = np.concatenate([np.arange(cut_at[d], cut_at[d + 1]) for d in group])
            local = np.repeat(np.arange(len(group)), cut_at[group + 1] - cut_at[group])
            used, inv = np.unique(slot[at], return_inverse=True)
            w, wb = weights(used), weights(np.array([size]))
            x = np.zeros((len(group), len(used)))
            x[local, inv] = value[at]
            logit = x @ w + wb
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(group)), y[group]] -= 1
            for s, g, ws in ((used, x.T @ p / len(group), w), (np.array([size]), p.mean(0, keepdims=True), wb)):
                sigma = (np.sqrt(n[s] + g * g) - np.sqrt(n[s])) / alpha
                z[s] += g - sigma * ws
                n[s] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def fit(docs: DataFrame, learn: Column, max_rows: int = 4000, each: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model of the rows with a language for which ``learn`` holds; None if there are none."""
    known = docs.filter(learn).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.filter("lang IS NOT NULL AND text IS NOT NULL")
    keyed, order = known.select("id", "lang"), [F.xxhash64("id"), F.col("id")]
    common = keyed.orderBy(*order, "lang").limit(max_rows)
    by_lang = keyed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= each).drop("r")
    chosen = common.unionByName(by_lang).select(F.col("id").alias("_id")).distinct()
    # At most max_rows ids and each by language; rows that repeat an id count once.
    sample = cut(known.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "lang", "text"))
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            who, slot, value = features(b.column(2).to_pylist())
            at = np.searchsorted(who, np.arange(1, b.num_rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.split(slot.astype(np.int32), at), pa.list_(pa.int32())), pa.array(np.split(value.astype(np.float32), at), pa.list_(pa.float32()))],
                ["id", "lang", "slot", "value"],
            )

    data = sample.mapInArrow(rows, f"id {docs.schema[id_col].dataType.simpleString()}, lang string, slot array<int>, value array<float>").toArrow().combine_chunks()
    keys = data.select(["id", "lang"]).to_pandas()
    order = keys.sort_values(["id", "lang"], kind="stable").drop_duplicates("id").index.to_numpy()
    y = keys["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)[order]
    runs = data["slot"].combine_chunks()
    start, lengths = runs.offsets.to_numpy()[order], np.diff(runs.offsets.to_numpy())[order]
    at = np.arange(lengths.sum()) + np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
    who = np.repeat(np.arange(len(y)), lengths)
    slot = runs.values.to_numpy()[at].astype(np.int64)
    value = data["value"].combine_chunks().values.to_numpy()[at].astype(np.float64)
    idf = np.log((1 + len(y)) / (1 + np.bincount(slot, minlength=1 << BITS))) + 1
    value = value * idf[slot] * 30  # a scale near 1 for the commonest n-grams
    back = np.arange(len(y)) % 5 == 4
    back &= np.bincount(y[~back], minlength=len(langs))[y] > 0
    train = np.flatnonzero(~back)
    pick = ~back[who]
    renumber = np.cumsum(~back) - 1
    w, b = ftrl(renumber[who[pick]], slot[pick], value[pick], y[train], len(langs))
    logits = np.stack([np.bincount(who, value * w[slot, c], minlength=len(y)) for c in range(len(langs))], 1) + b
    t = temperature(logits[back], y[back]) if back.any() else 1.0
    table = np.zeros(((1 << BITS) + 1, len(langs)), np.float32)
    table[:-1] = w * idf[:, None] * 30 / t
    return Model(langs, table, b / t)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor with the least log loss on held-back rows, from a fixed grid."""
    def loss(t):
        s = logits / t
        top = s.max(1)
        return float((top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.exp(np.linspace(-2, 2, 81)), key=loss))


def classify(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    k = len(model.langs)
    sums, total = np.zeros((len(texts), k)), np.zeros(len(texts))
    for slot, who, first in slots(texts, ORDERS, BITS):
        np.add.at(total, who, np.add.reduceat((slot < 1 << BITS).astype(np.int64), first))
        for c in range(k):
            np.add.at(sums[:, c], who, np.add.reduceat(model.weight[slot, c], first, dtype=np.float64))
    z = sums / np.maximum(total, 1)[:, None] + model.bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    known = [t is not None and LETTER.search(t) is not None for t in texts]
    return (
        [model.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)],
        [float(x) if ok else 0.0 for x, ok in zip(p[np.arange(len(best)), best], known, strict=True)],
    )


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    if model is None:
        return df.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast((model.langs, model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in sliced(batches):
            if not b.num_rows:
                continue
            lang, p = classify(b.column(1).to_pylist(), m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], [id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")
