"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Which n-grams (orders 3 to 5, lower-cased, hashed) a text holds is compared between labelled toxic and clean
texts: r = log of the ratio of smoothed shares. N-grams with a clear ratio are kept, each present one
adds its r as feature value, and logistic regression weighs them. The labelled rows that it is fitted on are a sample
of at most ``max_positive`` + ``max_negative`` documents, taken in order of a hash of their id.

Defined cases: a null or empty text has no features and scores as the intercept; without labelled rows of
both classes every score is 0; repeated rows each get a row; a null label is no label; where a label table has several rows for an
id, the text counts as toxic if one of them says so; a very long text is read whole, in blocks; an empty table gives an empty result; a
column that clashes with the score is replaced; other columns are dropped by ``score`` and kept by ``score_column``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.batches import sliced
from plumbline.llm.ngrams import slots
from plumbline.session import cut

BITS = 20
ORDERS = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    #: Kept slots (sorted), the product of ratio and weight for each, and the intercept.
    slot: np.ndarray
    value: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """Number of the kept feature by slot, from 1; 0 where none is kept."""
        t = np.zeros((1 << BITS) + 1, np.int32)
        t[self.slot] = np.arange(1, len(self.slot) + 1)
        return t


def present(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature number) pairs of the features that ``table`` numbers from 1, in order of the texts."""
    width = np.int64(table.max() + 1)
    place = np.empty(width, np.int64)
    keys, last, again = [np.empty(0, np.int64)], -1, False
    for block in itertools.batched(slots(texts, ORDERS, BITS), len(ORDERS), strict=True):
        hits = [table[slot] for slot, _, _ in block]
        who, first = block[0][1], block[0][2]
        for w, a, b in zip(who, first, np.append(first[1:], len(hits[0])), strict=True):
            again, last = again or w == last, w
            f = np.concatenate([h[a:b] for h in hits])
            f = f[f > 0]
            at = np.arange(len(f))
            place[f] = at  # of repeats, the last one stays
            keys.append(w * width + f[place[f] == at])
    pairs = np.concatenate(keys)
    if again:  # a text had several segments
        pairs = np.unique(pairs)
    return pairs // width, pairs % width


def _all_slots() -> np.ndarray:
    t = np.arange(1, (1 << BITS) + 2, dtype=np.int32)
    t[-1] = 0
    return t


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, max_positive: int, max_negative: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of the sample: labels are slim and bounded before they meet the texts."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("y"))
    known = known.withColumnRenamed("_id", id_col).filter(learn).withColumnRenamed(id_col, "_id")
    order = F.xxhash64("_id")
    take = lambda y, n: known.filter(F.col("y") == y).orderBy(order, "_id").limit(n)
    chosen = take(1, max_positive).unionByName(take(0, max_negative))
    # At most max_positive + max_negative rows.
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", F.col("y").cast("int").alias("y"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    max_positive: int = 4000,
    max_negative: int = 8000,
    smoothing: float = 1.0,
    least_ratio: float = 1.5,
    least_texts: int = 5,
    l2: float = 1e-3,
    steps: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model | None:
    """The model learned from labelled rows for which ``learn`` holds; None without both classes."""
    sample = cut(labelled_sample(docs, labels, learn, max_positive, max_negative, id_col, text_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << BITS) + 2), np.int64)
        texts_seen = np.zeros(2, np.int64)
        table = _all_slots()
        for b in sliced(batches):
            y = np.array(b.column(1).to_pylist(), np.int64)
            who, f = present(b.column(0).to_pylist(), table)
            for c in (0, 1):
                n[c] += np.bincount(f[y[who] == c], minlength=n.shape[1])
                texts_seen[c] += int((y == c).sum())
        n[:, 0] = texts_seen  # feature 0 counts the texts
        f = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n[0][f]), pa.array(n[1][f])], ["f", "neg", "pos"])

    counted = sample.mapInArrow(count, "f bigint, neg bigint, pos bigint").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = counted.filter("f = 0").first()
    if total is None or not total["pos"] or not total["neg"]:
        return None
    share = lambda c, n: (F.col(c) + smoothing) / F.lit(n + 2.0 * smoothing)
    ratio = F.log(share("pos", total["pos"]) / share("neg", total["neg"]))
    # Bounded by the number of slots.
    kept = (
        counted.filter((F.col("f") > 0) & (F.col("pos") + F.col("neg") >= least_texts))
        .select("f", ratio.alias("r"))
        .filter(F.abs("r") >= least_ratio)
        .orderBy("f")
        .toPandas()
    )
    slot, r = kept["f"].to_numpy(np.int64) - 1, kept["r"].to_numpy(np.float64)
    table = Model(slot, r, 0.0).table()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            who, f = present(b.column(0).to_pylist(), table)
            runs = np.split(f.astype(np.int32), np.searchsorted(who, np.arange(1, b.num_rows)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(runs, pa.list_(pa.int32()))], ["y", "f"])

    data = sample.mapInArrow(rows, "y int, f array<int>").toPandas()
    y = data["y"].to_numpy(np.float64)
    lengths = data["f"].map(len).to_numpy()
    f = np.concatenate(data["f"].tolist()).astype(np.int64) - 1 if lengths.sum() else np.empty(0, np.int64)
    who = np.repeat(np.arange(len(y)), lengths)
    w, b = _regress(who, f, r, y, l2, steps)
    return Model(slot, w * r, b)


def _regress(who: np.ndarray, f: np.ndarray, r: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; classes weigh the same."""
    w, b = np.full(len(r), 0.1), 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    x = r[f]
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(who, x * w[f], minlength=len(y)) + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(f, e[who] * x, minlength=len(r)) + l2 * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score_texts(texts: list[str | None], model: Model, table: np.ndarray) -> np.ndarray:
    who, f = present(texts, table)
    z = np.bincount(who, model.value[f - 1], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_column(df: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 (1: toxic is likelier) of each whole text."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    own = df.drop(out)
    names = own.columns
    shared = df.sparkSession.sparkContext.broadcast((model.slot.astype(np.int32), model.value, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        table = m.table()
        for b in sliced(batches):
            s = score_texts(b.column(b.schema.get_field_index(text_col)).to_pylist(), m, table)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(s)], [*names, out])

    return df.mapInArrow(run, StructType([*own.schema.fields, StructField(out, DoubleType())]))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score_column(df.select(id_col, text_col), model, text_col).drop(text_col)
