"""Ports for what runs outside: scorers, embedders and tokenizers are functions over pandas batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def apply_scorer(df: DataFrame, model_col: str, load: Callable[[str], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows scored by the model that ``model_col`` names.

    Rows are dealt by model and sorted, so a task loads each of its models once; ``load(name)`` gives a function from batch to scored batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, score = None, None
        for pdf in batches:
            for m, part in pdf.groupby(model_col, sort=False):
                if m != name:
                    name, score = m, load(m)
                yield score(part)

    return df.repartition(model_col).sortWithinPartitions(model_col).mapInPandas(run, schema)


def embed(df: DataFrame, id_col: str, text_col: str, encode: Callable[[list[str]], np.ndarray], normalise: bool = True) -> DataFrame:
    """(id, embedding): batches of texts through ``encode``; a batch with another number of vectors fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.asarray(encode(pdf[text_col].fillna("").tolist()), np.float32)
            if len(v) != len(pdf):
                raise ValueError(f"{len(v)} vectors for {len(pdf)} texts")
            if normalise and len(v):
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": list(v)})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, embedding array<float>")


def tokenize(df: DataFrame, text_col: str, encode: Callable[[str], list[int]], max_length: int | None = None, out: str = "ids") -> DataFrame:
    """``df`` with the ids of each text, cut at ``max_length``."""
    ids = F.pandas_udf(lambda s: s.map(lambda t: encode(t or "")[:max_length]), "array<int>")
    return df.withColumn(out, ids(text_col))


def half(df: DataFrame, col: str) -> DataFrame:
    """A float column rounded to what a half-precision number holds."""
    to_half = F.pandas_udf(lambda s: s.astype(np.float16).astype(np.float32), FloatType())
    return df.withColumn(col, to_half(F.col(col).cast("float")))
