"""The corpus pipeline: quality rules, toxicity, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. Models
are learned from those labelled documents that reach the stage.

Defined cases: a null, empty or wordless text goes in the first stage; a null doc_id is kept like any other, but is not labelled; a very
long text is treated whole; rows that repeat an id with another text are documents of their own, those that repeat the text too
go in exact dedup; equal texts, and the members of a near-duplicate class, leave their smallest id; a table without labels, or with
labels of one kind, drops nothing by a model; an empty table gives no pieces; columns of any name, those that operators add
included, come through all stages but the last unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, near_dedup, packing, quality, toxicity
from plumbline.session import MADE, fresh_path, remove, table

#: Rows of an Arrow batch: stages follow one another in the same executors, so each holds little.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """A stage's result is lazy, so the setting outlasts the stage; ``run`` puts the session's own back."""
    spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): all other columns in a struct, out of the way of what operators add."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("_row"))


def whole(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``apart`` with the columns of ``docs`` again."""
    return df.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return whole(quality.judge_column(apart(docs), model).filter("kept"), docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return whole(toxicity.score_column(apart(docs), model).filter("score < 0.5"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return whole(exact_dedup.content_sort(apart(docs)).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    marked = apart(docs).withColumn("_h", F.md5(F.coalesce("text", F.lit(""))))  # ids may repeat with other texts
    kept = near_dedup.classes(marked, carry=("_h",)).filter("kept").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_kept"))
    return whole(marked.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_kept")), "left_semi"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Trained models and packing are not SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn. What a stage wrote in the shared folder is deleted once its result is; the last table stays, as packing reads it."""
    docs, last = table(spark, sf_dir, "documents"), None
    batch = spark.conf.get(BATCH_CONF)
    try:
        for name, stage in STAGES[:-1]:
            mark = len(MADE)
            path = fresh_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            for made in [p for p in MADE[mark:] if p != path] + ([last] if last else []):
                remove(spark, made)
            del MADE[mark:]
            docs, last = spark.read.parquet(path), path
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.set(BATCH_CONF, batch)
