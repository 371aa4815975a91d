"""Corpus preparation: cleaning, keywords, cluster summaries, assignments and triplet sampling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T

#: English stop words of the keyword operators, a short list; a longer one is a parameter.
STOP_WORDS = (
    "about above after again all also and any are because been before being between both but can could did does "
    "doing down during each few for from further had has have having her here hers him his how into its itself just "
    "more most not now off once only other our out over own same she should some such than that the their them then "
    "there these they this those through too under until very was were what when where which while who whom why will "
    "with would you your"
).split()
KEYWORD = r"[a-z]+"


def clean(df: DataFrame, text_col: str = "text", min_chars: int = 50, keep_headings: bool = False) -> DataFrame:
    """``df`` with the text stripped and ``reason`` (null: kept)."""
    stripped = T.strip(F.coalesce(F.col(text_col), F.lit("")))
    return df.withColumn(text_col, stripped).withColumn("reason", T.drop_reason(F.col(text_col), min_chars, keep_headings))


def filter_stats(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def keep_first(cleaned: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first ``n`` kept rows: a distributed top-n, not a window over all rows."""
    return cleaned.filter(F.col("reason").isNull()).drop("reason").orderBy(order_col).limit(n)


def hash_order(*parts: Column | str | int) -> Column:
    """A seeded order that any engine with md5 can repeat."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *(c.cast("string") for c in cols)))


def sample_per_group(df: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    w = Window.partitionBy(group).orderBy(hash_order(seed, F.col(group), F.col(id_col)), id_col)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order (all, if there are no more)."""
    return df.orderBy(hash_order(seed, F.col(id_col)), id_col).limit(n)


def keyword_counts(df: DataFrame, group: str, id_col: str, text_col: str = "text", stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(group, term, df, total): words of three letters or more that are no stop words; other characters part words."""
    words = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit(rf"({KEYWORD})"), 1), lambda w: (F.length(w) >= 3) & ~w.isin(list(stop_words)))
    per_text = df.select(group, id_col, F.explode(words).alias("term")).groupBy(group, id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_text.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def top_keywords(df: DataFrame, group: str, id_col: str, text_col: str = "text", k: int = 10, min_df: int = 5, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(group, rank, term, total): the commonest terms of a group that at least ``min_df`` of its texts hold.

    Where no term reaches that, the limit falls until some does.
    """
    counts = keyword_counts(df, group, id_col, text_col, stop_words)
    most = counts.groupBy(group).agg(F.max("df").alias("most"))
    ok = counts.join(most, group).filter(F.col("df") >= F.least(F.lit(min_df), F.col("most")))
    w = Window.partitionBy(group).orderBy(F.desc("total"), "term")
    return ok.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(group, "rank", "term", "total")


def keyword_lists(top: DataFrame, group: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return top.groupBy(group).agg(F.transform(pairs, lambda x: x["term"]).alias("keywords"))


def cluster_summary(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    """One row: clusters without noise, noise count and ratio, largest, smallest and (whole) median size."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col(label) != -1, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col(label) == -1, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.sum("n").alias("n_texts"),
        F.count(real).alias("n_clusters"),
        noise.alias("noise_count"),
        (noise / F.sum("n")).alias("noise_ratio"),
        F.max(real).alias("largest"),
        F.min(real).alias("smallest"),
        F.percentile(real, F.lit(0.5)).cast("int").alias("median"),
    )


def cluster_sizes(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("all"))
    return sizes.join(F.broadcast(total)).select(label, "size", (F.col("size") / F.col("all")).alias("ratio"), (F.col(label) == -1).alias("is_noise"))


def triplet_splits(
    texts: DataFrame, label: str, id_col: str, sizes: tuple[int, int, int] = (50, 50, 50), per_domain: int = 10, seed: int = 42, keep_noise: bool = False
) -> DataFrame:
    """(triplet, cluster_label, domain_triplet_index, split, sample_idx, id): disjoint sets of one cluster each.

    Triplets are numbered over clusters in order of their label; clusters with too few texts give none.
    """
    need = sum(sizes)
    src = texts.select(F.col(label).alias("cluster_label"), F.col(id_col).alias("text_id"))
    if not keep_noise:
        src = src.filter("cluster_label != -1")
    big = src.groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need)
    # One row per cluster: numbering them is a small window.
    numbered = big.withColumn("c", F.row_number().over(Window.orderBy("cluster_label")) - 1).drop("n")
    drawn = src.join(F.broadcast(numbered), "cluster_label").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per_domain))))
    w = Window.partitionBy("cluster_label", "k").orderBy(hash_order(seed, F.col("cluster_label"), F.col("k"), F.col("text_id")), "text_id")
    a, b = sizes[0], sizes[0] + sizes[1]
    split = F.when(F.col("r") <= a, "train").when(F.col("r") <= b, "validation").otherwise("test")
    cutoff = drawn.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= need).withColumn("split", split)
    within = Window.partitionBy("cluster_label", "k", "split").orderBy("text_id")
    return cutoff.select(
        T.triplet_name(F.col("c") * per_domain + F.col("k")).alias("triplet"),
        "cluster_label",
        F.col("k").alias("domain_triplet_index"),
        "split",
        (F.row_number().over(within) - 1).alias("sample_idx"),
        "text_id",
    )


def triplet_skips(texts: DataFrame, label: str, sizes: tuple[int, int, int], per_domain: int) -> DataFrame:
    """The clusters that are too small, with the triplets they would have given."""
    counts = texts.filter(F.col(label) != -1).groupBy(F.col(label).alias("cluster_label")).agg(F.count(F.lit(1)).alias("cluster_size"))
    return counts.filter(F.col("cluster_size") < sum(sizes)).select(
        "cluster_label", "cluster_size", F.lit(sum(sizes)).alias("required_cluster_size"), F.lit(per_domain).alias("skipped_triplets")
    )
