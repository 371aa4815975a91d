"""Scores of samples before and after removal of a forget set, by an additive-smoothed count language model.

A stand-in for a neural scorer with exact removal: the removed model counts the corpus without the forget set's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prefix import sums_before
from plumbline.session import stored


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w, n): lower-case ASCII words of each text with their counts."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit("([a-z]+)"), 1)
    return df.select(id_col, F.explode(words).alias("w")).groupBy(id_col, "w").agg(F.count(F.lit(1)).alias("n"))


def unigram(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, c) and one row (N, V)."""
    c = counts.groupBy("w").agg(F.sum("n").alias("c"))
    return c, c.agg(F.sum("c").alias("N"), F.count(F.lit(1)).alias("V"))


#: A word is common from this share of the models on, and is then computed in the grid.
COMMON = 1 / 8
#: Numbers of all models together up to which they are broadcast.
BROADCAST = 1 << 23


def score_pairs(triplets: DataFrame, texts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Long table of losses: every model (its train split removed) on every sample of every triplet.

    The unlearned loss is the base loss plus corrections for the words that forget set and sample share. Words in few forget sets
    are joined, so only shared ones meet. Common ones would be hot keys with a row for nearly every model and sample, which
    is the grid itself: each model has an array of their corrections, and the grid's rows look up their sample's words in it.
    """
    counts = stored(tokens(texts, "text_id", "text"), "score-counts")
    vocab, size = unigram(counts)
    used = triplets.select("text_id").distinct()
    own = counts.join(used, "text_id", "left_semi").join(vocab, "w")
    key = ["triplet", "split", "sample_idx"]
    sample = stored(triplets.select(*key, "text_id").join(own, "text_id"), "score-samples")
    base = sample.groupBy(*key).agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * -F.log(F.col("c") + alpha)).alias("b"))
    forget = sample.filter("split = 'train'").groupBy(F.col("triplet").alias("model_triplet"), "w").agg(F.sum("n").alias("cm"), F.max("c").alias("cw"))
    gain = F.log(F.col("cw") + alpha) - F.log(F.col("cw") - F.col("cm") + alpha)
    forget = stored(forget.withColumn("g", gain), "score-forget")
    removed = forget.groupBy("model_triplet").agg(F.sum("cm").alias("Nm"))
    models = removed.count()

    # At most 1 / COMMON times the words of a forget set, however many models there are.
    often = forget.groupBy("w").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= max(2, COMMON * models))
    common = stored(sums_before(often.select("w"), ["w"], h=F.lit(1)).withColumn("h", F.col("h").cast("int")), "score-common")
    width = common.count()
    entries = forget.join(F.broadcast(common), "w").groupBy("model_triplet").agg(F.map_from_entries(F.collect_list(F.struct("h", "g"))).alias("by"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda h: F.coalesce(F.try_element_at("by", h), F.lit(0.0))) if width else F.array().cast("array<double>")
    removed = removed.join(entries, "model_triplet", "left").withColumn("by", F.coalesce("by", F.expr("cast(map() as map<int,double>)"))).withColumn("gs", dense).drop("by")
    met = sample.join(F.broadcast(common), "w").groupBy(*key).agg(F.collect_list(F.struct("h", "n")).alias("hs"))
    base = base.join(met, key, "left")

    rare = forget.join(F.broadcast(common), "w", "left_anti").select("model_triplet", "w", "g")
    shared = sample.select(*key, "w", "n").join(rare, "w").groupBy("model_triplet", *key).agg(F.sum(F.col("n") * F.col("g")).alias("d"))
    # models x samples is the wanted result
    grid = base.crossJoin(F.broadcast(removed) if models * max(1, width) <= BROADCAST else removed).crossJoin(F.broadcast(size))
    looked_up = F.aggregate(F.coalesce("hs", F.array()), F.lit(0.0), lambda s, x: s + x["n"] * F.get("gs", x["h"]))
    grid = grid.withColumn("dc", looked_up).drop("hs", "gs")
    full = grid.join(shared, ["model_triplet", *key], "left").withColumn("d", F.coalesce("d", F.lit(0.0)) + F.col("dc"))
    n, v = F.col("n_tokens"), F.col("V") * alpha
    base_loss = F.col("b") / n + F.log(F.col("N") + v)
    new_loss = (F.col("b") + F.coalesce("d", F.lit(0.0))) / n + F.log(F.col("N") - F.col("Nm") + v)
    return full.select("model_triplet", F.col("triplet").alias("eval_triplet"), "split", "sample_idx", "n_tokens", base_loss.alias("bl"), new_loss.alias("ul"))


def round_scores(df: DataFrame) -> DataFrame:
    """Loss to 6 and perplexity to 2 decimals, as stored; ratios are made from the stored values."""
    return df.select(
        "model_triplet", "eval_triplet", "split", "sample_idx",
        F.round("bl", 6).alias("base_loss"), F.round(F.exp("bl"), 2).alias("base_ppl"),
        F.round("ul", 6).alias("unlearn_loss"), F.round(F.exp("ul"), 2).alias("unlearn_ppl"), "n_tokens",
    )


def weighted_loss(df: DataFrame, *keys: str, loss: str = "base_loss", n: str = "n_tokens") -> DataFrame:
    """Token-weighted mean loss and its perplexity by key; infinite without tokens."""
    total = F.sum(n)
    mean = F.when(total > 0, F.sum(F.col(loss) * F.col(n)) / total).otherwise(F.lit(float("inf")))
    return df.groupBy(*keys).agg(mean.alias("avg_loss"), F.exp(mean).alias("ppl"), total.alias("n_tokens"))


def log_ratio(unlearn: Column, base: Column, floor: float = 1e-6) -> Column:
    return F.log(F.greatest(unlearn, F.lit(floor)) / F.greatest(base, F.lit(floor)))
