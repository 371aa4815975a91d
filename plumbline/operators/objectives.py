"""Values of unlearning objectives over score tables (losses are given; nothing is trained here).

Sequence tables have (idx, nll[, ref_nll, n]); token tables have (idx, pos, nll) with only labelled positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequence_nll(tokens: DataFrame, key: str = "idx") -> DataFrame:
    return tokens.groupBy(key).agg(F.sum("nll").alias("nll"), F.count(F.lit(1)).alias("n"))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def grad_ascent(tokens: DataFrame) -> DataFrame:
    return tokens.agg((-F.avg("nll")).alias("loss"))


def grad_diff(forget: DataFrame, retain: DataFrame, gamma: float = 1.0, alpha: float = 1.0) -> DataFrame:
    f, r = forget.agg((-F.avg("nll")).alias("f")), retain.agg(F.avg("nll").alias("r"))
    return f.crossJoin(F.broadcast(r)).select((gamma * F.col("f") + alpha * F.col("r")).alias("loss"))


def kl(ref: Column, cur: Column) -> Column:
    """KL divergence of log-probability arrays, sum of exp(ref) * (ref - cur)."""
    return F.aggregate(F.zip_with(ref, cur, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def npo(lose: DataFrame, beta: float = 1.0) -> DataFrame:
    """Negative preference optimisation: only the losing side, against a reference."""
    ratio = -(F.col("nll") - F.col("ref_nll"))
    return lose.agg((-2 / beta * F.avg(log_sigmoid(beta * (0 - ratio)))).alias("loss"))


def dpo(win: DataFrame, lose: DataFrame, beta: float = 1.0, key: str = "idx") -> DataFrame:
    w = win.select(key, (-(F.col("nll") - F.col("ref_nll"))).alias("w"))
    j = w.join(lose.select(key, (-(F.col("nll") - F.col("ref_nll"))).alias("l")), key)
    return j.agg((-2 / beta * F.avg(log_sigmoid(beta * (F.col("w") - F.col("l"))))).alias("loss"))


def simnpo(seqs: DataFrame, beta: float = 1.0, delta: float = 0.0) -> DataFrame:
    """Without reference, by length: -2/beta * logsigmoid(beta * (nll / n - delta))."""
    return seqs.agg((-2 / beta * F.avg(log_sigmoid(beta * (F.col("nll") / F.col("n") - delta)))).alias("loss"))


def wga(tokens: DataFrame, beta: float = 1.0) -> DataFrame:
    return tokens.agg((-F.avg(F.pow(F.exp(-F.col("nll")), F.lit(beta)) * F.col("nll"))).alias("loss"))


def satimp(tokens: DataFrame, beta1: float = 5.0, beta2: float = 1.0) -> DataFrame:
    p = F.exp(-F.col("nll"))
    return tokens.agg((-F.avg(F.pow(p, F.lit(beta1)) * F.pow(1 - p, F.lit(beta2)) * F.col("nll"))).alias("loss"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def cross_entropy(target: Column, logits: Column) -> Column:
    """Of a target distribution against logits."""
    z = log_sum_exp(logits)
    return -F.aggregate(F.zip_with(target, logits, lambda t, x: t * (x - z)), F.lit(0.0), lambda s, x: s + x)


def undial(df: DataFrame, beta: float = 10.0) -> DataFrame:
    """(logits, teacher, label): cross entropy against the teacher whose true logit is lowered by ``beta``."""
    soft = softmax(F.transform("teacher", lambda x, i: F.when(i == F.col("label"), x - beta).otherwise(x)))
    return df.agg(F.avg(cross_entropy(soft, F.col("logits"))).alias("loss"))


def ceu(df: DataFrame, skip: int = 0) -> DataFrame:
    """(idx, pos, logits, label): cross entropy against the own distribution without the true token, after ``skip`` answer tokens."""
    soft = softmax(F.transform("logits", lambda x, i: F.when(i == F.col("label"), F.lit(float("-inf"))).otherwise(x)))
    return df.filter(F.col("pos") >= skip).agg(F.avg(cross_entropy(soft, F.col("logits"))).alias("loss"))


def pdu(df: DataFrame) -> DataFrame:
    """(logits): mean of (largest - mean logit) squared."""
    mean = F.aggregate("logits", F.lit(0.0), lambda s, x: s + x) / F.size("logits")
    return df.agg(F.avg(F.pow(F.array_max("logits") - mean, F.lit(2.0))).alias("loss"))


def dual_step(weight: float, retain_loss: float, limit: float, rate: float) -> float:
    """The dual variable after one epoch: it rises while the retain loss is above its limit, and never below 0."""
    return max(0.0, weight + rate * (retain_loss - limit))


def rmu(df: DataFrame) -> DataFrame:
    """(activation, control): mean squared distance of supplied activations from the control vector."""
    d = F.aggregate(F.zip_with("activation", "control", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("activation")
    return df.agg(F.avg(d).alias("loss"))
