"""Dataset views, name registries and small lookups of the evaluation framework."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.prefix import sums_before

#: Names of the weight matrices that task vectors are made of.
WEIGHTS = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")
#: Splits that stay apart in evaluation; all others are training data.
EVAL_SPLITS = ("eval", "test")


def is_weight(name: Column) -> Column:
    return name.rlike("|".join(WEIGHTS))


def collapse_splits(df: DataFrame, split: str = "split") -> DataFrame:
    return df.withColumn(split, F.when(F.col(split).isin(*EVAL_SPLITS), F.col(split)).otherwise("train"))


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def first_mentions(df: DataFrame, name: str, order: str) -> DataFrame:
    """(pos, name): each value once, in order of first mention."""
    first = df.groupBy(name).agg(F.min(order).alias("_at"))
    return sums_before(first, ["_at"], pos=F.lit(1)).select(name, F.col("pos").cast("int").alias("pos"))


def member_filter(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is wanted, and the wanted keys that are missing."""
    return df.join(wanted, key, "left_semi"), wanted.join(df, key, "left_anti")


def complete(pair: DataFrame, sides: tuple[str, ...], splits: tuple[str, ...]) -> DataFrame:
    """Pairs whose maps hold all splits on all sides."""
    keys = F.array(*map(F.lit, splits))

    def has_all(side: str) -> Column:
        return F.forall(keys, lambda k: F.try_element_at(F.col(side), k).isNotNull())

    ok = F.lit(True)
    for side in sides:
        ok = ok & has_all(side)
    return pair.filter(ok)


def with_reference(metrics: DataFrame, reference: DataFrame, key: str = "metric") -> DataFrame:
    """Metric values beside the reference run's, null where that has none."""
    return metrics.join(reference.select(key, F.col("agg_value").alias("reference")), key, "left")


def warmup_steps(samples: int, batch: int, accumulation: int, devices: int, epochs: float, warmup_epochs: float) -> tuple[int, int]:
    """(steps in all, warm-up steps); an epoch has at least one step."""
    per_epoch = max(1, samples // (batch * accumulation * devices))
    return int(per_epoch * epochs), int(per_epoch * warmup_epochs)


def chat(turns: DataFrame, conv: str, order: str, role: str, text: str, tags: dict[str, tuple[str, str]], system: str | None = None) -> DataFrame:
    """(conv, prompt): turns in order between their role's start and end tag, after an optional system prompt."""
    tagged = F.lit("")
    for name, (start, end) in tags.items():
        tagged = F.when(F.col(role) == name, F.concat(F.lit(start), F.col(text), F.lit(end))).otherwise(tagged)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), tagged.alias("t"))))
    prompt = F.array_join(F.transform(ordered, lambda x: x["t"]), "")
    return turns.groupBy(conv).agg((F.concat(F.lit(system), prompt) if system else prompt).alias("prompt"))


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("", "_right")) -> DataFrame:
    """``left`` with its one row of ``right``: a row of ``left`` without one, or a key that ``right`` repeats, fails the job as it is read.

    So there are as many rows as in ``left``. Other columns that both have get the suffixes.
    """
    both = [c for c in left.columns if c in right.columns and c not in keys]
    own = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    other = right.withColumnsRenamed({c: c + suffixes[1] for c in both})
    rest = [c for c in other.columns if c not in keys]
    one = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    joined = own.join(one, keys, "left")
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.when(F.col("_n").isNull(), "a key is missing").otherwise("a key repeats")).cast("boolean"))
    return joined.filter(ok).select(*own.columns, *(F.col("_r").getField(c).alias(c) for c in rest))


def resume_after(todo: DataFrame, done: DataFrame, order: str, text: str) -> DataFrame:
    """The rows of ``todo`` after as many as ``done`` has; both are numbered by ``order``, and a done text that differs from the one in its place fails."""
    t, d = sums_before(todo, [order], _i=F.lit(1)), sums_before(done, [order], _i=F.lit(1)).select("_i", F.col(text).alias("_t"))
    j = t.join(d, "_i", "left")
    n = done.agg(F.count(F.lit(1)).alias("_n"))
    same = F.when(F.col("_t").isNull() | (F.col("_t") == F.col(text)), True).otherwise(F.raise_error("a finished row has another text").cast("boolean"))
    return j.filter(same).crossJoin(F.broadcast(n)).filter(F.col("_i") >= F.col("_n")).select(*todo.columns)


def warmup_columns(samples: Column, batch: int, accumulation: int, devices: int, epochs: float, warmup_epochs: float) -> tuple[Column, Column]:
    """``warmup_steps`` of a column of sample counts."""
    per_epoch = F.greatest(F.lit(1), F.floor(samples / (batch * accumulation * devices)))
    return (per_epoch * epochs).cast("int"), (per_epoch * warmup_epochs).cast("int")


def min_max(c: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))
