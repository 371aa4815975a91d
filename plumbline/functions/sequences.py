"""Token-array operators: chunking, masking, padding, overlap scores, dataset views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from plumbline.operators.prefix import sums_before

IGNORE = -100


def chunks(df: DataFrame, order: str, tokens: str, size: int, keep_empty_tail: bool = False) -> DataFrame:
    """(chunk, tokens): all rows' tokens in order, cut every ``size``.

    Offsets come from running sums of row lengths; tokens meet by chunk. With
    ``keep_empty_tail`` a total that ``size`` divides gets one more, empty chunk.
    """
    starts = sums_before(df.select(order, tokens), [order], first=F.size(tokens))
    long = starts.select(F.posexplode(tokens).alias("p", "t"), "first").withColumn("at", F.col("first") + F.col("p"))
    made = long.groupBy(F.floor(F.col("at") / size).cast("int").alias("chunk")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]).alias("tokens"))
    if keep_empty_tail:
        total = df.agg(F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("n")).filter(F.col("n") % size == 0)
        kind = df.schema[tokens].dataType.simpleString()
        made = made.unionByName(total.select((F.col("n") / size).cast("int").alias("chunk"), F.expr(f"cast(array() as {kind})").alias("tokens")))
    return made


def chat_labels(prompt: Column, answer: Column, eos: int) -> tuple[Column, Column]:
    """(input_ids, labels): prompt masked, end token appended and learned."""
    end = F.array(F.lit(eos))
    return F.concat(prompt, answer, end), F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), answer, end)


def completion_labels(prefix: Column, text: Column, max_length: int, insert_space: bool = False) -> tuple[Column, Column]:
    """(input_ids, labels) of a prefix and its continuation, cut at prefix + ``max_length``; position 0 never has a loss."""
    ids = F.slice(F.concat(prefix, text), F.lit(1), F.size(prefix) + max_length)
    masked = F.greatest(F.size(prefix), F.lit(1))
    return ids, F.transform(ids, lambda x, i: F.when(i < masked, F.lit(IGNORE)).otherwise(x))


def pad(ids: Column, length: Column | int, value: int, left: bool = False) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    fill = F.array_repeat(F.lit(value), F.greatest(n - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def attention(ids: Column, pad_id: int) -> Column:
    """1 where the id isn't padding; a genuine id that equals ``pad_id`` counts as padding too."""
    return F.transform(ids, lambda x: (x != pad_id).cast("int"))


def target_ids(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != IGNORE)


def shifted(labels: Column) -> Column:
    """Labels aligned with the position that predicts them."""
    return F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))


def valid_labels(labels: Column) -> Column:
    """Labelled ids without the last one (the end token)."""
    t = target_ids(labels)
    return F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))


def rouge1_recall(reference: Column, generated: Column) -> Column:
    """Share of the reference's words that the generated text has, counted with repeats."""
    hits = F.aggregate(
        F.array_distinct(reference), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(reference, lambda x: x == w)), F.size(F.filter(generated, lambda x: x == w)))
    )
    return hits / F.nullif(F.size(reference), F.lit(0))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _measure(stem: str) -> int:
    """How often a run of vowels is followed by one of consonants."""
    kinds = ""
    for c in stem:
        vowel = c in "aeiou" or (c == "y" and kinds[-1:] == "c")
        kinds += "v" if vowel else "c"
    return kinds.count("vc")


def _ends_short(s: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    shape = "".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))
    return shape[-3:] == "cvc" and s[-1] not in "wxy"


def _has_vowel(s: str) -> bool:
    return any(c in "aeiou" or (c == "y" and i) for i, c in enumerate(s))


# Fixed values of Porter's published stemmer: endings and what takes their place, by step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, ends) -> str | None:
    return max((e for e in ends if w.endswith(e)), key=len, default=None)


def stem(w: str) -> str:
    """Porter's stem of a lower-case English word; words of up to three letters stay, as overlap scores have it."""
    if len(w) <= 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (e := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _ends_short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (e := _longest(w, table)) and _measure(w[: -len(e)]):
            w = w[: -len(e)] + table[e]
    if (e := _longest(w, STEP_4)) and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Word arrays stemmed; each distinct word of a batch once."""
    known: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in ws])


def stopped(ids: Column, prompt: Column, stop: Column) -> Column:
    """Whether a sequence ends generation: the text of its last tokens, two more than the stop sequence has, holds that.

    ``ids`` and ``stop`` are arrays of token texts, ``prompt`` the number of tokens given; what was given is never looked at.
    """
    own = F.slice(ids, prompt + 1, F.greatest(F.size(ids) - prompt, F.lit(0)))
    back = F.least(F.size(own), F.size(stop) + 2)
    tail = F.slice(own, F.size(own) - back + 1, back)
    return (F.size(own) > 0) & F.contains(F.array_join(tail, ""), F.array_join(stop, ""))


@F.pandas_udf(StructType([StructField("recall", DoubleType()), StructField("f1", DoubleType())]))
def rouge_l(reference: pd.Series, generated: pd.Series) -> pd.DataFrame:
    """Longest-common-subsequence recall and F1 of word arrays."""
    out = []
    for r, g in zip(reference, generated, strict=True):
        n = lcs(list(r), list(g))
        rec, pre = n / max(1, len(r)), n / max(1, len(g))
        out.append((rec, 2 * rec * pre / (rec + pre) if n else 0.0))
    return pd.DataFrame(out, columns=["recall", "f1"])


def pick(df: DataFrame, key: str, pool: DataFrame, pool_key: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Each row with one pool row drawn by a hash of (seed, epoch, key); the pool is numbered in order of its key."""
    numbered = sums_before(pool, [pool_key], _i=F.lit(1))
    size = pool.agg(F.count(F.lit(1)).alias("_n"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.crossJoin(F.broadcast(size)).withColumn("_i", h % F.col("_n")).join(numbered, "_i").drop("_i", "_n")


def few_shot(df: DataFrame, pool: DataFrame, order: str, text: str, k: int, delimiter: str = "\n\n") -> DataFrame:
    """``df`` with a ``prefix`` of the pool's first ``k`` texts."""
    first = pool.orderBy(order).limit(k).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("_e"))
    return df.crossJoin(F.broadcast(first.select(F.array_join("_e", delimiter).alias("prefix"))))


def expand_answers(df: DataFrame, answers: str) -> DataFrame:
    """One row per answer of an item, with its number."""
    return df.select(*(c for c in df.columns if c != answers), F.posexplode(answers).alias("answer_idx", "answer"))


def with_alternate(question: Column, answer: Column, alternate: Column, only_alternate: bool = False) -> Column:
    """The question with its own and an alternate answer, or with the alternate alone."""
    other = F.struct(question.alias("question"), alternate.alias("answer"))
    if only_alternate:
        return F.struct(other.alias("alternate"))
    return F.struct(F.struct(question.alias("question"), answer.alias("answer")).alias("original"), other.alias("alternate"))
