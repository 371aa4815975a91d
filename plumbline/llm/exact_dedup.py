"""Exact dedup by content sort, in DataFrame operations only.

A first pass over the texts writes a slim table: id, digest, a second hash and length, and a sort key of a bounded prefix of the normalised
bytes and the digest. Splitters sampled from it range-partition the texts, which are read once more and shuffled once; an external sort
within each partition places equal contents side by side, and neighbours are compared over their full bytes. A content
that holds a large share of all rows is dealt over several partitions by a salt: each salt's neighbours are compared as any
others, neighbours of one digest and unequal bytes fail the job, and so do a digest's rows of unequal length or second
hash; its size and kept id are summed over the salts from the slim table.

Defined cases: a null text counts as empty; a very long one is sorted and compared whole; ids may repeat (equal texts with the
same id: exactly one of the rows stays); a null id stays only where all are null; an empty table gives an empty
result; columns of the input that clash with the added ones are replaced by those.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import shuffle_partitions, stored

#: Bytes of content in a splitter.
PREFIX = 64
#: A content is hot from 1/(HOT_PARTS * partitions) of all rows on.
HOT_PARTS = 4
#: Sampled keys by partition, from which splitters are taken; the driver holds about so many times the partitions.
SAMPLED = 40

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def sort_key(body: Column, sha: Column, salt: Column) -> Column:
    """Bytes that order contents by their prefix, then their digest and salt."""
    return F.concat(F.rpad(F.substring(body, 1, PREFIX), PREFIX, F.lit(b"\0")), sha, F.unhex(F.lpad(F.hex(salt), 16, "0")))


def place(key: Column, splitters: list[bytes]) -> Column:
    """How many splitters are at most ``key``; they are looked up by blocks, then within one."""
    if not splitters:
        return F.lit(0)
    width = math.isqrt(len(splitters)) + 1
    all_of, heads = F.array(*map(F.lit, map(bytes, splitters))), F.array(*map(F.lit, map(bytes, splitters[::width])))
    below = lambda a: F.size(F.filter(a, lambda s: s <= key))
    block = F.greatest(below(heads) - 1, F.lit(0))
    return F.get(F.transform(F.array(block), lambda b: b * width + below(F.slice(all_of, b * width + 1, F.lit(width)))), F.lit(0))


def content_sort(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep`` says whether the smallest (``min``) or the largest (``max``) id of equal contents stays.
    """
    parts = shuffle_partitions(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = (normalise(text) if normalise else text).cast("binary")
    own = [c for c in df.columns if c not in ADDED]
    sha = F.unhex(F.sha2(body, 256))
    best = F.max if keep == "max" else F.min

    slim = df.select(F.col(id_col).alias("id"), sha.alias("sha"), F.struct(F.octet_length(body), F.xxhash64(body)).alias("check"), F.substring(body, 1, PREFIX).alias("prefix"))
    slim = stored(slim, "exact-slim")
    total = slim.count()
    # At most HOT_PARTS * parts digests can reach the limit, whatever the input: small enough to broadcast.
    limit = max(64, total // (HOT_PARTS * parts))
    hot = (
        slim.groupBy(F.col("sha").alias("_hot"))
        .agg(F.count(F.lit(1)).alias("_all_n"), best("id").alias("_all_best"), (F.min("check") == F.max("check")).alias("one"))
        .filter(F.col("_all_n") > limit)
        .withColumn("_salts", F.ceil(F.col("_all_n") / limit).cast("int"))
        .withColumn("_all_n", F.when(F.col("one"), F.col("_all_n")).otherwise(F.raise_error("two contents share a SHA-256 digest").cast("bigint")))
        .drop("one")
    )
    hot = stored(hot, "exact-hot")

    def salted(rows: DataFrame, digest: str, id_name: str) -> DataFrame:
        salt = F.coalesce(F.pmod(F.xxhash64(id_name), F.col("_salts")), F.lit(0).cast("bigint"))
        return rows.join(F.broadcast(hot), F.col(digest) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")

    keys = salted(slim, "sha", "id").select(sort_key(F.col("prefix"), F.col("sha"), F.col("_salt")).alias("key"), "id")
    # About SAMPLED rows by partition, picked by a hash, so that equal runs pick alike; a hot content's salts get splitters by their rows.
    chance = min(1.0, SAMPLED * parts / max(1, total))
    sample = sorted(bytes(r[0]) for r in keys.filter(F.pmod(F.xxhash64("key", "id"), F.lit(1 << 20)) < int(chance * (1 << 20))).select("key").collect())
    splitters = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    base = salted(df.select(*own, body.alias("_body")).withColumn("_sha", F.unhex(F.sha2("_body", 256))), "_sha", id_col)
    key = sort_key(F.col("_body"), F.col("_sha"), F.col("_salt"))
    dealt = base.withColumn("_key", key).withColumn("_part", place(F.col("_key"), splitters).cast("int")).drop("_key")
    dealt = dealt.repartitionById(parts, "_part").withColumn("_key", key)
    order = F.col(id_col).desc_nulls_last() if keep == "max" else F.col(id_col).asc_nulls_last()
    digest = Window.partitionBy("_part", "_key").orderBy("_body", order)
    equal = Window.partitionBy("_part", "_key", "_body")
    same = F.coalesce(F.lag("_body").over(digest) == F.col("_body"), F.lit(True))
    near = (
        dealt.withColumn("_same", same)
        .withColumn("_rank", F.row_number().over(equal.orderBy(order)))
        .withColumn("_best", best(id_col).over(equal))
        .withColumn("_n", F.count(F.lit(1)).over(equal))
        .withColumn("_all_n", F.when(F.col("_same") | F.col("_all_n").isNull(), F.col("_all_n")).otherwise(F.raise_error("two contents share a SHA-256 digest").cast("bigint")))
        .drop("_body", "_key", "_same")
    )

    keep_id = F.coalesce("_all_best", "_best")
    return near.select(
        *own,
        keep_id.alias("keep_id"),
        F.coalesce("_all_n", "_n").alias("group_size"),
        ((F.col("_rank") == 1) & F.col(id_col).eqNullSafe(keep_id)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
