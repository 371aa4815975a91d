"""Running sums over a global order without passing all rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut


def sums_before(df: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """``df`` with, for each named value, its sum over all rows that come earlier in ``order`` (0 for the first).

    Rows are range-partitioned by ``order``; one total per partition is summed first, then each partition runs by itself.
    Where one order value may hold many rows, aggregate by it before. The partitioned rows are checkpointed at once, so calling this
    runs a job.
    """
    own = df.columns
    tagged = df.select("*", *(v.alias(f"_v_{k}") for k, v in values.items()))
    part = cut(tagged.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    w_all = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("_p").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values))
    offsets = totals.select("_p", *(F.coalesce(F.sum(f"_t_{k}").over(w_all), F.lit(0)).alias(f"_o_{k}") for k in values))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    joined = part.join(F.broadcast(offsets), "_p")
    return joined.select(*own, *((F.coalesce(F.sum(f"_v_{k}").over(w), F.lit(0)) + F.col(f"_o_{k}")).alias(k) for k in values))
