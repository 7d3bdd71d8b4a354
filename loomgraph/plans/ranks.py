"""Row numbers inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_rank(df: DataFrame, group: list[str], ident: list[str], bits: int = 8, seed: int = 0) -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2, … inside each group, in the order of a hash of ``ident`` (unique inside a group).

    A group's rows fall into 2**bits buckets of the hash; a bucket's first rank is the number of rows in the buckets before it,
    from a table of one row a group and bucket. Only rows of one bucket of one group meet in a task.
    """
    h = df.withColumn("_h", F.xxhash64(F.lit(seed), *ident)).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = h.groupBy(*group, "_b").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_b").orderBy("_h", *ident)
    return h.withColumn("_r", F.row_number().over(inside)).join(first, [*group, "_b"]).withColumn("rank", F.col("_first") + F.col("_r") - 1).drop("_h", "_b", "_r", "_first")
