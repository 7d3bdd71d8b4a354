"""Running totals over all rows, in order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], rank: str | None = None) -> DataFrame:
    """``df`` with inclusive running sums in the order of ``order``, which must be unique, and a 1-based ``rank``.

    The rows are range-partitioned by the order, summed inside each partition, and shifted by the totals of the partitions before
    it: one exchange of the rows and a table of one row a partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = df
    for i, c in enumerate(sums.values()):
        work = work.withColumn(f"_v{i}", c)
    parts = cut(work.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    names = list(sums)
    total = parts.groupBy("_p").agg(F.count("*").alias("_n"), *[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = total.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i in range(len(names))])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(shift), "_p")
    for i, name in enumerate(names):
        out = out.withColumn(name, F.sum(f"_v{i}").over(own) + F.col(f"_s{i}"))
    if rank:
        out = out.withColumn(rank, F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_s"))
    return out.drop("_p", "_s", *[f"_s{i}" for i in range(len(names))], *[f"_v{i}" for i in range(len(names))])


def running_max_before(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with the largest ``value`` of all rows before a row in the order of the unique column ``order``; null for the first."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("_p").agg(F.max(value).alias("_m")).select("_p", F.max("_m").over(before).alias("_s"))
    own = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(shift), "_p").withColumn(out, F.greatest(F.max(value).over(own), F.col("_s"))).drop("_p", "_s")
