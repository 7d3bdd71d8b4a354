"""Problem 6: a sample that matches target category proportions, with a minimum from small categories.

Divisor method: the rows of a category are in random order (a hash of the row's id), the row of rank r has priority
(r - 0.5) / target; each category's first ``min_rows`` rows come first, then the globally smallest priorities until the sample is full.
A category that runs out leaves its seats to the others by itself.

The seats follow from the categories' counts alone, so the driver handles one row a category. The rank inside a category is
had without gathering a category anywhere: rows fall into buckets of the hash, a bucket's first rank is the number of rows in
the buckets before it, and only rows of the bucket in which a category's sample ends are numbered.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .tables import plain_item, plain_label, table

BUCKET_BITS = 12
SEED = 6


def seats(cells: dict, size: int) -> dict:
    """Seats of each cell: ``cells`` has (available, target, least) by cell.

    Null or non-positive targets get their least rows only. If the least rows exceed the size, they are all kept.
    """
    got = {c: min(n, least or 0) for c, (n, _, least) in cells.items()}
    left = max(0, size - sum(got.values()))
    open_ = {c for c, (n, t, _) in cells.items() if t and t > 0 and got[c] < n}
    while left and open_:
        # all open cells at once up to the priority that fills most seats, then one by one
        weight = sum(cells[c][1] for c in open_)
        level = min((got[c] + 0.5) / cells[c][1] for c in open_)
        step = {c: min(cells[c][0] - got[c], max(0, int(cells[c][1] * (level + left / weight) + 0.5) - got[c])) for c in open_}
        if left > 4 * len(open_) and 0 < sum(step.values()) <= left:
            for c, k in step.items():
                got[c] += k
            left -= sum(step.values())
        else:
            # (rank - 0.5) / target of each cell's next row, smallest first
            queue = [((got[c] + 0.5) / cells[c][1], c) for c in open_]
            heapq.heapify(queue)
            for _ in range(min(left, 4 * len(open_) + 1)):
                if not queue:
                    break
                _, c = heapq.heappop(queue)
                got[c] += 1
                left -= 1
                if got[c] < cells[c][0]:
                    heapq.heappush(queue, ((got[c] + 0.5) / cells[c][1], c))
        open_ = {c for c in open_ if got[c] < cells[c][0]}
    return got


def cell_report(rows: DataFrame, targets: DataFrame, share: float, cell: list[str]) -> DataFrame:
    """A row a target cell: ``eligible, wanted, seats, short, missing`` beside the target.

    ``rows``: ``id`` and the cell's columns, one row an id; ``targets``: the cell's columns, ``target_share``, ``min_rows``
    (read by the driver: one row for each cell; of repeated cells the one with the largest share). Null cells take no part.
    A cell is short if its rows are fewer than ``min_rows`` or than its share of the sample. ``missing``: whole rows by which its seats
    stay below what it should have (its share of the sample or ``min_rows``, whichever is more), be it for want of rows or because other cells' minimum took them.
    """
    spark = rows.sparkSession
    schema = targets.schema
    want: dict[tuple, tuple] = {}
    for r in targets.select(*cell, "target_share", "min_rows").collect():
        if None not in r[: len(cell)]:
            want[tuple(r[: len(cell)])] = max(want.get(tuple(r[: len(cell)]), (0.0, 0)), (r["target_share"] or 0.0, r["min_rows"] or 0))
    count = {tuple(r[:-1]): r[-1] for r in rows.join(F.broadcast(targets.select(*cell).distinct()), cell, "left_semi").groupBy(*cell).count().collect()}
    size = int(sum(count.values()) * share)
    got = seats({c: (count.get(c, 0), t, least) for c, (t, least) in want.items()}, size)
    out = [(*c, t, least, count.get(c, 0), t * size, got[c], count.get(c, 0) < least or count.get(c, 0) < t * size, max(0, math.floor(max(t * size, least)) - got[c])) for c, (t, least) in want.items()]
    names = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in cell)
    return spark.createDataFrame(out, f"{names}, target_share double, min_rows int, eligible long, wanted double, seats long, short boolean, missing long")


def sample(rows: DataFrame, report: DataFrame, cell: list[str], seed: int = SEED) -> DataFrame:
    """The rows drawn, with ``rank`` left out: all of the seats of ``report``."""
    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    seat = F.broadcast(report.select(*cell, "seats"))
    before = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = hashed.join(seat, cell).groupBy(*cell, "bucket", "seats").count()
    # one row a cell and bucket: at most cells * 2**BUCKET_BITS
    ends = cut(counted.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).filter("first < seats").select(*cell, "bucket", (F.col("seats") - F.col("first")).alias("room"), "count"))
    placed = hashed.join(ends, [*cell, "bucket"])
    whole = placed.filter("room >= count")
    last = placed.filter("room < count").withColumn("r", F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy(F.shiftleft("h", BUCKET_BITS), "id"))).filter("r <= room")
    return whole.select("id", *cell).unionByName(last.select("id", *cell))


CELL = ["relationship_type", "item_key"]
#: the sample is a fifth of the eligible rows
PART = 0.2


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf_dir, "mix_targets")
    targets = t.select(plain_label(F.col("relationship_type")).alias("relationship_type"), plain_item(F.col("item_key")).alias("item_key"), "target_share", "min_rows")
    rows = table(spark, sf_dir, "company_relationships").select(
        F.col("row_id").alias("id"), plain_label(F.col("relationship_type")).alias("relationship_type"), plain_item(F.col("item_key")).alias("item_key")
    )
    return rows.filter("id is not null and relationship_type is not null and item_key is not null").join(F.broadcast(targets.select(*CELL).distinct()), CELL, "left_semi").distinct(), targets


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets = _edges(spark, sf_dir)
    return cell_report(rows, targets, PART, CELL).filter("short").select(*CELL)


def p6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible rows, seats and whether the target can be had, for each cell."""
    rows, targets = _edges(spark, sf_dir)
    return cell_report(rows, targets, PART, CELL).withColumn("wanted", F.round("wanted", 6))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself."""
    rows, targets = _edges(spark, sf_dir)
    rows = cut(rows)
    return sample(rows, cell_report(rows, targets, PART, CELL), CELL).withColumnRenamed("id", "row_id")


def p6_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct records drawn of each cell."""
    drawn = p6_sample(spark, sf_dir).distinct().groupBy(*CELL).agg(F.count("*").alias("drawn"))
    return drawn
