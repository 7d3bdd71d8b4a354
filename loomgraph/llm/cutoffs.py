"""Problem 5: a score cutoff per source that keeps a target fraction of the source's records.

Iterative histogram refinement: scores are counted into bins per source, the bin that holds the target rank becomes the
next range, until all its scores are equal. A bin's own least and largest score bound the next range, so every round
splits it and the result is exact for any doubles. A round is one aggregation; only the counts of at most ``ALL_BINS``
bins reach the driver, whatever the number of rows and sources.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .tables import plain_item, table

BINS = 1024
ALL_BINS = 1 << 20


def _needed(n: int, share: float) -> int | None:
    """Least number of records whose fraction of ``n`` reaches ``share``; None if none does."""
    k = max(1, math.ceil(share * n) - 2)
    while k <= n and k / n < share:
        k += 1
    return k if k <= n else None


def cutoffs(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, share, records, cutoff, kept`` for each source of ``targets`` (``source``, ``share``).

    ``scores``: ``source``, ``score``; null and NaN scores and sources without a target take no part. The cutoff is the
    highest score for which (records at or above it) / records >= share, so ties at the cutoff are all kept. A source without
    records, or with a share that is null or above 1, has a null cutoff and keeps nothing. Of repeated targets the largest
    share holds. Targets are a table of the caller's, read by the driver: one row for each source.
    """
    spark = scores.sparkSession
    want = {r[0]: r[1] for r in targets.filter("source is not null").groupBy("source").agg(F.max("share")).collect()}
    wanted = F.broadcast(spark.createDataFrame([(s,) for s in want], "source string"))
    rows = scores.filter("score is not null and not isnan(score) and source is not null").join(wanted, "source", "left_semi")
    total = {r[0]: r[1:] for r in rows.groupBy("source").agg(F.count("*"), F.min("score"), F.max("score")).collect()}
    done: dict[str, tuple[float, int]] = {}
    live: dict[str, list] = {}
    for s, (n, lo, hi) in total.items():
        k = None if want[s] is None else _needed(n, want[s])
        if k is not None:
            live[s] = [lo, hi, 0, k, n]  # range, records above it, rank sought, records in it
    while live:
        for s in [s for s, x in live.items() if x[0] == x[1]]:
            lo, _, above, _, inside = live.pop(s)
            done[s] = (lo, above + inside)
        if not live:
            break
        bins = max(2, min(BINS, ALL_BINS // len(live)))
        ranges = spark.createDataFrame([(s, x[0], x[1]) for s, x in live.items()], "source string, lo double, hi double")
        part = F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
        counted = rows.join(F.broadcast(ranges), "source").filter("score >= lo and score <= hi").groupBy("source", part.alias("bin")).agg(F.count("*"), F.min("score"), F.max("score"))
        by: dict[str, list] = {}
        for s, b, n, lo, hi in counted.collect():
            by.setdefault(s, []).append((b, n, lo, hi))
        for s, x in live.items():
            for _, n, lo, hi in sorted(by[s], reverse=True):
                if x[2] + n >= x[3]:
                    x[0], x[1], x[4] = lo, hi, n
                    break
                x[2] += n
    out = [(s, want[s], total.get(s, (0,))[0], done[s][0] if s in done else None, done[s][1] if s in done else 0) for s in sorted(want)]
    return spark.createDataFrame(out, "source string, share double, records long, cutoff double, kept long")


def _outcomes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The counting evaluations ``outcome_id, source, score`` and the targets."""
    targets = table(spark, sf_dir, "keep_targets").select(plain_item(F.col("item_key")).alias("source"), F.col("keep_share").alias("share"))
    items = table(spark, sf_dir, "company_relationships").select("chunk_id", plain_item(F.col("item_key")).alias("source")).filter("chunk_id is not null and source is not null").distinct()
    latest = F.max(F.struct("evaluated_at", F.col("confidence").alias("score"), "chunk_id")).alias("l")
    outcome = table(spark, sf_dir, "extraction_outcomes").filter("outcome_id is not null").groupBy("outcome_id").agg(latest).select("outcome_id", "l.score", "l.chunk_id").filter("score >= 0 and score <= 1")
    return cut(outcome.join(items, "chunk_id").join(targets.select("source").distinct(), "source", "left_semi").select("outcome_id", "source", "score")), targets


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, targets = _outcomes(spark, sf_dir)
    found = cutoffs(rows.select("source", "score"), targets).filter("cutoff is not null").select("source", "cutoff")
    return rows.join(F.broadcast(found), "source").filter("score >= cutoff").select("outcome_id").distinct()


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoff of each item and the number kept."""
    rows, targets = _outcomes(spark, sf_dir)
    return cutoffs(rows.select("source", "score"), targets).withColumnRenamed("source", "item_key")
