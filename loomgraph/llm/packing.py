"""Problem 7: filling containers of fixed capacity with items.

Harmonic packing: the lengths are partitioned into classes, and every container of a kind gets a fixed number of items of
each of its classes, so that workers fill containers independently: an item's container follows from its class and its
rank in the class by arithmetic. With the reciprocal classes (capacity/(k+1), capacity/k] alone a container holds items of
one class and stays up to half empty. The classes are therefore refined until a class is one length (there are no more
lengths than tokens in a container, whatever the number of items), and a plan made on the counts of the lengths combines
classes: a container is opened with the longest length left and filled with the longest that still fits, and the same filling is repeated while
the counts last. The plan has at most a few entries a length; the items never leave the workers.

An item longer than the capacity is cut into full pieces, each a container of its own (numbered by partition counts, without
moving anything), and a rest; no other item is cut. Ranks are had in buckets of a class, more of them the larger the largest class is. Null texts
and empty texts have no tokens, take no room and get no container (null). Null ids take no part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ranks import group_rank
from ..plans.ship import ship
from .tables import table

TOKENIZER = os.environ.get("LOOMGRAPH_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: fixed value: how the byte-level vocabulary splits a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: about the items of a class that are ranked in one bucket
BUCKET = 20_000


def _token_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "tokens"])

    return run


def token_counts(df: DataFrame, ident: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, tokens`` of each row, by a public tokenizer's ranks file that every worker can read."""
    ship(df.sparkSession)
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    return rows.mapInArrow(_token_counts(tokenizer), "id long, tokens long")


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each size the stretches ``(first rank, first container, items a container)`` of its items."""
    size = np.asarray(sizes, np.int64)
    order = np.argsort(-size)
    size, left = size[order], np.asarray(counts, np.int64)[order].copy()
    used = np.zeros(len(size), np.int64)
    out: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in size}
    following = np.arange(len(size) + 1)  # where the next size with items left is, with path halving

    def live(i: int) -> int:
        while following[i] != i:
            following[i] = following[following[i]]
            i = following[i]
        return i

    container = 0
    top = live(0)
    while top < len(size):
        room, at, fill = capacity, top, []
        while at < len(size) and room:
            at = live(max(at, int(np.searchsorted(-size, -room))))
            if at >= len(size):
                break
            k = int(min(left[at], room // size[at]))
            fill.append((at, k))
            room -= k * size[at]
            at += 1
        times = int(min(left[i] // k for i, k in fill))
        for i, k in fill:
            out[int(size[i])].append((int(used[i]), container, k))
            used[i] += k * times
            left[i] -= k * times
            if not left[i]:
                following[i] = i + 1
        container += times
        top = live(top)
    return out


def _place(stretches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = {s: tuple(np.array(c, np.int64) for c in zip(*x)) for s, x in stretches.value.items()}
        for batch in batches:
            size, rank = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            place = np.empty(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, container, each = table_[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                place[at] = container[k] + (rank[at] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(place)], ["id", "piece", "size", "container"])

    return run


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``id, piece, size, container``: a container number for each item (``id``, ``tokens``; one row an id).

    ``items`` should be materialised (``cut``): the numbers of full pieces follow the order of its partitions.
    """
    if capacity < 1:
        raise ValueError("a container must hold a token at least")
    spark = items.sparkSession
    ship(spark)
    n = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    pieces = pieces.select("id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long").alias("size"))
    # full pieces of longer items need no plan: each fills a container
    full = pieces.filter(F.col("size") == capacity).withColumn("_m", F.monotonically_increasing_id())
    filled = pieces.filter((F.col("size") > 0) & (F.col("size") < capacity))
    counts = [tuple(r) for r in filled.groupBy("size").count().collect()]  # at most a row for each size up to the capacity
    stretches = plan(np.array([r[0] for r in counts], np.int64), np.array([r[1] for r in counts], np.int64), capacity)
    held = dict(counts)
    # containers of the plan: those of each stretch's last item
    ends = [c + (next_ - 1 - f) // k for s, x in stretches.items() for (f, c, k), next_ in zip(x, [*(y[0] for y in x[1:]), held[s]])]
    first, offsets = max(ends, default=-1) + 1, []
    stretches = spark.sparkContext.broadcast(stretches)
    for part, n in sorted(full.groupBy(F.shiftright("_m", 33).cast("long").alias("_p")).count().collect()):  # a row a partition
        offsets.append((part, first))
        first += n
    offset = F.broadcast(spark.createDataFrame(offsets, "_p long, _first long"))
    full = full.withColumn("_p", F.shiftright("_m", 33).cast("long")).join(offset, "_p").select("id", "piece", "size", (F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("container"))
    bits = min(24, max(4, (max((r[1] for r in counts), default=0) // BUCKET).bit_length()))
    ranked = group_rank(filled, ["size"], ["id", "piece"], bits).select("id", "piece", "size", "rank")
    placed = ranked.mapInArrow(_place(stretches), "id long, piece long, size long, container long")
    return placed.unionByName(full).unionByName(pieces.filter("size <= 0").withColumn("container", F.lit(None).cast("long")))


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [tuple(r) for r in table(spark, sf_dir, "container_sizes").select("container_kind", "capacity_tokens").filter("container_kind is not null and capacity_tokens > 0").distinct().orderBy("container_kind").collect()]
    items = cut(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    out = None
    for kind, capacity in kinds:
        part = pack(items, capacity).select(F.lit(kind).alias("container_kind"), F.lit(capacity).alias("capacity"), "container", F.col("id").alias("doc_id"), "piece", F.col("size").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "container_kind string, capacity int, container long, doc_id long, piece long, tokens long")
    return out


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of one larger than the container, for each kind."""
    return _containers(spark, sf_dir).drop("capacity")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens in them and the share of their room that is filled, for each kind."""
    c = _containers(spark, sf_dir).filter("container is not null").groupBy("container_kind", "capacity")
    c = c.agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return c.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
