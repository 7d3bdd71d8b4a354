"""Keys and digests of content."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.ship import ship


def content_key(line: Column) -> Column:
    """SHA-256 of a line with its terminator."""
    return F.sha2(F.concat(line, F.lit("\n")), 256)


def _canonical(text: str) -> str:
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(StringType())
def _canonical_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else _canonical(t))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys, no blanks, ASCII only; null stays null."""
    ship()
    return _canonical_json(text)


_BLOCK, _LEVELS = 4096, 3


def rows_digest(df: DataFrame, order: str, row: Column, folded: str = "digest") -> DataFrame:
    """SHA-256 over the digests of all rows (JSON text ``row``) in the order of the unique column ``order``.

    The lines are hashed where they are, in blocks of consecutive order numbers; blocks of digests are hashed in blocks again, so
    that a task sees at most ``_BLOCK`` digests and the last one those of ``_BLOCK`` ** ``_LEVELS`` rows each.
    """
    join = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), ""), 256)
    part = df.select(F.col(order).cast("long").alias("k"), F.sha2(canonical_json(row), 256).alias("d"))
    for _ in range(_LEVELS):
        part = part.groupBy(F.floor(F.col("k") / _BLOCK).alias("b")).agg(join().alias("d")).withColumnRenamed("b", "k")
    return part.agg(join().alias(folded))


def jsonl_digest(df: DataFrame, order: str, row: Column) -> str:
    """SHA-256 of the canonical JSON lines of all rows (JSON text ``row``) in the order of ``order``: the digest of the file they would make.

    One digest runs over all lines in turn, so the sorted partitions are streamed through the driver one by one; nothing is held.
    ``rows_digest`` is the digest to compare tables of any size by.
    """
    whole = hashlib.sha256()
    for r in df.select(F.col(order).alias("k"), canonical_json(row).alias("line")).orderBy("k").select("line").toLocalIterator(prefetchPartitions=True):
        whole.update(r.line.encode() + b"\n")
    return whole.hexdigest()


def path_digest(path: str) -> str:
    """SHA-256 of a file, or of a folder's relative names and file digests."""
    p = Path(path)
    if p.is_file():
        with p.open("rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    whole = hashlib.sha256()
    for f in sorted(x for x in p.rglob("*") if x.is_file()):
        whole.update(f.relative_to(p).as_posix().encode() + b"\0" + path_digest(str(f)).encode())
    return whole.hexdigest()
