"""Problem 8: evaluation texts leaking into training text.

SimHash windows: each run of ``WINDOW`` words, the size of a leaked passage, of a document and of the held-out items has a
64-bit fingerprint of its weighted three-word shingles. The items' fingerprints are cut into four blocks of 16 bits; a
document's window within ``RADIUS`` (three) differing bits agrees with it in one block at least, so looking up the four
blocks finds every fingerprint within the radius. Candidates are verified by the exact weighted similarity of the two
windows' shingles; whether the words are the same one by one is told apart.

Invisible characters are dropped and compatibility forms of letters count as the plain letters. Null and empty texts,
and items of fewer than ``WINDOW`` words, repeat nothing. A null id takes no part. Texts are read whole.

The held-out items are the query set. Their index is built once a block of about ``ITEM_CHARS`` characters (at most about
100 bytes of index for each of their words are broadcast) and each block is one pass over the documents: time grows with the documents times the
blocks of items, and inside a block with the windows that share 16 bits, at most about 20 a block value when it is full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .tables import table
from .textkernel import Words, blocks, plain

WINDOW = 13
SHINGLE = 3
RADIUS = 3
SIMILAR = 0.8
ITEM_CHARS = 2_000_000
_PER = WINDOW - SHINGLE + 1
_STEP = 1 << 15


def _window_sums(a: np.ndarray) -> np.ndarray:
    """Sums of ``_PER`` consecutive rows, by doubling."""
    n = len(a) - _PER + 1
    out, width, at, left = None, 1, 0, _PER
    while left:
        if left & 1:
            out = a[at : at + n].copy() if out is None else out + a[at : at + n]
            at += width
        left >>= 1
        if left:
            a = a[:-width] + a[width:]
            width *= 2
    return out


class Windows:
    """All windows of ``WINDOW`` words of a block of texts: ``text``, ``at`` (word), ``print`` (SimHash), ``run`` (hash of the words)."""

    def __init__(self, texts: Sequence[str | None]):
        w = Words([plain(t) for t in texts])
        size = len(w.hash) - WINDOW + 1
        if size <= 0:
            self.at = self.text = np.zeros(0, np.int64)
            self.print = self.run = np.zeros(0, np.uint64)
            self.shingle, self.weight = np.zeros(0, np.uint64), np.zeros(0, np.int8)
            return
        n = len(w.hash) - SHINGLE + 1
        g = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            g = g * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + n]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        long = (w.end - w.start > 3).astype(np.int8)
        weight = np.ones(n, np.int8)
        for k in range(SHINGLE):
            weight += long[k : k + n]
        self.shingle, self.weight = g, weight
        prints = np.empty(size, np.uint64)
        for a in range(0, size, _STEP):
            b = min(a + _STEP, size)
            part = slice(a, b + _PER - 1)
            bits = np.unpackbits(g[part].view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
            signed = (2 * bits - 1) * weight[part, None]
            prints[a:b] = np.packbits(_window_sums(signed) > 0, axis=1).view(np.uint64)[:, 0]
        run = np.zeros(size, np.uint64)
        for k in range(WINDOW):
            run = run * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + size]
        self.at = np.flatnonzero(w.text[:size] == w.text[WINDOW - 1 :])
        self.text, self.print, self.run = w.text[self.at], prints[self.at], run[self.at]

    def shingles(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles and weights of the given windows, one row each; a repeated shingle counts once."""
        at = self.at[window][:, None] + np.arange(_PER)
        g, weight = self.shingle[at], self.weight[at].astype(np.float64)
        order = np.argsort(g, axis=1)
        g, weight = np.take_along_axis(g, order, 1), np.take_along_axis(weight, order, 1)
        weight[:, 1:][g[:, 1:] == g[:, :-1]] = 0
        return g, weight


class ItemIndex:
    """Fingerprints of the items' windows in four blocks of 16 bits."""

    def __init__(self, ids: Sequence[int], texts: Sequence[str | None]):
        self.w = Windows(texts)
        self.item = np.asarray(ids, np.int64)[self.w.text] if len(ids) else np.zeros(0, np.int64)
        self.by = []
        for k in range(4):
            key = ((self.w.print >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.by.append((np.append(0, np.cumsum(np.bincount(key, minlength=1 << 16))), order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document window, item window) whose fingerprints differ in ``RADIUS`` bits at most."""
        found = []
        for k, (first, order) in enumerate(self.by):
            key = ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            count = first[key + 1] - first[key]
            hit = np.flatnonzero(count)
            count = count[hit]
            doc = np.repeat(hit, count)
            begin = np.repeat(first[key[hit]] - (np.cumsum(count) - count), count)
            item = order[begin + np.arange(len(doc))]
            near = np.bitwise_count(prints[doc] ^ self.w.print[item]) <= RADIUS
            found.append(doc[near] * len(self.w.print) + item[near])
        pair = np.unique(np.concatenate(found))
        return np.divmod(pair, max(1, len(self.w.print)))

    def search(self, texts: Sequence[str | None]) -> tuple[np.ndarray, ...]:
        """(text, item, similarity, same words) of each verified pair of windows."""
        d = Windows(texts)
        a, b = self.candidates(d.print) if len(d.print) and len(self.item) else (np.zeros(0, np.int64),) * 2
        ga, wa = d.shingles(a)
        gb, wb = self.w.shingles(b)
        shared = np.zeros(len(a))
        for k in range(_PER):
            shared += np.where((ga == gb[:, k : k + 1]).any(1), wb[:, k], 0)
        similar = shared / np.maximum(wa.sum(1) + wb.sum(1) - shared, 1)
        same = d.run[a] == self.w.run[b]
        ok = (similar >= SIMILAR) | same
        return d.text[a][ok], self.item[b][ok], similar[ok], same[ok]


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                text, item, similar, same = items.search(texts[a:b])
                key, at = np.unique(np.stack([text, item]), axis=1, return_inverse=True)
                n = key.shape[1]
                best = np.zeros(n)
                np.maximum.at(best, at, similar)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(key[0] + a)), pa.array(key[1]), pa.array(np.bincount(at, minlength=n)), pa.array(np.bincount(at, weights=same, minlength=n).astype(np.int64)), pa.array(best)],
                    ["doc_id", "item_id", "windows", "same_windows", "similarity"],
                )

    return run


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, windows, same_windows, similarity``: windows of an item that stand in a document, nearly or word for word."""
    ship(docs.sparkSession)
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").distinct()
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-chars // ITEM_CHARS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    out = None
    for i in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id", "text").collect()
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in part], [r[1] for r in part]))
        found = texts.mapInArrow(_search(index), "doc_id long, item_id long, windows long, same_windows long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.sum("same_windows").alias("same_windows"), F.max("similarity").alias("similarity"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))
    return found.filter("same_windows > 0").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out item that leaked: documents with a passage of it, word for word or nearly."""
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.when(F.col("same_windows") > 0, F.col("doc_id"))).alias("word_for_word"), F.round(F.max("similarity"), 6).alias("similarity"))
