"""Links between texts of which at least a given share of word shingles is common, in any number of texts.

How: the shingles of each distinct text are put in the order of one hash function and the ``keep`` least are retained, a
bottom-k sketch. The inverted lists are keyed by ``run`` neighbouring retained values, each list entry with fingerprints of
the next ``NEXT`` values: two entries of a list overlap if a fingerprint agrees too. Pairs of texts with such an overlap are
candidates; the bottom-``SKETCH`` sketch of their union estimates the Jaccard coefficient, and what lies
clearly below the threshold (4.5 standard deviations) is dropped before any text is moved. The rest is verified exactly.

Why not lists of single values: texts of one domain share phrases, so a single value stands in a share of the texts that does
not fall as the collection grows, and overlaps counted over such lists grow with its square. Values in more than ``hot_share``
of the texts are therefore left out of a text's order, as long as at least ``COLD`` of its shingles remain: then a pair
at the threshold still has much in common among the others. A text with less is listed over all of its shingles too, with one value
more in a run, so a group of near copies is found however large it is. No list is cut: lists of more than ``LONG``
texts are compared in blocks by a second job.

Texts of few shingles: orders are repeated under other hashes until a text has about ``keep`` runs; texts with at most
``SMALL`` / threshold shingles are also listed by single values, the rarest first, by the exact prefix rule, so that no pair of them is missed.

A pair exactly at a threshold of 0.5 with 80 shingles that are not frequent is missed with a probability of about 0.5 %,
one at 0.6 of about 0.1 % (measured figures in the README). Everything found is exact.

Equal texts are one class (64-bit hash of the text) from the start: copies are never paired with one another
before the classes are linked.

Null texts and ids take no part; texts below ``min_words`` words are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ship import ship
from .textkernel import BLOCK_TEXTS, Words, blocks, mix

#: retained values of the sketch by which the Jaccard coefficient of a pair is estimated
SKETCH = 48
#: fingerprints beside a run
NEXT = 3
#: share of a text's shingles that must not be frequent, else all are listed
COLD = 0.5
SMALL = 12
#: orders of a text of few values at most
ORDERS = 8
#: a text of frequent shingles is listed under so many times as many runs
DENSE = 3
#: texts in a list from which on it is compared in blocks of as many
LONG = 2_000
#: list entries of one task; pairs held at once
ENTRIES = 1_000_000
MATCHES = 2_000_000
#: ids that are broadcast at most; beyond, texts are joined by shuffling
BROADCAST_IDS = 1_000_000
_PRINT = 24


@dataclass(frozen=True)
class Likeness:
    """What counts as alike, and how candidates are searched."""

    words: int = 5
    threshold: float = 0.8
    min_words: int = 1
    keep: int = 80
    run: int = 3
    hot_share: float = 1 / 30
    hot_least: int = 16

    def estimate(self) -> int:
        """Least number of common values among the ``SKETCH`` least of a union."""
        mean = SKETCH * self.threshold
        return max(1, int(mean - 4.5 * (mean * (1 - self.threshold)) ** 0.5))


def _count(like: Likeness):
    """Task: shingles frequent in the task's part, with counts, and the number of texts under -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        value, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        texts = size = 0

        def merge() -> None:
            nonlocal value, count, waiting, size
            fresh, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            u, at = np.unique(np.concatenate([value, fresh]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([count, times]), minlength=len(u)).astype(np.int64)
            good = n >= like.hot_share / 4 * texts
            value, count, waiting, size = u[good], n[good], [], 0

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = [i for i, c in enumerate(ids.tolist()) if not (c in seen or seen.add(c))]
            t = batch.column(1).take(pa.array(fresh, pa.int64())).to_pylist()
            for a, b in blocks(t):
                w = Words(t[a:b])
                g, first = w.distinct_shingles(like.words)
                enough = np.diff(w.first) >= like.min_words
                texts += int(enough.sum())
                waiting.append(g[np.repeat(enough, np.diff(first))])
                size += len(g)
                if size > 4_000_000:
                    merge()
        merge()
        good = count >= like.hot_share / 2 * texts
        yield pa.RecordBatch.from_arrays([pa.array(np.append(value[good].astype(np.int64), -1)), pa.array(np.append(count[good], texts))], ["g", "n"])

    return run


def hot_shingles(texts: DataFrame, like: Likeness) -> tuple[np.ndarray, np.ndarray, int]:
    """Ascending values of the shingles that stand in more than ``hot_share`` of the texts (columns ``c``, ``text``), their
    counts, and about how many texts there are (a text is counted once a task).

    A task gives at most 2 * (mean shingles of a text) / hot_share values, and as many come to the driver, whatever the number of texts.
    """
    counted = cut(texts.select("c", "text").mapInArrow(_count(like), "g long, n long"))
    total = counted.filter("g = -1").agg(F.sum("n")).first()[0] or 0
    least = max(like.hot_least, total * like.hot_share)
    rows = counted.filter("g >= 0").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()
    hot = np.array(sorted((g, n) for g, n in rows), dtype=np.int64).reshape(-1, 2)
    return hot[:, 0].astype(np.uint64), hot[:, 1], total


def _runs(value: np.ndarray, owner: np.ndarray, texts: int, keep: int, run: int, salt: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """List keys (the run in the high bits, fingerprints in the low ``_PRINT``) of each text's ``keep`` least values under an order, and their texts.

    ``value`` of ascending ``owner``. A text's order goes on at its beginning, so each value begins a run.
    """
    v = mix(value ^ np.uint64((order * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
    v = v[np.lexsort((v, owner))]
    n = np.bincount(owner, minlength=texts)
    first = np.cumsum(n) - n
    m = np.minimum(n, keep)
    who = np.repeat(np.arange(texts), m)
    place = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m)

    def at(j: int) -> np.ndarray:
        return v[first[who] + (place + j) % m[who]]

    key = mix(salt[who] ^ np.uint64(order + 64 * run))
    for j in range(run):
        key = mix(key ^ at(j))
    key &= ~np.uint64((1 << _PRINT) - 1)
    for j in range(NEXT):
        key |= (mix(at(run + j)) >> np.uint64(56)) << np.uint64(8 * j)
    return key, who


def _entries(like: Likeness, hot: np.ndarray, counts: np.ndarray):
    """Task: entries (k, c, side) of the inverted lists, for each distinct text."""

    def keys(g: np.ndarray, n: np.ndarray, owner: np.ndarray, salt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        texts = len(n)
        at = np.minimum(np.searchsorted(hot, g), max(0, len(hot) - 1))
        often = np.where(hot[at] == g, counts[at], 0) if len(hot) else np.zeros(len(g), np.int64)
        cold = often == 0
        rare = np.bincount(owner[cold], minlength=texts)
        few = rare < COLD * n
        for some, run, size, keep in ((cold, like.run, rare, like.keep), (few[owner], like.run + 1, np.where(few, n, 0), DENSE * like.keep)):
            orders = np.minimum(np.where(size > 0, -(-keep // np.maximum(size, 1)), 0), ORDERS)
            value, of = g[some], owner[some]
            for order in range(int(orders.max(initial=0))):
                more = (orders > order)[of]
                value, of = value[more], of[more]
                yield _runs(value, of, texts, keep, run, salt, order)
        short = n <= SMALL / like.threshold
        if short.any():
            part = np.flatnonzero(short[owner])
            part = part[np.lexsort((g[part], often[part], owner[part]))]
            m = np.where(short, n, 0)
            place = np.arange(len(part)) - np.repeat(np.cumsum(m) - m, m)
            part = part[place < (n - np.ceil(like.threshold * n - 1e-6).astype(np.int64) + 1)[owner[part]]]
            yield mix(mix(g[part]) ^ salt[owner[part]]) & ~np.uint64((1 << _PRINT) - 1), owner[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            c, side, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fresh = np.array([i for i, x in enumerate(zip(c.tolist(), side.tolist())) if not (x in seen or seen.add(x))], dtype=np.int64)
            t = batch.column(3).take(pa.array(fresh)).to_pylist()
            for a, b in blocks(t):
                w = Words(t[a:b])
                g, first = w.distinct_shingles(like.words)
                n = np.diff(first) * (np.diff(w.first) >= like.min_words)
                g = g[np.repeat(n > 0, np.diff(first))]
                row = fresh[a:b]
                for key, who in keys(g, n, np.repeat(np.arange(b - a), n), mix(salt[row].astype(np.uint64))):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c[row[who]]), pa.array(side[row[who]].astype(np.int32))], ["k", "c", "side"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether any of the fingerprints of two entries agree."""
    out = np.zeros(len(x), bool)
    for i in range(NEXT):
        p = (x >> (8 * i)) & 255
        for j in range(NEXT):
            out |= p == ((y >> (8 * j)) & 255)
    return out


def _within(key: np.ndarray, c: np.ndarray, side: np.ndarray, part: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Overlapping pairs of entries with one list (``key >> _PRINT``), given in its order; ``part``: 0 and 1 are paired with each other only, -1 with all."""
    listed = key >> _PRINT
    edge = np.flatnonzero(np.append(True, listed[1:] != listed[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    end = np.repeat(edge + size, size)
    at = np.flatnonzero(np.arange(len(key)) + 1 < end)
    step = 1
    held: list[np.ndarray] = []
    count = 0

    def give() -> tuple[np.ndarray, np.ndarray]:
        a, b = np.concatenate(held, axis=1)
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        return a[new], b[new]

    while len(at):
        to = at + step
        good = _overlap(key[at], key[to]) & (c[at] != c[to]) & ((part[at] != part[to]) | (part[at] < 0))
        if cross:
            good &= side[at] != side[to]
        a, b = c[at[good]], c[to[good]]
        if cross:
            turn = side[at[good]] > side[to[good]]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
        else:
            a, b = np.minimum(a, b), np.maximum(a, b)
        held.append(np.stack([a, b]))
        count += len(a)
        if count > MATCHES:
            yield give()
            held, count = [], 0
        step += 1
        at = at[at + step < end[at]]
    if held:
        yield give()


def _table(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    got = [[batch.column(n).to_numpy(zero_copy_only=False) for n in names] for batch in batches]
    return [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64) for _ in names]


def _meet(cross: bool):
    """Task: ``a``, ``b`` of overlapping pairs of its lists (``long`` 0); of lists that are too long, the entries and their side (``long`` 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c, side = _table(batches, ["k", "c", "side"])
        order = np.lexsort((side, c, k))
        k, c, side = k[order], c[order], side[order]
        if len(k):
            new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (side[1:] != side[:-1]))
            k, c, side = k[new], c[new], side[new]
        listed = k >> _PRINT
        edge = np.flatnonzero(np.append(True, listed[1:] != listed[:-1])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(k)))
        long = np.repeat(size > LONG, size)
        row = lambda a, b, s, kind: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.int32)), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "side", "long"])
        yield row(k[long], c[long], side[long], 1)
        k, c, side = k[~long], c[~long], side[~long]
        for a, b in _within(k, c, side, np.full(len(k), -1), cross):
            yield row(a, b, np.zeros(len(a)), 0)

    return run


def _meet_blocks(cross: bool):
    """Task: overlapping pairs of two blocks (parts 0 and 1) of a long list, or within one (-1)."""

    def run(table: pa.Table) -> pa.Table:
        k, c, side, part = (table.column(n).to_numpy() for n in ("k", "c", "side", "part"))
        order = np.argsort(c, kind="stable")
        found = list(_within(k[order], c[order], side[order], part[order], cross))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        return pa.table({"ca": a, "cb": b})

    return run


def _sketches(like: Likeness):
    """Task: (c, sketch) of each distinct text of enough words: its number of shingles and its ``SKETCH`` least hashes, filled up with ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = np.array([i for i, x in enumerate(c.tolist()) if not (x in seen or seen.add(x))], dtype=np.int64)
            t = batch.column(1).take(pa.array(fresh)).to_pylist()
            for a, b in blocks(t):
                w = Words(t[a:b])
                g, first = w.distinct_shingles(like.words)
                n = np.diff(first)
                owner = np.repeat(np.arange(b - a), n)
                v = (mix(g) >> np.uint64(32)).astype(np.uint32)
                v = np.minimum(v[np.lexsort((v, owner))], np.uint32(0xFFFFFFFE))
                out = np.full((b - a, SKETCH + 1), 0xFFFFFFFF, np.uint32)
                out[:, 0] = n
                place = np.arange(len(v)) - first[owner]
                low = place < SKETCH
                out[owner[low], place[low] + 1] = v[low]
                good = (np.diff(w.first) >= like.min_words) & (n > 0)
                ends = (np.arange(good.sum() + 1) * (SKETCH + 1) * 4).astype(np.int32)
                sketch = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out[good]))])
                yield pa.RecordBatch.from_arrays([pa.array(c[fresh[a:b][good]]), sketch], ["c", "sketch"])

    return run


def _estimate(like: Likeness):
    """Task: pairs ``ca``, ``cb`` of which the sketch of the union does not rule out the threshold, and ``n``, the shingles of the first."""
    need = like.estimate() / SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SKETCH + 1) for i in (2, 3)]
            v = np.sort(np.concatenate([x[:, 1:] for x in both], axis=1), axis=1)
            real = v != 0xFFFFFFFF
            twice = np.zeros(v.shape, bool)
            twice[:, 1:] = (v[:, 1:] == v[:, :-1]) & real[:, 1:]
            rank = np.cumsum(real & ~twice, axis=1)
            common = (twice & (rank <= SKETCH)).sum(1)
            keep = pa.array(common >= need * np.clip(rank[:, -1], 1, SKETCH) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(both[0][:, 0].astype(np.int64)).filter(keep)], ["ca", "cb", "n"])

    return run


def _verify(like: Likeness):
    """Task: exact Jaccard coefficient of each pair of texts, for those at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            both = [x for p in zip(ta, tb) for x in p]
            for a, b in blocks(both, count=BLOCK_TEXTS - 2):
                if (b - a) % 2 or a % 2:  # a block may end within a pair
                    a, b = a - a % 2, b - b % 2
                if a == b:
                    continue
                w = Words(both[a:b])
                g, first = w.distinct_shingles(like.words)
                words = np.diff(w.first)
                size = np.diff(first)
                pair = np.repeat(np.arange(b - a) // 2, size).astype(np.uint64)
                key = np.sort((pair << np.uint64(52)) | g)
                new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
                u = key[new]
                twice = np.diff(np.append(np.flatnonzero(new), len(key))) == 2
                owner = (u >> np.uint64(52)).astype(np.int64)
                n = (b - a) // 2
                ok = (words[::2] >= like.min_words) & (words[1::2] >= like.min_words)
                shared = np.bincount(owner[twice], minlength=n)
                union = np.bincount(owner, minlength=n)
                jaccard = shared / np.maximum(union, 1)
                ok &= (jaccard >= like.threshold) & (union > 0)
                at = np.arange(a // 2, b // 2)[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ca[at]), pa.array(cb[at]), pa.array(shared[ok]), pa.array(jaccard[ok]), pa.array(shared[ok] / np.maximum(size[::2][ok], 1))], ["ca", "cb", "shared", "jaccard", "containment"]
                )

    return run


def candidates(texts: DataFrame, like: Likeness, cross: bool) -> DataFrame:
    """Pairs ``ca``, ``cb`` of classes with an overlap in the inverted lists. ``cross``: only of side 0 with side 1, the former first."""
    spark = texts.sparkSession
    hot, counts, total = hot_shingles(texts, like)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * like.keep // ENTRIES))
    entries = texts.select("c", "side", "salt", "text").mapInArrow(_entries(like, hot, counts), "k long, c long, side int")
    met = cut(entries.repartition(parts, F.shiftright("k", _PRINT)).mapInArrow(_meet(cross), "a long, b long, side int, long int"))
    pairs = met.filter("long = 0").select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    # the lists that are too long for one task, in pairs of blocks; a list's entries are copied once for each block it meets
    listed = met.filter("long = 1").select(F.col("a").alias("k"), F.col("b").alias("c"), "side", F.shiftright("a", _PRINT).alias("list"))
    size = listed.groupBy("list").agg(F.ceil(F.count("*") / LONG).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"), F.when(F.col("own") == j, -1).otherwise((F.col("own") > j).cast("int")).alias("part")))
    dealt = listed.join(size, "list").withColumn("own", own).withColumn("to", F.explode(to)).select("list", "to.i", "to.j", "to.part", "k", "c", "side")
    more = dealt.groupBy("list", "i", "j").applyInArrow(_meet_blocks(cross), "ca long, cb long")
    return pairs.unionByName(more).distinct()


def links(texts: DataFrame, same: DataFrame, like: Likeness, cross: bool = False) -> DataFrame:
    """Verified links ``ca, cb, shared, jaccard, containment`` (of the first text's shingles in the second).

    ``texts``: ``c`` long, ``side`` int, ``salt`` long, ``text``; pairs are sought within one salt only. ``same``: classes
    ``c`` that are linked with themselves (copies), if they have enough words.
    """
    ship(texts.sparkSession)
    found = candidates(texts, like, cross).union(same.select("c", F.col("c").alias("d")))
    sketch = texts.select("c", "text").mapInArrow(_sketches(like), "c long, sketch binary").groupBy("c").agg(F.first("sketch").alias("sketch"))
    a, b = sketch.select(F.col("c").alias("ca"), F.col("sketch").alias("sa")), sketch.select(F.col("c").alias("cb"), F.col("sketch").alias("sb"))
    pairs = cut(found.join(a, "ca").join(b, "cb").select("ca", "cb", "sa", "sb").mapInArrow(_estimate(like), "ca long, cb long, n long"))
    copies, pairs = pairs.filter("ca = cb"), pairs.filter("ca != cb")
    wanted = cut(pairs.select(F.col("ca").alias("c")).union(pairs.select("cb")).distinct())
    few = wanted.count() <= BROADCAST_IDS
    text = texts.select("c", "text").join(F.broadcast(wanted) if few else wanted, "c", "left_semi").groupBy("c").agg(F.first("text").alias("text"))
    a, b = text.select(F.col("c").alias("ca"), F.col("text").alias("ta")), text.select(F.col("c").alias("cb"), F.col("text").alias("tb"))
    verified = pairs.join(a, "ca").join(b, "cb").select("ca", "cb", "ta", "tb").mapInArrow(_verify(like), "ca long, cb long, shared long, jaccard double, containment double")
    whole = copies.select("ca", "cb", F.col("n").alias("shared"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("containment"))
    return cut(verified.unionByName(whole))
