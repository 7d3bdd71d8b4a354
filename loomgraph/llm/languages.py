"""Problem 9: missing or wrong document language labels.

A bit-sliced Bloom filter over words holds one mask a slot, one bit for each language (a byte for eight languages, up to eight bytes for 64); the masks at a word's slots,
ANDed, are the set of languages that contain the word. For each sentence the languages' counts, less the filter's expected
false positives, decide; neighbouring sentences of one language are a segment. A language is in a document if a segment
of it has ``RUNNING`` words made of letters. Sentences without evidence (names, numbers, headings) belong to the segment
they stand in.

The filter is fitted on a sample of labelled documents of about ``SAMPLE`` documents a language, chosen by a hash of the id; everything
else covers all documents. A word belongs to a language if it stands in two of the language's sampled documents at least and
its share of them is at least ``SHARE`` of the largest share any language has; so wrong labels and names do not count.

Null and empty texts, and texts with fewer than ``RUNNING`` words made of letters, have no language. Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .tables import plain_label, table
from .textkernel import Words, blocks, mix

#: fixed values: usual forms of the languages' names, by two-letter code
NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german"],
    "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish"],
    "it": ["it", "ita", "italian"],
    "nl": ["nl", "nld", "dut", "dutch"],
    "pt": ["pt", "por", "portuguese"],
    "sv": ["sv", "swe", "swedish"],
}
CODES = list(NAMES)
RUNNING = 12
SAMPLE = 400
SHARE = 0.3
SLOTS = 1 << 20
HASHES = 3
#: words by which a sentence longer than that is decided piece by piece
PIECE = 12
#: share of a piece's words that must speak for its language
CLEAR = 0.4
#: the filter's slots hold a bit for each language
MASK = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(CODES) <= n)
_SALTS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def plain_language(c: Column) -> Column:
    """Two-letter code of a label in any usual form, null if it names no language."""
    s = F.regexp_extract(plain_label(c), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    pairs = [F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)]
    return F.try_element_at(F.create_map(*pairs), s)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [(mix(h ^ s) & np.uint64(SLOTS - 1)).astype(np.int64) for s in _SALTS]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: for each language the number of sampled documents with a word, and of all documents under word 0."""
    for batch in batches:
        code, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for a, b in blocks(texts):
            w = Words(texts[a:b])
            own = code[a:b].astype(np.uint64)
            each = np.stack([np.append(own[w.text], own), np.append(w.hash, np.zeros(b - a, np.uint64)), np.append(w.text, np.arange(b - a)).astype(np.uint64)])
            pair, n = np.unique(np.unique(each, axis=1)[:2], axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0].astype(np.int32)), pa.array(pair[1].astype(np.int64)), pa.array(n)], ["code", "word", "n"])


def fit(docs: DataFrame) -> np.ndarray:
    """The filter: a mask a slot."""
    labelled = docs.select(F.col("doc_id"), plain_language(F.col("lang")).alias("code"), "text").filter("code is not null and text is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("code").count().collect()}
    share = F.try_element_at(F.create_map(*[F.lit(x) for c in CODES for x in (c, min(1.0, SAMPLE / max(1, sizes.get(c, 0))))]), F.col("code"))
    number = F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CODES) for x in (c, i)]), F.col("code"))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select(number.cast("int").alias("code"), "text")
    counted = sample.mapInArrow(_count, "code int, word long, n long").groupBy("code", "word").agg(F.sum("n").alias("n")).filter("n >= 2 or word = 0")
    rows = counted.toArrow()
    code, word, n = (rows.column(i).to_numpy() for i in range(3))
    total = np.zeros(len(CODES))
    total[code[word == 0]] = n[word == 0]
    words, at = np.unique(word[word != 0], return_inverse=True)
    rate = np.zeros((len(words), len(CODES)))
    rate[at, code[word != 0]] = n[word != 0]
    rate /= np.maximum(total, 1)
    member = (rate > 0) & (rate >= SHARE * rate.max(1, initial=0, keepdims=True))
    mask = (member.astype(np.uint64) << np.arange(len(CODES), dtype=np.uint64)).sum(1, dtype=np.uint64).astype(MASK)
    slots = np.zeros(SLOTS, MASK)
    for s in _slots(words.astype(np.uint64)):
        np.bitwise_or.at(slots, s, mask)
    return slots


def _bits(mask: np.ndarray) -> np.ndarray:
    """A row of zeros and ones, one for each language, of each mask."""
    return np.unpackbits(mask[:, None].view(np.uint8), axis=1, bitorder="little", count=len(CODES))


def _edges(text: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])))


class Detector:
    """Segments of a block of texts from a fitted filter."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        fill = _bits(slots).mean(0)
        self.false = fill**HASHES
        self._digit = np.array([chr(c).isdigit() for c in range(256)])

    def segments(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """``text, first word, words, words made of letters, language, confidence`` of each segment, in order."""
        w = Words(texts)
        n = len(w.hash)
        if not n:
            return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0),)
        mask = np.full(n, np.iinfo(MASK).max, MASK)
        for s in _slots(w.hash):
            mask &= self.slots[s]
        code = w.codes
        stop = np.zeros(len(code) + 1, np.int64)
        np.cumsum(np.isin(code, np.frombuffer(b".!?:;\n", np.uint8).astype(code.dtype)), out=stop[1:])
        letters = ~self._digit[np.minimum(code[w.start], 255)] | (code[w.start] > 255)
        mask[~letters] = 0
        gap = w.start[1:] - w.end[:-1]
        new = np.ones(n, bool)
        new[1:] = (w.text[1:] != w.text[:-1]) | ((stop[w.start[1:]] > stop[w.end[:-1]]) & ((gap > 1) | (code[w.end[:-1]] == 10)))
        begin = np.flatnonzero(new)
        place = np.arange(n) - begin[np.cumsum(new) - 1]
        begin = np.flatnonzero(new | (place % PIECE == 0))
        size = np.diff(np.append(begin, n))
        counts = np.add.reduceat(_bits(mask).astype(np.int32), begin, axis=0)
        known = np.add.reduceat((mask > 0).astype(np.int32), begin)
        score = (counts - size[:, None] * self.false) / (1 - self.false)
        top = np.sort(score, axis=1)
        best = np.argmax(score, axis=1)
        # a part of a sentence must speak for itself more clearly: names and terms stand there too
        part = ~new[begin] | np.append(~new[begin[1:]], False)
        sure = (top[:, -1] >= np.where(part, np.maximum(2, CLEAR * size), 2)) & (top[:, -1] >= top[:, -2] + 1)
        text = w.text[begin]
        worded = np.add.reduceat(letters.astype(np.int32), begin)
        # a sentence without evidence joins the segment before it, or at a text's start the one after it
        at = np.where(sure, np.arange(len(begin)), -1)
        start = np.searchsorted(text, text)
        before = np.maximum.accumulate(at)
        after = np.minimum.accumulate(np.where(sure, np.arange(len(begin)), len(begin))[::-1])[::-1]
        source = np.where(before >= start, before, np.minimum(after, len(begin) - 1))
        valid = sure[source] & (text[source] == text)
        lang = np.where(valid, best[source], -1)
        # where the language changes inside a sentence, the change is moved to the words where it fits best
        turn = np.flatnonzero((text[1:] == text[:-1]) & (lang[1:] != lang[:-1]) & (lang[1:] >= 0) & (lang[:-1] >= 0) & ~new[begin[1:]]) + 1
        if len(turn):
            has = np.zeros((n + 1, len(CODES)), np.int32)
            np.cumsum(_bits(mask), axis=0, out=has[1:])
            ends = np.append(begin[1:], n)
            low, high = np.maximum(begin[turn - 1] + 1, begin[turn] - PIECE), np.minimum(ends[turn] - 1, begin[turn] + PIECE)
            at = np.clip(begin[turn][:, None] + np.arange(-PIECE, PIECE + 1), low[:, None], high[:, None])
            fit_ = has[at, lang[turn - 1][:, None]] - has[at, lang[turn][:, None]]
            # of places that fit as well the one nearest to the old
            fit_ = fit_ * (4 * PIECE) - np.abs(at - begin[turn][:, None])
            moved = np.take_along_axis(at, fit_.argmax(1)[:, None], 1)[:, 0]
            begin = begin.copy()
            begin[turn] = moved
            begin = np.maximum.accumulate(begin)
            keep = np.append(begin[1:] > begin[:-1], True)
            begin, lang, text = begin[keep], lang[keep], text[keep]
            size = np.diff(np.append(begin, n))
            counts = np.add.reduceat(_bits(mask).astype(np.int32), begin, axis=0)
            known = np.add.reduceat((mask > 0).astype(np.int32), begin)
            score = (counts - size[:, None] * self.false) / (1 - self.false)
            worded = np.add.reduceat(letters.astype(np.int32), begin)
        cut = _edges(text, lang)
        # a name or a foreign term inside a text of one language is no segment of its own
        few = np.add.reduceat(worded, cut) < RUNNING
        seg, owner = lang[cut], text[cut]
        inner = np.zeros(len(cut), bool)
        if len(cut) > 2:
            inner[1:-1] = few[1:-1] & (seg[:-2] == seg[2:]) & (owner[:-2] == owner[2:])
        lang = np.repeat(np.where(inner, np.roll(seg, 1), seg), np.diff(np.append(cut, len(lang))))
        cut = _edges(text, lang)
        own = np.take_along_axis(score, np.maximum(lang, 0)[:, None], 1)[:, 0]
        share = np.add.reduceat(own, cut) / np.maximum(np.add.reduceat(known, cut), 1)
        return text[cut], begin[cut] - w.first[text[cut]], np.add.reduceat(size, cut), np.add.reduceat(worded, cut), lang[cut], np.clip(share, 0, 1)


def _detect(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(slots.value)
        names = np.array([*CODES, ""])
        for batch in batches:
            ids, labels, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in blocks(texts):
                text, first, size, worded, lang, share = detector.segments(texts[a:b])
                keep = lang >= 0
                at = pa.array(text[keep] + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), labels.take(at), pa.array(first[keep].astype(np.int64)), pa.array(size[keep].astype(np.int64)), pa.array(worded[keep].astype(np.int64)), pa.array(names[lang[keep]]), pa.array(share[keep])],
                    ["doc_id", "label", "first_word", "words", "letter_words", "language", "confidence"],
                )

    return run


def segments(docs: DataFrame) -> DataFrame:
    """``doc_id, label, first_word, words, letter_words, language, confidence`` of each segment of each document."""
    ship(docs.sparkSession)
    slots = docs.sparkSession.sparkContext.broadcast(fit(docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_language(F.col("lang")).alias("label"), "text").filter("doc_id is not null and text is not null")
    return texts.mapInArrow(_detect(slots), "doc_id long, label string, first_word long, words long, letter_words long, language string, confidence double")


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, label, language, words, confidence, mixed``: the languages in each document, with the words in each."""
    s = segments(docs).filter(f"letter_words >= {RUNNING}")
    each = s.groupBy("doc_id", "label", "language").agg(F.sum("letter_words").alias("words"), (F.sum(F.col("confidence") * F.col("letter_words")) / F.sum("letter_words")).alias("confidence"))
    several = F.collect_set("language")
    of = each.groupBy("doc_id").agg(several.alias("set"), F.collect_list(F.struct("label", "language", "words", "confidence")).alias("l"))
    return of.select("doc_id", (F.size("set") > 1).alias("mixed"), F.inline("l"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = languages(table(spark, sf_dir, "documents"))
    return each.filter("label is null or label != language or mixed").select("doc_id", "language").distinct()


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every segment of every document."""
    s = segments(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "first_word", "words", "language", F.round("confidence", 6).alias("confidence"))
