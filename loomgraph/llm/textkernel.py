"""Word and shingle hashing over batches of texts, in numpy, without a Python step per word.

A batch of texts is laid end to end as one array of code points. Words are unbroken runs of letters and digits,
compared in lower case; a word's hash is a polynomial over its code points, had from one running sum, so the cost is
a few array operations per character whatever the number of words. Equal words have equal hashes in every batch,
task and run.

Null texts count as empty. An empty text has no words. There is no limit on a text's length: a block ends after the
text that fills it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

BLOCK_CHARS = 1 << 20
BLOCK_TEXTS = 1 << 12
_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_P))


@lru_cache(1)
def _alnum() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], dtype=bool)


@lru_cache(1)
def _alnum_latin() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(256)], dtype=bool)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_P, -1, 1 << 64)
        size = max(n, BLOCK_CHARS + BLOCK_CHARS // 8)
        _POWERS[:] = []
        for base in (_P, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def blocks(texts: Sequence[str | None], chars: int = BLOCK_CHARS, count: int = BLOCK_TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters and at most ``count`` texts."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars or i + 1 - start >= count:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def plain(text: str | None) -> str:
    """The text without invisible characters and with compatibility forms of letters as the plain letters."""
    if not text or text.isascii():
        return text or ""
    text = unicodedata.normalize("NFKC", text)
    invisible = {c for c in set(text) if c > "\x7f" and unicodedata.category(c) == "Cf"}
    return text.translate({ord(c): None for c in invisible}) if invisible else text


class Words:
    """The words of a block of texts: ``hash``, ``start`` and ``end`` (in the block's characters), ``text`` (index),
    ``first`` (for each text, the index of its first word; one entry more than texts), ``origin`` (where each text starts)
    and ``codes`` (code points of the lower-case block)."""

    def __init__(self, texts: Sequence[str | None]):
        low = [t.lower() if t else "" for t in texts]
        joined = "\n".join(low)
        if joined.isascii():
            codes = np.frombuffer(joined.encode(), dtype=np.uint8)
            table = _alnum_latin()
        else:
            try:
                codes = np.frombuffer(joined.encode("latin-1"), dtype=np.uint8)
                table = _alnum_latin()
            except UnicodeEncodeError:
                codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                table = _alnum()
        lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
        self.codes = codes
        self.origin = np.concatenate([[0], np.cumsum(lengths + 1)])[: len(low)].astype(np.int64)
        n = len(codes)
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = table[codes] if n else 0
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_values()[codes] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start]) if n else np.zeros(0, np.uint64)
        self.text = np.searchsorted(self.origin, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, np.append(self.origin, n + 1))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``n`` words inside one text, and the index of the text."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            g = g * np.uint64(_P) + self.hash[k : k + size]
        ok = self.text[:size] == self.text[n - 1 :]
        return mix(g[ok]), self.text[:size][ok]

    def distinct_shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of each text as 52-bit values in ascending order, and where each text's begin (one more than texts)."""
        g, text = self.shingles(n)
        key = np.sort((text.astype(np.uint64) << np.uint64(52)) | (g >> np.uint64(12)))
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        first = np.searchsorted(key, np.arange(len(self.first), dtype=np.uint64) << np.uint64(52)) if len(self.first) <= BLOCK_TEXTS else None
        if first is None:
            first = np.append(np.searchsorted(key, np.arange(len(self.first) - 1, dtype=np.uint64) << np.uint64(52)), len(key))
        return key & np.uint64((1 << 52) - 1), first
