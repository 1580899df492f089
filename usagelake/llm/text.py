"""Vectorised text helpers that run inside Spark tasks.

A batch of texts becomes one UTF-8 buffer; words, polynomial prefix hashes and
window hashes are numpy expressions over that buffer, so no Python code runs
per word.  Every helper accepts null texts (treated as empty) and texts of any
length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
CHUNK_BYTES = 2_000_000

U64 = np.uint64
#: Odd multiplier of the prefix polynomial, modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes that stand in a word `[^\x20\x09-\x0D]+`.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that stand in a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Maps A-Z to a-z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def encode(texts) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def chunks(raw: list[bytes], limit: int = CHUNK_BYTES):
    """(first, last) slices of at most `limit` bytes; a longer text stands alone."""
    yield from _slices(map(len, raw), limit)


def _slices(sizes, limit: int):
    first = size = end = 0
    for i, n in enumerate(sizes):
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n + 1
        end = i + 1
    if first < end:
        yield first, end


def steps(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(first, last, UTF-8 bytes of the texts between) as chunks() cuts them; the texts of one step only leave the Arrow array at a time."""
    for a, b in _slices(pc.binary_length(texts).fill_null(0).to_pylist(), limit):
        yield a, b, [x or b"" for x in texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12) if have is None else max(n, min(2 * len(have), CHUNK_BYTES + 4096))
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


#: Random 64-bit values that stand for the 256 bytes.
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


class Batch:
    """Some texts as one buffer, a line feed after each.

    data: the bytes; at: where each text starts, and the end of the last.
    """

    def __init__(self, raw: list[bytes], lower: bool = False):
        self.n = len(raw)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), np.uint8)[:-8]
        if lower:
            self.data = LOWER[self.data]
        self.at = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(b) + 1 for b in raw], out=self.at[1:])
        self._prefix: np.ndarray | None = None

    def words(self, table: np.ndarray = NONSPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of each word in the buffer, and `first`: words before each text, and all."""
        inside = table[self.data]
        inside[self.at[1:] - 1] = False
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(start, self.at)

    def prefix(self) -> np.ndarray:
        """Polynomial prefix hashes: prefix[i] covers the bytes before i."""
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_BYTES[self.data] * powers(BASE, len(self.data)), out=self._prefix[1:])
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges [start, end): equal ranges hash equally anywhere."""
        h = self.prefix()
        return mix((h[end] - h[start]) * powers(_INVERSE, len(self.data))[start] + (end - start).astype(U64))


def runs_of_words(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` items of h: item i covers h[i:i+size]."""
    if len(h) < size:
        return np.zeros(0, U64)
    pre = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(BASE, len(h)), out=pre[1:])
    return mix((pre[size:] - pre[:-size]) * powers(_INVERSE, len(h))[: len(h) - size + 1] + U64(size))


def window_hashes(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the item ranges [start, end) from the prefix hashes `pre` of a sequence."""
    return mix((pre[end] - pre[start]) * powers(_INVERSE, len(pre))[start] + (end - start).astype(U64))


def prefix_of(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of a sequence of 64-bit values."""
    pre = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASE, len(values)), out=pre[1:])
    return pre


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: block-wise prefix and suffix minima, O(len(h))."""
    k = len(h) - width + 1
    if k <= 0:
        return np.zeros(0, U64)
    full = np.concatenate([h, np.full(-len(h) % width, np.iinfo(np.uint64).max, U64)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:k], left[width - 1 : width - 1 + k])


def anchors(pre: np.ndarray, lo: int, hi: int, window: int, gram: int):
    """Anchored runs of the windows of `window` items inside [lo, hi).

    Each window is represented by the least hash of the `gram`-item grams it
    holds; neighbouring windows with the same gram for it form one run.
    Equal windows have equal representatives, so a window can repeat only where
    its run's key repeats.  Returns (key, context hash, first start, last start)
    of each run; the context covers every window of the run.
    """
    if hi - lo < window:
        z = np.zeros(0, np.int64)
        return z.astype(U64), z.astype(U64), z, z
    at = np.arange(lo, hi - gram + 1)
    h = window_hashes(pre, at, at + gram)
    least = sliding_min(h, window - gram + 1)
    # the first gram of that hash stands for the window: a run ends where it is left behind
    change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])]))
    first = lo + change
    last = lo + np.concatenate([change[1:], [len(least)]]) - 1
    return least[change], window_hashes(pre, first, last + window), first, last
