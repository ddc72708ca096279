"""Batches of texts as byte arrays, for numpy.

A block is a run of texts of a few MB that are encoded into one array, so that
words, hashes and counts come from a handful of array operations. Blocks hold
whole texts; a text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 2 << 20
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and all of other characters.
IS_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_a:_b] = True


def encode(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def blocks(texts, size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of runs of about size bytes."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        b = encode(t)
        if held and total + len(b) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(b)
        total += len(b) + 1
    if held:
        yield first, held


class Block:
    """Texts put end to end with a zero byte after each."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.sizes = sizes
        self.raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.low = LOWER[self.raw]

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and owners of all words."""
        step = np.diff(IS_WORD[self.low].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return begin, end, self.owner(begin)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed odd number modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(size, r, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which span_hash() gets the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the text it is in."""
    begin, end, own = block.words()
    return span_hash(prefix(block.low), begin, end), own


def shingles(hashes: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in one text, and their texts."""
    if len(hashes) < k:
        return hashes[:0], own[:0]
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    pw, inv = powers(len(hashes) + 1)
    np.cumsum(hashes * pw[:-1], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * inv[: len(hashes) - k + 1])
    inside = own[k - 1 :] == own[: len(own) - k + 1]
    return h[inside], own[: len(own) - k + 1][inside]


def span_hash_of(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of 64-bit values, as span_hash() of bytes."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    pw, inv = powers(len(values) + 1)
    np.cumsum(values * pw[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inv[begin])
