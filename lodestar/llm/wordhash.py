"""Hashes of words and word windows over whole Arrow batches of texts, without a loop over words.

A word is a run of bytes other than space and \\x09-\\x0D. It is hashed eight bytes at a time, and a window of words by
doubling: the hash of 2L words is made of those of its halves, and one of any other length of the two powers of two that
cover it from both ends. Every step is a bijection of 64 bits in each of its inputs and no sum, so no two sequences agree by
their structure; two different ones agree by chance about once in 2**64. Where a hash decides by itself what is equal,
the operators take a cryptographic digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are hashed in slices of about so many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19
#: Longer words than so many bytes get a digest, one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two parts in this order."""
    return mix(mix(a + U(0x9E3779B97F4A7C15)) ^ b)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets): consecutive texts and where each begins in their bytes; null is an empty text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, starts, data = texts.buffers()
    at = np.frombuffer(starts, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word, and where each text's words begin among them."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads, tails = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    first[heads], last[tails] = solid[heads], solid[tails]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - begin
    padded = np.concatenate([_LOWER[raw] if lower else raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, np.dtype("<u8"), padded, strides=(1,))  # the next eight bytes of each place
    hashes = mix(eight[begin] & _MASK[np.minimum(size, 8)] ^ mix(size.astype(U)))
    more, place = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        hashes[more] = joined(hashes[more], eight[begin[more] + place] & _MASK[np.minimum(size[more] - place, 8)])
        place += 8
        more = more[size[more] > place]
    for w in np.flatnonzero(size > LONG_WORD):
        hashes[w] = int.from_bytes(hashlib.blake2b(padded[begin[w] : end[w]].tobytes(), digest_size=8).digest(), "little")
    return hashes, begin, end, np.searchsorted(begin, at)


class Windows:
    """Hashes of all windows of consecutive words by their length; they may run over the end of a text."""

    def __init__(self, hashes: np.ndarray):
        self.doubled = [hashes]

    def __call__(self, length: int) -> np.ndarray:
        step = length.bit_length() - 1
        while len(self.doubled) <= step:
            half, n = self.doubled[-1], 1 << len(self.doubled) - 1
            self.doubled.append(joined(half[: max(0, len(half) - n)], half[n:]))
        whole, rest = self.doubled[step], length - (1 << step)
        return mix(joined(whole[: max(0, len(whole) - rest)], whole[rest:]) + U(length)) if rest else mix(whole + U(length))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text in lower case; the whole sequence if it has fewer words."""
    for lo, hi, raw, at in slices(texts):
        hashes, _, _, begin = words(raw, at, lower=True)
        windows = Windows(hashes)
        by_length = {n: windows(n) for n in range(1, k + 1)}
        for d in range(hi - lo):
            b, e = begin[d], begin[d + 1]
            if e - b >= k:
                s = np.sort(by_length[k][b : e - k + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            else:
                yield by_length[int(e - b)][b : b + 1] if e > b else np.zeros(0, U)
