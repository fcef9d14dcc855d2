"""Words of texts as 64-bit hashes, many at once.

A word is a stretch of bytes other than white space (0x20, 0x09 to 0x0D). Its hash takes eight
bytes at a time into a keyed state that is mixed after each step, so words that differ in one step
only never collide (the steps are one to one), words of up to eight bytes least of all. Words of
over ``LONG`` bytes go through XXH64; the work is linear in the bytes either way.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
LONG = 1024
SEED = 0x5851F42D4C957F2D
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the documents' bounds counted in words."""
    space = IS_SPACE[buf]
    filled = bounds[1:] > bounds[:-1]
    before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[bounds[:-1][filled]] = True
    after[bounds[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    h = mix(U(seed) + size.astype(U))
    own, at, left = np.arange(len(starts)), starts, size
    if len(size) and int(size.max()) > LONG:
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(buf[starts[i]:ends[i]].tobytes(), seed)
        own = np.flatnonzero(size <= LONG)
        at, left = at[own], left[own]
    while len(own):
        unused = U(8) * (U(8) - np.minimum(left, 8).astype(U))
        h[own] = mix(h[own] ^ ((eight[at] << unused) >> unused))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    return h


def same_words(buf: np.ndarray, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> bool:
    """Is each word (starts, ends) of ``one`` that of ``two``, byte by byte?"""
    size = one[1] - one[0]
    if not np.array_equal(size, two[1] - two[0]):
        return False
    own = np.flatnonzero(size > LONG)
    if any(buf[one[0][i]:one[1][i]].tobytes() != buf[two[0][i]:two[1][i]].tobytes() for i in own.tolist()):
        return False
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))
    own = np.flatnonzero((one[0] != two[0]) & (size <= LONG))
    a, b, left = one[0][own], two[0][own], size[own]
    while len(left):
        unused = U(8) * (U(8) - np.minimum(left, 8).astype(U))
        if ((eight[a] ^ eight[b]) << unused).any():
            return False
        more = left > 8
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
    return True
