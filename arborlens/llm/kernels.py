"""Columnar byte kernels over the text buffers of Arrow batches: word hashes, shingles and repeats, without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is a pair of multilinear sums over its 32-bit pieces, of which the
upper halves are kept: with secret coefficients, two different words chosen without them share it with a chance of 2**-64
(Lemire and Kaser, Strongly universal string hashing is fast), whatever the words. Words beyond 64 bytes are hashed by keyed BLAKE2b.
The key is drawn once a process; hashes that leave it need one key for all workers, which the caller gives.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; a longer document is cut at a space.
WINDOW = 1 << 16
_GOLD = 0x9E3779B97F4A7C15
#: The key of hashes that stay in this process; one for results that must not differ between runs.
LOCAL, FIXED = secrets.randbits(64), 0x243F6A8885A308D3
#: Eight-byte blocks of the longest word that is hashed by sums.
_BLOCKS = 8


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)


@cache
def _coefficients(key: int) -> np.ndarray:
    """(2, 2 * _BLOCKS + 1): what each lane multiplies the halves of blocks and the length by."""
    n = 2 * (2 * _BLOCKS + 1)
    return mix(np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD)).reshape(2, -1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def units(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most WINDOW bytes together, or of one document."""
    i, n, most = 0, len(offsets) - 1, WINDOW
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def _hash_window(data: np.ndarray, edges: np.ndarray, fold: bool, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    space = SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[edges] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | cut[1:n]
    last[:-1] &= space[1:] | cut[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return s, e, np.zeros(0, np.uint64)
    text = np.zeros(n + 8, np.uint8)
    text[:n] = _LOWER[data] if fold else data
    block_at = np.ndarray((n + 1,), "<u8", text, strides=(1,))
    length, a = e - s, _coefficients(key)
    sums = [a[lane, -1] * length.astype(np.uint64) for lane in range(2)]
    live = slice(None)
    for k in range(_BLOCKS):
        if k:
            live = np.flatnonzero(length > 8 * k)
            if not len(live):
                break
        x = block_at[s[live] + 8 * k] & _FIRST[np.minimum(length[live] - 8 * k, 8)]
        for lane in range(2):
            sums[lane][live] += a[lane, 2 * k] * (x & _LOW) + a[lane, 2 * k + 1] * (x >> _HALF)
    h = sums[0] >> _HALF << _HALF | sums[1] >> _HALF
    for i in np.flatnonzero(length > 8 * _BLOCKS):
        h[i] = int.from_bytes(blake2b(text[s[i] : e[i]], digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return s, e, mix(h)


def words(data: np.ndarray, starts: np.ndarray, fold: bool = False, key: int = LOCAL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of data; no word crosses a document's first byte in starts. fold: A-Z as a-z."""
    n = len(data)
    if n <= WINDOW:
        return _hash_window(data, starts[starts < n], fold, key)
    parts, p = [], 0
    while p < n:
        q = min(n, p + WINDOW)
        while q < n:
            if len(at := np.flatnonzero(SPACE[data[max(p, q - WINDOW) : q]])):
                q = max(p, q - WINDOW) + int(at[-1]) + 1
                break
            q = min(n, q + WINDOW)
        inside = starts[(starts >= p) & (starts < q)] - p
        s, e, h = _hash_window(data[p:q], inside, fold, key)
        parts.append((s + p, e + p, h))
        p = q
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def unit_words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, fold: bool = False, key: int = LOCAL) -> tuple[np.ndarray, ...]:
    """(bytes, document starts, start, end, hash, document index) of documents i to j, positions counted from the first byte."""
    d = data[offsets[i] : offsets[j]]
    starts = (offsets[i:j] - offsets[i]).astype(np.int64)
    s, e, h = words(d, starts, fold, key)
    return d, starts, s, e, h, np.searchsorted(starts, s, "right") - 1


def shingles(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document indexes of all runs of `size` words; a document with fewer words, but some, has its whole sequence as one."""
    n = len(h)
    if not n:
        return h, doc
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    counts = np.diff(np.r_[heads, n])
    out, at = [], []
    if n >= size:
        same = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        g = np.full(len(same), size, np.uint64)
        for k in range(size):
            g = mix(g * np.uint64(_GOLD) + h[same + k])
        out, at = [g], [doc[same]]
    short = np.flatnonzero(counts < size)
    if len(short):
        g = counts[short].astype(np.uint64)
        for k in range(size - 1):
            live = counts[short] > k
            g[live] = mix(g[live] * np.uint64(_GOLD) + h[heads[short[live]] + k])
        out, at = [*out, g], [*at, doc[heads[short]]]
    return np.concatenate(out), np.concatenate(at)


def distinct_sets(g: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds): the distinct hashes of documents 0 to n-1, each set in ascending order."""
    order = np.lexsort((g, doc)) if len(g) else np.zeros(0, np.int64)
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(n + 1))


def repeated_words(h: np.ndarray, doc: np.ndarray, n: int, size: int = 3) -> np.ndarray:
    """For each of n documents, the words that lie in a run of `size` words found twice or more in the document."""
    if len(h) < size:
        return np.zeros(n, np.int64)
    same = np.flatnonzero(doc[: len(h) - size + 1] == doc[size - 1 :])
    g = mix(doc[same].astype(np.uint64) + np.uint64(1))
    for k in range(size):
        g = mix(g * np.uint64(_GOLD) + h[same + k])
    order = np.argsort(g)
    s = g[order]
    twin = np.zeros(len(s), bool)
    equal = s[1:] == s[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    hit = same[order[twin]]
    mark = np.zeros(len(h), bool)
    for k in range(size):
        mark[hit + k] = True
    return np.bincount(doc[mark], minlength=n).astype(np.int64)


def repeated_lines(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document, the lines (split at line feeds) with a word that equal an earlier line of it; lines are compared whole."""
    n = len(starts)
    out, ends = np.zeros(n, np.int64), np.r_[starts[1:], len(data)]
    breaks = np.searchsorted(np.flatnonzero(data == 10), np.r_[starts, len(data)])
    for i in np.flatnonzero(np.diff(breaks)):
        lines = data[starts[i] : ends[i]].tobytes().split(b"\n")
        if len(lines) > len({*lines}):
            lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
            out[i] = len(lines) - len({*lines})
    return out


def per_doc(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of true bytes of each document."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[np.r_[starts[1:], len(flags)]] - run[starts]
