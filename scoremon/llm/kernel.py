"""Whole-batch byte work on texts inside Arrow functions: words, hashes, shingles.

Texts are looked at as UTF-8 bytes.  Both word definitions of the operators cut at ASCII
bytes only, so a byte table decides and no text is decoded.  Hashes are 64-bit; equal
hashes stand for equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240501)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
WEIGHTS = (_rng.integers(1, 2**62, 64, dtype=np.int64).astype(U) << U(1)) | U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Everything in ASCII that is neither a digit nor a lower-case letter.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Length of the tables of powers that a worker keeps.
KEPT = 1 << 20
#: Bytes of text that are hashed at once; the arrays of that take several times 8 bytes for each.
PIECE = 1 << 18
_powers = [np.ones(1, U), np.ones(1, U)]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer, so that every bit depends on every bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; tables above ``KEPT`` are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, KEPT)
    made = []
    for base in (BASE, BASE_INVERSE):
        out = np.full(size, base, U)
        out[0] = U(1)
        made.append(np.cumprod(out, out=out))
    if size == KEPT:
        _powers[:] = made
    return made[0], made[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times powers; two of them give the hash of any byte range."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``range_hash`` of words in text order, made from pieces of ``PIECE`` bytes; a longer word comes alone."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        base = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        out[a:b] = range_hash(prefix_sums(data[base : ends[b - 1]]), starts[a:b] - base, ends[a:b] - base)
        a = b
    return out


def words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and end of every word; words never cross documents."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def sort_in_documents(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by document, then value; ``doc`` is below 65536."""
    order = np.argsort(value)
    return order[np.argsort(doc[order].astype(np.uint16), kind="stable")]


def shingle_sets(
    column: pa.Array, k: int = 5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``k`` words: (document number, hash), and sizes per document.

    A text with fewer words counts as one run of all of them, one without words as none.
    """
    data, offsets = raw(column)
    docs = len(offsets) - 1
    data = LOWER[data]
    doc, starts, ends = words(data, offsets, SPACE)
    h = range_hash(prefix_sums(data), starts, ends)
    counts = np.bincount(doc, minlength=docs)
    n = len(h) - k + 1
    if n > 0:
        g = h[:n] * WEIGHTS[0]
        for j in range(1, k):
            g += h[j : n + j] * WEIGHTS[j]
        full = doc[:n] == doc[k - 1 :]
        d, g = doc[:n][full], g[full]
    else:
        d, g = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        firsts = (np.cumsum(counts) - counts)[short]
        s = counts[short].astype(U) * WEIGHTS[k]
        for j in range(k - 1):
            has = counts[short] > j
            s[has] += h[firsts[has] + j] * WEIGHTS[j]
        d, g = np.concatenate([d, short]), np.concatenate([g, s])
    g = mix(g)
    order = sort_in_documents(d, g)
    d, g = d[order], g[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    d, g = d[new], g[new]
    return d, g, np.bincount(d, minlength=docs)


def spans_in_order(n: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered runs of [start, end) ranges over ``n`` positions."""
    if not len(starts):
        return []
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    inside = np.concatenate([[False], np.cumsum(step)[:n] > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
