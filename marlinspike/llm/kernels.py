"""Vectorised text kernels that run inside Arrow batches.

A block is the UTF-8 bytes of several documents laid end to end plus the byte
offset of each document.  All word classes used here are unions of ASCII
characters and "everything above ASCII", so they can be decided byte by byte.

Word hashes are polynomials over a random byte table modulo 2**64, finished
with a bijective mixer; window hashes are polynomials over word hashes.  Equal
word sequences always get equal hashes.  Different ones collide with a
probability of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but space, tab, line feed, vertical tab, form feed, carriage return.
NON_SPACE = ~SPACES
#: ASCII digits and letters, and every byte of a character above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BLOCK_BYTES = 1 << 18
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_R, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES, most_rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of consecutive rows.

    A block holds whole documents: as many as fit in ``block_bytes`` and
    ``most_rows``, one at least.  Null texts count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each document."""
    n = len(buf)
    inside = is_word[buf]
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    edge = offsets[:-1]
    before[edge[edge < n]] = True
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    edge = offsets[1:]
    after[edge[edge > 0] - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end] for each ascending, non-overlapping span."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + BLOCK_BYTES, "right")), lo + 1)
        base, end = int(starts[lo]), int(ends[hi - 1])
        total = np.empty(end - base + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[buf[base:end]] * _power(_R, end - base), out=total[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (total[b] - total[a]) * _power(_inverse(_R), end - base)[a] + (b - a).astype(np.uint64)
        lo = hi
    return mix(out)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries (document ends are not regarded)."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(m, np.uint64), BLOCK_BYTES // 2
    for lo in range(0, m, step):
        hi = min(lo + step, m)
        total = np.zeros(hi - lo + k, np.uint64)
        np.cumsum(hashes[lo : hi + k - 1] * _power(_Q, hi - lo + k - 1), out=total[1:])
        out[lo:hi] = (total[k:] - total[:-k]) * _power(_inverse(_Q), hi - lo)
    return mix(out)


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the entries from each start to its end; equal ones of the same length agree."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_Q, len(hashes)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_inverse(_Q), len(hashes) + 1)[starts])


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole short sequence, which also depends on its length."""
    return mix(window_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))[0]


def window_starts(word_offsets: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the words at which k words of the same document start."""
    counts = np.diff(word_offsets)
    last = np.repeat(word_offsets[1:], counts) - k
    index = np.arange(word_offsets[-1]) if len(word_offsets) else np.zeros(0, np.int64)
    return index[index <= last]
