"""Vectorised words and word hashes over Arrow string columns.

The word classes used in this subpackage split only at ASCII bytes, so words
can be cut on the UTF-8 bytes themselves.  A 64-bit hash stands for a word: its
pieces of 8 bytes are mixed, each with its place, and summed, so words of at
most 8 bytes differ in their hashes unless their lengths make up for it, and
two given longer words collide with a probability of about 2^-64, regular or not.
Long columns are worked through in slices of bounded bytes, so a task's memory
does not follow the size of its partition (one single text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_PLACE = np.uint64(0x9E3779B97F4A7C15)

#: ASCII white space: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words between white space.
NON_SPACE = ~SPACE
#: Bytes of words of letters and digits (after A-Z are lower-cased) and of all non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(col: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them); nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each row (plus one) the index of its first word."""
    m = member[buf]
    before = np.empty(len(m), bool)
    before[:1] = False
    before[1:] = m[:-1]
    cut = off[:-1][off[:-1] < len(m)]
    before[cut] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(len(m), bool)
    after[-1:] = False
    after[:-1] = m[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each byte on

    def piece(at: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        bits = np.uint64(64) - np.uint64(8) * np.minimum(size, 8).astype(np.uint64)
        x = (eight[at] << bits) >> bits
        return mix(mix(x) + mix((place.astype(np.uint64) + np.uint64(1)) * _PLACE))

    size = ends - starts
    out = piece(starts, size, np.zeros(1, np.int64))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # pieces after the first
        first = np.cumsum(more) - more
        place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        at = np.repeat(starts[long], more) + 8 * place
        out[long] += np.add.reduceat(piece(at, np.repeat(ends[long], more) - at, place), first)
    return mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = h[:n].copy()
    for i in range(1, k):
        w *= np.uint64(0xD6E8FEB86659FD93)
        w += h[i:i + n]
    return mix(w + np.uint64(k))


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of words, as an array of length 1 (0 if it is empty)."""
    return windows(h, len(h)) if len(h) else np.zeros(0, np.uint64)
