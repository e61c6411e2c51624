"""Vectorised tokenising of Arrow text columns: words, lines and 64-bit hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is one piece.
CHUNK_BYTES = 1 << 21
#: Bytes hashed at once, in runs of words: their 64-bit sums and powers then stay small beside the text's own arrays.
HASH_BYTES = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 step)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_tables: dict[str, np.ndarray] = {}


def _byte_values() -> np.ndarray:
    """A random-looking 64-bit value for each byte, the same for A-Z as for a-z."""
    if "bytes" not in _tables:
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += np.uint64(32)
        _tables["bytes"] = mix64((folded + np.uint64(1)) * np.uint64(_BASE))
    return _tables["bytes"]


def is_space() -> np.ndarray:
    """For each byte, whether it is ASCII white space."""
    if "space" not in _tables:
        t = np.zeros(256, bool)
        t[[32, 9, 10, 11, 12, 13]] = True
        _tables["space"] = t
    return _tables["space"]


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or the powers of its inverse."""
    key = f"{base}{inverse}"
    have = _tables.get(key)
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, 1 << 16)
        seq = np.full(size, step, np.uint64)
        seq[0] = 1
        have = np.cumprod(seq, dtype=np.uint64)
        if size <= CHUNK_BYTES * 2:
            _tables[key] = have
    return have[:n]


@dataclass
class Words:
    """Words of a run of texts: byte bounds, the text each belongs to and a hash folded to lower case."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Split on ASCII white space and hash each word, ASCII letters folded."""
    n = len(buf)
    if not n:
        e = np.empty(0, np.int64)
        return Words(buf, offsets, e, e, e, np.empty(0, np.uint64))
    space = is_space()[buf]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    first = offsets[:-1]
    before[first[first < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = True
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    del space, before, after
    h = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # 24 bytes of memory for a byte of text, so in runs of words
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + HASH_BYTES, side="right")))
        at, size = start[lo], int(end[hi - 1] - start[lo])
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_byte_values()[buf[at : at + size]] * powers(_BASE, size), out=sums[1:])
        s, e = start[lo:hi] - at, end[lo:hi] - at
        h[lo:hi] = mix64((sums[e] - sums[s]) * powers(_BASE, size, True)[s] + (e - s).astype(np.uint64) * np.uint64(_WORD_BASE))
        lo = hi
    return Words(buf, offsets, start, end, np.searchsorted(offsets, start, side="right") - 1, h)


def word_runs(col: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Words of a column, piece by piece: first row, last row, words."""
    buf, offsets = text_buffer(col)
    for lo, hi in spans(offsets):
        yield lo, hi, words_of(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def sequence_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of words follows; see ``run_hash``."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_WORD_BASE, len(h)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position-free hash of words lo..hi-1 (before mixing)."""
    return (sums[hi] - sums[lo]) * powers(_WORD_BASE, len(sums), True)[lo]


def word_power(n: np.ndarray) -> np.ndarray:
    """The factor by which words after n others count in ``run_hash``."""
    n = np.asarray(n)
    return powers(_WORD_BASE, int(n.max(initial=0)) + 1)[n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
