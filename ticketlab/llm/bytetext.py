"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered.
A batch is cut into slices of whole texts, so temporary arrays stay a small
multiple of ``SLICE_BYTES`` (or of the longest single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64


def splitmix(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers (the splitmix64 sequence)."""
    with np.errstate(over="ignore"):
        x = U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        return finish(x)


def finish(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: glibc's, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system. A reused Python worker would else
    keep its largest batch's pages beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    upper = (data >= ord("A")) & (data <= ord("Z"))
    return data + (upper.view(np.uint8) << np.uint8(5))


_BYTE = splitmix(1, 256)
_POWER_BASE = U64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(2 * n, _POWER_BASE, U64)
        step[0] = 1
        _POWERS = np.multiply.accumulate(step)
    return _POWERS


class Slice(NamedTuple):
    first: int            # row of the batch that the slice starts with
    data: np.ndarray      # bytes of the texts, one after another
    offsets: np.ndarray   # where each text starts, and the end of the last


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null: empty text) into slices of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        lo = hi
    release()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a text: their starts, ends,
    and for each text the index of its first run (one entry more than texts)."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, the same in every process."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)))
    kind = np.int32 if first[-1] < 1 << 31 else np.int64
    position = np.arange(first[-1], dtype=kind) - np.repeat(first[:-1].astype(kind), lengths)
    with np.errstate(over="ignore"):
        terms = _BYTE[data[inside]] * _powers(int(lengths.max()))[position]
        return finish(np.add.reduceat(terms, first[:-1]) + lengths.astype(U64))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order of appearance, where each is first, and for each
    hash its place among them (a hash table, not a sort)."""
    import pandas as pd   # here, so that workers of other operators do not load it

    place, values = pd.factorize(hashes)
    first = np.empty(len(values), np.int64)
    first[place[::-1]] = np.arange(len(hashes) - 1, -1, -1)
    return values, first, place


class Words(NamedTuple):
    hashes: np.ndarray   # of every word of the slice, in order
    starts: np.ndarray   # byte positions in the slice
    ends: np.ndarray
    first: np.ndarray    # index of each text's first word, and the number of words


def words(s: Slice) -> Words:
    inside = ~is_space(s.data)
    starts, ends, first = runs(inside, s.offsets)
    return Words(run_hashes(lower(s.data), inside, starts, ends), starts, ends, first)


def per_text(values: np.ndarray, first: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """Reduce the values of each text; texts without values get ``empty``."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, first[:-1][full])
    return out
