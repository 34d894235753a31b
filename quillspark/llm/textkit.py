"""Vectorised helpers over Arrow string columns, for use inside ``mapInArrow`` tasks.

Texts are handled as UTF-8 bytes. A record batch is cut into slices of about
``SLICE_BYTES`` so that the working arrays of a task stay small whatever the
batch size; one text longer than that forms a slice of its own.

Hashes are 64-bit polynomials over randomised byte values, finished by a mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_UPPER = np.arange(ord("A"), ord("Z") + 1)
BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[_UPPER] = BYTE_VALUE[_UPPER + 32]
ORDER_VALUE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

#: The separators of words in most operators: space and \t\n\v\f\r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What the decontamination contract leaves outside words (upper case is folded first).
IS_PUNCTUATION = np.ones(256, bool)
IS_PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, so that a worker that serves many stages doesn't keep the peaks of all."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch: their bytes and where each text begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Slice(first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last
    give_back()


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for at least ``n`` positions."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 12))
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Running polynomial sums: ``span_hash`` of any span follows in constant time."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(piece: Slice, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes not in ``outside``; runs never cross texts.

    Returns starts, ends and, for each text, the index of its first run (one more entry than texts).
    """
    data, offs = piece.data, piece.offsets
    n = len(data)
    inside = ~outside[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of each text, and each text's first shingle.

    A text with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(len(counts)), made)
    begin = first[:-1][owner] + (np.arange(at[-1]) - at[:-1][owner])
    have = np.minimum(width, counts)[owner]
    total = np.zeros(at[-1], np.uint64)
    for k in range(width):
        more = have > k
        if more.all():
            total += words[begin + k] * ORDER_VALUE[k]
        else:
            total[more] += words[begin[more] + k] * ORDER_VALUE[k]
    return mix(total + have.astype(np.uint64)), at


def per_text_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's range ``at[i]:at[i+1]``; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]
