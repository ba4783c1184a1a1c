"""Terms of whole texts: maximal runs of bytes that are no separators, with A-Z like a-z, found and hashed in numpy.

Two terms count as equal if their 64-bit hashes are.  Every byte of a character beyond ASCII is part of a term, so
bytes tell the same terms as characters do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shingles import _BYTE, _LOWER, _power, mixed

#: Bytes handled at once; a longer document is handled alone, by stretches of so many.
CHUNK = 1 << 20


def separators(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: What does not belong to a term of letters, and of letters and digits.
NO_LETTER = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
NO_LETTER_OR_DIGIT = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _found(raw: np.ndarray, edges: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the terms; a term ends at each of the edges too."""
    inside = ~separator[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[edges] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | edge[1:])) + 1
    power, inverse = (x[: len(raw)] for x in _power(max(len(raw), CHUNK)))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power, out=total[1:])
    return starts, ends, mixed((total[ends] - total[starts]) * inverse[starts])


def pieces(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(whether its documents end here, row, hash, start, end of every term) by stretches of whole documents, or of one long document."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        x, stop = int(offsets[a]), int(offsets[b])
        while x < stop:
            y = min(stop, x + CHUNK)
            while y < stop:  # one long document: cut it where a term ends
                cuts = np.flatnonzero(separator[raw[x:y]])
                if len(cuts):
                    y = x + int(cuts[-1]) + 1
                    break
                y = min(stop, y + CHUNK)
            bounds = offsets[a : b + 1][(offsets[a : b + 1] >= x) & (offsets[a : b + 1] <= y)] - x
            starts, ends, hashes = _found(raw[x:y], bounds, separator)
            yield y == stop, np.searchsorted(offsets[a : b + 1], starts + x, "right") - 1 + a, hashes, starts + x, ends + x
            x = y
        a = b


def counted(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, hash, occurrences, start, end) of the distinct terms of every document, by stretches of whole documents."""
    held: list[tuple[np.ndarray, ...]] = []
    for done, row, hashes, start, end in pieces(raw, offsets, separator):
        held.append(summed(row, hashes, np.ones(len(row), np.int64), start, end))
        if done:
            yield held[0] if len(held) == 1 else summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []


def summed(row: np.ndarray, hashes: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each (row, hash): the sum of n, and a place where the term stands."""
    if not len(row):
        return row, hashes, n, start, end
    order = np.lexsort((hashes, row))
    row, hashes, n, start, end = (x[order] for x in (row, hashes, n, start, end))
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])
    return row[first], hashes[first], np.add.reduceat(n, first), start[first], end[first]


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The terms that stand there, A-Z lower-cased."""
    offsets = np.r_[0, np.cumsum(end - start)]
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_LOWER[raw[at]]))
