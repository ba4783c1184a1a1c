"""Sets of 5-word shingles as sorted arrays of 64-bit hashes, made from UTF-8 bytes in numpy.

Two shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes handled at once; a longer document is handled alone.
CHUNK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(20_260_101)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE = _BYTE[_LOWER]  # A-Z like a-z
_PLACE = _rng.integers(1, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_RATIO = np.uint64(0x9E3779B97F4A7C15)
_RATIO_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, ratio in enumerate((_RATIO, _RATIO_INV)):
            steps = np.full(max(n, CHUNK) + 1, ratio, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the documents end to end, and each document's first word (n + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets >= 0) & (offsets <= n)]] = True
    before = np.r_[False, word[:-1]]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.r_[word[1:], False]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power, out=total[1:])
    return mixed((total[ends] - total[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of every one of the documents end to end."""
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    return np.diff(np.searchsorted(starts, offsets))


def chunked_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() by stretches of about CHUNK bytes that end where a word does, so that memory follows the words and not the bytes."""
    n, docs = len(raw), len(offsets) - 1
    counts, out, a = np.zeros(docs, np.int64), [np.zeros(0, np.uint64)], 0
    while a < n:
        b = min(n, a + CHUNK)
        while b < n:
            edges = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "right")]
            blanks = np.flatnonzero(_SPACE[raw[a:b]])
            cut = max(int(edges[-1]) if len(edges) else 0, a + int(blanks[-1]) + 1 if len(blanks) else 0)
            if cut > a:
                b = cut
                break
            b = min(n, b + CHUNK)
        inner = np.unique(offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")])
        parts = np.r_[a, inner, b] - a
        hashes, first = word_hashes(raw[a:b], parts)
        np.add.at(counts, np.searchsorted(offsets, parts[:-1] + a, "right") - 1, np.diff(first))
        out.append(hashes)
        a = b
    return np.concatenate(out), np.r_[0, np.cumsum(counts)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every document."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        words, first = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes = np.zeros(0, np.uint64)
        if len(words) >= WORDS:
            m = len(words) - WORDS + 1
            hashes = words[:m] * _PLACE[0]
            for j in range(1, WORDS):
                hashes += words[j : j + m] * _PLACE[j]
            hashes = mixed(hashes)
        for k in range(a, b):
            x, y = int(first[k - a]), int(first[k - a + 1])
            if y - x >= WORDS:
                s = np.sort(hashes[x : y - WORDS + 1])
                if len(s) > 1:
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
                yield k, s
            elif y > x:
                with np.errstate(over="ignore"):
                    whole = np.uint64(y - x) + (words[x:y] * _PLACE[: y - x]).sum(dtype=np.uint64)
                yield k, mixed(np.array([whole], np.uint64))
            else:
                yield k, hashes[:0]
        a = b


def signature(shingles: np.ndarray) -> bytes:
    """Hashed bitmap: a power of two of bits, at least four a shingle, 512 to 8192."""
    bits = min(8192, max(512, 1 << int(4 * max(1, len(shingles)) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(mixed(shingles.copy()) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    """The bitmap (words of 64) that hashing to fewer bits would give."""
    while len(sig) > size:
        half = len(sig) // 2
        sig = sig[:half] | sig[half:]
    return sig


def enough(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """Whether so many common shingles link sets of sizes a and b: Jaccard 0.75 or more."""
    return 100 * common >= 75 * (a + b - common)


def prefix_length(n: int) -> int:
    """In any one order of all shingles, two linked sets of sizes a and b share least_shared(a) of the first so many, or more.

    The shortest prefix that works is n - ceil(3n/4) + 1, for one shared shingle.  A tenth more asks for a tenth more,
    and tells sets that share a line from sets that link.
    """
    return n - (3 * n + 3) // 4 + 1 + n // 10


def least_shared(n: int) -> int:
    """A set that links has 3n/4 shingles at least, so its longer prefix adds a tenth of that at least."""
    return 1 + 3 * n // 4 // 10
