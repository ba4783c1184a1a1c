"""SplitMix64 as a function of a counter, hash ranks and fingerprints.

The n-th output of a stream is a bijection of seed + n * GAMMA, so any stretch of a stream is one
vector expression and sites can be drawn in any order, on any executor.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of SplitMix64 and FNV-1a.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
FNV_OFFSET = 1469598103934665603
FNV_PRIME = 1099511628211

MASK = (1 << 64) - 1


def scramble(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def stream(seed: int | np.ndarray, count: int, start: int = 0) -> np.ndarray:
    """Outputs start .. start + count - 1 of the stream(s), the last axis running over outputs."""
    steps = np.arange(start + 1, start + count + 1, dtype=np.uint64) * np.uint64(GAMMA)
    return scramble(np.asarray(seed, np.uint64)[..., None] + steps)


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from the leading 53 bits."""
    return (np.asarray(x, np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53


def first(seed: int) -> int:
    return int(stream(seed & MASK, 1)[0])


class Stream:
    """A stream read from its front, for algorithms whose draws depend on one another."""

    def __init__(self, seed: int, ahead: int = 4_096):
        self.seed, self.ahead, self.at = seed & MASK, ahead, 0
        self.held: list[int] = []

    def next(self) -> int:
        if self.at % self.ahead == 0:
            self.held = stream(self.seed, self.ahead, self.at).tolist()
        self.at += 1
        return self.held[(self.at - 1) % self.ahead]

    def unit(self) -> float:
        return (self.next() >> 11) * 2.0**-53

    def below(self, bound: int) -> int:
        """Without bias: draws at or above the largest multiple of the bound are passed over."""
        limit = (1 << 64) // bound * bound
        while True:
            x = self.next()
            if x < limit:
                return x % bound


def case_seed(base: int, leaves: int, patterns: int, replicate: int, name: str) -> int:
    return _named(first(base ^ leaves) ^ patterns, replicate, name)


def topology_seed(base: int, leaves: int, replicate: int, name: str) -> int:
    return _named(first(base ^ leaves), replicate, name)


def _named(x: int, replicate: int, name: str) -> int:
    x ^= first(x + replicate)
    for byte in name.encode():
        x = first(x ^ byte)
    return x


def sequence_seed(tree_seed: int, sites: int, height: float) -> int:
    return first(first(tree_seed ^ sites) ^ struct.unpack("<Q", struct.pack("<d", height))[0])


def fnv1a(data: bytes) -> int:
    x = FNV_OFFSET
    for byte in data:
        x = (x ^ byte) * FNV_PRIME & MASK
    return x


def splitmix(seed: int):
    """Column function: unsigned hash of a counter as a signed long whose order is the unsigned one."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        h = scramble((x.to_numpy(np.int64).view(np.uint64) ^ np.uint64(seed & MASK)) + np.uint64(GAMMA))
        return pd.Series((h ^ np.uint64(1 << 63)).view(np.int64))

    return run


def stable_rank(namespace: str, identifier: Column) -> Column:
    """SHA-256 of namespace, a zero byte and the identifier: an order that does not depend on the input's."""
    return F.sha2(F.concat(F.lit(namespace + "\0"), identifier).cast("binary"), 256)


def dataset_id(path: Column, prefix: str) -> Column:
    name = F.trim(F.regexp_replace(path, r"[^A-Za-z0-9._-]+", "-"))
    return F.concat(F.lit(prefix), name, F.lit("-"), F.substring(F.sha2(path.cast("binary"), 256), 1, 12))


def jitter(identifier: Column, spread: float = 0.16) -> Column:
    """A fixed offset in [-spread, spread] for each identifier."""
    return (F.conv(F.substring(F.sha2(identifier.cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF)) * 2 - 1) * spread


def sha256_file(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
