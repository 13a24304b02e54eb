"""Reproducible draws: every random number is a hash of (seed, row key, position).

The JVM side uses the built-in ``xxhash64``; the NumPy side computes the same
64-bit hash for whole Arrow batches.  A draw therefore never depends on how the
rows are partitioned, and a recomputed task repeats it exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_POW_53 = float(2**53)

# The five 64-bit primes of the published XXH64 hash.
XXH_P1 = 0x9E3779B185EBCA87
XXH_P2 = 0xC2B2AE3D27D4EB4F
XXH_P3 = 0x165667B19E3779F9
XXH_P4 = 0x85EBCA77C2B2AE63
XXH_P5 = 0x27D4EB2F165667C5


def row_key(df: DataFrame, key: str) -> Column:
    """The key column as it is hashed: integers of any width count as LONG, so the same ids give the same draws."""
    return F.col(key).cast("long") if isinstance(df.schema[key].dataType, T.IntegralType) else F.col(key)


def hash_key(seed: int, *keys) -> Column:
    """64-bit hash of a seed and key columns; pass row keys through ``row_key``."""
    return F.xxhash64(F.lit(int(seed)).cast("long"), *[_column(k) for k in keys])


def hash_bits(seed: int, *keys) -> Column:
    """The top 53 bits of the hash as a non-negative LONG."""
    return F.shiftrightunsigned(hash_key(seed, *keys), 11)


def uniform(seed: int, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return hash_bits(seed, *keys).cast("double") / F.lit(TWO_POW_53)


def gumbel(u: Column, eps: float = 1e-20) -> Column:
    """Standard Gumbel noise from a uniform."""
    return -F.log(-F.log(u + F.lit(eps)) + F.lit(eps))


def _column(k) -> Column:
    if isinstance(k, str):
        return F.col(k)
    return k


def hash_long_np(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """``xxhash64`` of one LONG continuing from ``seeds``; shapes broadcast."""
    u = np.uint64

    def rotate(a, r):
        return (a << u(r)) | (a >> u(64 - r))

    with np.errstate(over="ignore"):
        mixed = rotate(values.astype(u) * u(XXH_P2), 31) * u(XXH_P1)
        h = (seeds.astype(u) + u(XXH_P5) + u(8)) ^ mixed
        h = rotate(h, 27) * u(XXH_P1) + u(XXH_P4)
        h = (h ^ (h >> u(33))) * u(XXH_P2)
        h = (h ^ (h >> u(29))) * u(XXH_P3)
        return h ^ (h >> u(32))


def normals_np(row_hash: np.ndarray, p: int) -> np.ndarray:
    """n x p standard normals by Box-Muller; ``row_hash`` is ``hash_key(seed, key)``.

    Features 2m and 2m+1 share one pair of uniforms.
    """
    width = p + (p % 2)
    bits = hash_long_np(np.arange(width, dtype=np.int64)[None, :], row_hash.view(np.uint64)[:, None])
    u = (bits >> np.uint64(11)).astype(np.float64) / TWO_POW_53
    radius = np.sqrt(-2.0 * np.log(1.0 - u[:, 0::2]))
    angle = 2.0 * np.pi * u[:, 1::2]
    z = np.empty_like(u)
    z[:, 0::2] = radius * np.cos(angle)
    z[:, 1::2] = radius * np.sin(angle)
    return z[:, :p]
