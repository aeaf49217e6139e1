"""Counter-based randomness: a value depends only on the seed and the row's own key.

Results therefore do not change with the partitioning, and a lost task recomputes the same draws.
Keys are folded into two numbers modulo a 31-bit prime, each is mixed, and both make one 62-bit number;
every product fits a signed 64-bit integer, and the same arithmetic is available as SQL text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647
FOLD = 1103515245
MIX1 = 1540483477
MIX2 = 2246822519
#: Added to the seed for the low half of a draw.
LOW = 1013904223


def _half(seed: int, *keys: Column) -> Column:
    h = F.lit(seed % PRIME).cast("long")
    for k in keys:
        h = (h * FOLD + k.cast("long") % PRIME + 12345) % PRIME
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * MIX1) % PRIME
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * MIX2) % PRIME
    return h


def draw(seed: int, *keys: Column) -> Column:
    """An integer below PRIME squared (62 bits) from non-negative integer keys."""
    return _half(seed, *keys) * PRIME + _half(seed + LOW, *keys)


def uniform(seed: int, *keys: Column) -> Column:
    """Uniform in (0, 1): 52 bits and a half, which a double holds exactly."""
    return (F.shiftright(draw(seed, *keys), 10).cast("double") + 0.5) / float(1 << 52)


def _sql_half(seed: int, *keys: str) -> str:
    h = f"CAST({seed % PRIME} AS BIGINT)"
    for k in keys:
        h = f"(({h} * {FOLD} + ({k}) % {PRIME} + 12345) % {PRIME})"
    h = f"((xor({h}, {h} >> 15) * {MIX1}) % {PRIME})"
    return f"((xor({h}, {h} >> 13) * {MIX2}) % {PRIME})"


def sql_draw(seed: int, *keys: str) -> str:
    """The same integer as SQL text."""
    return f"({_sql_half(seed, *keys)} * {PRIME} + {_sql_half(seed + LOW, *keys)})"


def sql_uniform(seed: int, *keys: str) -> str:
    return f"(((({sql_draw(seed, *keys)}) >> 10) + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"


def _mersenne(v: np.ndarray) -> np.ndarray:
    """Non-negative numbers modulo PRIME (2^31 - 1), in place, by adding the high bits to the low ones without a division."""
    v = np.asarray(v)
    high = np.asarray(v >> 31)
    v &= PRIME
    v += high
    np.right_shift(v, 31, out=high)
    v &= PRIME
    v += high
    np.add(v, 1, out=high)
    high >>= 31
    v += high
    v &= PRIME
    return v


def _numpy_half(seed: int, *keys) -> np.ndarray:
    h = np.asarray(seed % PRIME, np.int64)
    mod = _mersenne if all(np.min(k, initial=0) >= 0 for k in keys) else (lambda v: np.fmod(v, PRIME))
    for k in keys:
        h = mod(h * FOLD + (np.fmod(np.asarray(k, np.int64), PRIME) + 12345))
    h = mod((h ^ (h >> 15)) * MIX1)
    return mod((h ^ (h >> 13)) * MIX2)


def numpy_draw(seed: int, *keys) -> np.ndarray:
    """``draw`` on whole numbers or arrays that broadcast against each other."""
    return _numpy_half(seed, *keys) * PRIME + _numpy_half(seed + LOW, *keys)


def numpy_uniform(seed: int, *keys) -> np.ndarray:
    """``uniform`` on whole numbers or arrays that broadcast against each other."""
    drawn = numpy_draw(seed, *keys)
    drawn >>= 10
    out = drawn.astype(float)
    out += 0.5
    out *= 1 / (1 << 52)
    return out


#: Primes of xxHash64.
XX1, XX2, XX3, XX4, XX5 = (np.uint64(v) for v in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def numpy_xxhash64(*values: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of long columns without nulls."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(values[0]), 42, np.uint64)
    for v in values:
        h = (h + XX5 + np.uint64(8)) ^ (turn(np.asarray(v, np.int64).view(np.uint64) * XX2, 31) * XX1)
        h = turn(h, 27) * XX1 + XX4
        h = (h ^ (h >> np.uint64(33))) * XX2
        h = (h ^ (h >> np.uint64(29))) * XX3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def geometric(u: Column, log_q: Column) -> Column:
    """Failures before the first success from a uniform draw; ``log_q`` is ln(1 - p)."""
    return F.floor(F.ln(u) / log_q)


def nb_draw(mean: Column, theta: int, seed: int, *keys: Column) -> Column:
    """Negative-binomial counts with integer size ``theta``: a sum of geometric counts."""
    log_q = F.ln(mean / (mean + float(theta)))
    total = None
    for r in range(theta):
        g = geometric(uniform(seed + 7907 * (r + 1), *keys), log_q)
        total = g if total is None else total + g
    return F.when(mean > 0, total.cast("double")).otherwise(F.lit(0.0))
