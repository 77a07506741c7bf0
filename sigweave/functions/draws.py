"""Deterministic pseudo-random draws, equal in every SQL engine.

A draw depends only on (seed, keys, replicate, slot): a lost task repeats it exactly. A
replicate has a 60-bit number from md5; a slot's draw mixes that number with the slot in 32-bit
steps (xor-shift and multiplication by a constant below 2**31, so that products stay in 63
bits), which numpy does for whole replicates at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Multipliers of slots and of the mixing steps.
SLOT_STEP, MIX_STEP = 2654435761, 73244475
_LOW = np.uint64(2**32 - 1)
#: Draws that are worked out at a time, so that the steps stay in a core's cache.
DRAW_BLOCK = 1 << 15


def hash_number(*parts: Column | int | str) -> Column:
    """60-bit number from the md5 of the parts joined with colons."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("long")


def replicate_number(*parts: object) -> int:
    """What ``hash_number`` gives for texts and integers, on its own."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _mix(x: np.ndarray) -> None:
    """Mixes 32-bit numbers in place; products wrap."""
    shifted = np.empty_like(x)
    for _ in range(2):
        np.right_shift(x, np.uint32(16), out=shifted)
        np.bitwise_xor(x, shifted, out=x)
        np.multiply(x, np.uint32(MIX_STEP), out=x)
    np.right_shift(x, np.uint32(16), out=shifted)
    np.bitwise_xor(x, shifted, out=x)


def mixed(numbers: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """32-bit draws of ``slots`` in the replicates with these numbers (shapes broadcast)."""
    numbers = np.asarray(numbers).astype(np.uint64)
    x = np.atleast_1d((np.asarray(slots).astype(np.uint32) * np.uint32(SLOT_STEP)) + (numbers & _LOW).astype(np.uint32))
    _mix(x)
    np.bitwise_xor(x, (numbers >> np.uint64(32)).astype(np.uint32), out=x)
    _mix(x)
    return x


def drawn_positions(numbers: np.ndarray, n: int, cell: np.ndarray | None = None) -> np.ndarray:
    """Position in [0, n) that each of n slots draws, one row per replicate number; with ``cell`` what it holds for the position."""
    numbers = np.asarray(numbers)
    out = np.empty((len(numbers), n), np.int64)
    step = max(1, DRAW_BLOCK // max(n, 1))
    for first in range(0, n, DRAW_BLOCK):
        slots = np.arange(first, min(n, first + DRAW_BLOCK), dtype=np.uint32)[None, :]
        for r in range(0, len(numbers), step):
            at = mixed(numbers[r:r + step, None], slots).astype(np.uint64)
            at = ((at * np.uint64(n)) >> np.uint64(32)).view(np.int64)
            out[r:r + step, first:first + DRAW_BLOCK] = at if cell is None else cell[at]
    return out


@F.pandas_udf(T.LongType())
def slot_draw(number: pd.Series, slot: pd.Series) -> pd.Series:
    """32-bit draw of a slot in a replicate, for tables of (replicate, slot) rows."""
    return pd.Series(mixed(number.to_numpy(), slot.to_numpy()).astype(np.int64))


def position(n: Column, number: Column, slot: Column) -> Column:
    """Position in [0, n) that a slot draws in the replicate with this number."""
    return F.shiftright(slot_draw(number, slot) * n, 32)
