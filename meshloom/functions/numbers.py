"""Pseudo-random and low-discrepancy numbers as column expressions (MA20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 4294967296


def _low(x: Column) -> Column:
    """The low 32 bits of a non-negative long."""
    return x.bitwiseAND(F.lit(_WORD - 1))


def halton(index: Column, base: int) -> Column:
    """The radical inverse of a positive index: its digits in base mirrored at the point."""
    digits = range(40)
    total = F.lit(0.0)
    for k in digits:
        if base**k > 2**62:
            break
        total = total + F.pmod(F.floor(index / F.lit(base**k)) if k == 0 else (index - F.pmod(index, F.lit(base**k))) / F.lit(base**k), F.lit(base)) / F.lit(float(base) ** (k + 1))
    return total


def xorshift(x: Column) -> Column:
    """One step of the 32-bit xor-shift generator with shifts 13, 17 and 5."""
    x = x.bitwiseXOR(_low(F.shiftleft(x, 13)))
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(_low(F.shiftleft(x, 5)))


def kiss(z: Column, w: Column, y: Column, c: Column) -> Column:
    """One step of the generator that combines two multiply-with-carry words, a congruential and a shift generator."""
    z = _low(36969 * z.bitwiseAND(F.lit(65535)) + F.shiftright(z, 16))
    w = _low(18000 * w.bitwiseAND(F.lit(65535)) + F.shiftright(w, 16))
    c = _low(69069 * c + 1234567)
    y = y.bitwiseXOR(_low(F.shiftleft(y, 17)))
    y = y.bitwiseXOR(F.shiftright(y, 13))
    y = y.bitwiseXOR(_low(F.shiftleft(y, 5)))
    mixed = _low(_low(F.shiftleft(z, 16)) + w)
    return _low(mixed.bitwiseXOR(c) + y)
