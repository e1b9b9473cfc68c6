"""Bits of doubles and integers. Views of a double's bits are calls of the JVM's own methods; no row goes to Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matrixloom.model import column


def raw_bits(v: str | Column) -> Column:
    """The 64 bits of a double, as a long; null of null."""
    d = column(v).cast("double")
    return F.when(d.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), d).cast("long"))


def from_bits(v: str | Column) -> Column:
    """The double with these bits; its shortest decimal names it, so the cast is exact."""
    x = column(v).cast("long")
    return F.when(x.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), x).cast("double"))


def sign(bits: Column) -> Column:
    return F.shiftrightunsigned(bits, 63)


def exponent_bits(bits: Column) -> Column:
    return F.shiftrightunsigned(bits, 52).bitwiseAND(2047)


def exponent(bits: Column) -> Column:
    """Unbiased; 0 for zero."""
    return F.when(bits.bitwiseAND(2**63 - 1) == 0, F.lit(0).cast("long")).otherwise(exponent_bits(bits) - 1023)


def fraction(bits: Column) -> Column:
    return bits.bitwiseAND(2**52 - 1)


def upper12(bits: Column) -> Column:
    return F.shiftrightunsigned(bits, 52)


def trailing_zeros(bits: Column) -> Column:
    """64 for no bit set: x & -x leaves the lowest one, and one less has as many ones as zeros were below."""
    low = bits.bitwiseAND(F.negate(F.when(bits == -(2**63), F.lit(0).cast("long")).otherwise(bits)))
    return F.when(bits == 0, 64).when(bits == -(2**63), 63).otherwise(F.bit_count(low - 1)).cast("long")


def leading_zeros(bits: Column) -> Column:
    return F.when(bits < 0, 0).when(bits == 0, 64).otherwise(64 - F.length(F.bin(bits))).cast("long")


def surrounding_zeros(bits: Column) -> Column:
    return F.when(bits == 0, F.lit(64).cast("long")).otherwise(leading_zeros(bits) + trailing_zeros(bits))


def wrapped_difference(a: Column, b: Column) -> Column:
    """a - b modulo 2^64, by halves, so that it never overflows."""
    low = a.bitwiseAND(2**32 - 1) - b.bitwiseAND(2**32 - 1)
    high = F.shiftrightunsigned(a, 32) - F.shiftrightunsigned(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(2**32 - 1))


def bit_length(x: Column) -> Column:
    """Bits that a whole number needs; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def bits_to_bytes(bits: Column) -> Column:
    return F.ceil(bits / 8)


def extract_range(x: Column, first: int, size: int) -> Column:
    return F.shiftrightunsigned(x, first).bitwiseAND((1 << size) - 1)


def set_low(x: Column, n: int) -> Column:
    return x.bitwiseOR((1 << n) - 1)


def unset_low(x: Column, n: int) -> Column:
    return x.bitwiseAND(~((1 << n) - 1))


def set_high(x: Column, n: int) -> Column:
    """The n highest of 64 bits set."""
    return x.bitwiseOR(-1 << (64 - n) if n else 0)


def unset_high(x: Column, n: int) -> Column:
    return x.bitwiseAND((1 << (64 - n)) - 1 if n else -1)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rotate_left(x: Column, n: int) -> Column:
    n %= 64
    return x if not n else F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def rotate_right(x: Column, n: int) -> Column:
    return rotate_left(x, -n)


def log2_or_zero(v: Column) -> Column:
    return F.when(v == 0, F.lit(0.0)).otherwise(F.log2(v))
