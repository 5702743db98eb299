"""Vector arithmetic as Column expressions: all on the JVM, all in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def total(v: Column) -> Column:
    """Sum of the coordinates."""
    return _sum(doubles(v))


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of unequal length give null."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def squared_norm(v: Column) -> Column:
    return dot(v, v)


def ip_distance(a: Column, b: Column) -> Column:
    """1 - <a, b>."""
    return F.lit(1.0) - dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b)))


#: Distances by metric name; the search operators take any function of two columns besides.
METRICS = {"l2": squared_l2, "ip": ip_distance, "innerproduct": ip_distance, "cosine": cosine_distance}


def rescale(v: Column, factor) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(doubles(v), lambda x: x * f)


def residual(v: Column, c: Column) -> Column:
    return F.zip_with(doubles(v), doubles(c), lambda x, y: x - y)


def normalized_residual(v: Column, c: Column, least: float = 1e-5) -> Column:
    """(v - c) / |v - c|; every coordinate 1 / sqrt(dim) where the distance is at most least."""
    r, d = residual(v, c), F.sqrt(squared_l2(v, c))
    flat = F.lit(1.0) / F.sqrt(F.size(v).cast("double"))
    return F.transform(r, lambda x: F.when(d > least, F.try_divide(x, d)).otherwise(flat))


def value_range(v: Column) -> Column:
    return F.struct(F.array_min(doubles(v)).alias("lo"), F.array_max(doubles(v)).alias("hi"))


def uniform_codes(v: Column, lo: Column, delta: Column, half_even: bool = False) -> Column:
    """round((x - lo) / delta) of each coordinate; half away from zero, or half to even."""
    f = F.rint if half_even else F.round
    return F.transform(doubles(v), lambda x: f(F.try_divide(x - lo, delta)).cast("int"))


def sign_bits(v: Column, zero_is_one: bool = False) -> Column:
    """1 where a coordinate is above zero (or at least zero)."""
    return F.transform(doubles(v), lambda x: ((x >= 0) if zero_is_one else (x > 0)).cast("int"))


def pack_bits(bits: Column, width: int = 32) -> Column:
    """Words of so many bits, most significant first, as longs; the last word is filled up with zeros."""
    starts = F.sequence(F.lit(1), F.size(bits), F.lit(width))
    return F.transform(starts, lambda s: _word(F.slice(bits, s, width), width))


def _word(part: Column, width: int) -> Column:
    value = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a * 2 + x.cast("long"))
    return F.call_function("shiftleft", value, F.lit(width) - F.size(part))


def unpack_bits(words: Column, width: int = 32) -> Column:
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(width - 1), F.lit(0)), lambda i: F.call_function("shiftright", w, i).bitwiseAND(F.lit(1)).cast("int"))))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def common_bits(a: Column, b: Column) -> Column:
    """Bits set in both of two lists of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def masked_sum(bits: Column, q: Column) -> Column:
    """Sum of q where a bit is set."""
    return dot(bits, q)


def bit_planes(codes: Column, planes: int) -> Column:
    """Of unsigned codes, for each bit from the lowest up, the packed words of that bit."""

    def plane(j: int) -> Column:
        return pack_bits(F.transform(codes, lambda c: F.call_function("shiftright", c, F.lit(j)).bitwiseAND(F.lit(1))))

    each = [plane(j) for j in range(planes)]
    return F.array(*each)


def plane_dot(words: Column, planes: Column, delta: Column, vl: Column) -> Column:
    """<bits, delta * codes + vl> from packed bits and bit planes of the codes."""
    weighted = F.aggregate(F.transform(planes, lambda p, j: F.call_function("shiftleft", F.lit(1).cast("long"), j) * common_bits(words, p)), F.lit(0).cast("long"), lambda s, x: s + x)
    return delta * weighted + vl * popcount(words)


def reversed_bits(word: Column, width: int = 32) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), lambda a, i: a * 2 + F.call_function("shiftright", word, i).bitwiseAND(F.lit(1)))


def hashed_int(lo: int, hi: int, seed: int, *keys: Column) -> Column:
    """A whole number in lo..hi that depends only on seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(hi - lo + 1)) + F.lit(lo)


def drawn_level(u: Column, m: int) -> Column:
    """floor(-ln(u) / ln(m)) for u in (0, 1]."""
    import math

    return F.floor(-F.log(u) / F.lit(math.log(m))).cast("int")


def checksum(v: Column) -> Column:
    """sum of (place * coordinate), places from 1: one number that tells vectors apart in comparisons."""
    return F.aggregate(F.transform(doubles(v), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
