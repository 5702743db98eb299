"""Whole-number helpers of layouts and plans."""

from __future__ import annotations


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def padded(dim: int, to: int = 64) -> int:
    """dim rounded up to a multiple."""
    return ceil_div(dim, to) * to


def floor_log2(x: int) -> int:
    if x < 1:
        raise ValueError("the logarithm of a number below 1")
    return x.bit_length() - 1


def ceil_log2(x: int) -> int:
    if x < 1:
        raise ValueError("the logarithm of a number below 1")
    return (x - 1).bit_length()


def is_power_of_2(x: int) -> bool:
    return x > 0 and x & (x - 1) == 0
