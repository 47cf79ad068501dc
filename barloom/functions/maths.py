"""Numeric functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, to 7.5e-8: Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def round_to(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def finite(x: Column) -> Column:
    """Undefined numbers as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bandwidth(n: Column) -> Column:
    """Newey-West: 4 (n / 100)^(2/9), from 1 to 10."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100, F.lit(2 / 9))))).cast("int")


def p_label(p: Column, draws: int) -> Column:
    """A redrawn p value, never under one in so many draws."""
    return F.when(p < 1 / draws, F.lit(f"<{1 / draws:g}")).otherwise(F.format_string("%.3f", p))


def coin_flips(n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Between what hit rates ``n`` decisions by the toss of a coin lie, by the normal approximation."""
    half = z * F.sqrt(F.lit(0.25) / F.when(n > 0, n))
    return F.greatest(F.lit(0.0), 0.5 - half), F.least(F.lit(1.0), 0.5 + half)


def significant(t: Column) -> Column:
    return F.abs(t) >= 2
