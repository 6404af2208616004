"""Scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(text: Column) -> Column:
    """sha256 of a text modulo 2 ** 31."""
    return F.conv(F.substring(F.sha2(text, 256), 57, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def softplus(x: Column) -> Column:
    """log(1 + e^x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def cosine_rate(step: Column, total: int, peak: float, floor: float = 0.01) -> Column:
    """Cosine decay from ``peak`` to ``floor`` of it, flat afterwards."""
    share = F.least(step / total, F.lit(1.0))
    return peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(share * math.pi)))


def ramp(step: Column, start: float, end: float, total: int) -> Column:
    return F.lit(start) + (end - start) * F.least(F.greatest(step / total, F.lit(0.0)), F.lit(1.0))


def angle_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.least(F.abs(cosine), F.lit(1.0))))
