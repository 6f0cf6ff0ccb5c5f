"""Gamma functions as Columns, for positive arguments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments are moved up so far before the series in their inverse is used.
SHIFT = 8


def lgamma(x: Column) -> Column:
    """ln(gamma(x)) by Stirling's series at x + SHIFT, to 1e-11 at least."""
    z = x + SHIFT
    w = 1.0 / (z * z)
    series = ((((w * (1 / 1188) - 1 / 1680) * w + 1 / 1260) * w - 1 / 360) * w + 1 / 12) / z
    low = x
    for k in range(1, SHIFT):
        low = low * (x + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(low)


def digamma(x: Column) -> Column:
    """The derivative of lgamma."""
    z = x + SHIFT
    w = 1.0 / (z * z)
    out = F.ln(z) - 0.5 / z - ((((w * (1 / 132) - 1 / 240) * w + 1 / 252) * w - 1 / 120) * w + 1 / 12) * w
    for k in range(SHIFT):
        out = out - 1.0 / (x + k)
    return out


def trigamma(x: Column) -> Column:
    """The derivative of digamma."""
    z = x + SHIFT
    w = 1.0 / (z * z)
    out = 1.0 / z + 0.5 * w + ((((w * (5 / 66) - 1 / 30) * w + 1 / 42) * w - 1 / 30) * w + 1 / 6) * w / z
    for k in range(SHIFT):
        out = out + 1.0 / ((x + k) * (x + k))
    return out
