"""The normal distribution function as a column, and quadrature nodes as array literals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A rational approximation of the normal distribution's tail, good to 1e-12.
UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
         440.413735824752)
#: From here on the tail is below 1e-12.
FAR = 7.07106781186547


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(x)
    tail = F.when(a < FAR, F.exp(-a * a / 2) * _horner(a, UPPER) / _horner(a, LOWER)).otherwise(0.0)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def nodes(x: np.ndarray, w: np.ndarray) -> Column:
    """Quadrature nodes and weights as an array of (x, w), one literal to Spark however many there are."""
    return F.expr("array(" + ", ".join(f"named_struct('x', {float(a)!r}D, 'w', {float(b)!r}D)" for a, b in zip(x, w)) + ")")


def legendre(n: int) -> Column:
    return nodes(*np.polynomial.legendre.leggauss(n))


def normal_grid(n: int, reach: float = 8.0) -> Column:
    """Nodes for means over a standard normal variable; the weights add up to one.

    Even nodes: on smooth functions that vanish at both ends the plain sum is as good as any rule, and
    it does not mind a steep step.
    """
    x = np.linspace(-reach, reach, n)
    w = np.exp(-x * x / 2)
    return nodes(x, w / w.sum())
