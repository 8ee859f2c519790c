"""The normal distribution: driver-side quantiles, density and distribution as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def inv_cdf(p: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    """Quantile; infinite at 0 and 1, NaN outside."""
    if not 0 <= p <= 1:
        return math.nan
    return NormalDist(mu, sigma).inv_cdf(p) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


def pdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - F.lit(mu)) / F.lit(sigma)
    return F.exp(-z * z / 2) / F.lit(sigma * math.sqrt(2 * math.pi))


#: Cody's rational approximations (1969) of erf below 0.46875, and of erfc up to 4 and beyond: numerators and denominators, highest power first.
SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
MIDDLE = (
    (
        2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
        1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
    ),
    (
        1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
        3.43936767414372164e3, 1.23033935480374942e3,
    ),
)
LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(parts: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    done = []
    for coefficients in parts:
        y = F.lit(coefficients[0])
        for c in coefficients[1:]:
            y = y * x + F.lit(c)
        done.append(y)
    return done[0] / done[1]


def cdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    """With a relative error under 1e-13; null, NaN and infinities give null, NaN, 0 and 1."""
    v = (x - F.lit(mu)) / F.lit(sigma * math.sqrt(2))
    y = F.abs(v)
    tail = F.exp(-y * y)
    far = tail * (F.lit(1 / math.sqrt(math.pi)) - _ratio(LARGE, 1 / (y * y)) / (y * y)) / y
    upper = F.when(y <= 4, tail * _ratio(MIDDLE, y)).when(y < 27, far).otherwise(0.0)  # erfc of y
    side = F.when(v < 0, upper / 2).otherwise(1 - upper / 2)
    return F.when(F.isnan(v), v).when(y <= 0.46875, F.lit(0.5) + v * _ratio(SMALL, v * v) / 2).when(v.isNotNull(), side)


def rand(seed: int | None = None, mu: float = 0.0, sigma: float = 1.0) -> Column:
    return F.randn(seed) * sigma + mu


def bounds(mu: float = 0.0, sigma: float = 1.0) -> tuple[float, float]:
    """Three standard deviations to either side."""
    return mu - 3 * sigma, mu + 3 * sigma
