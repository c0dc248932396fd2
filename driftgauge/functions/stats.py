"""Statistical column functions. All are built from Spark's own functions, so they stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def logistic(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def softplus(eta: Column) -> Column:
    """ln(1 + exp(eta)) without overflow."""
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))


def log_loss(eta: Column, y: Column) -> Column:
    return softplus(eta) - y * eta


#: Cody's rational approximations (Mathematics of Computation 23, 1969), highest power first: erf(x) / x in x^2 up to 0.46875, exp(x^2) erfc(x) in x up to 4, and its rest in 1 / x^2 beyond.
_NEAR = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413102554473e-2, 2.33520497626869185e-3)


def _ratio(x: Column, of: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    above, below = (reduce(lambda c, a: c * x + a, t[1:], F.lit(t[0])) for t in of)
    return above / below


def erfc(x: Column) -> Column:
    """For x >= 0, to about 12 significant digits also where it is tiny: a quotient of two polynomials, by the size of x.

    ``x`` comes some forty times in it, so it should be a column that is worked out before.
    """
    far = (1 / math.sqrt(math.pi) - _ratio(1 / (x * x), _FAR) / (x * x)) / x
    return F.when(x <= 0.46875, 1 - x * _ratio(x * x, _NEAR)).otherwise(F.exp(-x * x) * F.when(x <= 4, _ratio(x, _MIDDLE)).otherwise(far))


def erfc_sql(x: str) -> str:
    """DuckDB text that works erfc out another way: Simpson's rule on exp(-x^2) times the integral of exp(-2 x s - s^2) over s."""
    return f"(2 / sqrt(pi()) * exp(-({x}) * ({x})) * 0.005::DOUBLE / 3 * list_sum(list_transform(range(0, 1601), lambda i: CASE WHEN i IN (0, 1600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-2 * ({x}) * i * 0.005::DOUBLE - i * i * 0.000025::DOUBLE))))"


def tail_p(x: Column) -> Column:
    """Two-sided p of |z| / sqrt(2), a column that is worked out before; null and NaN give 1."""
    p = F.coalesce(F.nanvl(erfc(x), F.lit(1.0)), F.lit(1.0))
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def two_sided_p(z: Column) -> Column:
    """Of a standard normal statistic; null and NaN give 1. Any expression may be given, as a lambda's variable keeps it from being worked out often; ``tail_p`` of a column is some twenty times as fast."""
    return F.element_at(F.transform(F.array(F.abs(z) / F.sqrt(F.lit(2.0))), tail_p), 1)


def wald_z(estimate: Column, se: Column) -> Column:
    """estimate / se, 0 where the error is 0."""
    return F.when(se > 0, estimate / se).otherwise(F.lit(0.0))


def needed(share: float, n: Column) -> Column:
    """How many of n a share demands, with a tolerance for its rounding."""
    return F.ceil(F.lit(share) * n - 1e-9)


def minimax_floor(tau: float) -> float:
    """No estimator of a gap has a smaller worst expected error than the drift allowed."""
    if tau < 0:
        raise ValueError("tau is negative")
    return float(tau)
