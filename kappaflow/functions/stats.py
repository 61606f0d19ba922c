"""Special functions as plain column expressions.

Spark has neither erf nor lgamma; both are written here as closed-form
column expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: coefficients of the complementary error function
# approximation "erfcc" (Numerical Recipes, Chebyshev fit), fractional
# error below 1.2e-7 everywhere.
ERFCC_COEF = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]

# FIXED VALUES: Lanczos approximation, g = 7, nine coefficients (public
# constants used by many numeric libraries); relative error ~1e-15.
LANCZOS_G = 7
LANCZOS_COEF = [0.99999999999980993, 676.5203681218851, -1259.1392167224028,
                771.32342877765313, -176.61502916214059, 12.507343278686905,
                -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def _poly_horner(t: Column, coef: list[float]) -> Column:
    acc = F.lit(coef[-1])
    for c in reversed(coef[:-1]):
        acc = F.lit(c) + t * acc
    return acc


def erfc(x: Column) -> Column:
    """Complementary error function of a DOUBLE column."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    ans = t * F.exp(-z * z + _poly_horner(t, ERFCC_COEF))
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def erfc_sql(x: str) -> str:
    """Same polynomial as SQL text (used by oracles)."""
    z = f"abs({x})"
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    acc = repr(ERFCC_COEF[-1])
    for c in reversed(ERFCC_COEF[:-1]):
        acc = f"({c!r} + {t} * {acc})"
    ans = f"({t} * exp(-{z} * {z} + {acc}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def ln_gamma(x: Column) -> Column:
    """log Gamma(x) for x >= 0.5 (all uses here are x = n + 1 >= 1)."""
    xm1 = x - F.lit(1.0)
    a = F.lit(LANCZOS_COEF[0])
    for i, c in enumerate(LANCZOS_COEF[1:], start=1):
        a = a + F.lit(c) / (xm1 + F.lit(float(i)))
    t = xm1 + F.lit(LANCZOS_G + 0.5)
    return (F.lit(0.5 * math.log(2 * math.pi)) + (xm1 + F.lit(0.5)) * F.log(t) - t + F.log(a))


def ln_choose(n: Column, k: Column) -> Column:
    """log C(n, k) for integer columns 0 <= k <= n."""
    nd, kd = n.cast("double"), k.cast("double")
    return ln_gamma(nd + 1.0) - ln_gamma(kd + 1.0) - ln_gamma(nd - kd + 1.0)
