"""Student's t distribution as column expressions: two-sided p value and its inverse, for any freedom from 1 up.

The p value is the regularised incomplete beta function I_x(df / 2, 1 / 2) at x = df / (df + t^2).  Its continued
fraction is run through ``aggregate`` by Lentz's method, on whichever side converges fast: 50 steps are enough for any
freedom, fewer for a small one.  The inverse starts from an expansion in 1 / df and takes
Newton steps on the logarithms of t and p, where the tail is nearly a straight line, each with its own fraction.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
SHIFT = 12  # arguments from here on have a precise asymptotic series


def _log_gamma_step(z: Column) -> Column:
    """ln(Gamma(z + 1/2) / Gamma(z)) for z > 0: moved up by whole steps, then the series in 1 / z."""
    far = z + SHIFT
    # The series of ln(Gamma(z + 1/2) / Gamma(z)) - ln(z) / 2 in odd powers of 1 / z.
    series = -1 / (8 * far) + 1 / (192 * F.pow(far, 3)) - 1 / (640 * F.pow(far, 5)) + 17 / (14336 * F.pow(far, 7))
    moved = sum((F.log(z + i) - F.log(z + i + 0.5) for i in range(SHIFT)), F.lit(0.0))
    return moved + F.log(far) / 2 + series


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def step(state: Column, m: Column) -> Column:
        k = m.cast("double")
        even = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        one = F.struct(safe(1 + even / state["c"]).alias("c"), (1 / safe(1 + even * state["d"])).alias("d"), state["h"].alias("h"))
        two = lambda s: F.struct(safe(1 + odd / s["c"]).alias("c"), (1 / safe(1 + odd * s["d"])).alias("d"), s["h"].alias("h"))
        times = lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h"))
        # A one-element transform binds a value once, which a plain nesting would compute again at every use.
        bound = lambda s, f: F.element_at(F.transform(F.array(s), f), 1)
        return bound(bound(bound(one, times), two), times)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])


def _log_p(t: Column, df: Column) -> Column:
    """ln of the two-sided p value for t > 0, df >= 1."""
    a, b, square = df / 2, F.lit(0.5), t * t
    x, y = df / (df + square), square / (df + square)
    front = _log_gamma_step(a) - math.log(math.pi) / 2 - a * F.log1p(square / df) + F.log(y) / 2
    steps = F.least(F.lit(60), 10 + 3 * F.ceil(F.sqrt(df))).cast("int")
    near = (a + 1) / (a + b + 2)
    tail = front + F.log(_fraction(a, b, x, steps)) - F.log(a)
    middle = F.log1p(-F.exp(front + F.log(_fraction(b, a, y, steps)) - F.log(b)))
    return F.when(x < near, tail).otherwise(middle)


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p value of ``t``; null for a null, NaN for a NaN, and null for a freedom below 1."""
    size, df = F.abs(t.cast("double")), df.cast("double")
    p = F.when(F.isnan(size), size).when(size == 0, 1.0).when(size == float("inf"), 0.0).otherwise(F.exp(_log_p(size, df)))
    return F.when(t.isNotNull() & (df >= 1), p)


def t_quantile(df: Column, level: float = 0.95) -> Column:
    """The t whose two-sided interval holds ``level``; null for a freedom below 1."""
    if not 0 < level < 1:
        raise ValueError(f"level must lie between 0 and 1: {level}")
    df, alpha = df.cast("double"), 1 - level
    a = df / 2
    # ln of the density without its power: Gamma(a + 1/2) / (Gamma(a) sqrt(pi df)).
    front = _log_gamma_step(a) - F.log(df * math.pi) / 2

    def newton(u: Column, _: Column) -> Column:
        t = F.exp(u)
        log_density = front - (a + 0.5) * F.log1p(t * t / df)
        log_p = _log_p(t, df)
        # d ln p / d ln t = -2 t f(t) / p
        return u + (log_p - math.log(alpha)) * F.exp(log_p - log_density - u) / 2

    z = NormalDist().inv_cdf(0.5 + level / 2)
    # The first terms of the expansion of t - z in 1 / df; it is of use from a few degrees of freedom on.
    near = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    few = df < 6
    steps = F.sequence(F.lit(1), F.when(few, 12).otherwise(4))
    return F.when(df >= 1, F.exp(F.aggregate(steps, F.log(F.when(few, F.lit(z)).otherwise(near)), newton)))
