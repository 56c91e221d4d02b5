"""Special functions as expressions: the log of the gamma function, and tails of Student's t by the incomplete beta function."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def log_gamma(z: Column) -> Column:
    """Stirling's series at ``z + 8``, less the logarithms of the eight factors between; for ``z`` above 0."""
    w = z + 8.0
    inverse = 1.0 / (w * w)
    series = 1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse * (1 / 1188 - inverse * 691 / 360360))))
    factors = z
    for i in range(1, 8):
        factors = factors * (z + float(i))
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series / w - F.log(factors)


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function, two terms a step, folded from the front."""
    away = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)

    def term(j: Column) -> Column:
        m = F.floor((j + 1) / 2).cast("double")
        odd = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        even = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return F.when(j % 2 == 1, odd).otherwise(even)

    def step(s: Column, j: Column) -> Column:
        return _let(
            _let(term(j), lambda t: F.struct((1 / away(1 + t * s["d"])).alias("d"), away(1 + t / s["c"]).alias("c"))),
            lambda k: F.struct(k["c"].alias("c"), k["d"].alias("d"), (s["h"] * k["d"] * k["c"]).alias("h")),
        )

    first = 1 / away(1 - (a + b) * x / (a + 1))
    start = _let(first, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))
    return F.aggregate(F.sequence(F.lit(1), 2 * steps), start, step, lambda s: s["h"])


def rank_correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs by Student's t with ``n - 2`` degrees of freedom.

    That is the regularised incomplete beta function of ``1 - rho * rho`` at
    ``(n - 2) / 2`` and one half. Its fraction is taken on the side where it converges
    in a number of steps that grows with the root of ``n``. Null for a missing ``rho``
    or fewer than three pairs; 0 for a perfect order.
    """
    half = F.lit(0.5)

    def of(k: Column) -> Column:
        a, y = k["a"], k["y"]
        x = 1 - y
        steps = (F.lit(60) + F.ceil(3 * F.sqrt(a))).cast("int")
        front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5 * math.log(math.pi) + a * F.log1p(-y) + 0.5 * F.log(y))
        low = front * _fraction(a, half, x, steps) / a
        high = 1 - front * _fraction(half, a, y, steps) / half
        return F.when(x < (a + 1) / (a + 2.5), F.least(F.lit(1.0), low)).otherwise(F.greatest(F.lit(0.0), high))

    found = _let(F.struct((rho * rho).cast("double").alias("y"), ((n - 2) / 2.0).cast("double").alias("a")), of)
    return F.when((n < 3) | F.isnan(rho), None).when(F.abs(rho) >= 1, 0.0).when(rho == 0, 1.0).when(rho.isNotNull(), found)
