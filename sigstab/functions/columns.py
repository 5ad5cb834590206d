"""Column expressions that Spark lacks: tails of distributions, correlation from sums, sample order by hash."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a published Chebyshev fit of the complementary error function (relative error under 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def two_sided_normal(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return t * F.exp(-x * x + poly)


#: Most degrees of freedom that are summed as a series, and by a continued fraction; above, the tail comes from the normal one.
SERIES, FRACTION = 60, 2000


def two_sided_t(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with a whole number of degrees of freedom.

    Up to SERIES degrees by the finite series of Abramowitz and Stegun 26.7.3-4, up to FRACTION by the continued fraction of
    the incomplete beta function, above by Hill's normal deviate (algorithm 395), whose error is far below that of the
    normal tail there; so the steps are bounded at any df.
    """
    small = _series(t, F.least(df, F.lit(SERIES)))
    return F.when(df > FRACTION, _hill(t, df.cast("double"))).when(df > SERIES, _beta(t, df.cast("double"))).otherwise(small)


def _let(value: Column, body) -> Column:
    """``body`` of the value, worked out once."""
    return F.transform(F.array(value), body)[0]


def _beta(t: Column, df: Column) -> Column:
    """The tail as I_x(df / 2, 1 / 2) at x = df / (df + t^2), for at least SERIES degrees of freedom.

    The beta function comes from the asymptotic series of Gamma(a + 1/2) / Gamma(a); the fraction is taken on the side
    where it converges fast.
    """

    def tail(v: Column) -> Column:
        a, x = v["a"], v["x"]
        ratio = F.sqrt(a) * (1 - 1 / (8 * a) + 1 / (128 * a * a) + 5 / (1024 * a**3) - 21 / (32768 * a**4) - 399 / (262144 * a**5))
        front = F.exp(a * F.log(x) + 0.5 * F.log1p(-x)) * ratio / F.sqrt(F.lit(math.pi))
        far = x < (a + 1) / (a + 2.5)
        near = lambda y: _fraction(y["a"], y["b"], y["x"], y["n"])
        side = lambda p, q, y: F.struct(p.alias("a"), q.alias("b"), y.alias("x"), v["n"].alias("n"))
        half = F.lit(0.5)
        return F.when(x >= 1, 1.0).when(far, front * _let(side(a, half, x), near) / a).otherwise(1 - front * _let(side(half, a, 1 - x), near) / 0.5)

    return _let(F.struct((df / 2).alias("a"), (df / (df + t * t)).alias("x"), (28 + F.sqrt(df)).cast("int").alias("n")), tail)


def _fraction(a: Column, b: Column, x: Column, n: Column) -> Column:
    """The continued fraction of the incomplete beta function, n terms from the front (Lentz)."""

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        term = F.when(k % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        def both(e: Column) -> Column:
            return _let(F.struct((1 / (1 + e * s["d"])).alias("d"), (1 + e / s["c"]).alias("c")), lambda y: F.struct(y["d"], y["c"], (s["h"] * y["d"] * y["c"]).alias("h")))

        return _let(term, both)

    one = F.lit(1.0)
    return 1 / F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(0.0).alias("d"), one.alias("c"), one.alias("h")), step)["h"]


#: Steps of the series and of the fraction of the normal tail, and where one gives way to the other.
STEPS, TURN = 60, 3.0


def _normal(z: Column) -> Column:
    """P(|Z| >= |z|) to the last digits of a double: below TURN by the series of erf, above by the fraction of erfc."""

    def tail(x: Column) -> Column:
        bell = F.exp(-x * x) / F.sqrt(F.lit(math.pi))

        def step(s: Column, k: Column) -> Column:
            return _let(s["term"] * 2 * x * x / (2 * k + 1), lambda term: F.struct(term.alias("term"), (s["sum"] + term).alias("sum")))

        erf = 2 * bell * F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(x.alias("term"), x.alias("sum")), step)["sum"]
        below = F.aggregate(F.sequence(F.lit(STEPS), F.lit(1)), x, lambda f, k: x + k / 2 / f)
        return F.when(x < TURN, 1 - erf).otherwise(bell / below)

    return _let(F.abs(z) / F.sqrt(F.lit(2.0)), tail)


def _hill(t: Column, df: Column) -> Column:
    a = df - 0.5
    b = 48 * a * a
    y = a * F.log1p(t * t / df)
    return _normal(((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b * F.sqrt(y) + F.sqrt(y))


def _series(t: Column, df: Column) -> Column:
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(angle), 2)
    odd = df % 2 == 1
    terms = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")
    first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    ratio = lambda k: F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * cos2 * ratio(k)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step)["sum"]
    inside = F.when(odd, 2 / F.lit(3.141592653589793) * (angle + F.when(df == 1, 0.0).otherwise(F.sin(angle) * total))).otherwise(F.sin(angle) * total)
    return F.greatest(F.lit(0.0), 1 - inside)


def clean(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def combinations_count(n: Column, k: int) -> Column:
    """Binomial coefficient n over k."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda a, i: a * (n - k + i) / i).cast("long")


def hash_order(*parts: Column) -> Column:
    """A text that sorts rows in a random order fixed by its parts; the same in any SQL engine."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
