"""Normal scores: the standard normal quantile and closed forms for sums of expected order statistics.

The score of rank i among n is m(i) = quantile((i - 3/8) / (n + 1/4)). Sums of scores over
a run of tied ranks are needed for the Shapiro-Wilk statistic. Instead of expanding a tied
run into its rows, `with_cumulative_scores` gives sum(m(1..r)) in constant time: the first TAIL
ranks are added up directly and the rest uses the midpoint Euler-Maclaurin formula, whose
remaining error beyond rank 32 is below 1e-10.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from statistics import NormalDist

from pyspark.sql import DataFrame

TAIL = 32

# Coefficients of the rational approximation by Wichura (1988), algorithm AS 241,
# lowest power first. Central range |p - 1/2| <= 0.425, middle tail r <= 5, far tail r > 5
# with r = sqrt(-ln(min(p, 1 - p))).
CENTRAL_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRAL_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
MIDDLE_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
MIDDLE_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
FAR_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
FAR_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)
# Polynomial weights of Royston (1995), algorithm AS R94, in u = n^(-1/2), powers 1 to 5.
LAST_WEIGHT = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)

_ROOT_TWO_PI = math.sqrt(2.0 * math.pi)
_NORMAL = NormalDist()


def _horner(coefficients, x: str) -> str:
    out = f"{coefficients[-1]!r}D"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}D)"
    return out


def score(i: int, n: int) -> float:
    """m(i) for one rank."""
    return _NORMAL.inv_cdf((i - 0.375) / (n + 0.25))


def _boundary(z: float, big_n: float) -> float:
    """Midpoint Euler-Maclaurin boundary term of the score sum at quantile z."""
    d = math.exp(-z * z / 2) / _ROOT_TWO_PI * big_n
    return -d - 1 / (24 * d) + 7 * (1 + 2 * z * z) / (5760 * d**3)


def score_constants(n: int) -> dict:
    """What the statistic needs to know about n alone; constant work for any n.

    `tail` holds sum(m(1..r)) for r = 0..TAIL, `offset` joins the tail to the closed form,
    and the final statistic is
    (inv_root * (sum m x - last * (x_n - x_1) - next * (x_{n-1} - x_2))
     + a_last * (x_n - x_1) + a_next * (x_{n-1} - x_2))^2 / sum (x - mean)^2.
    """
    big_n = n + 0.25
    half = n // 2
    direct = [score(i, n) for i in range(1, min(TAIL, half) + 1)]
    tail = [0.0]
    for m in direct:
        tail.append(tail[-1] + m)
    tail += [tail[-1]] * (TAIL + 1 - len(tail))

    squares = 2.0 * math.fsum(m * m for m in direct)
    if half > TAIL:
        squares += _square_sum(n, TAIL)
        offset = tail[TAIL] - _boundary(_NORMAL.inv_cdf((TAIL + 0.125) / big_n), big_n)
    else:
        offset = 0.0

    out = {"n": n, "tail": tail, "offset": offset}
    m_last, m_next = -score(1, n), (-score(2, n) if n > 3 else 0.0)
    if n == 3:
        return out | {"inv_root": 0.0, "m_last": 0.0, "m_next": 0.0, "a_last": math.sqrt(0.5), "a_next": 0.0}
    u = n ** -0.5
    a_last = m_last / math.sqrt(squares) + sum(c * u ** (k + 1) for k, c in enumerate(LAST_WEIGHT))
    if n <= 5:
        phi = (squares - 2 * m_last**2) / (1 - 2 * a_last**2)
        return out | {"inv_root": phi**-0.5, "m_last": m_last, "m_next": 0.0, "a_last": a_last, "a_next": 0.0}
    a_next = m_next / math.sqrt(squares) + sum(c * u ** (k + 1) for k, c in enumerate(NEXT_WEIGHT))
    phi = (squares - 2 * m_last**2 - 2 * m_next**2) / (1 - 2 * a_last**2 - 2 * a_next**2)
    return out | {
        "inv_root": phi**-0.5, "m_last": m_last, "m_next": m_next, "a_last": a_last, "a_next": a_next,
    }


def _square_sum(n: int, skip: int) -> float:
    """Sum of m(i)^2 over the ranks more than `skip` away from both ends, by Euler-Maclaurin."""
    big_n = n + 0.25

    def boundary(z: float) -> float:
        density = math.exp(-z * z / 2) / _ROOT_TWO_PI
        d = density * big_n
        f1, f2, f3 = 1 / d, z / d**2, (1 + 2 * z * z) / d**3
        first = 2 * z * f1
        third = 2 * (z * f3 + 3 * f1 * f2)
        return big_n * (_NORMAL.cdf(z) - z * density) - first / 24 + 7 * third / 5760

    low = _NORMAL.inv_cdf((skip + 0.125) / big_n)
    return boundary(-low) - boundary(low)


def with_cumulative_scores(df: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """Append sum(m(1..rank)) per output name -> rank column, given columns n, tail and offset.

    Scores are antisymmetric, so the sum depends only on the distance q of the rank from the nearer
    end: ranks inside the tail read the table, the others the closed form at the quantile z.

    Each step is a projection of its own and declared free of nulls. Written inline, the argument of
    the polynomials would be repeated in every Horner step, and with null checks in each of them the
    generated method would outgrow the size the JVM compiles to machine code.
    """
    steps = (
        ("q", "least({rank}, n - {rank})"),
        ("p", "coalesce(least(({q} + 0.125D) / (n + 0.25D), 0.5D), 0.5D)"),
        ("t", "coalesce(sqrt(-ln({p})), 0D)"),
        (
            "s",
            "CASE WHEN {p} >= 0.075D THEN 0.180625D - ({p} - 0.5D) * ({p} - 0.5D) "
            "WHEN {t} <= 5D THEN {t} - 1.6D ELSE {t} - 5D END",
        ),
        (
            "z",
            f"CASE WHEN {{p}} >= 0.075D THEN ({{p}} - 0.5D) * {_horner(CENTRAL_NUM, '{s}')} / {_horner(CENTRAL_DEN, '{s}')} "
            f"WHEN {{t}} <= 5D THEN -{_horner(MIDDLE_NUM, '{s}')} / {_horner(MIDDLE_DEN, '{s}')} "
            f"ELSE -{_horner(FAR_NUM, '{s}')} / {_horner(FAR_DEN, '{s}')} END",
        ),
        ("d", f"exp({{z}} * {{z}} * -0.5D) * ((n + 0.25D) / {_ROOT_TWO_PI!r}D)"),
        (
            "out",
            f"CASE WHEN {{q}} <= {TAIL}D THEN element_at(tail, cast(least({{q}}, {TAIL}D) as int) + 1) "
            "ELSE offset - {d} - 1D / (24D * {d}) + 7D * (1D + 2D * {z} * {z}) / (5760D * {d} * {d} * {d}) END",
        ),
    )
    kept = df.columns
    names = {out: {"rank": rank, "out": out} | {k: f"{out}_{k}" for k in "qptszd"} for out, rank in ranks.items()}
    for step, text in steps:
        df = df.selectExpr("*", *[f"{text.format(**n)} AS {n[step]}" for n in names.values()])
    return df.select(*kept, *ranks)
