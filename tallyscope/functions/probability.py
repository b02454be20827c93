"""Probability values for the tests, as Column expressions.

Normal quantiles: Wichura (1988), algorithm AS 241. Error function: Cody (1969). Skewness
and kurtosis tests: D'Agostino (1970), Anscombe and Glynn (1983). Student's t: Abramowitz
and Stegun 26.7, Hill (1970).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of AS 241 (PPND16), lowest power first.
CENTRE_TOP = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_BOTTOM = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
TAIL_TOP = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
TAIL_BOTTOM = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)

# Cody's rational approximations of erf and erfc, lowest power first.
NEAR_TOP = (
    3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02,
    3.16112374387056560e00, 1.85777706184603153e-1,
)
NEAR_BOTTOM = (
    2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02,
    2.36012909523441209e01, 1.0,
)
MIDDLE_TOP = (
    1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03,
    8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01,
    8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8,
)
MIDDLE_BOTTOM = (
    1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03,
    3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02,
    1.17693950891312499e02, 1.57449261107098347e01, 1.0,
)
FAR_TOP = (
    6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1,
    3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2,
)
FAR_BOTTOM = (
    2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
    1.87295284992346725e00, 2.56852019228982242e00, 1.0,
)


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it in ``body`` as ``name``.

    A sub-expression used twice is written out twice in a plan, so nested formulas would
    grow exponentially; a lambda variable is not written out.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def polynomial(coefficients: Sequence[float], x: str) -> str:
    """SQL of a polynomial in Horner form; coefficients lowest power first."""
    return reduce(lambda total, c: f"({total} * {x} + ({c!r}D))", reversed(coefficients), "0D")


def ratio(top: Sequence[float], bottom: Sequence[float], x: str) -> str:
    return f"{polynomial(top, x)} / {polynomial(bottom, x)}"


# The functions below take and return SQL text over columns of double type.


def normal_quantile_sql(p: str) -> str:
    """Inverse of the standard normal distribution for 1e-11 < p < 1 - 1e-11."""
    centre = let("r", "0.180625D - q * q", ratio(CENTRE_TOP, CENTRE_BOTTOM, "r"))
    tail = let("s", "sqrt(-ln(0.5D - abs(q))) - 1.6D", ratio(TAIL_TOP, TAIL_BOTTOM, "s"))
    return let(
        "q", f"{p} - 0.5D", f"IF(abs(q) <= 0.425D, q * {centre}, signum(q) * {tail})"
    )


def dagostino_sql(n: str, skew: str, kurtosis: str) -> str:
    """D'Agostino-Pearson K2 probability from n, population skewness and excess kurtosis."""
    beta = (
        "3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)"
        " / ((n - 2) * (n + 5) * (n + 7) * (n + 9))"
    )
    y = f"{skew} * sqrt((n + 1) * (n + 3) / (6 * (n - 2)))"
    z1 = let(
        "w", f"sqrt(2 * ({beta} - 1)) - 1", f"asinh({y} / sqrt(2 / (w - 1))) / sqrt(0.5D * ln(w))"
    )
    mean = "3 * (n - 1) / (n + 1)"
    variance = "24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))"
    x = f"({kurtosis} + 3 - {mean}) / sqrt({variance})"
    root = "sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))"
    s = f"6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * {root}"
    a = let("s", s, "6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s)))")
    cube = let(
        "d", f"1 + {x} * sqrt(2 / (a - 4))", "signum(d) * cbrt(try_divide(1 - 2 / a, abs(d)))"
    )
    z2 = let("a", a, f"(1 - 2 / (9 * a) - {cube}) / sqrt(2 / (9 * a))")
    return let("n", f"CAST({n} AS DOUBLE)", let("z", z1, f"exp(-(z * z + pow({z2}, 2D)) / 2)"))


def upper_tail_sql(z: str) -> str:
    """P(Z > z) for a standard normal Z, through the complementary error function."""
    near = "1 - x * " + let("s", "x * x", ratio(NEAR_TOP, NEAR_BOTTOM, "s"))
    middle = f"{ratio(MIDDLE_TOP, MIDDLE_BOTTOM, 'x')} * exp(-x * x)"
    rest = let("y", "1 / (x * x)", f"y * {ratio(FAR_TOP, FAR_BOTTOM, 'y')}")
    far = f"({1 / math.sqrt(math.pi)!r}D - {rest}) / x * exp(-x * x)"
    erfc = f"CASE WHEN x <= 0.46875D THEN {near} WHEN x <= 4 THEN {middle} ELSE {far} END"
    half = let("x", f"abs(v) / {math.sqrt(2)!r}D", f"0.5D * {erfc}")
    return let("v", z, let("u", half, "IF(v >= 0, u, 1 - u)"))


# Above this many degrees of freedom Hill's expansion is good to about 1e-11.
EXACT_DEGREES = 40


def t_two_sided_sql(t: str, degrees: str) -> str:
    """P(|T| > |t|) for Student's t with a whole number of degrees of freedom.

    Few degrees: the finite sums of Abramowitz and Stegun 26.7.3-4. More: Hill (1970),
    algorithm 395, which turns t into a normal deviate.
    """
    term = (
        "acc.term * IF(k % 2 = 1, 2D * j / (2D * j + 1), (2D * j - 1) / (2D * j))"
        " * cos(angle) * cos(angle)"
    )
    total = (
        "aggregate(filter(sequence(0, greatest(CAST(floor((k - IF(k % 2 = 1, 3, 2)) / 2) AS INT)"
        ", 0)), j -> j > 0), named_struct('term', 1D, 'sum', 1D), (acc, j) -> "
        + let("e", term, "named_struct('term', e, 'sum', acc.sum + e)")
        + ", acc -> acc.sum)"
    )
    inside = (
        f"CASE WHEN k = 1 THEN angle * {2 / math.pi!r}D"
        f" WHEN k % 2 = 1 THEN {2 / math.pi!r}D * (angle + sin(angle) * cos(angle) * {total})"
        f" ELSE sin(angle) * {total} END"
    )
    few = let("a", let("angle", "atan(t / sqrt(k))", inside), "IF(a > 1, 0D, 1 - a)")
    top = "((-0.4D * y - 3.3D) * y - 24.0D) * y - 85.5D"
    deviate = let(
        "b",
        "48 * (k - 0.5D) * (k - 0.5D)",
        let(
            "y",
            "(k - 0.5D) * log1p(t * t / k)",
            f"((({top}) / (0.8D * y * y + 100 + b) + y + 3) / b + 1) * sqrt(y)",
        ),
    )
    many = f"2 * {upper_tail_sql(deviate)}"
    body = (
        f"CASE WHEN t = double('inf') THEN 0D WHEN k <= {EXACT_DEGREES} THEN {few} ELSE {many} END"
    )
    return let("t", f"abs({t})", let("k", f"CAST({degrees} AS DOUBLE)", body))


# The same as Columns, for columns given by name.


def normal_quantile(p: str) -> Column:
    return F.expr(normal_quantile_sql(p))


def normal_upper_tail(z: str) -> Column:
    return F.expr(upper_tail_sql(z))


def t_two_sided(t: str, degrees: str) -> Column:
    return F.expr(t_two_sided_sql(t, degrees))


def dagostino_p(n: str, skew: str, kurtosis: str) -> Column:
    return F.expr(dagostino_sql(n, skew, kurtosis))
