"""Labels and formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_or(c: Column, other: float | None) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(other).cast("double"))


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities in float columns become null."""
    fixed = {
        f.name: finite_or(F.col(f.name).cast("double"), None)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(fixed) if fixed else df


def skew_label(skew: Column) -> Column:
    return (
        F.when(skew > 1, "right-skewed").when(skew < -1, "left-skewed").otherwise("symmetric")
    )


def kurtosis_label(kurtosis: Column) -> Column:
    return (
        F.when(kurtosis > 1, "heavy-tailed")
        .when(kurtosis < -1, "light-tailed")
        .otherwise("normal-tailed")
    )


def distribution_label(skew: Column, kurtosis: Column, is_normal: Column) -> Column:
    """NaN counts as no value: Spark would call it larger than any number."""
    skew, kurtosis = finite_or(skew, None), finite_or(kurtosis, None)
    return (
        F.when(is_normal | ((F.abs(skew) <= 0.5) & (F.abs(kurtosis) <= 1)), "normal")
        .when(skew > 1, "right-skewed")
        .when(skew < -1, "left-skewed")
        .when(kurtosis > 3, "heavy-tailed")
        .when(F.abs(skew) <= 0.5, "symmetric")
        .otherwise("skewed")
    )


def concentration_label(top_share: Column) -> Column:
    """From the share (0 to 1) of the most frequent value."""
    return (
        F.when(top_share > 0.5, "high").when(top_share > 0.25, "moderate").otherwise("dispersed")
    )


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    word = (
        F.when(size >= 0.7, "strong").when(size >= 0.5, "moderate").when(size >= 0.3, "weak")
    )
    sign = F.when(r > 0, "_positive").otherwise("_negative")
    return F.coalesce(F.concat(word, sign), F.lit("none"))


def rounded_exactly(c: Column, digits: int) -> Column:
    """Round a double by its exact binary value, ties to even, as Python's formatting does.

    405.95 is stored slightly below that number and gives 405.9 with one digit. The
    product with 10**digits is computed with its rounding error (Dekker's splitting), which
    decides the cases that look like ties.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        product = x * scale
        error = (high * scale - product) + (x - high) * scale
        looks_tied = product - F.floor(product) == 0.5
        return (
            F.when(looks_tied & (error > 0), F.ceil(product).cast("double"))
            .when(looks_tied & (error < 0), F.floor(product).cast("double"))
            .otherwise(F.rint(product))
            / scale
        )

    return F.get(F.transform(F.array(c.cast("double")), rounded), F.lit(0))


def fixed(c: Column, digits: int, flags: str = "") -> Column:
    """Text with a fixed number of decimals; ``flags`` as in printf."""
    return F.format_string(f"%{flags}.{digits}f", rounded_exactly(c, digits))


def human_number(value: Column, currency: Column | bool = False, whole: Column | bool = False) -> Column:
    """1234567 -> 1.2M; below a thousand two decimals, or none for whole numbers."""
    currency = F.lit(currency) if isinstance(currency, bool) else currency
    whole = F.lit(whole) if isinstance(whole, bool) else whole
    size = F.abs(value)
    unit = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).when(size >= 1e3, 1e3)
    letter = F.when(size >= 1e9, "B").when(size >= 1e6, "M").otherwise("K")
    plain = F.when(
        whole, F.format_string("%d", F.when(size < 1e3, value).cast("bigint"))
    ).otherwise(fixed(value, 2))
    shown = F.when(size >= 1e3, F.concat(fixed(value / unit, 1), letter)).otherwise(plain)
    prefixed = F.concat(F.when(currency, "$").otherwise(""), shown)
    return F.when(is_finite(value), prefixed).otherwise("N/A")
