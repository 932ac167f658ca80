"""Rounding, validity tests and number formats (half-up like the reference, never half-even)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    """True only for a present, finite number (never null)."""
    c = as_col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def finite_nonneg(c) -> Column:
    return is_finite(c) & F.coalesce(as_col(c) >= 0, F.lit(False))


def finite_positive(c) -> Column:
    return is_finite(c) & F.coalesce(as_col(c) > 0, F.lit(False))


def js_round(c, digits: int = 0) -> Column:
    """F-9: floor(x * 10^d + 0.5) / 10^d."""
    p = float(10**digits)
    return F.floor(as_col(c) * F.lit(p) + F.lit(0.5)).cast("double") / F.lit(p)


def significant(c, n: int) -> Column:
    """F-10: keep n significant digits (half-up on the magnitude)."""
    x = as_col(c).cast("double")
    exp = F.floor(F.log10(F.abs(x))) - F.lit(n - 1)
    up = F.pow(F.lit(10.0), F.abs(exp).cast("double"))
    mag = F.when(exp >= 0, F.floor(F.abs(x) / up + 0.5) * up).otherwise(F.floor(F.abs(x) * up + 0.5) / up)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * mag)


def whole(c) -> Column:
    """Half-up whole number with thousands separators: 1234.5 -> '1,235'."""
    return F.format_number(F.floor(as_col(c) + F.lit(0.5)).cast("double"), 0)


def plain_number(c, digits: int = 12) -> Column:
    """Shortest decimal text with grouping: trailing zeros (and a bare point) dropped."""
    s = F.format_number(as_col(c).cast("double"), digits)
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def sig2_text(c) -> Column:
    """Two significant digits with grouping: 131.69 -> '130', 0.0456 -> '0.046'."""
    x = as_col(c)
    return F.when(x == 0, F.lit("0")).otherwise(plain_number(significant(x, 2)))


def amount_text(c) -> Column:
    """Fact amounts: whole from 10 up, one decimal from 1, two decimals below 1."""
    x = as_col(c).cast("double")
    return (
        F.when(x >= 10, whole(x))
        .when(x < 1, plain_number(js_round(x, 2)))
        .otherwise(plain_number(js_round(x, 1)))
    )


def format_compact(c) -> Column:
    """F-13: 1,284 / 12.9k / 1.2M."""
    x = as_col(c).cast("double")

    def one_decimal(v: Column) -> Column:
        r = F.signum(v) * js_round(F.abs(v), 1)
        return F.regexp_replace(F.regexp_replace(F.format_number(r, 1), ",", ""), r"\.0$", "")

    a = F.abs(x)
    return (
        F.when(a >= 1e6, F.concat(one_decimal(x / 1e6), F.lit("M")))
        .when(a >= 1e4, F.concat(one_decimal(x / 1e3), F.lit("k")))
        .otherwise(whole(x))
    )


def format_percent(c) -> Column:
    return F.concat(F.floor(as_col(c) + F.lit(0.5)).cast("string"), F.lit("%"))


def delta_percent(cur, prev) -> Column:
    """W-17: period over period percent, null when the previous value is missing or not positive."""
    c, p = as_col(cur).cast("double"), as_col(prev).cast("double")
    return F.when(p > 0, (c - p) / p * 100.0)


def format_delta_percent(cur, prev) -> Column:
    """F-13: '+12%' or, with a minus sign, the drop; null when there is no base."""
    r = F.floor(delta_percent(cur, prev) + F.lit(0.5))
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r == 0, F.lit("0%"))
        .when(r > 0, F.concat(F.lit("+"), r.cast("string"), F.lit("%")))
        .otherwise(F.concat(F.lit("−"), F.abs(r).cast("string"), F.lit("%")))
    )


def format_scaled(c, whole_from: float) -> Column:
    """F-13: whole from ``whole_from`` up, one decimal from 1, two significant digits below 1."""
    x = as_col(c).cast("double")
    a = F.abs(x)
    return (
        F.when(a >= whole_from, whole(x))
        .when(a >= 1, plain_number(F.signum(x) * js_round(a, 1)))
        .when(a == 0, F.lit("0"))
        .otherwise(plain_number(significant(x, 2)))
    )


def format_points_display(c) -> Column:
    return format_scaled(c, 100.0)


def format_amount_display(c) -> Column:
    return format_scaled(c, 10.0)


def format_mass(grams) -> Column:
    g = as_col(grams).cast("double")
    return F.when(F.abs(g) >= 1000, F.concat(format_amount_display(g / 1000.0), F.lit(" kg"))).otherwise(
        F.concat(format_amount_display(g), F.lit(" g"))
    )


def nice_ceil(c) -> Column:
    """F-14: round an axis maximum up to 1, 2, 2.5, 5 or 10 times a power of ten."""
    x = as_col(c).cast("double")
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)).cast("double"))
    # fixed values: axis steps
    steps = F.transform(F.array(*[F.lit(v) for v in (1.0, 2.0, 2.5, 5.0, 10.0)]), lambda m: m * base)
    fit = F.element_at(F.filter(steps, lambda s: x <= s), 1)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(10.0)).otherwise(F.coalesce(fit, base * 10.0))


def json_number(c) -> Column:
    """A double as JSON text in the shortest form: 12, 0.5, 1.5e-7, 1e+21; null is null."""
    x = as_col(c).cast("double")
    digits = x.cast("decimal(38,17)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    parts = F.split(x.cast("string"), "E")
    head, power = F.regexp_replace(parts[0], r"\.0$", ""), parts[1].cast("int")
    spelled = F.concat(head, F.when(power < 0, F.lit("e")).otherwise(F.lit("e+")), power.cast("string"))
    return F.when((x == 0) | ((F.abs(x) >= 1e-6) & (F.abs(x) < 1e21)), plain).when(x.isNotNull() & ~F.isnan(x), spelled).otherwise(F.lit("null"))
