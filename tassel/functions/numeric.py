"""Rounding, percent and missing-value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def missing_to_null(value: Column | str) -> Column:
    """Double with NaN turned to null, so comparisons treat both alike."""
    number = as_col(value).cast("double")
    return F.when(~F.isnan(number), number)


def percent(part: Column | str, whole: Column | str) -> Column:
    """part/whole in percent to one decimal, half away from zero, exact on integers.

    Null when ``whole`` is zero.
    """
    p = as_col(part).cast("bigint")
    w = F.nullif(as_col(whole).cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", p * 2000 + w, w * 2) / F.lit(10.0)


def ratio(part: Column | str, whole: Column | str, places: int = 4) -> Column:
    """part/whole to a number of places, exact on integers; null when whole is zero."""
    scale = 10**places
    p = as_col(part).cast("bigint")
    w = F.nullif(as_col(whole).cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", p * (2 * scale) + w, w * 2) / F.lit(float(scale))


def safe_divide(part: Column | str, whole: Column | str) -> Column:
    """part/whole with 0.0 where whole is not positive or null."""
    p, w = as_col(part), as_col(whole)
    return F.when(w > 0, p / w).otherwise(F.lit(0.0))


def half_even(value: Column | str, places: int) -> Column:
    """Round the *binary* value of a non-negative double half to even.

    Text formatting in Python and C rounds this way (2.15 -> 2.1, 2.25 -> 2.2), while Spark's
    own rounding works on the shortest decimal text. The product with 10**places is split
    into two exact parts, so the comparison with the tie is exact as well.
    """
    x = as_col(value)
    scale = float(10**places)
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = x - high
    whole = F.floor(x * F.lit(scale)).cast("double")
    beyond = (high * F.lit(scale) - (whole + F.lit(0.5))) + low * F.lit(scale)
    step = F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(whole % 2)
    return (whole + step) / F.lit(scale)


def fixed_text(value: Column | str, places: int) -> Column:
    """Non-negative double as text with a fixed number of decimals, rounded by half_even."""
    return F.format_string(f"%.{places}f", half_even(value, places))


def half_up_tenth(tenths: Column | str) -> Column:
    """A number of tenths rounded to a whole, halves going up (also below zero), and divided by 10."""
    return F.floor(as_col(tenths) + F.lit(0.5)).cast("double") / F.lit(10.0)


def band(value: Column | str, edges: list[tuple[float, str]]) -> Column:
    """Label of the right-closed bin (previous edge, edge]; null at or below zero, or null input."""
    v = as_col(value)
    label = F.when(v.isNull() | F.isnan(v) | (v <= 0), F.lit(None).cast("string"))
    for edge, name in edges:
        label = label.when(v <= F.lit(float(edge)), name)
    return label


def ordinal(value: Column | str, order: list[str]) -> Column:
    """Position of a label in a fixed order; labels outside it and null come last."""
    v = as_col(value)
    rank = F.when(v == order[0], 0)
    for i, name in enumerate(order[1:], start=1):
        rank = rank.when(v == name, i)
    return rank.otherwise(len(order))
