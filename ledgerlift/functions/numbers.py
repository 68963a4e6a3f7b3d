"""Number and unit parsing.  Bad input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(?:\.\d+)?"


def not_nan(col: Column) -> Column:
    """NaN and the infinities as null."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col)


def to_number(col: Column) -> Column:
    """Number from text, decimal comma accepted; anything else is null."""
    return not_nan(F.replace(F.trim(col.cast("string")), F.lit(","), F.lit(".")).try_cast("double"))


def number_or_zero(col: Column) -> Column:
    return F.coalesce(to_number(col), F.lit(0.0))


def first_number(col: Column) -> Column:
    """First number found in a text."""
    text = F.replace(F.replace(col, F.lit(" "), F.lit(" ")), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(text, f"({NUMBER})", 1), F.lit("")).try_cast("double")


def weight_kg(col: Column, default_unit: str = "kg") -> Column:
    """Positive weight in kilograms; grams if the text says so or by default."""
    number = first_number(col)
    text = F.lower(col)
    in_grams = text.contains("g") & ~text.contains("kg")
    if default_unit == "g":
        in_grams = F.lit(True)
    return F.when(number > 0, F.when(in_grams, number / 1000).otherwise(number))


def length_cm(col: Column, default_unit: str = "cm") -> Column:
    """Positive length in centimetres from a text that may carry mm, cm or m."""
    number = first_number(col)
    text = F.lower(col)
    in_mm = F.lit(True) if default_unit == "mm" else text.contains("mm")
    in_m = text.contains("m") & ~text.contains("mm") & ~text.contains("cm")
    return F.when(number > 0, F.when(in_mm, number / 10).when(in_m, number * 100).otherwise(number))


def unit_to_cm(value: Column, unit: Column) -> Column:
    """Length with its unit in another column; unknown units give null."""
    number, name = to_number(value), F.lower(F.trim(unit))
    return F.when(name == "mm", number / 10).when(name == "cm", number).when(name == "m", number * 100)


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to a range, null stays null."""
    out = col
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null for a zero or missing divisor."""
    return F.try_divide(top, bottom)


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def share_of_one(col: Column, *, missing: float = 1.0, bounded: bool = False) -> Column:
    """Percent given as 0-1 or 0-100, as 0-1."""
    value = not_nan(col.cast("double"))
    value = F.coalesce(F.when(value > 1, value / 100).otherwise(value), F.lit(float(missing)))
    return clip(value, 0.0, 1.0) if bounded else value


def close_enough(a: Column, b: Column) -> Column:
    """Within two units or two percent of ``a``."""
    return F.abs(a - b) <= F.greatest(F.lit(2.0), F.abs(a) * 0.02)


def round_even(col: Column) -> Column:
    """Round to a whole number, halves to the even one."""
    return F.rint(col)


def missing_or_zero(col: Column) -> Column:
    """Blank, or a number that is zero; other text counts as a value."""
    text = F.trim(col.cast("string"))
    return F.coalesce((text == "") | (to_number(text) == 0), text.isNull())


def continuous_baseline(revenue_k_eur: Column, headcount: Column, lift: Column) -> Column:
    """Euro value read from size alone: revenue over a million, staff, bounded by segment lift."""
    # greatest() skips nulls, so a missing figure is replaced before it is compared
    revenue = F.greatest(F.coalesce(revenue_k_eur * 1000.0, F.lit(0.0)), F.lit(0.0))
    staff = F.greatest(F.coalesce(headcount, F.lit(25.0)), F.lit(1.0))
    size_part = F.greatest(F.log1p(revenue) - F.log1p(F.lit(1_000_000.0)), F.lit(0.0)) * 22_000.0
    staff_part = F.log1p(staff) * 6_500.0
    return (size_part + staff_part) * clip(F.coalesce(lift, F.lit(1.0)), 0.7, 1.8)
