"""Date parsing and calendar series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALES_DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm", "dd.MM.yyyy")


def month_start(col: Column) -> Column:
    """``YYYY-MM`` as the first of that month; bad text is null."""
    return F.try_to_timestamp(F.concat(col.cast("string"), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")


def parse_timestamp(col: Column, formats: Sequence[str] = SALES_DATE_FORMATS) -> Column:
    """First format that fits, in UTC; no fit is null."""
    text = F.trim(col)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats])


def month_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def days_since(reference: Column, col: Column, *, missing: int = 9999) -> Column:
    return F.greatest(F.coalesce(F.datediff(reference, col), F.lit(missing)), F.lit(0))


def in_lookback(col: Column, reference: Column, days: int, *, closed: bool = True) -> Column:
    """``(reference - days, reference]``; the upper end is open-ended unless ``closed``."""
    after = col > F.date_sub(reference, days)
    return after & (col <= reference) if closed else after


def snapshot_dates(sales: DataFrame, date_col: str, *, lookback_days: int, as_of: str | None = None) -> DataFrame:
    """Month ends from (first sale + lookback) to the last sale or ``as_of``.

    With fewer than two month ends: the midpoint and the end instead.  One row of minimum and
    maximum is all that is aggregated; the series is made from that row.
    """
    end = F.lit(as_of).cast("date") if as_of else F.col("last_date")
    span = sales.agg(F.min(date_col).cast("date").alias("first_date"), F.max(date_col).cast("date").alias("last_date"))
    span = span.select(F.date_add("first_date", lookback_days).alias("start"), end.alias("end"))
    months = F.when(
        F.col("start") <= F.col("end"),
        F.filter(
            F.transform(
                F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month")),
                lambda d: F.last_day(d),
            ),
            lambda d: (d >= F.col("start")) & (d <= F.col("end")),
        ),
    ).otherwise(F.array().cast("array<date>"))
    midpoint = F.date_sub("end", max(lookback_days // 2, 30))
    chosen = F.when(F.size("months") >= 2, F.col("months")).otherwise(F.array(midpoint, F.col("end")))
    return span.withColumn("months", months).select(F.explode(chosen).alias("snapshot_date"))
