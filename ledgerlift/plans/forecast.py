"""Calendar-year forecast per customer and product group, split over months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import numbers as nm
from ledgerlift.operators.aggregates import sum_where
from ledgerlift.operators.ranking import join_on
from ledgerlift.session import stage

UNKNOWN_GROUP = "Tuntematon tuoteryhmä"
YEAR_WEIGHTS = (0.10, 0.30, 0.60)


def resolved_group(*columns: str, unknown: str = UNKNOWN_GROUP):
    """First known group by trust order; the unknown marker counts as missing."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(unknown)) for c in columns], F.lit(unknown))


def seasonal_shares(months: DataFrame, years: list[int]) -> DataFrame:
    """Mean share of each month in a group's year, made to sum to one per group."""
    sums = months.filter(F.col("year").isin(years)).groupBy("product_group", "year", "month").agg(F.sum("sales_eur").alias("v"))
    totals = sums.groupBy("product_group", "year").agg(F.sum("v").alias("t"))
    shares = sums.join(totals, ["product_group", "year"]).withColumn("share", F.when(F.col("t") > 0, F.col("v") / F.col("t")).otherwise(0.0))
    mean = shares.groupBy("product_group", "month").agg(F.avg("share").alias("share"))
    whole = mean.groupBy("product_group").agg(F.sum("share").alias("s"))
    return mean.join(whole, "product_group").select(
        "product_group", "month", F.coalesce(nm.ratio(F.col("share"), F.nullif(F.col("s"), F.lit(0.0))), F.lit(1.0 / 12.0)).alias("share")
    )


def calendar_forecast(lines: DataFrame, *, reference_year: int, reference_month: int) -> tuple[DataFrame, DataFrame]:
    """Annual forecast per customer and group, and its twelve monthly rows.

    ``lines``: business_id, product_group, sold_on, sales_eur, already cut at the reference date.
    Three past years count .10/.30/.60 (only years with sales), this year's run rate counts 30
    percent where it sold, the last year-on-year trend is dampened.  Lines are added up per month
    once; everything else reads those sums.
    """
    y1, y2, y3 = reference_year - 3, reference_year - 2, reference_year - 1
    used = lines.filter(F.col("business_id").isNotNull() & (F.col("sales_eur") > 0) & F.year("sold_on").isin(y1, y2, y3, reference_year))
    months = stage(
        used.groupBy("business_id", "product_group", F.year("sold_on").alias("year"), F.month("sold_on").alias("month")).agg(F.sum("sales_eur").alias("sales_eur")),
        "group-months",
    )
    v = F.col("sales_eur")
    sums = months.groupBy("business_id", "product_group").agg(
        *[sum_where(v, F.col("year") == y).alias(n) for n, y in (("sales_y1", y1), ("sales_y2", y2), ("sales_y3", y3), ("ytd_sales", reference_year))]
    )
    pairs = list(zip(("sales_y1", "sales_y2", "sales_y3"), YEAR_WEIGHTS))
    weighted, available = F.lit(0.0), F.lit(0.0)
    for c, w in pairs:
        weighted = weighted + F.col(c) * w
        available = available + F.when(F.col(c) > 0, w).otherwise(0.0)
    base = F.coalesce(nm.ratio(weighted, available), F.lit(0.0))
    ytd_months = max(reference_month - 1, 1)
    run_rate = F.col("ytd_sales") / ytd_months * 12.0
    trend = F.when(F.col("sales_y2") > 0, nm.clip(F.col("sales_y3") / F.col("sales_y2"), 0.75, 1.25)).otherwise(1.0)
    annual = sums.withColumns(
        {"calendar_base_eur": F.when(F.col("ytd_sales") > 0, 0.70 * base + 0.30 * run_rate).otherwise(base), "trend_factor": trend}
    ).withColumn("forecast_annual_eur", F.greatest(F.col("calendar_base_eur") * (0.70 + 0.30 * F.col("trend_factor")), F.lit(0.0)))
    annual = stage(annual, "annual-forecast")
    shares = seasonal_shares(months, [y1, y2, y3])
    twelve = shares.groupBy("product_group").agg(F.map_from_entries(F.collect_list(F.struct("month", "share"))).alias("_shares"))  # twelve entries
    filled = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.element_at("_shares", m), F.lit(1.0 / 12.0)))
    out = join_on(annual, twelve, ["product_group"], "left").withColumn("_m", filled).drop("_shares")
    total = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("_t", F.when(total == 0, 1.0).otherwise(total)).select("business_id", "product_group", "forecast_annual_eur", "_t", F.posexplode("_m").alias("_i", "_s"))
    share = F.col("_s") / F.col("_t")
    monthly = out.select(
        "business_id", "product_group", F.lit(reference_year + 1).alias("forecast_year"), (F.col("_i") + 1).alias("forecast_month"),
        share.alias("seasonal_share"), (F.col("forecast_annual_eur") * share).alias("forecast_sales_eur"),
    )
    return annual, monthly


def add_calendar_potential(customers: DataFrame, annual: DataFrame) -> DataFrame:
    """Next calendar year's forecast and growth per customer."""
    sums = annual.groupBy("business_id").agg(F.sum("forecast_annual_eur").alias("potential_next_calendar_year_eur"))
    current = nm.zero_if_null(F.col("current_sales_eur"))
    out = customers.join(sums, "business_id", "left").withColumn("potential_next_calendar_year_eur", nm.zero_if_null(F.col("potential_next_calendar_year_eur")))
    growth = F.greatest(F.col("potential_next_calendar_year_eur") - current, F.lit(0.0))
    return out.withColumns({"potential_growth_calendar_year_eur": growth, "potential_growth_calendar_year_pct": F.when(current > 0, growth / current).otherwise(0.0)})
