"""Customer targets, labels and segment lift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import buckets as bk
from ledgerlift.functions.dates import in_lookback
from ledgerlift.functions.numbers import clip
from ledgerlift.operators.aggregates import sum_where
from ledgerlift.operators.ranking import first_per_key, head
from ledgerlift.session import stage

# Statuses of customers the models learn from; pass your own where they are called otherwise.
ELIGIBLE_STATUSES = ("active", "active+")
TOP_N = 1000
LOOKBACK_DAYS = 365 * 3
MIN_ANNUAL_SALES = 4000.0
YEAR_WEIGHTS = (0.60, 0.30, 0.10)


class EmptyInputError(ValueError):
    """A step that needs rows got none."""


def status_in(col: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(F.lower(F.trim(col)).isin(*[a.lower() for a in allowed]), F.lit(False))


def account_summary(accounts: DataFrame) -> DataFrame:
    """Per business id: first account name, distinct statuses, number of accounts, from one pass.

    A set holds each status of an id once, however many accounts share it.
    """
    known = accounts.filter(F.col("business_id").isNotNull() & F.col("account_id").isNotNull())
    return known.groupBy("business_id").agg(
        F.min_by("company_account_name", "account_id").alias("account_company_name"),
        F.count_distinct("account_id").alias("account_count"),
        F.array_join(F.array_sort(F.collect_set(F.trim("customer_status"))), ", ").alias("account_status"),
    )


def company_base(companies: DataFrame, accounts: DataFrame) -> DataFrame:
    """Registry with account facts; the parent defaults to the company, growth is kept in -100..200."""
    one = first_per_key(companies.filter(F.col("business_id").isNotNull()), ["business_id"], [("company_name", "asc")])
    return (
        one.join(account_summary(accounts), "business_id", "left")
        .withColumns(
            {
                "parent_business_id": F.coalesce("parent_business_id", "business_id"),
                "company_name": F.coalesce("company_name", "account_company_name"),
                "growth_pct": clip(F.col("growth_pct"), -100, 200),
            }
        )
    )


def scoring_universe(companies: DataFrame, accounts: DataFrame) -> DataFrame:
    """Registry plus account-only companies; one row per id, rows with figures first, then registry rows."""
    from_accounts = accounts.filter(F.col("business_id").isNotNull()).select(
        "business_id",
        F.col("company_account_name").alias("company_name"),
        F.col("account_name").alias("marketing_name"),
        F.coalesce("parent_business_id", "business_id").alias("parent_business_id"),
        F.lit(1).alias("_source"),
        F.col("account_id").alias("_row"),
    )
    both = companies.withColumns({"_source": F.lit(0), "_row": F.lit(0).cast("bigint")}).unionByName(from_accounts, allowMissingColumns=True)
    ranked = both.filter(F.col("business_id").isNotNull()).withColumn("_has", F.col("revenue_k_eur").isNotNull().cast("int"))
    return first_per_key(
        ranked, ["business_id"], [("_has", "desc"), ("_source", "asc"), ("_row", "asc"), ("company_name", "asc")]
    ).drop("_has", "_source", "_row")


def eligible_sales(months: DataFrame, accounts: DataFrame, statuses: Sequence[str] | None = ELIGIBLE_STATUSES) -> DataFrame:
    """Account-month sales of eligible accounts, by business id.  ``None`` takes every account."""
    keys = accounts.filter(F.col("business_id").isNotNull() & F.col("account_id").isNotNull())
    if statuses is not None:
        keys = keys.filter(status_in(F.col("customer_status"), statuses))
    return months.join(keys.select("account_id", "business_id"), "account_id")


def last_month(sales: DataFrame) -> Column:
    """Latest sales date as a scalar of one aggregated row."""
    return sales.agg(F.max("created_at").cast("date").alias("reference_date")).scalar()


def customer_targets(
    months: DataFrame, accounts: DataFrame, *, lookback_days: int = LOOKBACK_DAYS, min_annual: float = MIN_ANNUAL_SALES,
    statuses: Sequence[str] | None = ELIGIBLE_STATUSES,
) -> DataFrame:
    """Three-year sales and their yearly average per business id.

    The average divides by three whatever the lookback is.
    """
    sales = stage(eligible_sales(months, accounts, statuses), "eligible-sales")
    recent = sales.filter(in_lookback(F.col("created_at"), last_month(sales), lookback_days, closed=False))
    totals = recent.groupBy("business_id").agg(F.sum("total_value").alias("sales_3y_total_eur"))
    return totals.withColumn("avg_annual_sales_3y_eur", F.col("sales_3y_total_eur") / 3.0).filter(
        F.col("avg_annual_sales_3y_eur") >= min_annual
    )


def buyer_targets(months: DataFrame, accounts: DataFrame, *, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Sales of every buyer, whatever its status; only positive ones are buyers."""
    every = customer_targets(months, accounts, lookback_days=lookback_days, min_annual=float("-inf"), statuses=None)
    return every.filter(F.col("sales_3y_total_eur") > 0).withColumnRenamed(
        "avg_annual_sales_3y_eur", "actual_avg_annual_sales_3y_eur"
    )


def weighted_customer_targets(
    months: DataFrame, accounts: DataFrame, *, lookback_days: int = LOOKBACK_DAYS, min_annual: float = MIN_ANNUAL_SALES,
    weights: Sequence[float] = YEAR_WEIGHTS,
) -> DataFrame:
    """Targets in which recent sales years count more; the plain average is kept next to it."""
    total = sum(weights)
    if total <= 0:
        raise ValueError("at least one year weight must be positive")
    recent_w, middle_w, oldest_w = (w / total for w in weights)
    sales = stage(eligible_sales(months, accounts), "eligible-sales")
    reference = last_month(sales)
    window = sales.filter(in_lookback(F.col("created_at"), reference, lookback_days, closed=False))
    window = window.withColumn("_bucket", bk.sales_year_bucket(F.datediff(reference, "created_at")))
    sums = [
        sum_where(F.col("total_value"), F.col("_bucket") == b).alias(b) for b in ("recent_12m", "middle_12m", "oldest_12m")
    ]
    out = window.groupBy("business_id").agg(*sums).withColumns(
        {
            "sales_3y_total_eur": F.col("recent_12m") + F.col("middle_12m") + F.col("oldest_12m"),
            "avg_annual_sales_3y_eur": F.col("recent_12m") * recent_w + F.col("middle_12m") * middle_w + F.col("oldest_12m") * oldest_w,
        }
    )
    return out.withColumn("avg_annual_sales_3y_eur_unweighted", F.col("sales_3y_total_eur") / 3.0).filter(
        F.col("avg_annual_sales_3y_eur") >= min_annual
    )


def top_customers(targets: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` largest yearly averages; equal amounts go by business id.

    The last bits of a sum follow the order in which it was added up, so amounts are compared to the millionth.
    """
    return head(targets.withColumn("_avg", F.round("avg_annual_sales_3y_eur", 6)), [("_avg", "desc"), ("business_id", "asc")], n).drop("_avg")


def segment_lift(frame: DataFrame) -> DataFrame:
    """Share of a segment among the top customers over its share among all customers.

    One aggregate over customers; both totals are sums of that small table.
    """
    counts = frame.filter("current_customer = 1").groupBy("company_segment").agg(
        F.count("*").alias("_all"), F.sum("label").alias("_top")
    )
    totals = counts.agg(F.struct(F.sum("_all").alias("a"), F.sum("_top").alias("t"))).scalar()
    with_totals = counts.withColumn("_t", totals)
    top_share = F.coalesce(F.try_divide(F.col("_top"), F.col("_t.t")), F.lit(0.0))
    return with_totals.select("company_segment", (top_share / (F.col("_all") / F.col("_t.a"))).alias("segment_lift"))


def modeling_frame(companies: DataFrame, accounts: DataFrame, targets: DataFrame, *, top_n: int = TOP_N) -> DataFrame:
    """Companies with segments, customer flag, target, top-customer label and segment lift."""
    targets = stage(targets, "targets")
    base = bk.add_segment_features(company_base(companies, accounts))
    # an id with accounts is one that has a count of them
    base = base.withColumn("current_customer", F.col("account_count").isNotNull().cast("int"))
    labels = top_customers(targets, top_n).select("business_id", F.lit(1).alias("label"))
    # read by the lift, the medians and every later step: written once
    frame = stage(
        base.join(targets, "business_id", "left")
        .join(labels, "business_id", "left")
        .withColumn("label", F.coalesce("label", F.lit(0))),
        "modeling",
    )
    return frame.join(segment_lift(frame), "company_segment", "left").withColumn(
        "segment_lift", F.coalesce("segment_lift", F.lit(0.0))
    )


def add_sales_label(frame: DataFrame, buyers: DataFrame) -> DataFrame:
    """Buyer flag and yearly sales from sales history; non-buyers get 0."""
    facts = buyers.select("business_id", "actual_avg_annual_sales_3y_eur", "sales_3y_total_eur")
    return frame.join(facts, "business_id", "left").withColumns(
        {
            "has_sales_history": F.col("actual_avg_annual_sales_3y_eur").isNotNull().cast("int"),
            "actual_avg_annual_sales_3y_eur": F.coalesce("actual_avg_annual_sales_3y_eur", F.lit(0.0)),
            "sales_3y_total_eur": F.coalesce("sales_3y_total_eur", F.lit(0.0)),
        }
    )
