"""Sales preparation, snapshot panel and purchase-history features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import buckets as bk
from ledgerlift.functions import dates as dt
from ledgerlift.functions import numbers as nm
from ledgerlift.operators.aggregates import sum_where
from ledgerlift.operators.lookup import flag_member, interval_members
from ledgerlift.operators.ranking import first_per_key
from ledgerlift.plans.targets import EmptyInputError, status_in
from ledgerlift.session import stage

INVOICE_STATUSES = ("invoiced",)
OTHER_FEED_STATUSES = ("processed", "archived", "ready to archive")
EXCLUDED_GROUP_CODES = ("15.01.01", "04.05.02")


def company_features(companies: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Feature columns of a company, typed, one row per id."""
    chosen = [c for c in [*numeric, *categorical] if c in companies.columns]
    typed = companies.select(
        "business_id", *[(nm.to_number(F.col(c)) if c in numeric else F.col(c).cast("string")).alias(c) for c in chosen]
    )
    return first_per_key(typed, ["business_id"], [(c, "asc") for c in chosen])


def invoiced_only(sales: DataFrame, statuses: Sequence[str] = INVOICE_STATUSES) -> DataFrame:
    return sales.filter(status_in(F.col("status"), statuses))


def without_groups(sales: DataFrame, code_col: str, excluded: Sequence[str] = EXCLUDED_GROUP_CODES) -> DataFrame:
    """Drop rows of the excluded groups; rows without a group stay."""
    code = F.trim(F.col(code_col))
    return sales.filter(code.isNull() | ~code.isin(*excluded))


def completed_sales(sales: DataFrame, feeds: Mapping[str, Sequence[str]], *, source_col: str = "source_file") -> DataFrame:
    """Completed lines with a positive value; every feed (named by a part of its file name) has its own finished statuses."""
    source, status = F.lower(F.col(source_col)), F.lower(F.trim("status"))
    done = F.lit(False)
    for name, statuses in feeds.items():
        done = done | (source.contains(name.lower()) & status.isin(*[s.lower() for s in statuses]))
    return sales.filter(done & F.col("account_id").isNotNull() & F.col("sold_on").isNotNull() & (F.col("total_value") > 0))


def product_fallback_key(sales: DataFrame, code: str, name: str, reference: str, category: str) -> DataFrame:
    """Product key from code, else name and category, else reference and category; with its source."""
    value = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in (code, name, reference)}
    tail = F.concat(F.lit("|category:"), F.coalesce(F.trim(F.col(category).cast("string")), F.lit("")))
    key = F.coalesce(
        F.concat(F.lit("productcode:"), value[code]),
        F.concat(F.lit("name_category:"), value[name], tail),
        F.concat(F.lit("reference_category:"), value[reference], tail),
    )
    source = (
        F.when(value[code].isNotNull(), "productcode").when(value[name].isNotNull(), "name_category")
        .when(value[reference].isNotNull(), "reference_category")
    )
    return sales.withColumns({"product_service": key, "product_fallback_source": source})


def sales_history(sales: DataFrame, *, code: str, name: str, reference: str, category: str, group_code: str) -> DataFrame:
    """Dated, invoiced, not excluded lines with product key and match confidence."""
    ready = without_groups(invoiced_only(sales.filter(F.col("sold_on").isNotNull())), group_code)
    keyed = product_fallback_key(ready, code, name, reference, category)
    return keyed.withColumn("product_group_match_confidence", bk.match_confidence(F.col("product_group_match_method")))


def with_account_status(sales: DataFrame, accounts: DataFrame) -> DataFrame:
    """Status of the account with the same business id (first one by account id)."""
    one = first_per_key(accounts.filter(F.col("business_id").isNotNull()), ["business_id"], [("account_id", "asc")])
    return sales.drop("customer_status").join(one.select("business_id", F.trim("customer_status").alias("customer_status")), "business_id", "left")


def with_fixed_status(sales: DataFrame, account_ids: DataFrame, status: str) -> DataFrame:
    """One status for every listed id; other rows keep theirs."""
    flagged = flag_member(sales, "business_id", account_ids, "business_id", "_listed")
    return flagged.withColumn("customer_status", F.when(F.col("_listed"), F.lit(status)).otherwise(F.col("customer_status"))).drop("_listed")


def annual_sales(sales: DataFrame, *, lookback_days: int = 365, as_of: str | None = None) -> DataFrame:
    """Sales per business in ``(reference - lookback, reference]``; only missing values give 0."""
    reference = F.lit(as_of).cast("date") if as_of else sales.agg(F.max("sold_on").cast("date").alias("d")).scalar()
    window = sales.filter(dt.in_lookback(F.col("sold_on"), reference, lookback_days))
    return window.filter(F.col("business_id").isNotNull()).groupBy("business_id").agg(
        F.coalesce(F.sum("net_sales"), F.lit(0.0)).alias("annual_sales_eur")
    )


def eligible_training_sales(sales: DataFrame, *, minimum: float = 4000.0, lookback_days: int = 365, as_of: str | None = None, check: bool = True) -> DataFrame:
    """Sales of eligible customers that reach the yearly minimum."""
    eligible = sales.filter(status_in(F.col("customer_status"), ("active", "active+")))
    ids = annual_sales(eligible, lookback_days=lookback_days, as_of=as_of).filter(F.col("annual_sales_eur") >= minimum)
    kept = eligible.join(ids.select("business_id"), "business_id", "left_semi")
    if check and kept.limit(1).isEmpty():
        raise EmptyInputError("no sales left after the status and minimum-sales rules")
    return kept


def training_panel(companies: DataFrame, sales: DataFrame, *, lookback_days: int = 365, test_fraction: float = 0.2) -> DataFrame:
    """Company by month end with a label (bought within the lookback) and the train/test part.

    The last fifth of the dates (at least one) is test.  Dates are few (months of history) and
    ride along as one array, so no table is multiplied by another.
    """
    points = stage(dt.snapshot_dates(sales, "sold_on", lookback_days=lookback_days), "snapshots")
    buyers = interval_members(sales, "business_id", "sold_on", points, "snapshot_date", lookback_days)
    series = points.agg(F.array_sort(F.collect_list("snapshot_date")).alias("d")).scalar()
    panel = companies.withColumn("_dates", series)
    n_test = F.greatest(F.lit(1), F.floor(F.size("_dates") * test_fraction).cast("int"))
    panel = panel.withColumn("_first_test", F.element_at("_dates", -n_test)).withColumn("snapshot_date", F.explode("_dates")).drop("_dates")
    labelled = panel.join(buyers.withColumn("label", F.lit(1)), ["business_id", "snapshot_date"], "left")
    return labelled.withColumns(
        {
            "label": F.coalesce("label", F.lit(0)),
            "snapshot_month": F.month("snapshot_date"),
            "snapshot_quarter": F.quarter("snapshot_date"),
            "part": F.when(F.col("snapshot_date") >= F.col("_first_test"), "test").otherwise("train"),
        }
    ).drop("_first_test")


def scoring_snapshot(companies: DataFrame, as_of: str) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return companies.withColumns({"snapshot_date": day, "snapshot_month": F.month(day), "snapshot_quarter": F.quarter(day)})


# --------------------------------------------------------------------------- purchase history

def history_features(accounts: DataFrame, lines: DataFrame, *, y3: int) -> DataFrame:
    """What a customer bought before year ``y3`` and in it, from one pass over the lines.

    ``lines`` has business_id, sold_on, total_value, line_id, product_group.  Years: y1 and y2 are
    the two before ``y3``, y4 is the one running.
    """
    y1, y2, y4 = y3 - 2, y3 - 1, y3 + 1
    value, year = F.col("total_value"), F.year("sold_on")
    month, quarter = F.trunc("sold_on", "month"), F.quarter("sold_on")
    known = lines.filter(F.col("business_id").isNotNull())
    prior = year.isin(y1, y2)
    sums = {
        "sales_y1_eur": year == y1, "sales_y2_eur": year == y2, "actual_sales_y3_eur": year == y3, "sales_y4_ytd_eur": year == y4,
        **{f"sales_y2_q{q}_eur": (year == y2) & (quarter == q) for q in (1, 2, 3, 4)},
    }
    facts = known.groupBy("business_id").agg(
        *[sum_where(value, cond).alias(name) for name, cond in sums.items()],
        F.max(F.when(prior, month)).alias("last_purchase"),
        # months are numbered, so distinct months of any customer are few
        F.size(F.collect_set(F.when(prior, month))).alias("active_months_y1_y2"),
        F.size(F.collect_set(F.when(year == y2, month))).alias("active_months_y2"),
    )
    rows_y2 = known.filter(year == y2).groupBy("business_id").agg(
        F.count_distinct("line_id").alias("order_rows_y2"), F.count_distinct("product_group").alias("product_group_count_y2")
    )
    base = first_per_key(
        accounts.filter(F.col("business_id").isNotNull()), ["business_id"], [("account_id", "asc")]
    ).select("business_id", "account_id", F.col("account_name").alias("customer_name"), "country", "category")
    frame = base.join(facts, "business_id", "left").join(rows_y2, "business_id", "left")
    counts = ["active_months_y1_y2", "active_months_y2", "order_rows_y2", "product_group_count_y2"]
    frame = frame.withColumns(
        {**{c: F.coalesce(c, F.lit(0.0)) for c in sums}, **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in counts}}
    )
    h1, h2 = F.col("sales_y2_q1_eur") + F.col("sales_y2_q2_eur"), F.col("sales_y2_q3_eur") + F.col("sales_y2_q4_eur")
    start = F.make_date(F.lit(y3), F.lit(1), F.lit(1))
    grown = F.col("actual_sales_y3_eur") - F.col("sales_y2_eur")
    return frame.withColumns(
        {
            "avg_monthly_sales_y2_eur": F.coalesce(nm.ratio(F.col("sales_y2_eur"), F.col("active_months_y2")), F.lit(0.0)),
            "sales_momentum": _ratio_or(F.col("sales_y2_eur"), F.col("sales_y1_eur"), 2.0, 0.0),
            "h2_vs_h1": _ratio_or(h2, h1, 2.0, 0.0),
            "days_since_last_purchase": dt.days_since(start, F.col("last_purchase")),
            "grew_y3": ((F.col("actual_sales_y3_eur") > F.col("sales_y2_eur") * 1.10) & (grown > 1000)).cast("int"),
            "bought_y3": (F.col("actual_sales_y3_eur") > 0).cast("int"),
        }
    ).drop("last_purchase")


def _ratio_or(top: Column, bottom: Column, if_positive: float, otherwise: float) -> Column:
    """Ratio; without a divisor a fixed value by the sign of the numerator."""
    return F.coalesce(nm.ratio(top, bottom), F.when(top > 0, F.lit(if_positive)).otherwise(F.lit(otherwise)))


FORWARD_WEIGHTS: Mapping[str, float] = {
    "sales_y1_eur": 0.10, "sales_y2_eur": 0.20, "actual_sales_y3_eur": 0.35, "sales_y4_annualized_eur": 0.35,
}


def annualization(lines: DataFrame, *, y3: int) -> Column:
    """Scalar struct: months seen this year, yearly factor from last year's same months, plain factor.

    Computed from one row per year and month.
    """
    y4 = y3 + 1
    months = lines.groupBy(F.year("sold_on").alias("y"), F.month("sold_on").alias("m")).agg(F.sum("total_value").alias("v")).filter(
        F.col("y").isin(y3, y4)
    )
    packed = months.agg(F.collect_list(F.struct("y", "m", "v")).alias("a"))  # at most 24 rows
    seen = F.size(F.filter("a", lambda x: x["y"] == y4))
    seen = F.when(seen > 0, seen).otherwise(5)
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x["v"])
    row = packed.select("a", seen.alias("ytd_months"), (12.0 / seen).alias("simple_factor"))
    row = row.select(
        "ytd_months", "simple_factor",
        add(F.filter("a", lambda x: x["y"] == y3)).alias("full"),
        add(F.filter("a", lambda x: (x["y"] == y3) & (x["m"] <= F.col("ytd_months")))).alias("same_months"),
    )
    factor = F.when((F.col("full") > 0) & (F.col("same_months") > 0), F.col("full") / F.col("same_months")).otherwise(F.col("simple_factor"))
    return row.select(F.struct("ytd_months", "simple_factor", "full", "same_months", factor.alias("factor")).alias("s")).scalar()


def forward_features(history: DataFrame, lines: DataFrame, *, y3: int) -> DataFrame:
    """Recent-weighted base and trend ratios for forecasting the year after next."""
    out = history.withColumn("_a", annualization(lines, y3=y3)).withColumns(
        {
            "sales_y4_annualized_eur": F.col("sales_y4_ytd_eur") * F.col("_a.factor"),
            "ytd_months": F.col("_a.ytd_months"), "annualization_factor": F.col("_a.factor"),
            "simple_annualization_factor": F.col("_a.simple_factor"),
        }
    )
    base = F.lit(0.0)
    for col, weight in FORWARD_WEIGHTS.items():
        base = base + F.col(col) * weight
    out = out.withColumns(
        {
            "recent_weighted_sales_base_eur": base,
            "recent_two_year_avg_eur": (F.col("actual_sales_y3_eur") + F.col("sales_y4_annualized_eur")) / 2.0,
            "older_two_year_avg_eur": (F.col("sales_y1_eur") + F.col("sales_y2_eur")) / 2.0,
        }
    )
    return out.withColumns(
        {
            "recent_vs_older_ratio": _ratio_or(F.col("recent_two_year_avg_eur"), F.col("older_two_year_avg_eur"), 1.25, 1.0),
            "ytd_vs_y3_ratio": _ratio_or(F.col("sales_y4_annualized_eur"), F.col("actual_sales_y3_eur"), 1.10, 1.0),
        }
    ).drop("_a")


def with_current_model(history: DataFrame, current: DataFrame) -> DataFrame:
    """Current model figures per customer, missing ones 0."""
    one = first_per_key(current.filter(F.col("business_id").isNotNull()), ["business_id"], [("rank", "asc")]).select(
        "business_id", "company", "priority", "company_segment", "score", "revenue_k_eur", "segment_lift",
        F.col("expected_potential_eur").alias("_e"), F.col("conditional_potential_eur").alias("_c"), F.col("probability_of_growth").alias("_p"),
    )
    return history.join(one, "business_id", "left").withColumns(
        {
            "current_model_expected_eur": nm.zero_if_null(F.col("_e")),
            "current_model_conditional_eur": nm.zero_if_null(F.col("_c")),
            "current_probability_of_growth": nm.zero_if_null(F.col("_p")),
        }
    ).drop("_e", "_c", "_p")


def sanitize(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), *, fill: float | None = None) -> DataFrame:
    """Feature columns as doubles (NaN and infinities null, or ``fill``) and strings."""
    def number(c: str) -> Column:
        value = nm.not_nan(F.col(c).cast("double"))
        return F.coalesce(value, F.lit(float(fill))) if fill is not None else value

    return df.withColumns({**{c: number(c) for c in numeric}, **{c: F.col(c).cast("string") for c in categorical}})


def profile_enrichment(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry profile of each id: revenue per employee added, missing texts ``unknown``."""
    facts = registry.select("business_id", "industry", "company_segment", "revenue_class", "headcount_class", "revenue_k_eur", "headcount")
    out = ids.join(facts, "business_id", "left")
    texts = ("industry", "company_segment", "revenue_class", "headcount_class")
    return out.withColumns(
        {
            **{c: F.coalesce(c, F.lit("unknown")) for c in texts},
            "revenue_per_employee": F.when(F.col("headcount") > 0, F.col("revenue_k_eur") * 1000.0 / F.col("headcount")),
        }
    )
