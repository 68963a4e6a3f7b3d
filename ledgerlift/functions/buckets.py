"""Bins, priorities and lookup scales.

Revenue and staff bins are closed on the left, the growth bins on the right.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _contains_any(text: Column, needles: Sequence[str]) -> Column:
    test = text.contains(needles[0])
    for needle in needles[1:]:
        test = test | text.contains(needle)
    return test


def revenue_bucket(revenue_k_eur: Column) -> Column:
    eur = revenue_k_eur * 1000.0
    return (
        F.when(eur.isNull() | F.isnan(eur), "unknown")
        .when(eur < 1_000_000, "0-1M")
        .when(eur < 5_000_000, "1-5M")
        .when(eur < 20_000_000, "5-20M")
        .when(eur < 100_000_000, "20-100M")
        .otherwise("100M+")
    )


def headcount_bucket(headcount: Column) -> Column:
    return (
        F.when(headcount.isNull() | F.isnan(headcount), "unknown")
        .when(headcount < 10, "1-10")
        .when(headcount < 50, "10-50")
        .when(headcount < 250, "50-250")
        .when(headcount < 1000, "250-1000")
        .otherwise("1000+")
    )


# Class labels and their bins, tested in this order.
REVENUE_LABELS = (
    (("20+",), "20-100M"),
    (("10-20", "10 - 20"), "5-20M"),
    (("2-10", "2 - 10", "1-2", "1 - 2"), "1-5M"),
    (("0.4-1", "0,4-1", "0.4 - 1"), "0-1M"),
)
HEADCOUNT_LABELS = (
    (("500-999", "500 - 999", "250-499", "250 - 499"), "250-1000"),
    (("100-249", "100 - 249", "50-99", "50 - 99"), "50-250"),
    (("20-49", "20 - 49", "10-19", "10 - 19"), "10-50"),
    (("1-9", "1 - 9"), "1-10"),
    ((">999", "1000"), "1000+"),
)


def bucket_from_label(label: Column, labels: Sequence[tuple[Sequence[str], str]]) -> Column:
    text = F.lower(F.trim(label))
    out = F.when(F.lit(False), F.lit(""))
    for needles, bucket in labels:
        out = out.when(_contains_any(text, needles), bucket)
    return out


def growth_bucket(growth_pct: Column) -> Column:
    return (
        F.when(growth_pct <= -5, "decline")
        .when(growth_pct <= 5, "stable")
        .when(growth_pct <= 20, "growth")
        .when(growth_pct.isNotNull(), "high_growth")
    )


def add_segment_features(df: DataFrame) -> DataFrame:
    """Revenue, staff and growth bins, the segment they form and revenue per employee.

    Revenue: the number first, then the class label.  Staff: the label first, then the number.
    """
    from_number = F.nullif(revenue_bucket(F.col("revenue_k_eur")), F.lit("unknown"))
    revenue = F.coalesce(from_number, bucket_from_label(F.col("revenue_class"), REVENUE_LABELS), F.lit("unknown"))
    staff = F.coalesce(bucket_from_label(F.col("headcount_class"), HEADCOUNT_LABELS), headcount_bucket(F.col("headcount")))
    # the segment reads the finished bins; put together here it would look for every label a second time
    return df.withColumns({"revenue_bucket": revenue, "headcount_bucket": staff}).withColumns(
        {
            "company_segment": F.concat("revenue_bucket", F.lit("_"), "headcount_bucket"),
            "revenue_per_employee": F.when(
                F.col("headcount") > 0, F.col("revenue_k_eur") * 1000.0 / F.col("headcount")
            ),
            "growth_bucket": growth_bucket(F.col("growth_pct")),
        }
    )


def priority(rank: Column, cuts: Sequence[int] = (100, 500, 1000)) -> Column:
    a, b, c = cuts
    return F.when(rank <= a, "A").when(rank <= b, "B").when(rank <= c, "C").when(rank.isNotNull(), "D")


COMMERCIAL_CUTS = (100, 500, 1500)


def potential_segment(
    eur: Column, *, minimum: float = 4_000.0, c: float = 10_000.0, b: float = 50_000.0, a: float = 100_000.0
) -> Column:
    return (
        F.when(eur < minimum, "Partner").when(eur >= a, "A").when(eur >= b, "B").when(eur >= c, "C").otherwise("Below C")
    )


def sales_priority(score: Column) -> Column:
    return (
        F.when(score.isNull() | (score <= -1) | (score > 100), F.lit(None))
        .when(score <= 39.999, "Low").when(score <= 69.999, "Medium").otherwise("High")
    )


def sales_year_bucket(days: Column) -> Column:
    return F.when(days <= 365, "recent_12m").when(days <= 730, "middle_12m").when(days.isNotNull(), "oldest_12m")


def match_confidence(method: Column, *, rule_order: str = "last") -> Column:
    """Confidence in a product-group match from the name of its method.

    ``last``: rules overwrite one another, so the last fitting rule counts.
    ``first``: the first fitting rule counts, and only a leading ``manual_`` counts as manual.
    """
    text = F.trim(method)
    low = F.lower(text)
    name_like = low.rlike("name_category|same_name|name_unique")
    if rule_order == "first":
        return (
            F.when(text.isNull() | (text == ""), 0.0)
            .when(low == "sku", 1.0)
            .when(low.contains("productcode"), 0.95)
            .when(name_like, 0.85)
            .when(low.contains("reference") | low.contains("source_zip"), 0.8)
            .when(low.startswith("manual_"), 0.75)
            .when(low.contains("category_guided"), 0.7)
            .otherwise(0.6)
        )
    return (
        F.when(text.isNull() | (text == ""), 0.0)
        .when(low.contains("category_guided"), 0.7)
        .when(low.contains("manual_"), 0.75)
        .when(low.contains("reference") | low.contains("source_zip"), 0.8)
        .when(name_like, 0.85)
        .when(low.contains("productcode"), 0.95)
        .when(text == "sku", 1.0)
        .otherwise(0.6)
    )


# Growth scale by priority.
PRIORITY_MULTIPLIER = {"A": 1.00, "B": 0.85, "C": 0.65, "D": 0.45}
PRIORITY_CAP_PCT = {"A": 0.60, "B": 0.45, "C": 0.30, "D": 0.20}
PRIORITY_CAP_FLOOR = {"A": 15000.0, "B": 10000.0, "C": 6000.0, "D": 3000.0}


def by_priority(priority_col: Column, scale: Mapping[str, float], default: float) -> Column:
    key = F.upper(F.trim(priority_col))
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in scale.items():
        out = out.when(key == name, F.lit(float(value)))
    return out.otherwise(F.lit(float(default)))
