"""Backtest tables: calibration, errors, product-group grid, potential case, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import buckets as bk
from ledgerlift.functions import numbers as nm
from ledgerlift.operators.ranking import exact_quantiles, first_per_key, global_row_number, head, join_on, take_places, top_n
from ledgerlift.session import stage


def next_year_forecast(frame: DataFrame) -> DataFrame:
    """Base times three limited uplifts (chance, score, trend), with fallbacks for customers without history."""
    chance = nm.clip(nm.zero_if_null(F.col("improved_probability_of_growth")), 0.01, 0.99)
    score = nm.clip(nm.zero_if_null(F.col("score")), 0, 1)
    recent = nm.clip(F.coalesce("recent_vs_older_ratio", F.lit(1.0)), 0.60, 1.80)
    ytd = nm.clip(F.coalesce("ytd_vs_y3_ratio", F.lit(1.0)), 0.60, 1.80)
    uplift = (1.0 + (chance - 0.50) * 0.18) * (1.0 + (score - 0.50) * 0.10) * (1.0 + (recent - 1.0) * 0.18 + (ytd - 1.0) * 0.12)
    active = (F.col("sales_y1_eur") + F.col("sales_y2_eur") + F.col("actual_sales_y3_eur") + F.col("sales_y4_ytd_eur")) > 0
    expected = F.col("improved_expected_sales_eur")
    out = frame.withColumn("next_year_growth_multiplier", nm.clip(uplift, 0.75, 1.35))
    raw = F.col("recent_weighted_sales_base_eur") * F.col("next_year_growth_multiplier")
    value = F.when(~active, nm.zero_if_null(expected) * 0.25).when((raw <= 0) & (expected > 0), expected * 0.35).otherwise(raw)
    out = out.withColumn("next_year_forecast_eur", F.greatest(value, F.lit(0.0)))
    delta = F.col("next_year_forecast_eur") - F.col("actual_sales_y3_eur")
    pct = nm.ratio(delta, F.nullif(F.col("actual_sales_y3_eur"), F.lit(0.0)))
    return out.withColumns(
        {
            "next_year_probability_weighted_eur": F.col("next_year_forecast_eur") * chance,
            "next_year_vs_actual_eur": delta, "next_year_vs_actual_pct": pct,
            "forecast_interpretation": F.when(pct > 0.10, "growth_vs_last_year").when(pct < -0.10, "lower_than_last_year").otherwise("near_last_year_level"),
        }
    )


def bin_edges(df: DataFrame, value: str, bins: int = 10, fallback: int = 5) -> DataFrame:
    """Quantile bins ``(bin, low, high]`` without empty ones; equal widths if all values are one."""
    points = [i / bins for i in range(bins + 1)]
    marks = exact_quantiles(df, [], value, points)  # bins + 1 rows
    cut = marks.agg(F.array_sort(F.collect_set("value")).alias("e"))
    cut = cut.withColumn("wide", F.transform(F.sequence(F.lit(0), F.lit(fallback)), lambda i: F.col("e")[0] - 0.5 + i / float(fallback)))
    return cut.select(F.when(F.size("e") > 1, F.col("e")).otherwise(F.col("wide")).alias("edges"))


def add_bin(df: DataFrame, value: str, edges: DataFrame, out: str = "probability_bin") -> DataFrame:
    """Bin number by edges: right-closed, the lowest edge belongs to the first bin."""
    e = edges.select("edges").scalar()
    below = F.size(F.filter(F.col("_edges"), lambda x: x < F.col(value)))
    return df.withColumn("_edges", e).withColumn(out, F.greatest(below, F.lit(1))).drop("_edges")


def calibration_table(frame: DataFrame, *, raw: str = "current_probability_of_growth", calibrated: str = "calibrated_probability", label: str = "grew_y3", sums: Sequence[str] = ()) -> DataFrame:
    binned = add_bin(frame, raw, bin_edges(frame, raw))
    return binned.groupBy("probability_bin").agg(
        F.count("*").alias("customers"), F.min(raw).alias("lowest"), F.max(raw).alias("highest"), F.avg(raw).alias("avg_raw_probability"),
        F.avg(calibrated).alias("avg_calibrated_probability"), F.avg(F.col(label).cast("double")).alias("observed_rate"), *[F.sum(c).alias(c) for c in sums],
    )


def error_analysis(frame: DataFrame, *, actual: str = "actual_sales_y3_eur", predicted: str = "improved_expected_sales_eur") -> DataFrame:
    """Error of each customer and its bucket; the first fitting bucket counts."""
    error, size = F.col(predicted) - F.col(actual), F.abs(actual)
    limit = F.greatest(F.lit(5000.0), size * 0.50)
    return frame.withColumns(
        {
            "model_error_eur": error, "absolute_error_eur": F.abs(error),
            "error_bucket": F.when(F.abs(error) <= F.greatest(F.lit(1000.0), size * 0.20), "good_fit").when(error > limit, "model_over_high")
            .when(error < -limit, "model_under_high").when((F.col(actual) == 0) & (F.col(predicted) > 5000), "no_actual_sales_high_prediction").otherwise("medium_error"),
        }
    )


FEEDBACK_COLUMNS = ("sales_feedback_type", "sales_corrected_potential_eur", "exclude_from_training", "reason_code", "missing_product_groups", "sales_notes")


def feedback_template(errors: DataFrame, n: int = 500) -> DataFrame:
    """The largest errors with empty columns for comments."""
    return head(errors, [("absolute_error_eur", "desc"), ("business_id", "asc")], n).withColumns({c: F.lit("") for c in FEEDBACK_COLUMNS})


def customer_group_grid(customers: DataFrame, sales: DataFrame, group: str, value: str, *, n: int | None = None) -> DataFrame:
    """Every customer (``business_id``) with each group, or with the ``n`` best-selling ones.

    The full grid is the result here; the groups travel in blocks, copied as often as the customers fill tasks.
    """
    totals = sales.groupBy(group).agg(F.sum(value).alias("_t"))
    if n is not None:
        totals = head(totals, [("_t", "desc"), (group, "asc")], n)
    listed = stage(global_row_number(totals, [("_t", "desc"), (group, "asc")], "_place").select(group, "_place"), "groups")
    return take_places(customers, listed, [], "_place", listed.agg(F.count("*")).scalar(), ["business_id"]).drop("_place")


def group_model(grouped: DataFrame, customers: DataFrame, recommendations: DataFrame, *, y2: int, y3: int, n: int | None = None) -> DataFrame:
    """Per customer and group: own and peer share of year 2, what that expects of year 3, and what happened.

    Most customers buy few of the groups, so the grid is kept sparse: a row for each customer and group with sales in
    either year or a recommendation, and rows without a ``business_id`` for all others, one for each segment
    and group and one for each group with what no segment row counts.  These hold sums over ``customers``
    customers, which is exact: who bought nothing of a group has no share of it and is expected to buy the
    peers' share.  ``n`` keeps the best-selling groups only.
    """
    valid = grouped.filter(F.col("business_id").isNotNull() & F.col("year").isin(y2, y3) & F.col("product_group").isNotNull())
    sold = valid.groupBy("business_id", "product_group").agg(
        F.sum(F.when(F.col("year") == y2, F.col("sales_eur")).otherwise(0.0)).alias("customer_group_sales_y2_eur"),
        F.sum(F.when(F.col("year") == y3, F.col("sales_eur")).otherwise(0.0)).alias("actual_group_sales_y3_eur"),
    )
    sold = stage(sold, "group-years")
    groups = sold.groupBy("product_group").agg(F.sum(F.col("customer_group_sales_y2_eur") + F.col("actual_group_sales_y3_eur")).alias("_v"))
    if n is not None:
        groups = head(groups, [("_v", "desc"), ("product_group", "asc")], n)
    groups = stage(groups.select("product_group"), "groups")
    base = stage(first_per_key(customers, ["business_id"], [("business_id", "asc")]).select("business_id", "company_segment", "sales_y2_eur"), "customers")
    rec = recommendations.select("business_id", "product_group", "recommended_group_expected_potential_eur", "recommendation_rank")
    listed = sold.join(rec, ["business_id", "product_group"], "full_outer").join(groups, "product_group", "left_semi").join(base, "business_id")
    zeros = ("customer_group_sales_y2_eur", "actual_group_sales_y3_eur", "recommended_group_expected_potential_eur")
    listed = listed.withColumns({c: nm.zero_if_null(F.col(c)) for c in zeros})
    listed = stage(listed.withColumn("customer_group_share_y2", nm.zero_if_null(nm.ratio(F.col("customer_group_sales_y2_eur"), F.col("sales_y2_eur")))), "listed")
    # what the segments hold, and what of it the listed customers do
    held = {"_n": F.count("*"), "_y": F.sum("sales_y2_eur"), "_a": F.sum(F.abs("sales_y2_eur"))}
    whole = base.filter(F.col("company_segment").isNotNull()).groupBy("company_segment").agg(*[e.alias(c) for c, e in held.items()])
    own = listed.filter(F.col("company_segment").isNotNull()).groupBy("company_segment", "product_group").agg(
        F.sum("customer_group_sales_y2_eur").alias("_g"), *[e.alias(f"_l{c}") for c, e in held.items()]
    )
    peers = own.join(whole, "company_segment").withColumn("similar_customer_group_share_y2", nm.zero_if_null(nm.ratio(F.col("_g"), F.col("_y"))))
    peers = stage(peers, "peer-shares")
    gap = F.greatest(F.col("similar_customer_group_share_y2") - F.col("customer_group_share_y2"), F.lit(0.0))
    rows = listed.join(peers.select("company_segment", "product_group", "similar_customer_group_share_y2"), ["company_segment", "product_group"], "left")
    rows = rows.withColumns({"customers": F.lit(1).cast("bigint"), "white_space_gap_y2": gap})
    rows = rows.withColumn("group_model_expected_eur", F.col("sales_y2_eur") * F.col("white_space_gap_y2"))
    rows = rows.withColumn("absolute_error_eur", F.abs(F.col("group_model_expected_eur") - F.col("actual_group_sales_y3_eur")))
    rest = {**{c: F.lit(0.0) for c in (*zeros, "customer_group_share_y2")}, "business_id": F.lit(None).cast(base.schema["business_id"].dataType), "recommendation_rank": F.lit(None).cast("int")}
    others = peers.withColumns(rest).withColumns({"customers": F.col("_n") - F.col("_l_n"), "sales_y2_eur": F.col("_y") - F.col("_l_y"), "white_space_gap_y2": F.greatest("similar_customer_group_share_y2", F.lit(0.0))})
    others = others.filter(F.col("customers") > 0).withColumns(
        {"group_model_expected_eur": F.col("sales_y2_eur") * F.col("white_space_gap_y2"), "absolute_error_eur": (F.col("_a") - F.col("_l_a")) * F.col("white_space_gap_y2")}
    )
    counted = rows.unionByName(others.select(*rows.columns))
    total = base.agg(F.count("*").alias("n"), F.sum("sales_y2_eur").alias("y"))
    seen = counted.groupBy("product_group").agg(F.sum("customers").alias("_n"), F.sum("sales_y2_eur").alias("_y"))
    seen = groups.join(seen, "product_group", "left").withColumns({"_n": F.coalesce("_n", F.lit(0)), "_y": nm.zero_if_null(F.col("_y"))})
    last = seen.withColumns({**rest, "company_segment": F.lit(None).cast(base.schema["company_segment"].dataType), "similar_customer_group_share_y2": F.lit(None).cast("double")}).withColumns({
        "customers": total.select("n").scalar() - F.col("_n"), "sales_y2_eur": total.select("y").scalar() - F.col("_y"), "white_space_gap_y2": F.lit(0.0), "group_model_expected_eur": F.lit(0.0), "absolute_error_eur": F.lit(0.0),
    }).filter(F.col("customers") > 0)
    grid = counted.unionByName(last.select(*rows.columns))
    return grid.withColumn("group_error_eur", F.col("group_model_expected_eur") - F.col("actual_group_sales_y3_eur"))


def group_calibration(grid: DataFrame) -> DataFrame:
    """Factor actual / expected per group, pulled to the overall factor where evidence is thin (.25 to 6)."""
    groups = stage(
        grid.groupBy("product_group").agg(
            F.sum("customers").alias("customers"), F.count_if(F.col("actual_group_sales_y3_eur") > 0).alias("buyers"),
            F.sum("actual_group_sales_y3_eur").alias("actual_group_sales_y3_eur"), F.sum("group_model_expected_eur").alias("group_model_expected_eur"),
            F.sum("recommended_group_expected_potential_eur").alias("current_recommendation_expected_eur"),
        ),
        "group-sums",
    )
    overall = groups.agg(
        F.when(F.sum("group_model_expected_eur") > 0, F.sum("actual_group_sales_y3_eur") / F.sum("group_model_expected_eur")).otherwise(1.0).alias("f")
    ).scalar()
    out = groups.withColumns(
        {
            "global_calibration_factor": overall,
            "raw_calibration_factor": nm.ratio(F.col("actual_group_sales_y3_eur"), F.col("group_model_expected_eur")),
            "calibration_credibility": F.greatest(
                nm.clip(F.col("buyers") / 50.0, 0, 1), nm.clip(F.col("actual_group_sales_y3_eur") / 250000.0, 0, 1)
            ),
        }
    )
    cred = F.col("calibration_credibility")
    factor = F.coalesce("raw_calibration_factor", "global_calibration_factor") * cred + F.col("global_calibration_factor") * (1.0 - cred)
    return out.withColumns(
        {
            "group_calibration_factor": nm.clip(factor, 0.25, 6.0),
            "calibration_method": F.when(cred >= 0.80, "group_specific_high_confidence").when(cred >= 0.40, "group_specific_smoothed").otherwise("global_ratio_heavily_smoothed"),
        }
    )


def calibrated_grid(grid: DataFrame, calibration: DataFrame) -> DataFrame:
    facts = calibration.select("product_group", "group_calibration_factor", "raw_calibration_factor", "calibration_credibility", "calibration_method")
    out = grid.join(facts, "product_group", "left").withColumn(
        "group_calibrated_expected_eur", F.col("group_model_expected_eur") * F.col("group_calibration_factor")
    )
    return out.withColumns(
        {
            "group_calibrated_error_eur": F.col("group_calibrated_expected_eur") - F.col("actual_group_sales_y3_eur"),
            # nobody in a row of others bought anything
            "calibrated_absolute_error_eur": F.when(F.col("business_id").isNull(), F.col("absolute_error_eur") * F.col("group_calibration_factor")).otherwise(
                F.abs(F.col("group_calibrated_expected_eur") - F.col("actual_group_sales_y3_eur"))),
            "recommended_group_calibrated_expected_eur": F.col("recommended_group_expected_potential_eur") * F.col("group_calibration_factor"),
        }
    )


def group_summary(grid: DataFrame) -> DataFrame:
    """Per group: buyers, sums, errors before and after calibration, improvement."""
    out = grid.groupBy("product_group").agg(
        F.sum("customers").alias("customers"), F.count_if(F.col("actual_group_sales_y3_eur") > 0).alias("buyers"),
        *[F.sum(c).alias(c) for c in ("actual_group_sales_y3_eur", "group_model_expected_eur", "group_calibrated_expected_eur", "recommended_group_expected_potential_eur", "recommended_group_calibrated_expected_eur")],
        F.max("group_calibration_factor").alias("group_calibration_factor"), F.max("calibration_method").alias("calibration_method"),
        (F.sum("absolute_error_eur") / F.sum("customers")).alias("mae_eur"), (F.sum("calibrated_absolute_error_eur") / F.sum("customers")).alias("calibrated_mae_eur"),
    )
    bias, calibrated = F.col("group_model_expected_eur") - F.col("actual_group_sales_y3_eur"), F.col("group_calibrated_expected_eur") - F.col("actual_group_sales_y3_eur")
    return out.withColumns(
        {
            "buyer_rate": F.col("buyers") / F.col("customers"), "bias_eur": bias, "calibrated_bias_eur": calibrated,
            "bias_improvement_pct": 1.0 - nm.ratio(F.abs(calibrated), F.nullif(F.abs(bias), F.lit(0.0))),
            "mae_improvement_pct": 1.0 - nm.ratio(F.col("calibrated_mae_eur"), F.nullif(F.col("mae_eur"), F.lit(0.0))),
        }
    )


def calibrated_recommendations(recommendations: DataFrame, calibration: DataFrame) -> DataFrame:
    """Recommendations with calibrated euros, ranked again inside each customer (few rows each)."""
    overall = calibration.agg(
        F.when(F.sum("group_model_expected_eur") > 0, F.sum("actual_group_sales_y3_eur") / F.sum("group_model_expected_eur")).otherwise(1.0).alias("f")
    ).scalar()
    out = recommendations.join(calibration.select("product_group", "group_calibration_factor", "calibration_method"), "product_group", "left").withColumns(
        {
            "group_calibration_factor": nm.clip(F.coalesce("group_calibration_factor", overall), 0.25, 6.0),
            "calibration_method": F.coalesce("calibration_method", F.lit("global_factor_for_unseen_group")),
        }
    )
    out = out.withColumn(
        "recommended_group_calibrated_expected_eur", nm.zero_if_null(F.col("recommended_group_expected_potential_eur")) * F.col("group_calibration_factor")
    )
    most = recommendations.agg(F.max("recommendation_rank").alias("m")).first()["m"] or 1
    return top_n(out, ["business_id"], [("recommended_group_calibrated_expected_eur", "desc"), ("product_group", "asc")], int(most), "calibrated_recommendation_rank")


def potential_case(forecast: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Forecast plus a limited share of the white space: realistic and upside potential, action text."""
    top = recommendations.withColumn("_v", F.greatest(nm.zero_if_null(F.col("recommended_group_calibrated_expected_eur")), F.lit(0.0))).filter(
        F.col("calibrated_recommendation_rank") <= 10
    )
    named = F.array_sort(F.collect_list(F.when(F.col("calibrated_recommendation_rank") <= 3, F.struct("calibrated_recommendation_rank", "product_group"))))
    pool = top.groupBy("business_id").agg(  # at most ten rows per customer
        F.sum("_v").alias("product_group_growth_pool_eur"), F.count_distinct("product_group").alias("recommended_product_group_count"),
        F.array_join(F.transform(named, lambda x: x["product_group"]), ", ").alias("top_recommended_product_groups"),
    )
    frame = forecast.join(pool, "business_id", "left").withColumns(
        {
            "product_group_growth_pool_eur": nm.zero_if_null(F.col("product_group_growth_pool_eur")),
            "recommended_product_group_count": F.coalesce("recommended_product_group_count", F.lit(0)),
            "top_recommended_product_groups": F.coalesce("top_recommended_product_groups", F.lit("")),
        }
    )
    chance = nm.clip(nm.zero_if_null(F.col("improved_probability_of_growth")), 0, 1)
    actual = F.greatest(nm.zero_if_null(F.col("actual_sales_y3_eur")), F.lit(0.0))
    reference = F.greatest(nm.zero_if_null(F.col("next_year_forecast_eur")), actual)
    priority = F.col("priority")
    cap = F.greatest(reference * bk.by_priority(priority, bk.PRIORITY_CAP_PCT, 0.25), bk.by_priority(priority, bk.PRIORITY_CAP_FLOOR, 5000.0))
    pooled = F.col("product_group_growth_pool_eur")
    growth = pooled * bk.by_priority(priority, bk.PRIORITY_MULTIPLIER, 0.55) * nm.clip(0.70 + chance, 0.75, 1.35)
    out = frame.withColumns(
        {
            "sales_potential_reference_eur": reference, "growth_potential_eur": F.greatest(F.least(growth, cap), F.lit(0.0)),
            "upside_potential_eur": reference + F.greatest(F.least(pooled, cap * 1.50), F.lit(0.0)),
        }
    ).withColumn("realistic_potential_eur", F.col("sales_potential_reference_eur") + F.col("growth_potential_eur"))
    return out.withColumns(
        {
            "growth_opportunity_pct": nm.ratio(F.col("growth_potential_eur"), F.nullif(F.col("sales_potential_reference_eur"), F.lit(0.0))),
            "realistic_potential_vs_actual_eur": F.col("realistic_potential_eur") - actual,
            "recommended_growth_action": F.when((F.col("sales_y4_ytd_eur") <= 0) & (actual > 0), "Reactivate customer and test top product groups")
            .when(F.col("growth_potential_eur") > 25000, "Expand into top recommended product groups")
            .when(F.col("growth_potential_eur") > 5000, "Target selected white-space product groups").otherwise("Maintain base sales and monitor opportunity"),
        }
    )


def regression_metrics(frame: DataFrame, predicted: str, label: str, *, actual: str = "actual_sales_y3_eur") -> DataFrame:
    """One row: bias, MAE, RMSE, median absolute error, MAPE over 100, correlation."""
    p, a = nm.zero_if_null(F.col(predicted)), F.col(actual)
    rows = frame.select(p.alias("_p"), a.alias("_a"), F.abs(p - a).alias("_e"))
    middle = exact_quantiles(rows, [], "_e", [0.5]).select("value").scalar()
    return rows.agg(
        F.lit(label).alias("model"), F.count("*").alias("customers"), F.sum("_a").alias("actual_eur"), F.sum("_p").alias("predicted_eur"),
        (F.sum("_p") - F.sum("_a")).alias("bias_eur"), F.avg("_e").alias("mae_eur"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_eur"),
        F.avg(F.when(F.col("_a") > 100, F.col("_e") / F.col("_a"))).alias("mape_over_100eur"),
        F.when((F.min("_p") < F.max("_p")) & (F.min("_a") < F.max("_a")), F.corr("_p", "_a")).alias("correlation"),
    ).withColumn("median_abs_error_eur", middle)
