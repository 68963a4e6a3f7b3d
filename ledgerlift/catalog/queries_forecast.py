"""Queries for forecast, backtest and CRM validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import CTES, accounts, crm_potentials, sales_lines, sql
from ledgerlift.catalog.queries_features import Y3, history_frame, history_lines, scored_customers
from ledgerlift.catalog.queries_recommend import product_master, product_sales
from ledgerlift.catalog.queries_scalar import name_of_account_sql
from ledgerlift.catalog.registry import query
from ledgerlift.plans import backtest as bt
from ledgerlift.plans import crm as cr
from ledgerlift.plans import features as ft
from ledgerlift.plans import forecast as fc
from ledgerlift.plans import recommend as rc
from ledgerlift.session import stage

# the backtest frame: history, forward features and model signals, with a stand-in for the trained estimate
CTES["back"] = (("forward", "custs"), """
SELECT f.*, c.priority, c.company_segment, coalesce(c.score, 0) AS score, coalesce(c.expected_potential_eur, 0) AS current_model_expected_eur,
 least(greatest(coalesce(c.probability_of_growth, 0) * 0.8 + 0.05, 0.01), 0.99) AS improved_probability_of_growth,
 coalesce(c.probability_of_growth, 0) AS current_probability_of_growth, 0.6 * sales_y2_eur + 0.4 * sales_y1_eur AS improved_expected_sales_eur
FROM forward f LEFT JOIN custs c USING (business_id)""")


def back_frame(spark, sf):
    frame = ft.with_current_model(ft.forward_features(history_frame(spark, sf), sales_lines(spark, sf), y3=Y3), scored_customers(spark, sf))
    chance = F.least(F.greatest(F.col("current_probability_of_growth") * 0.8 + 0.05, F.lit(0.01)), F.lit(0.99))
    return frame.withColumns({
        "score": F.coalesce("score", F.lit(0.0)), "improved_probability_of_growth": chance,
        "improved_expected_sales_eur": 0.6 * F.col("sales_y2_eur") + 0.4 * F.col("sales_y1_eur"),
        "calibrated_probability": chance,
    })


CTES["nyf"] = (("back",), """
SELECT *, next_year_forecast_eur - actual_sales_y3_eur AS next_year_vs_actual_eur, (next_year_forecast_eur - actual_sales_y3_eur) / nullif(actual_sales_y3_eur, 0) AS next_year_vs_actual_pct FROM
(SELECT *, greatest(CASE WHEN sales_y1_eur + sales_y2_eur + actual_sales_y3_eur + sales_y4_ytd_eur <= 0 THEN improved_expected_sales_eur * 0.25
  WHEN recent_weighted_sales_base_eur * mult <= 0 AND improved_expected_sales_eur > 0 THEN improved_expected_sales_eur * 0.35 ELSE recent_weighted_sales_base_eur * mult END, 0) AS next_year_forecast_eur
 FROM (SELECT *, least(greatest((1 + (least(greatest(improved_probability_of_growth, 0.01), 0.99) - 0.5) * 0.18) * (1 + (least(greatest(score, 0), 1) - 0.5) * 0.10)
  * (1 + (least(greatest(recent_vs_older_ratio, 0.6), 1.8) - 1) * 0.18 + (least(greatest(ytd_vs_y3_ratio, 0.6), 1.8) - 1) * 0.12), 0.75), 1.35) AS mult FROM back))""")


@query("fc_01_next_year_forecast", sql("nyf", """
SELECT business_id, round(mult, 8) AS next_year_growth_multiplier, round(next_year_forecast_eur, 2) AS next_year_forecast_eur, round(next_year_vs_actual_pct, 6) AS next_year_vs_actual_pct,
 CASE WHEN next_year_vs_actual_pct > 0.1 THEN 'growth_vs_last_year' WHEN next_year_vs_actual_pct < -0.1 THEN 'lower_than_last_year' ELSE 'near_last_year_level' END AS forecast_interpretation FROM nyf"""))
def _(spark, sf):
    return bt.next_year_forecast(back_frame(spark, sf)).select(
        "business_id", F.round("next_year_growth_multiplier", 8).alias("next_year_growth_multiplier"), F.round("next_year_forecast_eur", 2).alias("next_year_forecast_eur"),
        F.round("next_year_vs_actual_pct", 6).alias("next_year_vs_actual_pct"), "forecast_interpretation",
    )


_CAL = {
    "gm": """SELECT business_id, coalesce(product_group, 'Tuntematon tuoteryhmä') AS product_group, year(sold_on) AS y, month(sold_on) AS m, sum(total_value) AS v FROM hist
 WHERE business_id IS NOT NULL AND total_value > 0 AND year(sold_on) BETWEEN 1998 AND 2001 AND sold_on < DATE '2001-08-01' GROUP BY ALL""",
    "su": """SELECT business_id, product_group, coalesce(sum(v) FILTER (y = 1998), 0) AS a, coalesce(sum(v) FILTER (y = 1999), 0) AS b, coalesce(sum(v) FILTER (y = 2000), 0) AS c, coalesce(sum(v) FILTER (y = 2001), 0) AS ytd FROM gm GROUP BY 1, 2""",
    "an": """SELECT *, greatest(base * (0.7 + 0.3 * trend), 0) AS annual FROM (SELECT *, CASE WHEN ytd > 0 THEN 0.7 * hb + 0.3 * ytd / 7 * 12 ELSE hb END AS base, CASE WHEN b > 0 THEN least(greatest(c / b, 0.75), 1.25) ELSE 1 END AS trend FROM
 (SELECT *, coalesce((0.1 * a + 0.3 * b + 0.6 * c) / nullif(CASE WHEN a > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN b > 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c > 0 THEN 0.6::DOUBLE ELSE 0 END, 0), 0) AS hb FROM su))""",
    "se": """SELECT product_group, m, avg(sh) AS sh FROM (SELECT product_group, y, m, sum(v) / sum(sum(v)) OVER (PARTITION BY product_group, y) AS sh FROM gm WHERE y <= 2000 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "sn": "SELECT product_group, m, sh / sum(sh) OVER (PARTITION BY product_group) AS sh FROM se",
    "x": """SELECT an.*, g.m, coalesce(sn.sh, 1.0 / 12) AS sh FROM an CROSS JOIN (SELECT unnest(range(1, 13)) AS m) g LEFT JOIN sn ON sn.product_group = an.product_group AND sn.m = g.m""",
}


def _calendar(spark, sf):
    lines = history_lines(spark, sf).filter(F.col("sold_on") < F.lit("2001-08-01").cast("date")).select(
        "business_id", F.coalesce("product_group", F.lit(fc.UNKNOWN_GROUP)).alias("product_group"), "sold_on", F.col("total_value").alias("sales_eur")
    )
    return fc.calendar_forecast(lines, reference_year=2001, reference_month=8)


@query("fc_02_calendar_forecast", sql("hist", """
SELECT business_id, product_group, m::INTEGER AS forecast_month, round(sh / sum(sh) OVER (PARTITION BY business_id, product_group), 8) AS seasonal_share,
 round(annual * sh / sum(sh) OVER (PARTITION BY business_id, product_group), 2) AS forecast_sales_eur FROM x""", _CAL))
def _(spark, sf):
    _, monthly = _calendar(spark, sf)
    return monthly.select("business_id", "product_group", "forecast_month", F.round("seasonal_share", 8).alias("seasonal_share"), F.round("forecast_sales_eur", 2).alias("forecast_sales_eur"))


@query("fc_02_calendar_potential", sql("hist custs", """
SELECT business_id, round(p, 2) AS potential_next_calendar_year_eur, round(greatest(p - expected_potential_eur, 0), 2) AS potential_growth_calendar_year_eur FROM
(SELECT c.business_id, c.expected_potential_eur, coalesce(sum(annual), 0) AS p FROM custs c LEFT JOIN an USING (business_id) GROUP BY 1, 2)""", _CAL))
def _(spark, sf):
    annual, _ = _calendar(spark, sf)
    customers = scored_customers(spark, sf).withColumn("current_sales_eur", F.col("expected_potential_eur"))
    return fc.add_calendar_potential(customers, annual).select(
        "business_id", F.round("potential_next_calendar_year_eur", 2).alias("potential_next_calendar_year_eur"),
        F.round("potential_growth_calendar_year_eur", 2).alias("potential_growth_calendar_year_eur"),
    )


_BINS = ", ".join(f"quantile_cont(current_probability_of_growth, {i / 10})" for i in range(11))


@query("bt_01_calibration_table", sql("back", f"""
SELECT bin::INTEGER AS probability_bin, count(*) AS customers, round(avg(current_probability_of_growth), 8) AS avg_raw_probability, round(avg(improved_probability_of_growth), 8) AS avg_calibrated_probability,
 round(avg(grew_y3), 8) AS observed_rate, round(sum(actual_sales_y3_eur), 2) AS actual_sales_y3_eur FROM (
SELECT b.*, greatest(len(list_filter(e, lambda x : x < round(current_probability_of_growth, 12))), 1) AS bin FROM back b, (SELECT list_sort(list_distinct(list_transform([{_BINS}], lambda x : round(x, 12)))) AS e FROM back)) GROUP BY 1"""))
def _(spark, sf):
    frame = stage(back_frame(spark, sf).withColumn("current_probability_of_growth", F.round("current_probability_of_growth", 12)), "back")
    edges = bt.bin_edges(frame, "current_probability_of_growth").select(F.array_distinct(F.transform("edges", lambda x: F.round(x, 12))).alias("edges"))
    binned = bt.add_bin(frame, "current_probability_of_growth", edges)
    return binned.groupBy("probability_bin").agg(
        F.count("*").alias("customers"), F.round(F.avg("current_probability_of_growth"), 8).alias("avg_raw_probability"),
        F.round(F.avg("improved_probability_of_growth"), 8).alias("avg_calibrated_probability"), F.round(F.avg("grew_y3"), 8).alias("observed_rate"),
        F.round(F.sum("actual_sales_y3_eur"), 2).alias("actual_sales_y3_eur"),
    )


@query("bin_09_quantile_bins", """
SELECT greatest(len(list_filter(e, lambda x : x < o_totalprice)), 1)::INTEGER AS price_bin, count(*) AS n, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders,
 (SELECT list_sort(list_distinct([%s])) AS e FROM orders) GROUP BY 1""" % ", ".join(f"quantile_cont(o_totalprice, {i / 10})" for i in range(11)))
def _(spark, sf):
    from ledgerlift.catalog.bindings import table

    o = table(spark, sf, "orders").select("o_totalprice")
    return bt.add_bin(o, "o_totalprice", bt.bin_edges(o, "o_totalprice"), "price_bin").groupBy("price_bin").agg(
        F.count("*").alias("n"), F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest")
    )


_ERR = """SELECT *, CASE WHEN abs(err) <= greatest(1000, actual_sales_y3_eur * 0.2) THEN 'good_fit' WHEN err > greatest(5000, actual_sales_y3_eur * 0.5) THEN 'model_over_high' WHEN err < -greatest(5000, actual_sales_y3_eur * 0.5) THEN 'model_under_high'
 WHEN actual_sales_y3_eur = 0 AND improved_expected_sales_eur > 5000 THEN 'no_actual_sales_high_prediction' ELSE 'medium_error' END AS error_bucket FROM (SELECT *, improved_expected_sales_eur - actual_sales_y3_eur AS err FROM back)"""


@query("bt_02_error_analysis", sql("back", f"SELECT business_id, round(err, 4) AS model_error_eur, error_bucket FROM ({_ERR})"))
def _(spark, sf):
    return bt.error_analysis(back_frame(spark, sf)).select("business_id", F.round("model_error_eur", 4).alias("model_error_eur"), "error_bucket")


@query("bt_02_feedback_template", sql("back", f"SELECT business_id, error_bucket, '' AS sales_notes FROM ({_ERR}) ORDER BY abs(err) DESC, business_id LIMIT 500"))
def _(spark, sf):
    return bt.feedback_template(bt.error_analysis(back_frame(spark, sf))).select("business_id", "error_bucket", "sales_notes")


_GRID = {
    "gy": "SELECT business_id, product_group, coalesce(sum(total_value) FILTER (year(sold_on) = 1999), 0) AS s2, coalesce(sum(total_value) FILTER (year(sold_on) = 2000), 0) AS s3 FROM hist WHERE business_id IS NOT NULL AND product_group IS NOT NULL AND year(sold_on) IN (1999, 2000) GROUP BY 1, 2",
    "tg": "SELECT DISTINCT product_group FROM gy",
    "g0": """SELECT b.business_id, b.company_segment, b.sales_y2_eur, tg.product_group, coalesce(gy.s2, 0) AS s2, coalesce(gy.s3, 0) AS s3, coalesce(coalesce(gy.s2, 0) / nullif(b.sales_y2_eur, 0), 0) AS own, gy.business_id IS NOT NULL AS listed FROM back b CROSS JOIN tg
 LEFT JOIN gy ON gy.business_id = b.business_id AND gy.product_group = tg.product_group""",
    "pe": "SELECT company_segment, product_group, coalesce(sum(s2) / nullif(sum(sales_y2_eur), 0), 0) AS peer FROM g0 WHERE company_segment IS NOT NULL GROUP BY 1, 2",
    "grid": "SELECT g0.*, greatest(peer - own, 0) AS gap, sales_y2_eur * greatest(peer - own, 0) AS expected, CASE WHEN g0.company_segment LIKE '1-5M%' THEN 100.0::DOUBLE ELSE 0 END AS rec FROM g0 LEFT JOIN pe USING (company_segment, product_group)",
    "cal0": "SELECT product_group, count(*) AS customers, count_if(s3 > 0)::BIGINT AS buyers, sum(s3) AS actual, sum(expected) AS expected FROM grid GROUP BY 1",
    "cal": """SELECT *, least(greatest(coalesce(actual / nullif(expected, 0), gf) * cred + gf * (1 - cred), 0.25), 6) AS factor FROM (SELECT *, (SELECT sum(actual) / sum(expected) FROM cal0) AS gf,
 greatest(least(greatest(buyers / 50.0::DOUBLE, 0), 1), least(greatest(actual / 250000, 0), 1)) AS cred FROM cal0)""",
}


def group_grid(spark, sf):
    frame = stage(back_frame(spark, sf).select("business_id", "company_segment", "sales_y2_eur", "actual_sales_y3_eur"), "back")
    grouped = history_lines(spark, sf).select("business_id", "product_group", F.year("sold_on").alias("year"), F.col("total_value").alias("sales_eur"))
    rec = grouped.filter(F.col("product_group").isNotNull() & (F.col("year") == 1999)).select("business_id", "product_group").distinct().withColumns(
        {"recommended_group_expected_potential_eur": F.lit(100.0), "recommendation_rank": F.lit(1)}
    )
    return stage(bt.group_model(grouped, frame, rec, y2=1999, y3=2000), "group-grid")


@query("bt_03_group_grid", sql("hist back", """
SELECT business_id, company_segment, product_group, count(*)::BIGINT AS customers, round(sum(s2), 4) AS customer_group_sales_y2_eur, round(any_value(own), 9) AS customer_group_share_y2, round(any_value(gap), 9) AS white_space_gap_y2,
 round(sum(expected), 2) AS group_model_expected_eur FROM (
SELECT CASE WHEN listed THEN business_id END AS business_id, CASE WHEN listed OR known THEN company_segment END AS company_segment, product_group, s2, own, gap, expected FROM (
 SELECT *, company_segment IS NOT NULL AND bool_or(listed) OVER (PARTITION BY company_segment, product_group) AS known FROM grid)) GROUP BY ALL""", {k: v for k, v in _GRID.items() if not k.startswith("cal")}))
def _(spark, sf):
    return group_grid(spark, sf).select(
        "business_id", "company_segment", "product_group", "customers", F.round("customer_group_sales_y2_eur", 4).alias("customer_group_sales_y2_eur"), F.round("customer_group_share_y2", 9).alias("customer_group_share_y2"),
        F.round("white_space_gap_y2", 9).alias("white_space_gap_y2"), F.round("group_model_expected_eur", 2).alias("group_model_expected_eur"),
    )


@query("bt_04_group_calibration", sql("hist back", """
SELECT product_group, customers, buyers, round(actual / nullif(expected, 0), 6) AS raw_calibration_factor, round(cred, 9) AS calibration_credibility, round(factor, 6) AS group_calibration_factor,
 CASE WHEN cred >= 0.8 THEN 'group_specific_high_confidence' WHEN cred >= 0.4 THEN 'group_specific_smoothed' ELSE 'global_ratio_heavily_smoothed' END AS calibration_method FROM cal""", _GRID))
def _(spark, sf):
    return bt.group_calibration(group_grid(spark, sf)).select(
        "product_group", "customers", "buyers", F.round("raw_calibration_factor", 6).alias("raw_calibration_factor"), F.round("calibration_credibility", 9).alias("calibration_credibility"),
        F.round("group_calibration_factor", 6).alias("group_calibration_factor"), "calibration_method",
    )


@query("bt_05_group_summary", sql("hist back", """
SELECT product_group, count(*) AS customers, round(sum(expected * factor), 2) AS group_calibrated_expected_eur, round(avg(abs(expected - s3)), 3) AS mae_eur, round(avg(abs(expected * factor - s3)), 3) AS calibrated_mae_eur,
 round(1 - abs(sum(expected * factor) - sum(s3)) / nullif(abs(sum(expected) - sum(s3)), 0), 5) AS bias_improvement_pct FROM grid JOIN (SELECT product_group, factor FROM cal) USING (product_group) GROUP BY 1""", _GRID))
def _(spark, sf):
    grid = group_grid(spark, sf)
    calibration = stage(bt.group_calibration(grid), "calibration")
    out = bt.group_summary(bt.calibrated_grid(grid, calibration))
    return out.select(
        "product_group", "customers", F.round("group_calibrated_expected_eur", 2).alias("group_calibrated_expected_eur"), F.round("mae_eur", 3).alias("mae_eur"),
        F.round("calibrated_mae_eur", 3).alias("calibrated_mae_eur"), F.round("bias_improvement_pct", 5).alias("bias_improvement_pct"),
    )


# potential case on group recommendations made from last year's group sales
_CASE = {
    "rec": """SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY v DESC, product_group) AS rk FROM (SELECT business_id, product_group, sum(amount) * 20 AS v FROM hist WHERE business_id IS NOT NULL AND product_group IS NOT NULL GROUP BY 1, 2)""",
    "pool": """SELECT business_id, sum(v) AS pool, count(*) AS cnt, array_to_string(list(product_group ORDER BY rk) FILTER (rk <= 3), ', ') AS names FROM rec WHERE rk <= 10 GROUP BY 1""",
    "c0": """SELECT n.*, coalesce(pool, 0) AS pool, coalesce(cnt, 0) AS cnt, coalesce(names, '') AS names, greatest(next_year_forecast_eur, actual_sales_y3_eur) AS ref,
 CASE priority WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.85 WHEN 'C' THEN 0.65 WHEN 'D' THEN 0.45 ELSE 0.55 END AS mul, CASE priority WHEN 'A' THEN 0.6::DOUBLE WHEN 'B' THEN 0.45 WHEN 'C' THEN 0.3 WHEN 'D' THEN 0.2 ELSE 0.25 END AS pct,
 CASE priority WHEN 'A' THEN 15000.0::DOUBLE WHEN 'B' THEN 10000 WHEN 'C' THEN 6000 WHEN 'D' THEN 3000 ELSE 5000 END AS flo FROM nyf n LEFT JOIN pool USING (business_id)""",
    "c1": """SELECT *, ref + gp AS realistic, ref + least(pool, greatest(ref * pct, flo) * 1.5) AS upside FROM (SELECT *, least(pool * mul * least(greatest(0.7 + improved_probability_of_growth, 0.75), 1.35), greatest(ref * pct, flo)) AS gp FROM c0)""",
}


def case_frame(spark, sf):
    grouped = history_lines(spark, sf).filter(F.col("business_id").isNotNull() & F.col("product_group").isNotNull()).groupBy("business_id", "product_group").agg(
        (F.sum("amount") * 20).alias("recommended_group_calibrated_expected_eur")
    )
    from ledgerlift.operators.ranking import top_n

    rec = top_n(grouped, ["business_id"], [("recommended_group_calibrated_expected_eur", "desc"), ("product_group", "asc")], 10, "calibrated_recommendation_rank")
    return bt.potential_case(bt.next_year_forecast(back_frame(spark, sf)), rec)


@query("bt_06_potential_case", sql("nyf hist", """
SELECT business_id, round(gp, 4) AS growth_potential_eur, round(realistic, 4) AS realistic_potential_eur, round(upside, 4) AS upside_potential_eur, cnt AS recommended_product_group_count, names AS top_recommended_product_groups,
 CASE WHEN sales_y4_ytd_eur <= 0 AND actual_sales_y3_eur > 0 THEN 'Reactivate customer and test top product groups' WHEN gp > 25000 THEN 'Expand into top recommended product groups'
  WHEN gp > 5000 THEN 'Target selected white-space product groups' ELSE 'Maintain base sales and monitor opportunity' END AS recommended_growth_action FROM c1""", _CASE))
def _(spark, sf):
    return case_frame(spark, sf).select(
        "business_id", F.round("growth_potential_eur", 4).alias("growth_potential_eur"), F.round("realistic_potential_eur", 4).alias("realistic_potential_eur"),
        F.round("upside_potential_eur", 4).alias("upside_potential_eur"), "recommended_product_group_count", "top_recommended_product_groups", "recommended_growth_action",
    )


@query("ml_10_regression_metrics", sql("back", """
SELECT 'history' AS model, count(*) AS customers, round(sum(improved_expected_sales_eur) - sum(actual_sales_y3_eur), 2) AS bias_eur, round(avg(abs(improved_expected_sales_eur - actual_sales_y3_eur)), 4) AS mae_eur,
 round(sqrt(avg(power(improved_expected_sales_eur - actual_sales_y3_eur, 2))), 4) AS rmse_eur, round(median(abs(improved_expected_sales_eur - actual_sales_y3_eur)), 4) AS median_abs_error_eur,
 round(corr(improved_expected_sales_eur, actual_sales_y3_eur), 8) AS correlation FROM back"""))
def _(spark, sf):
    out = bt.regression_metrics(stage(back_frame(spark, sf), "back"), "improved_expected_sales_eur", "history")
    return out.select(
        "model", "customers", F.round("bias_eur", 2).alias("bias_eur"), F.round("mae_eur", 4).alias("mae_eur"), F.round("rmse_eur", 4).alias("rmse_eur"),
        F.round("median_abs_error_eur", 4).alias("median_abs_error_eur"), F.round("correlation", 8).alias("correlation"),
    )


@query("bt_07_backtest_summary", sql("back", """
SELECT model, customers, round(bias, 2) AS bias_eur, round(mae, 4) AS mae_eur FROM (
SELECT 'current_model_expected' AS model, count(*) AS customers, sum(current_model_expected_eur) - sum(actual_sales_y3_eur) AS bias, avg(abs(current_model_expected_eur - actual_sales_y3_eur)) AS mae FROM back
UNION ALL SELECT 'history_feature_model', count(*), sum(improved_expected_sales_eur) - sum(actual_sales_y3_eur), avg(abs(improved_expected_sales_eur - actual_sales_y3_eur)) FROM back
UNION ALL SELECT 'input_customers', count(*), NULL, NULL FROM back)"""))
def _(spark, sf):
    frame = stage(back_frame(spark, sf), "back")
    rows = bt.regression_metrics(frame, "current_model_expected_eur", "current_model_expected").unionByName(
        bt.regression_metrics(frame, "improved_expected_sales_eur", "history_feature_model")
    ).unionByName(frame.agg(F.lit("input_customers").alias("model"), F.count("*").alias("customers")), allowMissingColumns=True)
    return rows.select("model", "customers", F.round("bias_eur", 2).alias("bias_eur"), F.round("mae_eur", 4).alias("mae_eur"))


_CRM = {
    "r": f"SELECT *, {name_of_account_sql('name')} AS nk, coalesce(sales, 0) AS s, least(greatest(coalesce(CASE WHEN probability > 1 THEN probability / 100 ELSE probability END, 0), 0), 1) AS ch FROM crm",
    "n": "SELECT nk, count(*) AS rows_n, sum(s) AS s, sum(s * ch) AS e, max(ch) AS mx, list(DISTINCT status) FILTER (status IS NOT NULL) AS st FROM r WHERE nk <> '' GROUP BY 1",
    "a": f"SELECT nk, min(business_id) AS business_id, count(DISTINCT business_id) > 1 AS amb FROM (SELECT {name_of_account_sql('account_name')} AS nk, business_id FROM acc WHERE business_id IS NOT NULL) WHERE nk <> '' GROUP BY 1",
    "cb": """SELECT business_id, sum(rows_n)::BIGINT AS crm_source_row_count, sum(s) AS crm_sales_eur, sum(e) AS crm_expected_sales_eur, array_to_string(list_sort(list_distinct(flatten(list(st)))), ', ') AS crm_statuses,
 CASE WHEN bool_or(amb) THEN 'name_match_ambiguous' ELSE 'name_match_unique' END AS q FROM n JOIN a USING (nk) GROUP BY 1""",
}


@query("cr_01_crm_validation", sql("crm acc custs", """
SELECT c.business_id, cb.business_id IS NOT NULL AS crm_found, coalesce(crm_source_row_count, 0) AS crm_source_row_count, coalesce(q, 'missing_in_crm') AS crm_match_quality, coalesce(crm_statuses, '') AS crm_statuses,
 round(CASE WHEN crm_expected_sales_eur > o THEN crm_expected_sales_eur ELSE o END, 4) AS crm_validated_potential_eur,
 CASE WHEN cb.business_id IS NULL THEN 'missing_in_crm_kept_original' WHEN crm_expected_sales_eur > o * 1.2 THEN 'model_may_be_too_low' WHEN o > crm_expected_sales_eur * 1.2 THEN 'model_above_crm_pipeline' ELSE 'aligned_with_crm' END AS crm_validation_status
FROM (SELECT business_id, expected_potential_eur / 25 AS o FROM custs) c LEFT JOIN cb USING (business_id)""", _CRM))
def _(spark, sf):
    case = scored_customers(spark, sf).select("business_id", (F.col("expected_potential_eur") / 25).alias("realistic_potential_eur"))
    return cr.crm_validation(case, crm_potentials(spark, sf), accounts(spark, sf)).select(
        "business_id", "crm_found", "crm_source_row_count", "crm_match_quality", "crm_statuses", F.round("crm_validated_potential_eur", 4).alias("crm_validated_potential_eur"), "crm_validation_status"
    )


@query("cr_02_model_vs_crm", sql("crm custs acc", """
WITH k AS (SELECT business_id, sum(sales * coalesce(CASE WHEN probability > 1 THEN probability / 100 ELSE probability END, 1)) AS crm_potential_eur FROM crm WHERE business_id IS NOT NULL GROUP BY 1),
j AS (SELECT business_id, crm_potential_eur, expected_potential_eur / 25 AS m, expected_potential_eur / 25 - crm_potential_eur AS d, greatest(abs(crm_potential_eur) * 0.1, 1000) AS band FROM k LEFT JOIN custs USING (business_id))
SELECT business_id, round(d, 4) AS potential_diff_eur, CASE WHEN m IS NULL THEN 'missing_in_model' WHEN abs(d) <= band THEN 'exact_or_close' WHEN d > band THEN 'model_higher' ELSE 'crm_higher' END AS validation_match_status FROM j
UNION ALL SELECT business_id, NULL, 'missing_in_crm' FROM custs WHERE business_id IN (SELECT business_id FROM acc) AND business_id NOT IN (SELECT business_id FROM k)"""))
def _(spark, sf):
    from ledgerlift.functions.numbers import share_of_one
    from ledgerlift.operators.lookup import flag_member

    crm = crm_potentials(spark, sf).filter(F.col("business_id").isNotNull()).groupBy("business_id").agg(
        F.sum(F.col("sales") * share_of_one(F.col("probability"))).alias("crm_potential_eur")
    )
    scored = scored_customers(spark, sf)
    customers = crm.join(scored.select("business_id", (F.col("expected_potential_eur") / 25).alias("model_estimated_potential_eur")), "business_id", "left")
    every = flag_member(scored, "business_id", accounts(spark, sf), "business_id", "is_account_customer")
    return cr.model_vs_crm(customers, every).select("business_id", F.round("potential_diff_eur", 4).alias("potential_diff_eur"), "validation_match_status")
