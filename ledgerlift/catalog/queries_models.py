"""Queries for trained models; only the metrics are plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import accounts, exclusions, sql, table
from ledgerlift.catalog.queries_features import eligible_history, scored_customers
from ledgerlift.catalog.queries_forecast import back_frame
from ledgerlift.catalog.queries_targets import months_and_accounts, weighted_model
from ledgerlift.catalog.registry import query
from ledgerlift.plans import models as ml
from ledgerlift.plans import potential as po
from ledgerlift.plans import targets as tg
from ledgerlift.session import stage

HISTORY = ["sales_y1_eur", "sales_y2_eur", "active_months_y2", "order_rows_y2", "sales_momentum", "h2_vs_h1", "days_since_last_purchase", "product_group_count_y2"]


def _customers(spark, sf):
    return weighted_model(spark, sf).filter("current_customer = 1")


@query("ml_01_preprocess")
def _(spark, sf):
    model = weighted_model(spark, sf)
    trained = ml.train(model.filter("current_customer = 1"))
    return trained.features(model).select("business_id", F.size(ml.vector_to_array("features")).alias("feature_count"))


@query("ml_02_lookalike_score")
def _(spark, sf):
    """The whole way: targets, label, training on customers, score for every company, ranked prospects."""
    model = weighted_model(spark, sf)
    trained = ml.train(model.filter("current_customer = 1"))
    return po.rank_prospects(trained.score(model), model, accounts(spark, sf), exclusions(spark, sf))


@query("ml_02_holdout_metrics")
def _(spark, sf):
    return ml.train_and_evaluate(_customers(spark, sf), "business_id")[1]


@query("ml_03_boosted_trees")
def _(spark, sf):
    model = _customers(spark, sf)
    return ml.train(model, kind="gradient_boosting").score(model).select("business_id", "label", "score")


@query("ml_04_sigmoid_calibration")
def _(spark, sf):
    model = _customers(spark, sf)
    return ml.calibrate_sigmoid(model, "business_id").score(model).select("business_id", "label", "score")


# the best monotone fit at a score is the largest, over starts before it, of the smallest mean from there to any end behind it
@query("ml_05_isotonic_calibration", sql("back", """
SELECT business_id, round(current_probability_of_growth, 9) AS current_probability_of_growth, round(least(greatest(v, 0.01), 0.99), 9) AS calibrated_probability
FROM (SELECT *, least(greatest(coalesce(current_probability_of_growth, 0), 0), 1) AS x FROM back) JOIN iso USING (x)""", {
    "pts": "SELECT least(greatest(coalesce(current_probability_of_growth, 0), 0), 1) AS x, avg(grew_y3)::DOUBLE AS y, count(*)::DOUBLE AS w FROM back GROUP BY 1",
    "sums": "SELECT *, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(w * y) OVER (ORDER BY x) AS cy FROM pts",
    "means": "SELECT a.i AS j, b.i AS k, b.x, (b.cy - a.cy + a.w * a.y) / (b.cw - a.cw + a.w) AS m FROM sums a JOIN sums b ON a.i <= b.i",
    "iso": "SELECT x, max(m) AS v FROM (SELECT j, x, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM means) GROUP BY x",
}))
def _(spark, sf):
    frame = back_frame(spark, sf).select("business_id", "current_probability_of_growth", "grew_y3")
    out = ml.calibrate_isotonic(frame, "current_probability_of_growth", "grew_y3")
    return out.select("business_id", F.round("current_probability_of_growth", 9).alias("current_probability_of_growth"), F.round("calibrated_probability", 9).alias("calibrated_probability"))


@query("ml_06_out_of_fold_forest")
def _(spark, sf):
    frame = back_frame(spark, sf).drop("improved_probability_of_growth", "improved_expected_sales_eur")
    out = ml.out_of_fold(frame, "business_id", HISTORY, label="grew_y3", target="actual_sales_y3_eur")
    return out.select("business_id", "improved_probability_of_growth", "improved_expected_sales_eur")


@query("ml_07_two_stage")
def _(spark, sf):
    m, a = months_and_accounts(spark, sf)
    frame = stage(tg.add_sales_label(weighted_model(spark, sf, (m, a)).drop("sales_3y_total_eur"), tg.buyer_targets(m, a)), "two-stage")
    return ml.two_stage(frame).select("business_id", "purchase_probability", "predicted_buyer_potential_eur", "expected_12m_sales_eur")


@query("sc_08_two_stage_ranking")
def _(spark, sf):
    m, a = months_and_accounts(spark, sf)
    frame = stage(tg.add_sales_label(weighted_model(spark, sf, (m, a)).drop("sales_3y_total_eur"), tg.buyer_targets(m, a)), "two-stage")
    scored = ml.two_stage(frame)
    return po.rank_and_label(scored, "expected_12m_sales_eur").select("business_id", "rank", "priority", "expected_12m_sales_eur")


@query("ml_08_permutation_importance")
def _(spark, sf):
    return ml.forest_importance(back_frame(spark, sf), "business_id", HISTORY, label="grew_y3")


@query("ml_09_classification_metrics", sql("custs", """
WITH d AS (SELECT round(score, 1) AS s, CASE WHEN revenue_k_eur > 60000 THEN 1 ELSE 0 END AS y FROM custs),
g AS (SELECT s, sum(y)::DOUBLE AS p, count(*) AS n FROM d GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS seen, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER () AS tn, sum(p) OVER () AS t FROM g)
SELECT 'roc_auc' AS metric, round((sum(p * (tn - seen + (n + 1) / 2.0::DOUBLE)) - max(t) * (max(t) + 1) / 2) / (max(t) * (max(tn) - max(t))), 9) AS value FROM c
UNION ALL SELECT 'average_precision', round(sum(p / t * tp / seen), 9) FROM c UNION ALL SELECT 'brier_score', round(avg(power(s - y, 2)), 9) FROM d UNION ALL SELECT 'positive_rate', round(avg(y), 9) FROM d UNION ALL SELECT 'rows', count(*)::DOUBLE FROM d
UNION ALL SELECT 'log_loss', round(avg(-(y * ln(least(greatest(s, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)))), 9) FROM d"""))
def _(spark, sf):
    rows = scored_customers(spark, sf).select(F.round("score", 1).alias("score"), F.when(F.col("revenue_k_eur") > 60000, 1).otherwise(0).alias("y"))
    return ml.classification_metrics(rows, "y", "score").withColumn("value", F.round("value", 9))


@query("ml_11_contributions")
def _(spark, sf):
    model = weighted_model(spark, sf)
    trained = ml.train(model.filter("current_customer = 1"))
    return ml.contributions(trained, model).select("business_id", "explanation")
