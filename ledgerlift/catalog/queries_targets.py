"""Queries for targets, segments, features and the potential in euros."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import CTES, accounts, companies, crm_potentials, exclusions, sales_months, sql
from ledgerlift.catalog.queries_scalar import SEGMENT_SQL, name_for_matching_sql
from ledgerlift.catalog.registry import query
from ledgerlift.functions import text as tx
from ledgerlift.plans import potential as po
from ledgerlift.plans import targets as tg
from ledgerlift.session import stage

# --------------------------------------------------------------------------- SQL twins, layered
_ELIGIBLE = "lower(trim(customer_status)) IN ('active', 'active+')"

CTES["esales"] = (("acc", "months"), f"""
SELECT m.*, a.business_id FROM months m JOIN acc a USING (account_id) WHERE a.business_id IS NOT NULL AND {_ELIGIBLE}""")
CTES["targets"] = (("esales",), """
SELECT business_id, sum(total_value) AS sales_3y_total_eur, sum(total_value) / 3.0 AS avg_annual_sales_3y_eur FROM esales
WHERE created_at > (SELECT max(created_at) FROM esales) - 1095 GROUP BY business_id HAVING sum(total_value) / 3.0 >= 4000""")
CTES["wtargets"] = (("esales",), """
SELECT *, recent_12m * 0.6 + middle_12m * 0.3 + oldest_12m * 0.1 AS avg_annual_sales_3y_eur, sales_3y_total_eur / 3.0 AS avg_annual_sales_3y_eur_unweighted FROM
(SELECT *, recent_12m + middle_12m + oldest_12m AS sales_3y_total_eur FROM (SELECT business_id, coalesce(sum(total_value) FILTER (d <= 365), 0) AS recent_12m,
  coalesce(sum(total_value) FILTER (d > 365 AND d <= 730), 0) AS middle_12m, coalesce(sum(total_value) FILTER (d > 730), 0) AS oldest_12m
  FROM (SELECT *, date_diff('day', created_at, (SELECT max(created_at) FROM esales)) AS d FROM esales) WHERE d < 1095 GROUP BY business_id))
WHERE recent_12m * 0.6 + middle_12m * 0.3 + oldest_12m * 0.1 >= 4000""")
CTES["asum"] = (("acc",), """
SELECT business_id, arg_min(company_account_name, account_id) AS account_company_name, count(DISTINCT account_id) AS account_count,
  coalesce(array_to_string(list_sort(list_distinct(list(trim(customer_status)) FILTER (customer_status IS NOT NULL))), ', '), '') AS account_status
FROM acc WHERE business_id IS NOT NULL GROUP BY business_id""")
CTES["base"] = (("comp", "asum"), """
SELECT c.* REPLACE (coalesce(c.parent_business_id, c.business_id) AS parent_business_id, coalesce(c.company_name, s.account_company_name) AS company_name,
  CASE WHEN growth_pct < -100 THEN -100 WHEN growth_pct > 200 THEN 200 ELSE growth_pct END AS growth_pct), account_company_name, account_count, account_status
FROM comp c LEFT JOIN asum s USING (business_id)""")
CTES["seg"] = (("base",), f"SELECT * FROM ({SEGMENT_SQL} base))")


def _modeling(targets: str) -> tuple[tuple[str, ...], str]:
    return (("seg", targets, "acc"), f"""
SELECT f.*, coalesce(l.segment_lift, 0) AS segment_lift FROM frame0_{targets} f LEFT JOIN lift_{targets} l USING (company_segment)""")


for _t in ("targets", "wtargets"):
    CTES[f"frame0_{_t}"] = (("seg", _t, "acc"), f"""
SELECT s.*, t.* EXCLUDE (business_id), CASE WHEN s.business_id IN (SELECT business_id FROM acc WHERE business_id IS NOT NULL) THEN 1 ELSE 0 END AS current_customer,
  CASE WHEN s.business_id IN (SELECT business_id FROM {_t} ORDER BY avg_annual_sales_3y_eur DESC, business_id LIMIT 200) THEN 1 ELSE 0 END AS label
FROM seg s LEFT JOIN {_t} t USING (business_id)""")
    CTES[f"lift_{_t}"] = ((f"frame0_{_t}",), f"""
SELECT company_segment, coalesce(sum(label) / (SELECT sum(label) FROM frame0_{_t} WHERE current_customer = 1), 0)
  / (count(*) / (SELECT count(*) FROM frame0_{_t} WHERE current_customer = 1)) AS segment_lift
FROM frame0_{_t} WHERE current_customer = 1 GROUP BY company_segment""")
    CTES[f"model_{_t}"] = ((f"frame0_{_t}", f"lift_{_t}"), _modeling(_t)[1])

# a score every engine can compute, standing for a trained one
SCORE_SQL = "CASE WHEN revenue_k_eur IS NULL THEN 0.25 ELSE least(revenue_k_eur / 120000.0, 1) END"


def stand_in_score():
    return F.when(F.col("revenue_k_eur").isNull(), 0.25).otherwise(F.least(F.col("revenue_k_eur") / 120000.0, F.lit(1.0)))


def flags_sql(source: str) -> str:
    return f"""SELECT f.*, business_id IN (SELECT business_id FROM acc WHERE business_id IS NOT NULL) AS excluded_current_customer,
  business_id IN (SELECT business_id FROM excl) AS excluded_external_business_id,
  business_id IN (SELECT parent_business_id FROM acc WHERE parent_business_id IS NOT NULL) AS excluded_customer_parent_company,
  parent_business_id IN (SELECT business_id FROM acc WHERE business_id IS NOT NULL UNION SELECT parent_business_id FROM acc WHERE parent_business_id IS NOT NULL) AS excluded_customer_group,
  contains(lower(company_name), '000000077') OR contains(coalesce(lower(marketing_name), ''), '000000077') AS excluded_manual_name_term FROM {source} f"""


TERMS = ("000000077",)
_LIFTED = "CASE WHEN lift < 0.7 THEN 0.7 WHEN lift > 1.8 THEN 1.8 ELSE lift END"


def values_sql(source: str, model: str) -> str:
    return f"""SELECT *, 0.70::DOUBLE * model_value_eur + 0.30::DOUBLE * baseline_value_eur AS final_value_eur FROM (SELECT *, score * segment_median_value_eur AS model_value_eur,
  (greatest(ln(1 + coalesce(greatest(revenue_k_eur * 1000.0::DOUBLE, 0), 0)) - ln(1000001::DOUBLE), 0) * 22000 + ln(1 + greatest(coalesce(headcount, 25), 1)) * 6500)
   * least(greatest(segment_lift, 0.7), 1.8) AS baseline_value_eur
  FROM (SELECT s.*, coalesce(m.med, (SELECT coalesce(median(avg_annual_sales_3y_eur), 0) FROM {model} WHERE label = 1)) AS segment_median_value_eur FROM {source} s
  LEFT JOIN (SELECT company_segment, median(avg_annual_sales_3y_eur) AS med FROM {model} WHERE label = 1 AND avg_annual_sales_3y_eur IS NOT NULL GROUP BY 1) m USING (company_segment)))"""


CTES["scored"] = (("model_wtargets",), f"SELECT *, {SCORE_SQL} AS score FROM model_wtargets")
CTES["flagged"] = (("scored", "acc", "excl"), flags_sql("scored"))
CTES["valued"] = (("flagged",), values_sql("flagged", "model_wtargets"))
CTES["uplift"] = (("valued",), """
SELECT * REPLACE (CASE WHEN recent_sales_value_eur > 0 THEN greatest(final_value_eur, 0.35::DOUBLE * final_value_eur + 0.65::DOUBLE * recent_sales_value_eur, recent_sales_value_eur)
  ELSE final_value_eur END AS final_value_eur), final_value_eur AS pre_sales_adjusted_final_value_eur FROM
 (SELECT *, greatest(coalesce(recent_12m, 0), 0) AS recent_sales_value_eur FROM valued)""")
CTES["growth"] = (("uplift",), """
SELECT *, probability_of_growth * conditional_potential_eur AS expected_potential_eur FROM (SELECT *,
  least(greatest(0.12 + 0.58 * least(greatest(score, 0), 1) + CASE WHEN recent_sales_value_eur > 0 THEN 0.10 ELSE -0.05 END
   + 0.14 * tanh(ln(least(greatest(coalesce(sales_momentum_ratio, 1), 0.25), 4.0))) + least(greatest((least(greatest(segment_lift, 0.5), 2.0) - 1) * 0.08, -0.04), 0.08), 0.05), 0.90) AS probability_of_growth,
  greatest(final_value_eur, 0) AS conditional_potential_eur
 FROM (SELECT *, CASE WHEN coalesce(middle_12m, 0) > 0 THEN recent_sales_value_eur / middle_12m END AS sales_momentum_ratio FROM uplift))""")
CTES["allscored"] = (("growth",), """
SELECT *, row_number() OVER (ORDER BY round(final_value_eur, 4) DESC, business_id) AS rank, ceil(final_value_eur)::BIGINT AS estimated_potential_eur,
 coalesce(company_name, marketing_name, business_id) AS company FROM growth""")


def months_and_accounts(spark, sf):
    """Accounts are written once: the optimizer copies the patterns that clean their ids into filters of every join, even on the orders."""
    return sales_months(spark, sf), stage(accounts(spark, sf), "accounts")


def plain_model(spark, sf):
    m, a = months_and_accounts(spark, sf)
    return tg.modeling_frame(companies(spark, sf), a, tg.customer_targets(m, a), top_n=200)


def weighted_model(spark, sf, months_accounts=None):
    m, a = months_accounts or months_and_accounts(spark, sf)
    return tg.modeling_frame(companies(spark, sf), a, tg.weighted_customer_targets(m, a), top_n=200)


def scored_frame(spark, sf, months_accounts=None):
    model = weighted_model(spark, sf, months_accounts)
    return model.withColumn("score", stand_in_score()), model


def all_scored(spark, sf, *wanted):
    """Every company scored and ranked, on the stand-in score; with ``wanted`` only these columns beside id, euros, rank and priority are sorted."""
    m, a = months_and_accounts(spark, sf)
    scored, model = scored_frame(spark, sf, (m, a))
    flagged = po.exclusion_flags(scored, a, exclusions(spark, sf), terms=TERMS).withColumn("is_account_customer", F.col("excluded_current_customer"))
    valued = po.growth_expectation(po.recent_sales_uplift(po.add_values(flagged, model)))
    valued = valued.withColumns({
        "estimated_potential_eur": F.ceil("final_value_eur").cast("bigint"), "_order": F.round("final_value_eur", 4),
        "company": F.coalesce("company_name", "marketing_name", "business_id"),
    })
    if wanted:
        valued = valued.select("business_id", "estimated_potential_eur", "_order", *wanted)
    # the sort looks at its input twice, for the ranges and for the rows
    return po.rank_and_label(stage(valued, "valued"), "_order").drop("_order")


# --------------------------------------------------------------------------- queries


@query("tg_01_customer_target", sql("targets", "SELECT business_id, round(sales_3y_total_eur, 4) AS sales_3y_total_eur, round(avg_annual_sales_3y_eur, 4) AS avg_annual_sales_3y_eur FROM targets"))
def _(spark, sf):
    return tg.customer_targets(*months_and_accounts(spark, sf)).select(
        "business_id", F.round("sales_3y_total_eur", 4).alias("sales_3y_total_eur"), F.round("avg_annual_sales_3y_eur", 4).alias("avg_annual_sales_3y_eur")
    )


@query("tg_02_weighted_target", sql("wtargets", """
SELECT business_id, round(recent_12m, 4) AS recent_12m, round(middle_12m, 4) AS middle_12m, round(oldest_12m, 4) AS oldest_12m,
 round(avg_annual_sales_3y_eur, 5) AS avg_annual_sales_3y_eur, round(avg_annual_sales_3y_eur_unweighted, 4) AS avg_annual_sales_3y_eur_unweighted FROM wtargets"""))
def _(spark, sf):
    out = tg.weighted_customer_targets(*months_and_accounts(spark, sf))
    return out.select(
        "business_id", *[F.round(c, 4).alias(c) for c in ("recent_12m", "middle_12m", "oldest_12m")],
        F.round("avg_annual_sales_3y_eur", 5).alias("avg_annual_sales_3y_eur"), F.round("avg_annual_sales_3y_eur_unweighted", 4).alias("avg_annual_sales_3y_eur_unweighted"),
    )


@query("tg_04_buyer_target", sql("months acc", """
SELECT business_id, round(sum(total_value), 4) AS sales_3y_total_eur FROM months JOIN acc USING (account_id)
WHERE business_id IS NOT NULL AND created_at > (SELECT max(created_at) FROM months JOIN acc USING (account_id) WHERE business_id IS NOT NULL) - 1095
GROUP BY business_id HAVING sum(total_value) > 0"""))
def _(spark, sf):
    return tg.buyer_targets(*months_and_accounts(spark, sf)).select("business_id", F.round("sales_3y_total_eur", 4).alias("sales_3y_total_eur"))


@query("tg_05_top_label", sql("model_targets", "SELECT business_id, current_customer, label FROM model_targets"))
def _(spark, sf):
    return plain_model(spark, sf).select("business_id", "current_customer", "label")


@query("tg_06_sales_label", sql("base months acc", """
SELECT business_id, CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END AS has_sales_history, round(coalesce(t, 0) / 3.0, 4) AS actual_avg_annual_sales_3y_eur FROM base LEFT JOIN
(SELECT business_id, sum(total_value) AS t FROM months JOIN acc USING (account_id) WHERE business_id IS NOT NULL
 AND created_at > (SELECT max(created_at) FROM months JOIN acc USING (account_id) WHERE business_id IS NOT NULL) - 1095 GROUP BY 1 HAVING sum(total_value) > 0) USING (business_id)"""))
def _(spark, sf):
    m, a = months_and_accounts(spark, sf)
    out = tg.add_sales_label(tg.company_base(companies(spark, sf), a), tg.buyer_targets(m, a))
    return out.select("business_id", "has_sales_history", F.round("actual_avg_annual_sales_3y_eur", 4).alias("actual_avg_annual_sales_3y_eur"))


@query("sg_01_segment_features", sql("seg", "SELECT company_segment, growth_bucket, count(*) AS companies, round(sum(revenue_k_eur), 4) AS revenue_k_eur FROM seg GROUP BY 1, 2"))
def _(spark, sf):
    from ledgerlift.functions.buckets import add_segment_features

    frame = add_segment_features(tg.company_base(companies(spark, sf), accounts(spark, sf)))
    return frame.groupBy("company_segment", "growth_bucket").agg(F.count("*").alias("companies"), F.round(F.sum("revenue_k_eur"), 4).alias("revenue_k_eur"))


@query("sg_02_segment_lift", sql("model_targets", "SELECT business_id, company_segment, round(segment_lift, 6) AS segment_lift FROM model_targets"))
def _(spark, sf):
    return plain_model(spark, sf).select("business_id", "company_segment", F.round("segment_lift", 6).alias("segment_lift"))


@query("ft_02_company_base", sql("base", "SELECT business_id, company_name, parent_business_id, growth_pct, account_company_name, account_status, account_count FROM base"))
def _(spark, sf):
    return tg.company_base(companies(spark, sf), accounts(spark, sf)).select(
        "business_id", "company_name", "parent_business_id", "growth_pct", "account_company_name", "account_status", "account_count"
    )


@query("ft_03_scoring_universe", sql("comp acc", """
SELECT business_id, company_name, marketing_name, parent_business_id, revenue_k_eur FROM (SELECT *, row_number() OVER (PARTITION BY business_id
  ORDER BY revenue_k_eur IS NOT NULL DESC, src, rowno, company_name) AS rn FROM (
 SELECT business_id, company_name, marketing_name, parent_business_id, revenue_k_eur, 0 AS src, 0 AS rowno FROM comp UNION ALL
 SELECT business_id, company_account_name, account_name, coalesce(parent_business_id, business_id), NULL, 1, account_id FROM acc)
 WHERE business_id IS NOT NULL) WHERE rn = 1"""))
def _(spark, sf):
    return tg.scoring_universe(companies(spark, sf), accounts(spark, sf)).select("business_id", "company_name", "marketing_name", "parent_business_id", "revenue_k_eur")


@query("sc_01_exclusion_flags", sql("flagged", "SELECT business_id, " + ", ".join(po.FLAGS) + " FROM flagged"))
def _(spark, sf):
    m, a = months_and_accounts(spark, sf)
    scored, _ = scored_frame(spark, sf, (m, a))
    return po.exclusion_flags(scored, a, exclusions(spark, sf), terms=TERMS).select("business_id", *po.FLAGS)


@query("flt_07_prospect_eligibility", sql("flagged", """
SELECT metric, value::DOUBLE AS value FROM (SELECT count_if(excluded_current_customer) AS excluded_current_customer, count_if(excluded_external_business_id) AS excluded_external_business_id,
 count_if(excluded_customer_parent_company) AS excluded_customer_parent_company, count_if(excluded_manual_name_term) AS excluded_manual_name_term,
 count_if((excluded_customer_group OR excluded_customer_parent_company) AND NOT excluded_current_customer) AS excluded_customer_family FROM flagged)
UNPIVOT (value FOR metric IN (excluded_current_customer, excluded_external_business_id, excluded_customer_parent_company, excluded_manual_name_term, excluded_customer_family))"""))
def _(spark, sf):
    m, a = months_and_accounts(spark, sf)
    scored, _ = scored_frame(spark, sf, (m, a))
    return po.exclusion_counts(po.exclusion_flags(scored, a, exclusions(spark, sf), terms=TERMS))


@query("sc_02_segment_median_value", sql("valued", "SELECT business_id, round(segment_median_value_eur, 3) AS segment_median_value_eur, round(model_value_eur, 2) AS model_value_eur FROM valued"))
def _(spark, sf):
    scored, model = scored_frame(spark, sf)
    return po.add_values(scored, model).select(
        "business_id", F.round("segment_median_value_eur", 3).alias("segment_median_value_eur"), F.round("model_value_eur", 2).alias("model_value_eur")
    )


@query("sc_03_baseline_value", sql("valued", "SELECT business_id, round(baseline_value_eur, 3) AS baseline_value_eur FROM valued"))
def _(spark, sf):
    scored, model = scored_frame(spark, sf)
    return po.add_values(scored, model).select("business_id", F.round("baseline_value_eur", 3).alias("baseline_value_eur"))


@query("sc_04_prospect_ranking", sql("valued", """
SELECT rank, CASE WHEN rank <= 100 THEN 'A' WHEN rank <= 500 THEN 'B' WHEN rank <= 1000 THEN 'C' ELSE 'D' END AS priority, company, business_id, parent_business_id,
 round_even(final_value_eur, 0)::BIGINT AS estimated_potential_eur, company_segment, industry, growth_bucket FROM (
 SELECT *, row_number() OVER (ORDER BY round(final_value_eur, 4) DESC, business_id) AS rank, coalesce(company_name, marketing_name, business_id) AS company FROM valued
 WHERE NOT (excluded_current_customer OR excluded_external_business_id OR excluded_customer_parent_company OR excluded_customer_group OR excluded_manual_name_term)
 AND business_id IS NOT NULL AND company_name IS NOT NULL)"""))
def _(spark, sf):
    m, a = months_and_accounts(spark, sf)
    scored, model = scored_frame(spark, sf, (m, a))
    eligible = po.eligible_prospects(po.exclusion_flags(scored, a, exclusions(spark, sf), terms=TERMS))
    valued = po.add_values(eligible, model).withColumns({
        "_order": F.round("final_value_eur", 4), "company": F.coalesce("company_name", "marketing_name", "business_id"),
    })
    return po.rank_and_label(valued, "_order").select(
        "rank", "priority", "company", "business_id", "parent_business_id", F.rint("final_value_eur").cast("bigint").alias("estimated_potential_eur"),
        "company_segment", "industry", "growth_bucket",
    )


@query("sc_05_recent_sales_uplift", sql("uplift", """
SELECT business_id, round(recent_sales_value_eur, 4) AS recent_sales_value_eur, round(final_value_eur, 4) AS final_value_eur,
 round(final_value_eur - pre_sales_adjusted_final_value_eur, 4) AS sales_history_adjustment_eur FROM uplift"""))
def _(spark, sf):
    scored, model = scored_frame(spark, sf)
    return po.recent_sales_uplift(po.add_values(scored, model)).select(
        "business_id", F.round("recent_sales_value_eur", 4).alias("recent_sales_value_eur"), F.round("final_value_eur", 4).alias("final_value_eur"),
        F.round("sales_history_adjustment_eur", 4).alias("sales_history_adjustment_eur"),
    )


@query("sc_06_growth_expectation", sql("growth", """
SELECT business_id, round(probability_of_growth, 6) AS probability_of_growth, round(sales_momentum_ratio, 6) AS sales_momentum_ratio,
 round(expected_potential_eur, 2) AS expected_potential_eur FROM growth"""))
def _(spark, sf):
    scored, model = scored_frame(spark, sf)
    return po.growth_expectation(po.recent_sales_uplift(po.add_values(scored, model))).select(
        "business_id", F.round("probability_of_growth", 6).alias("probability_of_growth"), F.round("sales_momentum_ratio", 6).alias("sales_momentum_ratio"),
        F.round("expected_potential_eur", 2).alias("expected_potential_eur"),
    )


@query("wn_01_global_rank", sql("allscored", """
SELECT business_id, rank, CASE WHEN rank <= 100 THEN 'A' WHEN rank <= 500 THEN 'B' WHEN rank <= 1000 THEN 'C' ELSE 'D' END AS priority, estimated_potential_eur FROM allscored"""))
def _(spark, sf):
    return all_scored(spark, sf).select("business_id", "rank", "priority", "estimated_potential_eur")


@query("sc_07_commercial_potential", sql("growth", """
SELECT business_id, greatest(round_even(least(raised, CASE WHEN market > 0 THEN market ELSE greatest(raised, buyer) END), 0), 0) AS commercial_potential_eur FROM (
SELECT *, greatest((0.5::DOUBLE * expected + 0.3::DOUBLE * buyer + 0.2::DOUBLE * market) * CASE WHEN segment_lift >= 5 AND revenue >= 20000 THEN 1.25::DOUBLE WHEN segment_lift >= 3 OR revenue >= 100000 THEN 1.15
  WHEN segment_lift >= 1.5 OR revenue >= 20000 THEN 1.08 ELSE 1 END,
 CASE WHEN (segment_lift >= 2 OR revenue >= 20000) AND score >= 0.55 THEN 5000 WHEN (segment_lift >= 2 OR revenue >= 20000) AND score >= 0.35 THEN 2500
  WHEN (segment_lift >= 2 OR revenue >= 20000) AND score >= 0.2 THEN 1000 ELSE 0 END) AS raised FROM
 (SELECT *, coalesce(revenue_k_eur, 0) AS revenue, expected_potential_eur AS expected, recent_sales_value_eur AS buyer, CASE WHEN headcount > 700 THEN final_value_eur ELSE 0 END AS market FROM growth))"""))
def _(spark, sf):
    scored, model = scored_frame(spark, sf)
    frame = po.growth_expectation(po.recent_sales_uplift(po.add_values(scored, model))).withColumns({
        "expected_12m_sales_eur": F.col("expected_potential_eur"), "predicted_buyer_potential_eur": F.col("recent_sales_value_eur"),
        "market_potential_eur": F.when(F.col("headcount") > 700, F.col("final_value_eur")), "purchase_probability": F.col("score"),
    })
    return po.commercial_potential(frame).select("business_id", "commercial_potential_eur")


@query("sc_09_lead_value", sql("growth", """
SELECT business_id, round(score * coalesce(a, 0), 3) AS expected_annual_potential_eur FROM growth LEFT JOIN (SELECT business_id, avg_annual_sales_3y_eur AS a FROM wtargets) USING (business_id)
WHERE coalesce(a, 0) >= 4000"""))
def _(spark, sf):
    m, a = months_and_accounts(spark, sf)
    scored, _ = scored_frame(spark, sf, (m, a))
    potential = tg.weighted_customer_targets(m, a).select("business_id", F.col("avg_annual_sales_3y_eur").alias("annual_potential_estimate_eur"))
    return po.lead_value(scored.select("business_id", "score"), potential).select(
        "business_id", F.round("expected_annual_potential_eur", 3).alias("expected_annual_potential_eur")
    )


@query("sc_10_customer_rollup", sql("crm allscored", f"""
SELECT customer_key, crm_row_id, business_id, model_estimated_potential_eur, crm_source_row_count, round(crm_potential_eur, 4) AS crm_potential_eur, crm_source_row_ids,
 row_number() OVER (ORDER BY model_estimated_potential_eur DESC NULLS LAST, crm_row_id) AS customer_potential_rank FROM (
SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY coalesce(model_estimated_potential_eur, -1) DESC, pot DESC, crm_row_id) AS rn,
 count(*) OVER (PARTITION BY customer_key) AS crm_source_row_count, sum(pot) OVER (PARTITION BY customer_key) AS crm_potential_eur,
 array_to_string(list_transform(list_sort(list(crm_row_id) OVER (PARTITION BY customer_key))[1:50], lambda x : x::VARCHAR), ', ') AS crm_source_row_ids FROM (
SELECT c.crm_row_id, c.business_id, s.estimated_potential_eur::DOUBLE AS model_estimated_potential_eur, c.sales * coalesce(CASE WHEN probability > 1 THEN probability / 100 ELSE probability END, 1) AS pot,
 CASE WHEN c.business_id IS NOT NULL THEN 'bid:' || c.business_id WHEN nk IS NOT NULL THEN 'name:' || nk ELSE 'row:' || c.crm_row_id END AS customer_key
FROM (SELECT *, {name_for_matching_sql('name')} AS nk FROM crm) c LEFT JOIN allscored s USING (business_id))) WHERE rn = 1"""))
def _(spark, sf):
    # a small file is read by few tasks: rows are dealt out before their names are taken apart
    crm = crm_potentials(spark, sf).repartition("crm_row_id").withColumn("name_key", tx.name_for_matching(F.col("name")))
    ranked, _ = po.customer_rollup(crm, all_scored(spark, sf, "company"))
    return ranked.select(
        "customer_key", "crm_row_id", "business_id", "model_estimated_potential_eur", "crm_source_row_count",
        F.round("crm_potential_eur", 4).alias("crm_potential_eur"), "crm_source_row_ids", "customer_potential_rank",
    )


@query("sc_11_customer_growth", sql("growth", """
SELECT business_id, round(greatest(expected_potential_eur - coalesce(recent_12m, 0), 0), 2) AS potential_growth_eur,
 round(CASE WHEN coalesce(recent_12m, 0) > 0 THEN greatest(expected_potential_eur - recent_12m, 0) / recent_12m ELSE 0 END, 6) AS potential_growth_pct,
 CASE WHEN s <= 39.999 THEN 'Low' WHEN s <= 69.999 THEN 'Medium' ELSE 'High' END AS sales_priority FROM
 (SELECT *, round(least(greatest(score * 0.7 + probability_of_growth * 0.3, 0), 1) * 100, 1) AS s FROM growth)"""))
def _(spark, sf):
    scored, model = scored_frame(spark, sf)
    frame = po.customer_growth(po.growth_expectation(po.recent_sales_uplift(po.add_values(scored, model))))
    return frame.select(
        "business_id", F.round("potential_growth_eur", 2).alias("potential_growth_eur"), F.round("potential_growth_pct", 6).alias("potential_growth_pct"), "sales_priority"
    )
