"""From score to euros: exclusions, values, ranks, growth, commercial potential."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import buckets as bk
from ledgerlift.functions import numbers as nm
from ledgerlift.functions import text as tx
from ledgerlift.operators.lookup import flag_member, sparse_join
from ledgerlift.operators.ranking import first_per_key, global_row_number
from ledgerlift.session import stage

FLAGS = (
    "excluded_current_customer", "excluded_external_business_id", "excluded_customer_parent_company",
    "excluded_customer_group", "excluded_manual_name_term",
)


def exclusion_flags(
    frame: DataFrame, accounts: DataFrame, excluded_ids: DataFrame, *, terms: Sequence[str] = ()
) -> DataFrame:
    """Five reasons not to treat a company as a prospect, each as a flag.

    The ids of accounts are gathered once, each with what it is: an account's own, a parent's or both.
    """
    both = F.array(
        F.struct(F.col("business_id").alias("_id"), F.lit(True).alias("_own"), F.lit(False).alias("_parent")),
        F.struct(F.col("parent_business_id").alias("_id"), F.lit(False).alias("_own"), F.lit(True).alias("_parent")),
    )
    ids = accounts.select(F.explode(both).alias("_m")).select("_m.*").filter(F.col("_id").isNotNull())
    ids = ids.groupBy("_id").agg(F.bool_or("_own").alias("_own"), F.bool_or("_parent").alias("_parent"))
    out = frame.join(ids, F.col("business_id") == F.col("_id"), "left").withColumn("excluded_current_customer", F.coalesce("_own", F.lit(False)))
    out = flag_member(out.drop("_id", "_own"), "business_id", excluded_ids, "business_id", "excluded_external_business_id")
    out = out.withColumn("excluded_customer_parent_company", F.coalesce("_parent", F.lit(False))).drop("_parent")
    # both marks are looked at again, so that the gathered ids are the same table to Spark and are used twice
    out = out.join(ids, F.col("parent_business_id") == F.col("_id"), "left").withColumn(
        "excluded_customer_group", F.coalesce(F.col("_own") | F.col("_parent"), F.lit(False))
    ).drop("_id", "_own", "_parent")
    words = [t for t in (" ".join(term.lower().split()) for term in terms) if t]
    hit = F.lit(False)
    for name in ("company_name", "marketing_name") if words else ():
        hit = hit | tx.has_any(tx.name_plain(F.col(name)), words)
    return out.withColumn("excluded_manual_name_term", hit)


def eligible_prospects(flagged: DataFrame) -> DataFrame:
    keep = F.col("business_id").isNotNull() & F.col("company_name").isNotNull()
    for flag in FLAGS:
        keep = keep & ~F.col(flag)
    return flagged.filter(keep)


def exclusion_counts(flagged: DataFrame) -> DataFrame:
    """How many companies each reason takes out, one pass, long form."""
    from ledgerlift.operators.aggregates import metrics_long

    group = F.col("excluded_customer_group") | F.col("excluded_customer_parent_company")
    metrics = {f: F.count_if(f) for f in FLAGS if f != "excluded_customer_group"}
    metrics["excluded_customer_family"] = F.count_if(group & ~F.col("excluded_current_customer"))
    return metrics_long(flagged, metrics)


def segment_medians(frame: DataFrame) -> DataFrame:
    """Median yearly sales of the top customers per segment.

    Only labelled rows count, and there are at most as many as the top-customer limit, so an
    exact percentile is safe here.
    """
    top = frame.filter((F.col("label") == 1) & F.col("company_segment").isNotNull() & F.col("avg_annual_sales_3y_eur").isNotNull())
    return top.groupBy("company_segment").agg(F.median("avg_annual_sales_3y_eur").alias("_segment_median"))


def overall_median(frame: DataFrame) -> Column:
    top = frame.filter(F.col("label") == 1)
    return top.agg(F.coalesce(F.median("avg_annual_sales_3y_eur"), F.lit(0.0)).alias("m")).scalar()


def add_values(scored: DataFrame, modeling: DataFrame) -> DataFrame:
    """Segment median (overall median where the segment has none), model value, baseline and the blend."""
    out = scored.join(segment_medians(modeling), "company_segment", "left").withColumn(
        "segment_median_value_eur", F.coalesce("_segment_median", overall_median(modeling))
    ).drop("_segment_median")
    out = out.withColumns(
        {
            "model_value_eur": F.col("score") * F.col("segment_median_value_eur"),
            "baseline_value_eur": nm.continuous_baseline(F.col("revenue_k_eur"), F.col("headcount"), F.col("segment_lift")),
        }
    )
    return out.withColumn("final_value_eur", 0.70 * F.col("model_value_eur") + 0.30 * F.col("baseline_value_eur"))


def rank_and_label(df: DataFrame, value: str, *, cuts: Sequence[int] = (100, 500, 1000)) -> DataFrame:
    """Rank over everything by value (ties by business id) and the priority letter."""
    ranked = global_row_number(df, [(value, "desc"), ("business_id", "asc")], "rank")
    return ranked.withColumn("priority", bk.priority(F.col("rank"), cuts))


def rank_prospects(scored: DataFrame, modeling: DataFrame, accounts: DataFrame, excluded_ids: DataFrame) -> DataFrame:
    """Eligible companies with euros, rank, priority and reasons."""
    eligible = eligible_prospects(exclusion_flags(scored, accounts, excluded_ids))
    valued = add_values(eligible, modeling).withColumns(
        {
            "estimated_potential_eur": nm.round_even(F.col("final_value_eur")).cast("bigint"),
            "positive_signals": tx.positive_signals(),
            "company": F.coalesce("company_name", "marketing_name", "business_id"),
        }
    )
    ranked = rank_and_label(valued, "final_value_eur")
    return ranked.select(
        "rank", "priority", "company", "business_id", "parent_business_id", "score", "segment_median_value_eur",
        "model_value_eur", "baseline_value_eur", "estimated_potential_eur", "avg_annual_sales_3y_eur", "revenue_k_eur",
        "revenue_class", "headcount_class", "company_segment", "segment_lift", "industry", "growth_bucket", "positive_signals",
    )


def recent_sales_uplift(df: DataFrame, *, weight: float = 0.65, floor: float = 1.0) -> DataFrame:
    """Value of customers with recent sales: the highest of model, blend and floor."""
    recent = F.greatest(F.coalesce("recent_12m", F.lit(0.0)), F.lit(0.0))
    out = df.withColumns({"pre_sales_adjusted_final_value_eur": F.col("final_value_eur"), "recent_sales_value_eur": recent})
    share = min(max(weight, 0.0), 1.0)
    blend = (1.0 - share) * F.col("final_value_eur") + share * F.col("recent_sales_value_eur")
    lifted = F.greatest(F.col("final_value_eur"), blend, F.col("recent_sales_value_eur") * max(floor, 0.0))
    out = out.withColumn("final_value_eur", F.when(F.col("recent_sales_value_eur") > 0, lifted).otherwise(F.col("final_value_eur")))
    return out.withColumn("sales_history_adjustment_eur", F.col("final_value_eur") - F.col("pre_sales_adjusted_final_value_eur"))


def growth_expectation(df: DataFrame) -> DataFrame:
    """Chance of growth from score, momentum and segment; expected value = chance times value."""
    score = nm.clip(nm.zero_if_null(F.col("score")), 0, 1)
    recent = F.greatest(nm.zero_if_null(F.col("recent_12m")), F.lit(0.0))
    previous = F.greatest(nm.zero_if_null(F.col("middle_12m")), F.lit(0.0))
    lift = nm.clip(F.coalesce("segment_lift", F.lit(1.0)), 0.5, 2.0)
    momentum = F.when(previous > 0, recent / previous)
    signal = F.tanh(F.log(nm.clip(F.coalesce(momentum, F.lit(1.0)), 0.25, 4.0)))
    chance = (
        0.12 + 0.58 * score + F.when(recent > 0, 0.10).otherwise(-0.05) + 0.14 * signal + nm.clip((lift - 1.0) * 0.08, -0.04, 0.08)
    )
    out = df.withColumns(
        {
            "probability_of_growth": nm.clip(chance, 0.05, 0.90),
            "sales_momentum_ratio": momentum,
            "conditional_potential_eur": F.greatest(nm.zero_if_null(F.col("final_value_eur")), F.lit(0.0)),
        }
    )
    return out.withColumn("expected_potential_eur", F.col("probability_of_growth") * F.col("conditional_potential_eur"))


def score_all(scored: DataFrame, modeling: DataFrame, accounts: DataFrame, excluded_ids: DataFrame, *, weight: float = 0.65, floor: float = 1.0) -> DataFrame:
    """Every company, customers too: values, uplift, growth, rank."""
    flagged = exclusion_flags(scored, accounts, excluded_ids).withColumn("is_account_customer", F.col("excluded_current_customer"))
    valued = growth_expectation(recent_sales_uplift(add_values(flagged, modeling), weight=weight, floor=floor)).withColumns(
        {
            "estimated_potential_eur": F.ceil("final_value_eur").cast("bigint"),
            "positive_signals": tx.positive_signals(),
            "company": F.coalesce("company_name", "marketing_name", "business_id"),
        }
    )
    return rank_and_label(valued, "final_value_eur")


def commercial_potential(df: DataFrame) -> DataFrame:
    """Blend of expected, buyer and market value, boosted by fit, floored by chance, capped by market."""
    def z(name: str) -> Column:
        return F.greatest(nm.zero_if_null(F.col(name)), F.lit(0.0))

    expected, buyer, market = z("expected_12m_sales_eur"), z("predicted_buyer_potential_eur"), z("market_potential_eur")
    lift, revenue, chance = (nm.zero_if_null(F.col(c)) for c in ("segment_lift", "revenue_k_eur", "purchase_probability"))
    boost = (
        F.when((lift >= 5) & (revenue >= 20_000), 1.25)
        .when((lift >= 3) | (revenue >= 100_000), 1.15)
        .when((lift >= 1.5) | (revenue >= 20_000), 1.08)
        .otherwise(1.0)
    )
    fit = (lift >= 2.0) | (revenue >= 20_000)
    floor = (
        F.when(fit & (chance >= 0.55), 5000.0).when(fit & (chance >= 0.35), 2500.0).when(fit & (chance >= 0.20), 1000.0).otherwise(0.0)
    )
    raised = F.greatest((0.50 * expected + 0.30 * buyer + 0.20 * market) * boost, floor)
    ceiling = F.when(market > 0, market).otherwise(F.greatest(raised, buyer))
    value = F.greatest(nm.round_even(F.least(raised, ceiling)), F.lit(0.0))
    return df.withColumn("commercial_potential_eur", value)


def market_potential(rows: DataFrame) -> DataFrame:
    """One market figure per business id: highest potential and score."""
    return rows.groupBy("business_id").agg(
        F.max("market_potential_eur").alias("market_potential_eur"), F.max("market_model_score").alias("market_model_score")
    )


def lead_value(leads: DataFrame, recommendations: DataFrame, *, minimum: float = 4000.0) -> DataFrame:
    """Score times yearly potential, small ones dropped; sorting is left to the report."""
    joined = leads.join(recommendations, "business_id", "left")
    return joined.withColumn(
        "expected_annual_potential_eur", F.col("score") * nm.zero_if_null(F.col("annual_potential_estimate_eur"))
    ).filter(nm.zero_if_null(F.col("annual_potential_estimate_eur")) >= minimum)


def customer_growth(df: DataFrame) -> DataFrame:
    """Current against expected sales: growth in euros and percent, 0-100 score, sales priority."""
    current = nm.zero_if_null(F.col("recent_12m"))
    following = nm.zero_if_null(F.col("expected_potential_eur"))
    growth = F.greatest(following - current, F.lit(0.0))
    mix = nm.clip(nm.zero_if_null(F.col("score")) * 0.7 + nm.zero_if_null(F.col("probability_of_growth")) * 0.3, 0, 1)
    out = df.withColumns(
        {
            "current_sales_eur": current,
            "potential_next_12m_eur": following,
            "potential_growth_eur": growth,
            "potential_growth_pct": F.when(current > 0, growth / current).otherwise(0.0),
            "potential_score": F.bround(mix * 100, 1),
        }
    )
    return out.withColumn("sales_priority", bk.sales_priority(F.col("potential_score")))


def customer_rollup(crm: DataFrame, scored: DataFrame, *, shown_ids: int | None = None) -> tuple[DataFrame, DataFrame]:
    """CRM rows with model figures, one row per customer, and the table of source rows.

    A customer is its business id, else its name, else the row itself.  The best row per customer
    stays; potentials add up.  Source rows are listed in the text column, all or the first ``shown_ids``;
    one row for each is in the second table ``(customer_key, crm_row_id)``.

    Keys are written once: sums, lists and best rows would each make them again, and the optimizer copies their texts
    into a filter of every join.  Only the best row needs the model's figures.
    """
    facts = first_per_key(scored.filter(F.col("business_id").isNotNull()), ["business_id"], [("rank", "asc")]).select(
        "business_id", F.col("estimated_potential_eur").cast("double").alias("model_estimated_potential_eur"), "priority", "company",
    )
    rows = stage(
        crm.withColumns(
            {
                "customer_key": F.when(F.coalesce("business_id", F.lit("")) != "", F.concat(F.lit("bid:"), "business_id"))
                .when(F.coalesce("name_key", F.lit("")) != "", F.concat(F.lit("name:"), "name_key"))
                .otherwise(F.concat(F.lit("row:"), F.col("crm_row_id").cast("string"))),
                "crm_row_potential_eur": nm.zero_if_null(F.col("sales")) * nm.share_of_one(F.col("probability")),
            }
        ),
        "crm-rows",
    )
    sums = rows.groupBy("customer_key").agg(
        F.count("*").alias("crm_source_row_count"), F.sum("crm_row_potential_eur").alias("crm_potential_eur")
    )
    # most rows have no id; the sign keeps a blank one a key like any other
    signed = F.concat(F.lit("="), F.col("business_id"))
    modelled = sparse_join(
        rows.withColumn("_id", signed), facts.withColumn("_id", signed).drop("business_id"), ["_id"], spread=["crm_row_id"]
    ).drop("_id")
    best = first_per_key(
        modelled.withColumn("_model", F.coalesce("model_estimated_potential_eur", F.lit(-1.0))),
        ["customer_key"],
        [("_model", "desc"), ("crm_row_potential_eur", "desc"), ("crm_row_id", "asc")],
    ).drop("_model", "crm_row_potential_eur")
    from ledgerlift.operators.ranking import top_n

    listed = rows.select("customer_key", "crm_row_id")
    if shown_ids is not None:
        listed = top_n(listed, ["customer_key"], [("crm_row_id", "asc")], shown_ids, "_r")
    ids = listed.groupBy("customer_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("crm_row_id")), lambda x: x.cast("string")), ", ").alias("crm_source_row_ids")
    )
    one = best.join(sums, "customer_key").join(ids, "customer_key")
    ranked = global_row_number(
        one, [("model_estimated_potential_eur", "desc"), ("crm_row_id", "asc")], "customer_potential_rank"
    )
    return ranked, rows.select("customer_key", "crm_row_id")
