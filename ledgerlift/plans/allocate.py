"""Sharing an account's potential among products."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.functions.numbers import zero_if_null
from ledgerlift.operators.ranking import grouped_row_number, join_on, top_n
from ledgerlift.session import stage

MAX_WEIGHT = 0.3
TOLERANCE = 0.01


class AllocationError(ValueError):
    """Input that cannot be allocated, or totals that do not match."""


def product_sales_by_segment(sales: DataFrame, segments: DataFrame, *, product: str = "product_code", name: str | None = None) -> DataFrame:
    """Product sales with the buyer's segment (``unknown`` without one); negative sales count 0."""
    label = F.nullif(F.trim(product), F.lit(""))
    if name is not None:
        label = F.coalesce(label, F.nullif(F.trim(name), F.lit("")))
    joined = sales.join(segments, "business_id", "left")
    return joined.select(
        label.alias("product_id"), F.coalesce("company_segment", F.lit("unknown")).alias("segment"),
        F.greatest(zero_if_null(F.col("sales_eur")), F.lit(0.0)).alias("sales"),
    ).filter(F.col("product_id").isNotNull())


def check_accounts(accounts: DataFrame) -> None:
    """Ids present and potentials not negative, else an error."""
    bad = accounts.agg(
        F.count_if(F.col("business_id").isNull()).alias("ids"), F.count_if(F.col("account_potential") < 0).alias("negative")
    ).first()
    if bad["ids"]:
        raise AllocationError(f"{bad['ids']} accounts have no business id")
    if bad["negative"]:
        raise AllocationError(f"{bad['negative']} accounts have a negative potential")


def _weights(base: DataFrame, keys: list[str], cap: float | None) -> DataFrame:
    """Sales shares per group, equal where nothing was sold, no weight above the cap.

    A capped product takes ``cap`` of the whole, so no more than 1/cap products per group can be
    capped: only that many leading products are looked at.  The first k for which the next product,
    scaled to the mass left, stays under the cap gives the answer for the whole group.
    """
    totals = base.groupBy(*keys).agg(F.sum("sales").alias("_total"), F.count("*").alias("_n"))
    sized = join_on(base, totals, keys, "left") if keys else base.withColumn("_t", totals.select(F.struct("_total", "_n").alias("s")).scalar()).select(
        "*", F.col("_t._total").alias("_total"), F.col("_t._n").alias("_n")
    ).drop("_t")
    weight = F.when(F.col("_total") > 0, F.col("sales") / F.col("_total")).otherwise(1.0 / F.col("_n"))
    sized = sized.withColumn("weight", weight)
    if cap is None:
        return sized.select(*keys, "product_id", "weight")
    low = totals.filter(F.col("_n") * cap < 1.0 - 1e-12).limit(1).collect()
    if low:
        raise AllocationError(f"a cap of {cap} is too low for {low[0]['_n']} products")
    sized = stage(sized, "weights")
    most = math.floor(1.0 / cap + 1e-9) + 1
    anchor = keys or ["_all"]
    with_key = sized if keys else sized.withColumn("_all", F.lit(1))
    lead = top_n(with_key, anchor, [("weight", "desc"), ("product_id", "asc")], most, "_rank").select(*anchor, "product_id", "weight", "_n", "_rank")
    marked = with_key.join(lead.select(*anchor, "product_id", "_rank"), [*anchor, "product_id"], "left")
    # sums of what is left are added up, never found by subtraction: a tail of 1e-10 must keep its digits
    beyond = marked.groupBy(*anchor).agg(F.coalesce(F.sum(F.when(F.col("_rank").isNull(), F.col("weight"))), F.lit(0.0)).alias("_beyond"))
    onward = Window.partitionBy(*anchor).orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)  # at most `most` rows per group
    heads = lead.join(beyond, anchor).withColumn("_rest", F.sum("weight").over(onward) + F.col("_beyond"))
    mass = 1.0 - (F.col("_rank") - 1) * cap
    scaled = F.when(F.col("_rest") > 0, F.col("weight") / F.col("_rest") * mass).otherwise(mass / F.greatest(F.col("_n") - F.col("_rank") + 1, F.lit(1)))
    # k capped products: one less than the first rank that fits; all leaders if none does
    chosen = heads.withColumn("_fits", scaled <= cap + 1e-12).groupBy(*anchor).agg(
        F.coalesce(F.min(F.when(F.col("_fits"), F.col("_rank"))) - 1, F.max("_rank")).alias("_k"), F.max("_n").alias("_size"), F.max("_beyond").alias("_beyond"),
    )
    tails = heads.join(chosen.select(*anchor, "_k"), anchor).groupBy(*anchor).agg(
        F.coalesce(F.sum(F.when(F.col("_rank") > F.col("_k"), F.col("weight"))), F.lit(0.0)).alias("_tail")
    )
    facts = chosen.join(tails, anchor).select(*anchor, "_k", "_size", (F.col("_tail") + F.col("_beyond")).alias("_free"))
    out = marked.join(facts, anchor)
    left = 1.0 - F.col("_k") * cap
    free = F.when(F.col("_free") > 0, F.col("weight") / F.col("_free") * left).otherwise(left / F.greatest(F.col("_size") - F.col("_k"), F.lit(1)))
    return out.select(*keys, "product_id", F.when(F.coalesce(F.col("_rank") <= F.col("_k"), F.lit(False)), F.lit(cap)).otherwise(free).alias("weight"))


def product_weights(sales: DataFrame, *, max_weight: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights per segment and over everything."""
    if max_weight is not None and not 0 < max_weight <= 1:
        raise AllocationError("the cap must lie in (0, 1]")
    clean = sales.filter(F.col("product_id").isNotNull()).withColumn("sales", F.greatest(zero_if_null(F.col("sales")), F.lit(0.0)))
    by_segment = stage(clean.groupBy("segment", "product_id").agg(F.sum("sales").alias("sales")), "segment-sales")
    overall = by_segment.groupBy("product_id").agg(F.sum("sales").alias("sales"))
    known = by_segment.filter(F.col("segment").isNotNull())
    return _weights(known, ["segment"], max_weight), _weights(overall, [], max_weight)


def allocate(accounts: DataFrame, sales: DataFrame, *, max_weight: float | None = None, tolerance: float = TOLERANCE, check: bool = True) -> DataFrame:
    """Potential of every account split over the products of its segment (all products without one).

    Products are ranked once per segment; the order inside an account is the same, except for
    accounts without potential, whose products follow the product id.
    """
    if check:
        check_accounts(accounts)
    weights, overall = product_weights(sales, max_weight=max_weight)
    known = weights.select("segment").distinct()
    homes = accounts.join(known.withColumn("_home", F.col("segment")), "segment", "left")
    # every account without a segment of its own shares one extra segment: the overall weights
    homes = homes.withColumn("_home", F.coalesce("_home", F.lit(OVERALL)))
    table = weights.select(F.col("segment").alias("_home"), "product_id", "weight").unionByName(
        overall.select(F.lit(OVERALL).alias("_home"), "product_id", "weight")
    )
    sums = table.groupBy("_home").agg(F.sum("weight").alias("_sum"))
    table = table.join(sums, "_home").withColumn("weight", F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum")).otherwise(0.0)).drop("_sum")
    table = stage(table, "segment-weights")
    table = grouped_row_number(table, ["_home"], [("weight", "desc"), ("product_id", "asc")], "_by_weight")
    table = stage(grouped_row_number(table, ["_home"], [("product_id", "asc")], "_by_id"), "segment-products")
    out = homes.join(table, "_home").select(
        "business_id", "product_id", (F.col("account_potential") * F.col("weight")).alias("product_potential"),
        F.when(F.col("account_potential") > 0, F.col("_by_weight")).otherwise(F.col("_by_id")).alias("product_rank"), "account_potential",
    )
    if check:
        wrong = reconcile(out).filter(F.abs("difference") >= tolerance).limit(5).collect()
        if wrong:
            raise AllocationError(f"allocated totals differ: {[r.asDict() for r in wrong]}")
    return out.drop("account_potential")


OVERALL = "(overall)"


def reconcile(allocated: DataFrame) -> DataFrame:
    """Allocated total against the potential, per account."""
    return allocated.groupBy("business_id").agg(
        F.sum("product_potential").alias("allocated"), F.max("account_potential").alias("account_potential")
    ).withColumn("difference", F.col("allocated") - F.col("account_potential"))


def top_products(allocated: DataFrame, n: int = 3) -> DataFrame:
    return allocated.filter(F.col("product_rank") <= n)
