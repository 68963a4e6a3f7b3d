"""Run-over-run comparison and change reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.aggregates import metrics_long
from ledgerlift.operators.lookup import full_compare
from ledgerlift.operators.ranking import Order, head, join_on


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of the same key with another value, both values shown."""
    old = before.select(*keys, *[F.col(c).alias(f"before_{c}") for c in columns])
    new = after.select(*keys, *[F.col(c).alias(f"after_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    return join_on(new, old, keys, "inner").filter(differs)


def change_counts(before: DataFrame, after: DataFrame, key: str, path: str) -> DataFrame:
    """How many rows moved from which path to which."""
    moved = changed_rows(before, after, [key], [path])
    return moved.groupBy(F.col(f"before_{path}").alias("old_path"), F.col(f"after_{path}").alias("new_path")).agg(F.count("*").alias("changed_rows"))


def top_overlap(previous: DataFrame, current: DataFrame, key: str, order: Order, sizes: Sequence[int]) -> DataFrame:
    """Common, dropped and entered ids of the two top-n lists, one row per n."""
    rows = None
    for n in sizes:
        old, new = (head(d, order, n).select(key) for d in (previous, current))
        both = full_compare(old, new, [key])
        row = both.agg(
            F.lit(n).cast("bigint").alias("top_n"), F.count_if(F.col("side") == "both").alias("overlap"),
            F.count_if(F.col("side") == "left_only").alias("dropped"), F.count_if(F.col("side") == "right_only").alias("entered"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def metric_deltas(previous: DataFrame, current: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """The same metrics of two runs side by side, with their difference."""
    old = metrics_long(previous, metrics).withColumnRenamed("value", "previous")
    new = metrics_long(current, metrics).withColumnRenamed("value", "current")
    return old.join(new, "metric").withColumn("delta", F.col("current") - F.col("previous"))


def movers(previous: DataFrame, current: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Per id: side, value and rank in both runs, value and rank change."""
    old = previous.select(key, F.col(value).alias("previous_value"), F.col(rank).alias("previous_rank"))
    new = current.select(key, F.col(value).alias("current_value"), F.col(rank).alias("current_rank"))
    return full_compare(old, new, [key]).withColumns(
        {
            "value_delta": F.coalesce("current_value", F.lit(0.0)) - F.coalesce("previous_value", F.lit(0.0)),
            "rank_delta": F.col("previous_rank") - F.col("current_rank"),
        }
    )


def largest_movers(compared: DataFrame, key: str, n: int = 50) -> DataFrame:
    return head(compared.withColumn("absolute_delta", F.abs("value_delta")), [("absolute_delta", "desc"), (key, "asc")], n)


def model_input(lines: DataFrame, statuses: Sequence[str], group_col: str, excluded: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Account-month input for one status scope, and its audit."""
    in_scope = F.coalesce(F.lower(F.trim("status")).isin(*[s.lower() for s in statuses]), F.lit(False))
    excluded_group = F.coalesce(F.trim(group_col).isin(*excluded), F.lit(False))
    usable = in_scope & ~excluded_group & F.col("account_id").isNotNull() & F.col("sold_on").isNotNull()
    months = lines.filter(usable).groupBy("account_id", F.date_format("sold_on", "yyyy-MM").alias("created_year_month")).agg(
        F.sum("total_value").alias("total_value")
    )
    value = F.col("total_value")
    audit = metrics_long(
        lines,
        {
            "source_rows": F.count("*"), "rows_in_status_scope": F.count_if(in_scope), "excluded_group_rows": F.count_if(in_scope & excluded_group),
            "excluded_group_eur": F.round(F.sum(F.when(in_scope & excluded_group, value).otherwise(0.0)), 2), "model_rows": F.count_if(usable),
            "model_eur": F.round(F.sum(F.when(usable, value).otherwise(0.0)), 2), "model_accounts": F.count_distinct(F.when(usable, F.col("account_id"))),
        },
    )
    return months, audit
