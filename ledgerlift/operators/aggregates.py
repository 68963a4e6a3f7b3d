"""Aggregation helpers with the null and tie rules used across the library."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.operators.ranking import first_per_key, join_on, top_n
from ledgerlift.session import stage


def sum_or_zero(col: Column) -> Column:
    """Sum in which nothing to add gives 0."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def sum_where(col: Column, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, col)), F.lit(0.0))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def fold_distinct(df: DataFrame, keys: Sequence[str], col: str, out: str, sep: str = ", ") -> DataFrame:
    """Distinct non-null values per key, sorted and joined.

    Values are made distinct before they are collected, so copies of one value never pile up.
    """
    distinct = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("string").alias("_v")).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_v")), sep).alias(out))


def merge_folded(df: DataFrame, keys: Sequence[str], col: str, out: str, sep: str = ", ") -> DataFrame:
    """Lists that were folded before: split, merged, made distinct, folded again."""
    parts = df.select(*keys, F.explode(F.split(F.col(col), ",")).alias("_p"))
    parts = parts.select(*keys, F.nullif(F.trim("_p"), F.lit("")).alias("_p"))
    return fold_distinct(parts, keys, "_p", out, sep)


def sample_values(df: DataFrame, keys: Sequence[str], col: str, order_col: str, out: str, n: int, sep: str = " | ") -> DataFrame:
    """First ``n`` distinct values per key by first appearance."""
    text = F.trim(F.col(col).cast("string"))
    values = df.select(*keys, text.alias("_v"), order_col).filter(F.col("_v").isNotNull() & (F.lower("_v") != "nan") & (F.col("_v") != ""))
    firsts = values.groupBy(*keys, "_v").agg(F.min(order_col).alias("_o"))
    picked = top_n(firsts, keys, [("_o", "asc"), ("_v", "asc")], n, "_r")
    return picked.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda x: x["_v"]), sep).alias(out)
    )


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of a row in its group total; 0 where the total is not positive."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    joined = join_on(df, totals, keys, "left") if keys else df.withColumn("__total", totals.scalar())
    return joined.withColumn(
        out, F.when(F.col("__total") > 0, F.col(value) / F.col("__total")).otherwise(F.lit(0.0))
    ).drop("__total")


def pivot_sum(df: DataFrame, keys: Sequence[str], pivot: str, value: str, names: Mapping[object, str]) -> DataFrame:
    """Sums by the given pivot values as columns, all of them present, gaps filled with 0."""
    aggs = [sum_where(F.col(value), F.col(pivot) == F.lit(v)).alias(name) for v, name in names.items()]
    return df.groupBy(*keys).agg(*aggs)


def argmax_row(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [(value, "desc"), *((t, "asc") for t in tie)])


def most_frequent(df: DataFrame, keys: Sequence[str], values: Sequence[str], seen: str) -> DataFrame:
    """Most frequent value combination per key; ties go to the one seen first."""
    counts = df.groupBy(*keys, *values).agg(F.count("*").alias("value_count"), F.min(seen).alias("_seen"))
    return first_per_key(
        counts, keys, [("value_count", "desc"), ("_seen", "asc"), *((v, "asc") for v in values)]
    ).drop("_seen")


def top_words(df: DataFrame, text: Column, n: int, stop_words: Sequence[str], pattern: str = "([a-zåäö0-9]{3,})") -> DataFrame:
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))).alias("word"))
    counts = words.filter(~F.col("word").isin(*stop_words)).groupBy("word").agg(F.count("*").alias("word_count"))
    return counts.orderBy(F.desc("word_count"), "word").limit(n)


def level_summary(df: DataFrame, levels: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Summaries of each prefix of a hierarchy in one pass (grouping sets)."""
    sets = [levels[: i + 1] for i in range(len(levels))]
    depth = F.lit(0)
    for level in levels:
        depth = depth + (1 - F.grouping(level).cast("int"))
    return df.groupingSets(sets, *levels).agg(
        depth.cast("int").alias("level"), *[expr.alias(name) for name, expr in aggs.items()]
    )


def metrics_long(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Many metrics from one pass over a table, as rows ``(metric, value)``."""
    row = df.agg(*[expr.cast("double").alias(name) for name, expr in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def consolidate_small(df: DataFrame, levels: Sequence[str], minimum: int, source: str, *, rounds: int = 5,
                      review: str = "Muut / tarkistettavat", other_prefix: str = "Muut ") -> DataFrame:
    """Merge leaves with fewer than ``minimum`` rows into "other" of their top level, else into review.

    The rounds work on leaf counts (one row per leaf), not on products: a mapping old leaf ->
    new leaf is grown round by round and joined to the products once at the end.  Each round is
    written, so the plan stays flat, and the loop stops when nothing moves.
    """
    leaf_cols = list(levels)
    start = [f"_o_{c}" for c in leaf_cols]
    leaves = df.groupBy(*leaf_cols).agg(F.count("*").alias("_n"))
    mapping = stage(
        leaves.select(*[F.col(c).alias(s) for c, s in zip(leaf_cols, start)], *leaf_cols, "_n", F.lit(0).alias("_moved")), "leaves"
    )
    top = leaf_cols[0]
    for _ in range(rounds):
        size = mapping.groupBy(*leaf_cols).agg(F.sum("_n").alias("_leaf"))
        top_size = mapping.groupBy(top).agg(F.sum("_n").alias("_top"))
        sized = join_on(join_on(mapping, size, leaf_cols, "left"), top_size, [top], "left")
        small = F.col("_leaf") < minimum
        keep_top = (F.col("_top") >= minimum) & (F.col(top) != review)
        other = F.concat(F.lit(other_prefix), F.lower(F.col(top)))
        target = {c: (F.when(keep_top, F.col(top)) if c == top else F.when(keep_top, other)).otherwise(F.lit(review)) for c in leaf_cols}
        moved = {c: F.when(small, expr).otherwise(F.col(c)) for c, expr in target.items()}
        changed = F.lit(False)
        for c in leaf_cols:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"_t_{c}"))
        moved_before = mapping.agg(F.sum("_moved")).first()[0]
        mapping = stage(
            sized.withColumns({f"_t_{c}": expr for c, expr in moved.items()})
            .withColumn("_moved", F.col("_moved") + changed.cast("int"))
            .select(*start, *[F.col(f"_t_{c}").alias(c) for c in leaf_cols], "_n", "_moved"),
            "leaves",
        )
        if mapping.agg(F.sum("_moved")).first()[0] == moved_before:
            break
    final = mapping.groupBy(*leaf_cols).agg(F.sum("_n").alias("_leaf"))
    sized = join_on(mapping, final, leaf_cols, "left")
    last = F.col("_leaf") < minimum
    sized = sized.select(
        *start, *[F.when(last, F.lit(review)).otherwise(F.col(c)).alias(f"_t_{c}") for c in leaf_cols],
        "_moved", last.alias("_last"),
    )
    joined = df
    condition = None
    for c, s in zip(leaf_cols, start):
        part = F.col(c).eqNullSafe(F.col(s))
        condition = part if condition is None else condition & part
    joined = joined.join(sized, condition, "left")
    tag = F.concat(
        F.coalesce(F.col(source), F.lit("")),
        F.repeat(F.lit("|min_leaf"), F.col("_moved")),
        F.when(F.col("_last"), F.lit("|review_bucket")).otherwise(F.lit("")),
    )
    others = [c for c in df.columns if c not in leaf_cols and c != source]
    return joined.select(*others, *[F.col(f"_t_{c}").alias(c) for c in leaf_cols], tag.alias(source))
