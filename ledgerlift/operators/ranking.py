"""Ranking, top-k and quantiles that never pull an unbounded group into one task.

An order is a list of ``(column, "asc" | "desc")``; nulls sort last either way.  Callers end it
with a unique column, so that results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.session import stage

Order = Sequence[tuple[str, str]]

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in partition below


def sort_columns(order: Order) -> list[Column]:
    return [F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in order]


def top_n(df: DataFrame, keys: Sequence[str], order: Order, n: int, rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    Spark cuts every map-side partition to ``n`` rows per key before the exchange
    (WindowGroupLimit), so a hot key costs each task at most ``n`` rows.
    """
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """One row per key: the first in the given order."""
    return top_n(df, keys, order, 1, "_first").drop("_first")


def head(df: DataFrame, order: Order, n: int) -> DataFrame:
    """First ``n`` rows overall, in order."""
    return df.orderBy(*sort_columns(order)).limit(n)


def global_row_number(df: DataFrame, order: Order, rank_col: str = "rank") -> DataFrame:
    """1, 2, 3, ... over the whole table, at every size in the same way.

    A range sort spreads rows by the full sort key, so equal values spread too; the sorted table is written
    once with its row ids, and partition sizes turn local positions into global ones.
    """
    return _sorted_positions(df, order, rank_col)


def _sorted_positions(df: DataFrame, order: Order, rank_col: str) -> DataFrame:
    staged = stage(df.orderBy(*sort_columns(order)).withColumn("_row", F.monotonically_increasing_id()), "ranked")
    partition = F.shiftright("_row", _ROW_BITS)
    sizes = staged.groupBy(partition.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    position = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        staged.withColumn("_part", partition)
        .join(F.broadcast(starts), "_part")  # one row per sort partition
        .withColumn(rank_col, F.col("_start") + position + 1)
        .drop("_part", "_start", "_row")
    )


def grouped_row_number(df: DataFrame, keys: Sequence[str], order: Order, rank_col: str = "rank") -> DataFrame:
    """1, 2, 3, ... within each group, also where one group holds most rows.

    The table is numbered sorted by group, and the first number of the group is taken off.
    """
    numbered = _sorted_positions(df, [*((k, "asc") for k in keys), *order], "_pos")
    firsts = numbered.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    return join_on(numbered, firsts, keys, "inner").withColumn(
        rank_col, F.col("_pos") - F.col("_first") + 1
    ).drop("_pos", "_first")


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which a null key matches a null key, keys kept once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for key in keys:
        part = F.col(key).eqNullSafe(F.col(f"_r_{key}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def group_totals(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Totals of a group on each of its rows: aggregate map-side, then join back."""
    totals = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return join_on(df, totals, keys, "left")


#: Accuracy of the sketch that brackets a quantile, and how much wider than its error the bracket is.
SKETCH, WIDER = 10_000, 3


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, long form ``(keys, quantile, value)``; a null key is a group.

    A sketch of fixed size first gives two values for each group and point between which the quantile lies.  Then what
    is below is counted, and only the different values between are put in order: some ten thousandths of a
    group.  Nothing is sorted as a whole.  Should a sketch have been wrong, which the counts show, all is ranked
    with :func:`grouped_row_number`.
    """
    present = stage(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "values")
    points = [float(p) for p in points]
    reach = WIDER / SKETCH
    edges = [x for p in points for x in (max(p - reach, 0.0), min(p + reach, 1.0))]
    facts = present.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", edges, SKETCH).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    # the first and last bracket reach to the ends, where a sketch has nothing beside it
    low = lambda k, p: F.col("_min") if p <= reach else F.element_at("_e", 2 * k + 1)
    high = lambda k, p: F.col("_max") if p >= 1 - reach else F.element_at("_e", 2 * k + 2)
    brackets = F.array(*[F.struct(F.lit(k).alias("k"), low(k, p).alias("lo"), high(k, p).alias("hi")) for k, p in enumerate(points)])
    facts = stage(facts.select(*keys, "_n", brackets.alias("_b")), "brackets")
    rows = join_on(present, facts, keys, "inner") if keys else present.withColumn("_b", facts.select("_b").scalar())
    below = rows.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_b")[k]["lo"]).alias(f"_below{k}") for k in range(len(points))])
    inside = rows.select(*keys, "_v", F.explode(F.filter("_b", lambda b: F.col("_v").between(b["lo"], b["hi"]))).alias("_in")).groupBy(*keys, F.col("_in.k").alias("_k"), "_v").agg(F.count("*").alias("_c"))
    told = facts.select(*keys, "_n", F.explode("_b.k").alias("_k"))
    under = below.select(*keys, F.posexplode(F.array(*[f"_below{k}" for k in range(len(points))])).alias("_k", "_below"))
    told = join_on(told, under, [*keys, "_k"], "inner").withColumn("_at", (F.col("_n") - 1) * F.element_at(F.array(*map(F.lit, points)), F.col("_k") + 1))
    window = Window.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = join_on(told, inside.withColumn("_upto", F.sum("_c").over(window)), [*keys, "_k"], "inner").withColumn("_upto", F.col("_upto") + F.col("_below"))
    first = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    found = ordered.groupBy(*keys, "_k", "_at").agg(
        first(F.floor("_at")).alias("_a"), first(F.ceil("_at")).alias("_z"), (F.min("_below") <= F.floor("_at")).alias("_sure")
    )
    found = stage(found, "quantiles")
    if not found.filter(~F.col("_sure") | F.col("_a").isNull() | F.col("_z").isNull()).isEmpty():
        return _ranked_quantiles(present, keys, points)
    weight = F.col("_at") - F.floor("_at")
    return found.select(*keys, F.element_at(F.array(*map(F.lit, points)), F.col("_k") + 1).alias("quantile"), (F.col("_a") * (1.0 - weight) + F.col("_z") * weight).alias("value"))


def _ranked_quantiles(present: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """As :func:`exact_quantiles`, from the rank of every value ``_v``."""
    counts = {"_n": F.count("*")}
    if keys:
        ranked = group_totals(grouped_row_number(present, keys, [("_v", "asc")], "_rank"), keys, counts)
    else:
        ranked = global_row_number(present, [("_v", "asc")], "_rank")
        size = ranked.agg(F.count("*").alias("_n"))
        ranked = ranked.withColumn("_n", size.scalar())
    spread = ranked.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    at = (F.col("_n") - 1) * F.col("_p") + 1
    near = spread.withColumn("_at", at).filter(
        (F.col("_rank") == F.floor("_at")) | (F.col("_rank") == F.ceil("_at"))
    )
    # at most two rows per group and point are left here
    weight = F.when(F.floor("_at") == F.ceil("_at"), F.lit(1.0)).otherwise(1.0 - F.abs(F.col("_rank") - F.col("_at")))
    return (
        near.groupBy(*keys, F.col("_p").alias("quantile"))
        .agg(F.sum(F.col("_v") * weight).alias("value"))
    )


def quota_top(
    df: DataFrame, keys: Sequence[str], order: Order, *, limit: int, special: Column, special_limit: int = 1,
    rank_col: str = "rank",
) -> DataFrame:
    """Top ``limit`` per key in which at most ``special_limit`` rows come from the special class.

    The special rows take their places, the rest goes to ordinary rows; all are ranked together.
    """
    flagged = df.withColumn("_special", special)
    best_special = top_n(flagged.filter("_special"), keys, order, special_limit, "_r")
    ordinary = top_n(flagged.filter(~F.col("_special")), keys, order, limit, "_r")
    picked = best_special.unionByName(ordinary)
    taken = F.sum(F.col("_special").cast("int")).over(Window.partitionBy(*keys))
    # at most limit + special_limit rows per key reach these windows
    kept = picked.withColumn("_taken", taken).filter(F.col("_special") | (F.col("_r") <= limit - F.col("_taken")))
    return top_n(kept.drop("_special", "_r", "_taken"), keys, order, limit, rank_col)


#: Places of a ranking that travel together, and rows that look at the same places in one task.
PLACE_BLOCK, PLACE_SHARE = 64, 20_000


def take_places(wanted: DataFrame, ranked: DataFrame, keys: Sequence[str], place: str, need: Column, spread: Sequence[str]) -> DataFrame:
    """The first ``need`` rows of its key's ranking for each row of ``wanted``: columns of both, keys once.

    Everyone who shares a key wants its first places, so those are hot whatever the ranking's size.  Places are cut
    into blocks of ``PLACE_BLOCK``; a block that more than ``PLACE_SHARE`` rows want is copied as often as these fill
    tasks, and the rows are dealt to the copies by the ``spread`` columns (an id of theirs).  Copies hold
    no more than one block for each ``PLACE_SHARE`` rows that want it.  Places beyond the ranking's end give
    nothing; a null key matches a null key.
    """
    facts = [c for c in ranked.columns if c not in keys]
    blocks = ranked.groupBy(*keys, F.floor((F.col(place) - 1) / PLACE_BLOCK).cast("int").alias("_block")).agg(
        F.collect_list(F.struct(*facts)).alias("_rows")  # at most as many as one block has places for each key
    )
    asks = wanted.withColumn("_need", need.cast("bigint")).filter(F.col("_need") > 0)
    asks = asks.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_need") - 1) / PLACE_BLOCK).cast("int"))))
    hot = asks.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).filter(F.col("_n") > PLACE_SHARE)
    hot = stage(hot.withColumn("_copies", F.ceil(F.col("_n") / PLACE_SHARE).cast("int")).drop("_n"), "hot-places")
    copied = F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    blocks = join_on(blocks, hot, [*keys, "_block"], "left").withColumn("_copy", copied).drop("_copies")
    asks = join_on(asks, hot, [*keys, "_block"], "left").withColumn(
        "_copy", F.pmod(F.xxhash64(*spread), F.coalesce("_copies", F.lit(1)).cast("bigint")).cast("int")
    ).drop("_copies")
    met = join_on(asks, blocks, [*keys, "_block", "_copy"], "inner").drop("_block", "_copy")
    met = met.withColumn("_row", F.explode("_rows")).filter(F.col(f"_row.{place}") <= F.col("_need"))
    return met.select(*wanted.columns, *[F.col(f"_row.{c}").alias(c) for c in facts])


def fill_from_global(
    listed: DataFrame, keys: Sequence[str], item: str, global_ranked: DataFrame, rank_col: str, n: int
) -> DataFrame:
    """Best ``n`` items of a global ranking that a key does not list yet.

    A key that lists m items needs no more than the first n + m of the ranking, so that is what it looks at:
    linear in the lists, no key-by-item product.
    """
    sizes = listed.groupBy(*keys).agg(F.count("*").alias("_m"))
    ranking = global_ranked.withColumnRenamed(rank_col, "_want")
    offered = take_places(sizes, ranking, [], "_want", F.col("_m") + n, keys).drop("_m")
    marks = listed.select(*keys, item)
    missing = join_on(offered, marks.withColumn("_listed", F.lit(True)), [*keys, item], "left").filter(
        F.col("_listed").isNull()
    )
    return top_n(missing, keys, [("_want", "asc")], n, "_r").drop("_r", "_want", "_listed")
