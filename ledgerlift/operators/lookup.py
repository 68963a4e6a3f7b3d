"""Joins that look a value up: unique keys only, cascades, containment, fuzzy names."""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import text as tx
from ledgerlift.operators.ranking import Order, first_per_key, sort_columns, top_n
from ledgerlift.session import stage


class DuplicateKeyError(ValueError):
    """A lookup side has more than one row for a key."""


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "lookup") -> DataFrame:
    """Raise if a key occurs twice (many-to-one check); hands the table back."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").limit(5).collect()
    if twice:
        raise DuplicateKeyError(f"{label}: keys occur more than once, e.g. {[tuple(r)[:-1] for r in twice]}")
    return df


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str = "lookup") -> DataFrame:
    return left.join(assert_unique(right, keys, label), list(keys), "left")


def exists_flag(left: DataFrame, right: DataFrame, on: Column, flag: str) -> DataFrame:
    """Left table with a boolean: is there a match on the right?"""
    return left.join(right.withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def flag_member(left: DataFrame, left_col: str, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """Set membership as a flag; ids are made distinct first so rows never multiply."""
    members = ids.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    return exists_flag(left, members, F.col(left_col) == F.col("_id"), flag).drop("_id")


def full_compare(left: DataFrame, right: DataFrame, keys: Sequence[str], side: str = "side") -> DataFrame:
    """Full outer join with an indicator: ``both``, ``left_only`` or ``right_only``."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full_outer")
    return joined.withColumn(
        side, F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    ).drop("_l", "_r")


def unique_lookup(df: DataFrame, keys: Sequence[str], values: Sequence[str], *, must_agree: Sequence[str] | None = None,
                  order: Order | None = None) -> DataFrame:
    """Keys that lead to exactly one value (blank keys dropped).

    min = max says "one distinct value" with a plain, map-side combinable aggregate; rows are made distinct by
    hashing before, as Spark sorts all its input for extremes of texts.  Columns in
    ``values`` that need not agree come from the first row in ``order``.
    """
    agree = list(must_agree or values)
    present = df
    for key in keys:
        present = present.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    aggs = []
    for col in agree:
        aggs += [F.min(col).alias(f"_lo_{col}"), F.max(col).alias(f"_hi_{col}")]
    grouped = present.select(*dict.fromkeys([*keys, *agree])).distinct().groupBy(*keys).agg(*aggs)
    for col in agree:
        grouped = grouped.filter(F.col(f"_lo_{col}") == F.col(f"_hi_{col}"))
    found = grouped.select(*keys, *[F.col(f"_lo_{c}").alias(c) for c in agree])
    rest = [v for v in values if v not in agree]
    if not rest:
        return found
    firsts = first_per_key(present, keys, order or [(v, "asc") for v in rest]).select(*keys, *rest)
    return found.join(firsts, list(keys))


def key_status(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: its value if it is the only one, and ``unique`` or ``ambiguous``."""
    present = df.filter((F.col(key) != "") & (F.col(value) != ""))
    lo, hi = F.min(value), F.max(value)
    return present.groupBy(key).agg(
        F.when(lo == hi, lo).alias(value), F.when(lo == hi, "unique").otherwise("ambiguous").alias("key_status")
    )


SALTS = 4096


def sparse_join(left: DataFrame, right: DataFrame, keys: Sequence[str], need: Column | None = None, *, spread: Sequence[str]) -> DataFrame:
    """Left join for keys that are often blank; one pass over the left side.

    A third of all rows may share the blank key (or need no lookup at all).  Their keys become null, which
    matches nothing, and a salt from the ``spread`` columns (a row id) deals them out; a retried task deals
    them the same way again.  Only keys and ``spread`` columns are read for this, and keys keep their types.
    """
    if not spread:
        raise ValueError("spread needs the columns of a row id")
    usable = F.lit(True)
    for key in keys:
        usable = usable & F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    if need is not None:
        usable = usable & need
    usable = F.coalesce(usable, F.lit(False))
    salted = {f"_k{i}": F.when(usable, F.col(k)) for i, k in enumerate(keys)}
    others = [c for c in right.columns if c not in keys]
    lookup = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *others)
    salted["_salt"] = F.when(usable, F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int") + 1)
    # always 0, but not a constant: the optimizer would take a constant out of the join keys, and the salt would not deal rows out
    lookup = lookup.withColumn("_salt", F.pmod(F.xxhash64(*[f"_k{i}" for i in range(len(keys))]), F.lit(1)).cast("int"))
    return left.withColumns(salted).join(lookup, list(salted), "left").drop(*salted)


def cascade_fill(
    df: DataFrame, steps: Sequence[tuple[str, Sequence[str], DataFrame, Sequence[str]]], values: Sequence[str],
    method_col: str, missing: Column, *, spread: Sequence[str],
) -> DataFrame:
    """Fill missing rows by ordered lookups; the first step that knows the key wins.

    ``spread`` names a row id, see :func:`sparse_join`.

    A step is ``(method, key columns of df, lookup, key columns of lookup)``.  Filled rows never change.
    """
    out = df.withColumn("_open", F.coalesce(missing, F.lit(False)))
    for method, left_keys, lookup, right_keys in steps:
        renamed = lookup.select(
            *[F.col(r).alias(l) for l, r in zip(left_keys, right_keys)],
            *[F.col(v).alias(f"_v_{v}") for v in values],
            F.lit(True).alias("_hit"),
        )
        out = sparse_join(out, renamed, left_keys, F.col("_open"), spread=spread)
        hit = F.col("_open") & F.coalesce(F.col("_hit"), F.lit(False))
        out = (
            out.withColumns(
                {
                    **{v: F.when(hit, F.col(f"_v_{v}")).otherwise(F.col(v)) for v in values},
                    method_col: F.when(hit, F.lit(method)).otherwise(F.col(method_col)),
                    "_open": F.col("_open") & ~hit,
                }
            )
            .drop("_hit", *[f"_v_{v}" for v in values])
        )
    return out.drop("_open")


def first_of_columns(df: DataFrame, columns: Sequence[str], value_cols: Sequence[str], order_col: str,
                     clean=lambda c: F.nullif(F.lower(F.trim(c.cast("string"))), F.lit(""))) -> DataFrame:
    """Several key columns made one lookup ``(key, key_source, values)``; earlier columns win."""
    entries = F.array(
        *[F.struct(clean(F.col(c)).alias("key"), F.lit(c).alias("key_source"), F.lit(i).alias("_i")) for i, c in enumerate(columns)]
    )
    long = df.select(F.explode(entries).alias("e"), *value_cols, F.col(order_col).alias("_order"))
    long = long.select("e.key", "e.key_source", "e._i", *value_cols, "_order").filter(F.col("key").isNotNull())
    return first_per_key(long, ["key"], [("_i", "asc"), ("_order", "asc")]).drop("_i", "_order")


def index_join(records: DataFrame, record_id: str, record_keys: Column, items: DataFrame, item_id: str, item_keys: Column) -> DataFrame:
    """Pairs that share any of several exact keys, each pair once."""
    left = records.select(record_id, F.explode(F.array_distinct(record_keys)).alias("_key"))
    right = items.select(item_id, F.explode(F.array_distinct(item_keys)).alias("_key"))
    keyed = left.filter(F.col("_key") != "").join(right.filter(F.col("_key") != ""), "_key")
    return keyed.select(record_id, item_id).distinct()


TEXT_TOKEN = r"(?<![A-Z0-9])([A-Z0-9][A-Z0-9._/-]{4,})(?![A-Z0-9])"


def token_in_text_join(
    records: DataFrame, record_id: str, record_keys: Column, items: DataFrame, item_id: str, text: Column, *, max_hits: int = 5
) -> DataFrame:
    """Keys of at least five characters found as a token of an item's text.

    A key that hits more than ``max_hits`` items identifies none and is left out.  Hits are
    counted per key before the join, so a word found everywhere never multiplies rows.
    """
    stripped = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[._/-]+", ""), r"[._/-]+$", "")
    keys = records.select(record_id, F.explode(F.array_distinct(record_keys)).alias("_raw"))
    keys = keys.filter(F.length("_raw") >= 5).select(record_id, stripped(F.col("_raw")).alias("_key"))
    found = F.regexp_extract_all(F.upper(text), F.lit(TEXT_TOKEN), F.lit(1))
    words = items.select(item_id, F.explode(F.array_distinct(F.transform(found, stripped))).alias("_key"))
    words = words.join(keys.select("_key").distinct(), "_key", "left_semi")
    few = words.groupBy("_key").agg(F.count("*").alias("_hits")).filter(F.col("_hits") <= max_hits)
    allowed = words.join(few.select("_key"), "_key")
    return keys.join(allowed, "_key").select(record_id, item_id).distinct()


#: Lengths of the grams that names are found by; a name is looked up by the longest that it has room for.
GRAM_SIZES = (1, 2, 3, 4, 8, 16)


def _grams(text: Column, size: Column | int) -> Column:
    """The different pieces of ``size`` characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size) if isinstance(size, int) else size)))


def contained_names(longer: DataFrame, long_id: str, long_name: str, shorter: DataFrame, short_name: str) -> DataFrame:
    """Pairs in which a whole name is a part of a longer text; ``long_id`` names a text.

    A name is indexed under one of its pieces only, the one that the fewest texts hold; texts meet the names under
    their own pieces, and what meets is verified.  A text gives at most as many rows as it has pieces of
    the few sizes in use, whatever the names are.
    """
    size = F.lit(GRAM_SIZES[0])
    for g in GRAM_SIZES[1:]:
        size = F.when(F.length("_name") >= g, F.lit(g)).otherwise(size)
    names = shorter.filter(F.length(short_name) > 0).select(F.col(short_name).alias("_name")).distinct()
    names = stage(names.withColumn("_size", size).withColumn("_gram", F.explode(_grams(F.col("_name"), F.col("_size")))), "name-pieces")
    used = names.select("_size", "_gram").distinct()
    sizes = [r["_size"] for r in names.select("_size").distinct().collect()]  # six at most
    texts = stage(longer.select(F.col(long_id).alias("_long"), F.col(long_name).alias("_t")).filter(F.col("_t").isNotNull()), "texts")
    pieces = F.array(*[F.struct(F.lit(g).alias("_size"), F.when(F.length("_t") >= g, _grams(F.col("_t"), g)).alias("_grams")) for g in sizes])
    found = texts.select("_long", F.explode(pieces).alias("_p")).select("_long", F.col("_p._size").alias("_size"), F.explode("_p._grams").alias("_gram")) if sizes else texts.select(
        "_long", F.lit(0).alias("_size"), F.lit("").alias("_gram"))
    found = stage(found.join(used, ["_size", "_gram"], "left_semi"), "text-pieces")
    often = found.groupBy("_size", "_gram").agg(F.count("*").alias("_often"))
    # a piece that no text has rules its name out
    index = names.join(often, ["_size", "_gram"], "left").groupBy("_name", "_size").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("_often"), "_gram")).alias("_best"))
    index = index.filter("_best._often > 0").select("_name", "_size", F.col("_best._gram").alias("_gram"))
    met = found.join(index, ["_size", "_gram"]).select("_long", "_name").join(texts, "_long").filter(F.contains("_t", "_name"))
    facts = shorter.withColumnRenamed(short_name, "_name")
    return met.select(F.col("_long").alias(long_id), "_t", "_name").join(facts, "_name").select(
        long_id, "_t", F.col("_name").alias(short_name), *[c for c in shorter.columns if c != short_name])


def unique_containment(open_rows: DataFrame, row_id: str, name: str, known: DataFrame, known_name: str, known_id: str, *, min_len: int = 4) -> DataFrame:
    """Rows whose name contains, or is contained in, names of exactly one known id."""
    rows = open_rows.filter(F.length(name) >= min_len).select(row_id, F.col(name).alias("_name"))
    names = known.filter(F.length(known_name) >= min_len).select(F.col(known_name).alias("_known"), F.col(known_id).alias("_id")).distinct()
    wanted = rows.select("_name").distinct()
    holds = contained_names(wanted.withColumn("_row_name", F.col("_name")), "_row_name", "_name", names, "_known").select("_row_name", "_id")
    held = contained_names(
        names.withColumn("_pair", F.struct("_known", "_id")), "_pair", "_known", wanted, "_name"
    ).select(F.col("_name").alias("_row_name"), F.col("_pair._id").alias("_id"))
    both = holds.unionByName(held).groupBy("_row_name").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    single = both.filter(F.col("_lo") == F.col("_hi")).select(F.col("_row_name").alias("_name"), F.col("_lo").alias(known_id))
    return rows.join(single, "_name").select(row_id, known_id)


def similarity_at(threshold: float):
    """Vectorised sequence-similarity ratio (0-1) for blocked candidates.

    Pairs whose length or letter counts already rule the threshold out get 0 without the costly part.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        matcher, last = SequenceMatcher(None), None
        for i in np.argsort(b.to_numpy(), kind="stable"):
            if b.iat[i] != last:  # what is known of the second text is kept while it stays
                last = b.iat[i]
                matcher.set_seq2(last)
            matcher.set_seq1(a.iat[i])
            if matcher.real_quick_ratio() >= threshold and matcher.quick_ratio() >= threshold:
                out[i] = matcher.ratio()
        return pd.Series(out)

    return ratio


GRAM = 2

#: Pairs of one gram that are made together, about: four thousand rows of each side.
PAIR_SHARE = 1 << 24


def _max_edits(total: Column, threshold: float) -> Column:
    """Insertions plus deletions two texts of ``total`` characters may need at that ratio."""
    return F.floor(total * (1.0 - threshold) + 1e-9).cast("int")


def _partners(size: Column, threshold: float) -> tuple[Column, Column]:
    """Shortest and longest text that can reach the threshold with one of that size."""
    return F.ceil(size * (threshold / (2.0 - threshold)) - 1e-9).cast("int"), F.floor(size * ((2.0 - threshold) / threshold) + 1e-9).cast("int")


def _tokens(text: Column) -> Column:
    """The text's different grams, padded at both ends."""
    pad = GRAM - 1
    padded = F.concat(F.lit("\u0001" * pad), text, F.lit("\u0002" * pad))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + pad), lambda i: F.substring(padded, i, F.lit(GRAM))))


def similar_candidates(left: DataFrame, left_key: str, right: DataFrame, right_key: str, threshold: float) -> DataFrame:
    """(_l, _r): pairs of distinct texts among which are all with similarity >= ``threshold``.

    A ratio r over lengths m and n allows d = (1 - r)(m + n) insertions and deletions, and each spoils the grams at
    ``GRAM`` places at most.  So of each text's different grams all but ``GRAM * d`` are the other's too, and under
    any order of all grams the first one in common is among the first ``GRAM * d + 1`` of both.  Grams are ordered by how many texts hold them, rare ones
    first: what most names begin or end with is hardly ever a key.  Pairs that meet must then have grams and
    characters enough in common, seen from bits that travel with them (:func:`marks`), before they are made distinct and scored.  Below a threshold of
    about .8 the edits may spoil all grams; such texts meet by length.
    """
    lefts = left.select(F.col(left_key).alias("_t")).filter(F.length("_t") > 0).distinct()
    rights = right.select(F.col(right_key).alias("_t")).filter(F.length("_t") > 0).distinct()
    both = lefts.withColumn("_side", F.lit(0)).unionByName(rights.withColumn("_side", F.lit(1))).withColumn("_n", F.length("_t"))
    both = stage(both.withColumns({"_tokens": _tokens(F.col("_t")), "_marks": marks(F.col("_t"))}).withColumn("_size", F.size("_tokens")), "name-grams")
    held = both.select("_t", "_side", "_n", "_size", "_marks", F.explode("_tokens").alias("_g"))
    often = held.groupBy("_g").agg(F.count("*").alias("_f"))
    low, high = _partners(F.col("_n"), threshold)
    edits = _max_edits(F.col("_n") + high, threshold)
    # a text so short that the edits may spoil all its grams has no prefix that must be met
    short = GRAM * edits >= F.col("_size")
    ranked = held.join(often, "_g").filter(~short).groupBy("_t", "_side", "_n").agg(F.first("_marks").alias("_marks"), F.array_sort(F.collect_list(F.struct("_f", "_g"))).alias("_order"))
    prefix = ranked.withColumn("_k", F.explode(F.slice("_order", F.lit(1), GRAM * edits + 1))).select("_t", "_side", "_n", "_marks", F.col("_k._g").alias("_g"), low.alias("_low"), high.alias("_high"))
    prefix = stage(prefix, "name-prefixes")
    a, b = (prefix.filter(F.col("_side") == k).select("_g", F.col("_t").alias(t), F.col("_marks").alias(f"{t}m"), F.col("_n").alias(n), F.col("_low").alias(f"{n}_low"), F.col("_high").alias(f"{n}_high")) for k, t, n in ((0, "_l", "_m"), (1, "_r", "_n")))
    # few bytes make many pairs, so the number of tasks doesn't follow from the bytes
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (side.repartition(tasks, "_g", "_part") for side in dealt_in_blocks(a, b, "_g", "_l", "_r"))
    met = a.join(b, ["_g", "_part"]).filter((F.col("_n") >= F.col("_m_low")) & (F.col("_n") <= F.col("_m_high")))
    # the short ones meet by length
    tiny = both.filter(short).select("_t", "_side", "_n", "_marks", low.alias("_low"), high.alias("_high"))
    reach = lambda side, t: tiny.filter(F.col("_side") == side).select(F.col("_t").alias(t), F.col("_marks").alias(f"{t}m"), F.explode(F.sequence("_low", "_high")).alias("_n"))
    others = lambda side, t: both.filter(F.col("_side") == side).select(F.col("_t").alias(t), F.col("_marks").alias(f"{t}m"), "_n")
    near = possibly_similar(threshold)
    pairs = met.filter(near).select("_l", "_r")
    for mine, its in ((reach(0, "_l"), others(1, "_r")), (reach(1, "_r"), others(0, "_l"))):
        pairs = pairs.unionByName(mine.join(its, "_n").filter(near).select("_l", "_r"))
    return pairs.repartition(tasks, "_l", "_r").distinct()


def dealt_in_blocks(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` with a column ``_part``, by which each pair of a key still meets once.

    A key that makes more than its share of pairs has both sides dealt into pieces of the root of the share, by their texts,
    and each pair of pieces is a part.  A row is copied as often as the other side has pieces; were one side dealt
    alone, copies would grow with the cube of a key's rows.
    """
    piece = math.isqrt(PAIR_SHARE)
    counts = a.groupBy(key).agg(F.count("*").alias("_a")).join(b.groupBy(key).agg(F.count("*").alias("_b")), key).filter(F.col("_a") * F.col("_b") > PAIR_SHARE)
    crowded = stage(counts.select(key, *[F.ceil(F.col(c) / piece).cast("int").alias(c) for c in ("_a", "_b")]), "crowded-keys")
    n_a, n_b = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1))
    mine = lambda text, n: F.pmod(F.xxhash64(text), n.cast("bigint")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt_a = a.join(crowded, key, "left").withColumn("_other", each(n_b)).withColumn("_part", F.struct(mine(left, n_a).alias("a"), F.col("_other").alias("b")))
    dealt_b = b.join(crowded, key, "left").withColumn("_other", each(n_a)).withColumn("_part", F.struct(F.col("_other").alias("a"), mine(right, n_b).alias("b")))
    return dealt_a.drop("_a", "_b", "_other"), dealt_b.drop("_a", "_b", "_other")


def marks(text: Column) -> Column:
    """Eight words of bits of a text: four with a bit for each gram, four with a bit for each character and how often it came before.

    Different ones may share a bit, so two texts differ in at least as many grams and characters as in bits.
    """

    @F.pandas_udf("array<long>")
    def bits(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), 2, 256), bool)
        for i, one in enumerate(texts):
            codes = np.frombuffer(f"\u0001{one}\u0002".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            out[i, 0, (codes[:-1] * 31 + codes[1:]) % 256] = True
            letters = np.sort(codes[1:-1])
            out[i, 1, (letters * 7 + 53 * (np.arange(len(letters)) - np.searchsorted(letters, letters))) % 256] = True
        return pd.Series(list(np.packbits(out.reshape(len(texts), 512), axis=1).view(np.int64)))

    return bits(text)


def possibly_similar(threshold: float) -> Column:
    """Whether the :func:`marks` of ``_l`` and ``_r``, ``_lm`` and ``_rm``, leave room for the similarity: bits that one of them
    lacks are no more than grams the edits can spoil, and bits of characters that differ no more than edits."""
    edits = _max_edits(F.length("_l") + F.length("_r"), threshold)
    bits = lambda x, places: sum((F.bit_count(x(F.col("_lm")[i], F.col("_rm")[i])) for i in places[1:]), F.bit_count(x(F.col("_lm")[places[0]], F.col("_rm")[places[0]])))
    lacks = lambda p, q: p.bitwiseAND(F.bitwise_not(q))
    return (bits(lambda p, q: p.bitwiseXOR(q), [4, 5, 6, 7]) <= edits) & (bits(lacks, [0, 1, 2, 3]) <= GRAM * edits) & (bits(lambda p, q: lacks(q, p), [0, 1, 2, 3]) <= GRAM * edits)


def similar_pairs(left: DataFrame, left_key: str, right: DataFrame, right_key: str, threshold: float, *, condition=None) -> DataFrame:
    """All pairs of distinct texts with similarity >= ``threshold``, see :func:`similar_candidates`.

    ``condition(left text, right text)`` may narrow them before they are scored.
    """
    pairs = similar_candidates(left, left_key, right, right_key, threshold)
    if condition is not None:
        pairs = pairs.filter(condition(F.col("_l"), F.col("_r")))
    scored = pairs.withColumn("similarity", similarity_at(threshold)("_l", "_r"))
    return scored.filter(F.col("similarity") >= threshold).select(
        F.col("_l").alias(left_key), F.col("_r").alias(right_key), "similarity"
    )


def fuzzy_best(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, *, accept: float = 0.93, margin: float = 0.03, min_token: int = 4
) -> DataFrame:
    """Best similar text that shares a word, if good enough and clearly ahead of the second best.

    A rival only matters above ``accept - margin``, so pairs from there on are all that is needed.
    """
    shares_word = lambda a, b: F.arrays_overlap(tx.tokens(a, min_token), tx.tokens(b, min_token))
    pairs = similar_pairs(left, left_key, right, right_key, accept - margin, condition=shares_word)
    top = top_n(pairs, [left_key], [("similarity", "desc"), (right_key, "asc")], 2, "_rank")
    best = top.groupBy(left_key).agg(
        F.max_by(right_key, -F.col("_rank")).alias(right_key),
        F.max("similarity").alias("similarity"),
        F.max(F.when(F.col("_rank") == 2, F.col("similarity"))).alias("_second"),
    )
    return best.filter(
        (F.col("similarity") >= accept)
        & (F.col("_second").isNull() | (F.col("similarity") - F.col("_second") >= margin))
    ).drop("_second")


def interval_members(events: DataFrame, key: str, date_col: str, points: DataFrame, point_col: str, lookback_days: int) -> DataFrame:
    """Distinct (key, point) with an event in ``(point - lookback, point]``.

    Both sides are cut into calendar months and joined on the month; the exact bounds are then
    checked.  Events are made distinct by day first.
    """
    days = events.select(key, F.col(date_col).cast("date").alias("_day")).filter(F.col(key).isNotNull()).distinct()
    days = days.withColumn("_month", F.trunc("_day", "month"))
    months = points.select(
        point_col,
        F.explode(
            F.sequence(F.trunc(F.date_sub(point_col, lookback_days), "month"), F.trunc(point_col, "month"), F.expr("interval 1 month"))
        ).alias("_month"),
    )
    hits = days.join(months, "_month").filter(
        (F.col("_day") > F.date_sub(point_col, lookback_days)) & (F.col("_day") <= F.col(point_col))
    )
    return hits.select(key, point_col).distinct()
