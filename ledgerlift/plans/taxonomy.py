"""Product taxonomy: rule tables, cascades, tree codes, group maintenance."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlift.functions import text as tx
from ledgerlift.operators.aggregates import most_frequent
from ledgerlift.operators.ranking import first_per_key, join_on

RULES_DIR = Path(__file__).parent / "rules"
REVIEW = ("Muut / tarkistettavat", "Muut / tarkistettavat", "Tarkistettavat")


@dataclass(frozen=True)
class Rule:
    """One line of a rule table: a pattern, words any of which must occur, or conditions; the group path; who it is for.

    ``conditions`` are alternatives, each of (kind, term) pairs that must all hold; see :func:`holds`.
    """

    name: str
    path: tuple[str, ...]
    pattern: str = ""
    words: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    priority: bool = False
    confidence: str = "medium"
    conditions: tuple[tuple[tuple[str, str], ...], ...] = ()


def _rows(name: str) -> list[list[str]]:
    lines = (RULES_DIR / f"{name}.tsv").read_text(encoding="utf-8").splitlines()
    return [line.split("\t") for line in lines if line and not line.startswith("#")]


def pattern_rules(name: str) -> list[Rule]:
    """Rule table with patterns, categories and priority marks."""
    out = []
    for label, pattern, categories, priority, *path in _rows(name):
        allowed = tuple("" if c == "(blank)" else c for c in categories.split(";")) if categories else ()
        out.append(Rule(label, tuple(path), pattern=pattern, categories=allowed, priority=priority == "1"))
    return out


def word_rules(name: str, *, with_confidence: bool = False) -> list[Rule]:
    out = []
    for label, words, *rest in _rows(name):
        confidence, path = (rest[0], rest[1:]) if with_confidence else ("high", rest)
        out.append(Rule(label, tuple(path), words=tuple(words.split(";")), confidence=confidence))
    return out


def name_fill_rules(which: str) -> list[Rule]:
    """A set of the rules that judge a name by conditions: keywords, common_names, duties, category_default or overwrites."""
    out = []
    for own, label, conditions, *path in _rows("name_fills"):
        if own == which:
            parts = tuple(tuple(tuple(c.split(":", 1)) for c in p.split(" & ")) if ":" in p.split(" & ")[-1] else (tuple(p.split(":", 1)),) for p in conditions.split(" | "))
            out.append(Rule(label, tuple(path), confidence="high", conditions=parts))
    return out


def holds(kind: str, term: str, name: Column, category: Column | None) -> Column:
    """Whether a name meets a condition.

    ``word``: the term stands in the name, no letter beside it; ``has``: anywhere; both in the name in small letters, hyphens as
    spaces, ``10 x 20 cm`` as ``10x20cm``.  ``exact``: the whole name but for case and spaces; ``pattern``: in it; ``same``: the name
    as it is; ``category``: the row's category but for case.
    """
    name = F.coalesce(name, F.lit(""))
    plain = tx.collapse(F.lower(name))
    if kind in ("word", "has"):
        spelt = tx.collapse(F.regexp_replace(F.regexp_replace(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), r"(?<=\d)\s*x\s*(?=\d)", "x"), r"(?<=\d)\s+cm\b", "cm"))
        return F.contains(spelt, F.lit(term)) if kind == "has" else spelt.rlike(rf"(?<![a-zåäö]){re.escape(term)}(?![a-zåäö])")
    if kind == "category":
        if category is None:
            raise ValueError("the rule needs a category column")
        return F.lower(F.trim(F.coalesce(category, F.lit("")))) == term
    return {"exact": lambda: plain == term, "pattern": lambda: plain.rlike(term), "same": lambda: name == term}[kind]()


def category_paths() -> dict[str, tuple[str, ...]]:
    return {key: tuple(path) for key, *path in _rows("inventory_categories")}


def fold_pattern(pattern: str) -> str:
    """Pattern for folded text: å ä ö é è á ü without marks."""
    return pattern.translate(str.maketrans("äöåéèáü", "aoaeeau"))


def fits(rule: Rule, text: Column, category: Column | None = None, *, folded: bool = False) -> Column:
    if rule.conditions:
        test = F.lit(False)
        for every in rule.conditions:
            one = F.lit(True)
            for kind, term in every:
                one = one & holds(kind, term, text, category)
            test = test | one
    elif rule.words:
        # plain words are searched as bytes, many times faster than as a pattern
        test = reduce(or_, [F.contains(text, F.lit(word)) for word in rule.words])
    else:
        body = fold_pattern(rule.pattern) if folded else rule.pattern
        test = text.rlike(f"(?iU){body}")
    if rule.categories:
        if category is None:
            raise ValueError(f"rule {rule.name} needs a category column")
        test = test & F.coalesce(F.trim(category), F.lit("")).isin(*rule.categories)
    return F.coalesce(test, F.lit(False))


def first_rule(rules: Sequence[Rule], text: Column, category: Column | None = None, *, folded: bool = False) -> Column:
    """Position (from 1) of the first fitting rule, else null: one expression, one pass."""
    out = F.when(fits(rules[0], text, category, folded=folded), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(fits(rule, text, category, folded=folded), F.lit(i))
    return out


def rule_result(rules: Sequence[Rule], position: Column) -> Column:
    """Struct (source, confidence, l1.. ) of a rule position."""
    depth = max(len(r.path) for r in rules)
    entries = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("source"), F.lit(r.confidence).alias("confidence"),
                *[F.lit(r.path[i] if i < len(r.path) else "").alias(f"l{i + 1}") for i in range(depth)],
            )
            for r in rules
        ]
    )
    return F.when(position.isNotNull(), F.element_at(entries, position))


def classify(df: DataFrame, rules: Sequence[Rule], text: Column, out: str = "group", category: Column | None = None, *, folded: bool = False) -> DataFrame:
    """Adds struct ``out`` of the first fitting rule (null if none fits)."""
    # a column of its own: the text is made once for a row, not once for every rule
    marked = df.withColumn("_text", text).withColumn("_pos", first_rule(rules, F.col("_text"), category, folded=folded))
    return marked.withColumn(out, rule_result(rules, F.col("_pos"))).drop("_pos", "_text")


def classify_or_review(df: DataFrame, rules: Sequence[Rule], text: Column, *, folded: bool = True) -> DataFrame:
    """Group columns l1..l3, source and confidence; products without a rule go to review."""
    out = classify(df, rules, text, "_g", folded=folded)
    default = {"l1": REVIEW[0], "l2": REVIEW[1], "l3": REVIEW[2], "source": "manual_review_no_rule_match", "confidence": "review"}
    return out.withColumns({k: F.coalesce(F.col(f"_g.{k}"), F.lit(v)) for k, v in default.items()}).drop("_g")


def by_category(df: DataFrame, category: str, out: str, paths: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Struct of the exact category map (folded key), null where the category is unknown."""
    table = paths or category_paths()
    depth = max(len(p) for p in table.values())
    keys = F.create_map(*[x for key, path in table.items() for x in (F.lit(key), F.struct(*[F.lit(path[i] if i < len(path) else "").alias(f"l{i + 1}") for i in range(depth)]))])
    return df.withColumn(out, F.element_at(keys, tx.fold(F.col(category))))


def choose_group(candidates: Sequence[tuple[Column, str]], default: Sequence[str]) -> Column:
    """First path that is known, with the name of the step that gave it: struct (l1..l4, source)."""
    n = len(default)
    known = [
        F.when(col.isNotNull(), F.struct(*[F.coalesce(col[f"l{i + 1}"], F.lit("")).alias(f"l{i + 1}") for i in range(n)], F.lit(tag).alias("source")))
        for col, tag in candidates
    ]
    fallback = F.struct(*[F.lit(v).alias(f"l{i + 1}") for i, v in enumerate(default)], F.lit("not_classified").alias("source"))
    return F.coalesce(*known, fallback)


def is_other_like(*levels: Column) -> Column:
    """Any level that says "other" or "needs review"."""
    names = ("muut", "muu", "muut tarkistettavat", "tarkistettava", "tarkistettavat")
    test = F.lit(False)
    for level in levels:
        key = tx.fold(level)
        test = test | key.startswith("muut ") | key.isin(*names)
    return test


def tree_codes(df: DataFrame, levels: Sequence[str], *, widths: Sequence[int] = (2, 2, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """Codes like 01.02.03.001 by folded name inside each parent, path texts, and the table of nodes.

    Numbering works on the distinct nodes of the tree; products get their codes by a join.
    """
    counts = df.groupBy(*levels).agg(F.count("*").alias("_n"))
    nodes = None
    paths = counts
    for depth in range(1, len(levels) + 1):
        here = list(levels[:depth])
        level = counts.groupBy(*here).agg(F.sum("_n").alias("product_count"))
        window = Window.orderBy("_f", here[-1]) if depth == 1 else Window.partitionBy(*here[:-1]).orderBy("_f", here[-1])
        number = F.lpad(F.dense_rank().over(window).cast("string"), widths[depth - 1], "0")  # siblings of one tree node
        level = level.withColumn("_f", tx.fold(F.col(here[-1]))).withColumn("_number", number).drop("_f")
        if depth > 1:
            level = join_on(level, parents, here[:-1], "left")  # noqa: F821
            level = level.withColumn("code", F.concat_ws(".", "_parent", "_number"))
        else:
            level = level.withColumns({"_parent": F.lit(""), "code": F.col("_number")})
        node = level.select(F.lit(depth).alias("level"), "code", F.col(here[-1]).alias("name"), F.col("_parent").alias("parent_code"), "product_count")
        nodes = node if nodes is None else nodes.unionByName(node)
        parents = level.select(*here, F.col("code").alias("_parent"))
        paths = join_on(paths, level.select(*here, F.col("code").alias(f"{levels[depth - 1]}_code")), here, "left")
    coded = join_on(df, paths.drop("_n"), list(levels), "left")
    return coded.withColumns(
        {
            "path_code": F.concat_ws(" > ", *[f"{c}_code" for c in levels]),
            "path_name": F.concat_ws(" > ", *levels),
        }
    ), nodes


def next_codes(tree: DataFrame, new_groups: DataFrame) -> DataFrame:
    """Codes for new groups under existing parents: the next free number, counting on per parent.

    ``tree``: parent_code, code.  ``new_groups``: parent_code, name.  Two new groups under one
    parent get different numbers.
    """
    last = tree.groupBy("parent_code").agg(F.max(F.regexp_extract("code", r"(\d+)$", 1).cast("int")).alias("_last"))
    order = Window.partitionBy("parent_code").orderBy("name")  # accepted suggestions under one parent
    fresh = new_groups.distinct().withColumn("_i", F.row_number().over(order)).join(last, "parent_code", "left")
    number = F.lpad((F.coalesce("_last", F.lit(0)) + F.col("_i")).cast("string"), 2, "0")
    return fresh.select("parent_code", "name", F.concat_ws(".", "parent_code", number).alias("code"))


def majority_groups(sales: DataFrame, codes: Sequence[str], levels: Sequence[str], seen: str) -> DataFrame:
    """Most frequent complete group per product code over several code columns; review groups do not vote."""
    complete = F.lit(True)
    for level in levels:
        complete = complete & (F.coalesce(F.trim(level), F.lit("")) != "")
    votes = sales.filter(complete & (F.col(levels[0]) != REVIEW[0])).withColumn(
        "code", F.explode(F.array_distinct(F.array(*[tx.code_key(F.col(c)) for c in codes])))
    )
    return most_frequent(votes.filter(F.col("code") != ""), ["code"], list(levels), seen)


# Old top groups and where they went (new level 1, default level 2, default level 3).
RENAMED_TOP_GROUPS = {
    "Toimisto, painotuotteet ja pakkaukset": ("Toimistotuotteet", "Toimistotarvikkeet", "Muut toimistotuotteet"),
    "Makeiset ja elintarvikkeet": ("Elintarvikkeet", "Elintarvikkeet", "Muut elintarvikkeet"),
}
# Old top groups that became a second level (new level 1, level 2, default level 3).
DEMOTED_TOP_GROUPS = {"Asusteet": ("Vaatteet", "Asusteet", "Muut asusteet"), "Turvallisuus": ("Työkalut ja turvallisuus", "Suojaimet", "Suojaimet")}
DELIVERY_TOP_GROUP = ("Toimitus- ja käsittelykulu", "Toimitus- ja käsittelykulut")
GIFT_TOP_GROUP = "Lahjat ja sesonkituotteet"
GIFT_CARDS = ("Lahjakortit ja hyväntekeväisyys", "Lahjakortit")


def canonical_group(l1: Column, l2: Column, l3: Column) -> Column:
    """Old group names in today's tree: struct (l1, l2, l3)."""
    a, b, c = (tx.repair_misread(F.coalesce(F.trim(x), F.lit(""))) for x in (l1, l2, l3))

    def path(x, y, z) -> Column:
        cols = [v if isinstance(v, Column) else F.lit(v) for v in (x, y, z)]
        return F.struct(*[col.alias(f"l{i + 1}") for i, col in enumerate(cols)])

    def filled(value: Column, default: str) -> Column:
        return F.when(value == "", F.lit(default)).otherwise(value)

    out = F.when(a == DELIVERY_TOP_GROUP[0], path(REVIEW[0], DELIVERY_TOP_GROUP[1], DELIVERY_TOP_GROUP[1]))
    for old, (new, second, third) in RENAMED_TOP_GROUPS.items():
        out = out.when(a == old, path(new, filled(b, second), filled(c, third)))
    for old, (new, second, third) in DEMOTED_TOP_GROUPS.items():
        out = out.when(a == old, path(new, second, F.when(c != "", c).otherwise(filled(b, third))))
    gift_like = F.translate(F.lower(F.concat_ws(" ", b, c)), "äöå", "aoa").rlike("lahjakort|gift card|hyvantekevaisyys|charity")
    out = out.when((a == GIFT_TOP_GROUP) & gift_like, path(GIFT_CARDS[0], filled(b, GIFT_CARDS[1]), filled(c, GIFT_CARDS[0])))
    return out.when(a == GIFT_TOP_GROUP, path(*REVIEW)).otherwise(path(a, b, c))


def merge_small_leaves(df: DataFrame, levels: Sequence[str], minimum: int = 5, *, source: str = "source", confidence: str = "confidence") -> DataFrame:
    """Groups with fewer products than the minimum go to review at once."""
    small = df.groupBy(*levels).agg(F.count("*").alias("_n")).filter(F.col("_n") < minimum)
    marked = join_on(df, small, list(levels), "left")
    is_small = F.col("_n").isNotNull()
    return marked.withColumns(
        {
            **{c: F.when(is_small, F.lit(v)).otherwise(F.col(c)) for c, v in zip(levels, REVIEW)},
            source: F.when(is_small, F.concat(F.col(source), F.lit("_merged_small_l3"))).otherwise(F.col(source)),
            confidence: F.when(is_small, F.lit("review")).otherwise(F.col(confidence)),
        }
    ).drop("_n")


def apply_suggestions(products: DataFrame, suggestions: DataFrame, key: str, path: str, order: str) -> DataFrame:
    """First accepted suggestion per product replaces its path; the old path is kept next to it."""
    first = first_per_key(suggestions, [key], [(order, "asc")]).select(key, F.col(path).alias("_new"))
    out = products.join(first, key, "left")
    return out.withColumns(
        {"old_path": F.col(path), path: F.coalesce("_new", path), "changed": F.coalesce(F.col("_new") != F.col(path), F.lit(False))}
    ).drop("_new")
