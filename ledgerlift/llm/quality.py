"""Quality rules kept as a ledger of failure bits.

``ledger`` measures every text once and evaluates every rule once: the measurements stay as columns and
the failures as one integer, bit k for rule k.  A policy is a version name and a set of rules, so its
verdict is one ``&`` on the stored integer; policies are changed, compared and taken apart
(``ablations``) without reading a text again.

Words are runs of characters other than space and ``\\x09-\\x0D``.

Defined cases: a null or empty text has no words, all its measurements are 0 and it fails ``few_words``;
shares of nothing are 0; repeated rows are judged each for itself; an empty table gives an empty ledger
and ablations of 0; columns of the documents that bear a result's name are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import add_columns, raw_texts

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
#: Texts with more words count their windows in arrays instead of a dictionary.
_ARRAY_WORDS = 20_000
#: Words of a window whose different words are counted; the share of different words of a whole text falls with its length.
WINDOW = 1000

_OWN = "__quality_"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_distinct_words", "n_window_distinct")


def _repeated(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    n = len(words)
    if n <= width:
        return 0
    if n <= _ARRAY_WORDS:
        grams = list(zip(*(words[k:] for k in range(width)), strict=False))
        seen = Counter(grams)
        if len(seen) == len(grams):
            return 0
        starts = [i for i, g in enumerate(grams) if seen[g] > 1]
    else:
        codes: dict[bytes, int] = {}
        first = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
        rank = first
        for k in range(1, width):  # the rank of a window of k + 1 words, from that of its first k
            _, rank = np.unique(rank[: n - k] * len(codes) + first[k:], return_inverse=True)
        starts = np.flatnonzero(np.bincount(rank)[rank] > 1).tolist()
    covered = end = 0
    for s in starts:
        covered += s + width - max(s, end)
        end = s + width
    return covered


def measure(raw: bytes | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text in UTF-8."""
    if not raw:
        return (0,) * len(MEASURES)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    capital = sum(1 for w in words if len(w) > 2 and w.isupper())
    return (
        len(words), len(raw.translate(None, _SPACE + _CONTINUED)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
        _repeated(words), len(lines), capital, len(set(words)),
        sum(len(set(words[k:k + WINDOW])) for k in range(0, len(words), WINDOW)),
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (over the measurements) holds.  Its place in ``RULES`` is its bit for good."""

    name: str
    fails: str


#: Append only: a bit keeps its meaning in every stored ledger.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "100 * n_capital_words > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("few_distinct_words", "n_words >= 20 and 100 * n_distinct_words < 30 * n_words"),
    Rule("few_distinct_in_windows", "n_words >= 20 and 100 * n_window_distinct < 30 * n_words"),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """Documents that fail any of ``rules`` are rejected."""

    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))

    def rejects(self, failures: Column | str = "failures") -> Column:
        failures = F.col(failures) if isinstance(failures, str) else failures
        return failures.bitwiseAND(F.lit(self.mask).cast("bigint")) != 0


BASE = Policy("base", ("few_words", "repeated_windows"))
_V1 = ("few_words", "repeated_windows", "symbols", "capitals", "repeated_lines", "few_distinct_words")
#: v2 judges different words by windows, so long texts don't fail for their length.
POLICIES = {p.version: p for p in (BASE, Policy("v1", _V1), Policy("v2", (*_V1[:-1], "few_distinct_in_windows")))}
CURRENT = "v2"


def _measured(docs: DataFrame, drop: tuple[str, ...]) -> tuple[DataFrame, Column]:
    """``docs`` with the measurements under names of their own, and the failure bits over these."""

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [measure(r) for r in raw_texts(batch)]
        return [pa.array([f[k] for f in found], pa.int64()) for k in range(len(MEASURES))]

    out = add_columns(docs, ", ".join(f"{_OWN}{m} bigint" for m in MEASURES), rows, drop)
    name = re.compile(r"\b(" + "|".join(MEASURES) + r")\b")
    return out, F.expr(" + ".join(f"IF({name.sub(_OWN + chr(92) + '1', r.fails)}, {BIT[r.name]}L, 0L)" for r in RULES))


def ledger(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (text) with the measurements and ``failures``, the bits of the failed rules.

    Columns named in ``drop`` are left out of the result.
    """
    measured, bits = _measured(docs.drop(*MEASURES, "failures"), drop)
    return measured.withColumn("failures", bits).withColumnsRenamed({f"{_OWN}{m}": m for m in MEASURES})


def ablations(kept: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does, from the ledger's bits alone.

    One row per rule: ``n_docs``, ``n_failed`` (fail it), ``n_rejected`` (by the whole policy) and
    ``n_saved`` (kept if this rule is left out).  The ledger shrinks to a count per bit pattern first,
    of which there are at most two to the number of rules.
    """
    patterns = kept.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in BIT if r in policy.rules]
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    parts = [F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_docs"), total(F.col("bits") != 0).alias("n_rejected")]
    for r in rules:
        bit = F.lit(BIT[r]).cast("bigint")
        parts.append(F.struct(F.lit(r).alias("rule"), total(F.col("bits").bitwiseAND(bit) != 0).alias("n_failed"), total(F.col("bits") == bit).alias("n_saved")).alias(f"_{r}"))
    one = patterns.agg(*parts)
    return one.select(F.lit(policy.version).alias("policy"), "n_docs", "n_rejected", F.inline(F.array(*[f"_{r}" for r in rules])))


def judged(docs: DataFrame, policy: Policy = POLICIES[CURRENT], drop: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` (neither the base rules nor the policy reject)."""
    base = BASE.rejects()
    return ledger(docs, drop).drop("base_failed", "kept").withColumns({"base_failed": base, "kept": ~base & ~policy.rejects()})


def keep(docs: DataFrame, policy: Policy = POLICIES[CURRENT]) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the policy reject, with their own columns."""
    measured, bits = _measured(docs, ())
    return measured.where(~BASE.rejects(bits) & ~policy.rejects(bits)).select(*docs.columns)
