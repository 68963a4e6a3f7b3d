"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words (A-Z lower-cased; letters, digits and all characters beyond ASCII
make words) and put into one suffix automaton, so a document is read once, word by word, whatever the
number of items; the state and its length say the longest item passage that ends at each word.

A *window* is ``window`` consecutive item words; an item with fewer words, but not none, is one window.
A document word inside any occurrence of a window is *hit*.

Sizes.  The items are the stated query set.  They are cut into automata of at most ``shard_words`` words
(one longer item is a shard of its own), so what is broadcast at once is bounded; the documents pass
each shard, and with several shards the marks are carried in a column and written between passes.

Defined cases: a null or empty text has no words and no hits; an item without words matches nothing; a
null item id counts as the id "null"; rows with one item id are one item; repeated document rows are
judged each for itself; an empty item table leaves every document clean; columns of the documents that
bear a result's name are replaced, but in ``decontaminate`` every column keeps its values.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import WORD_TABLE, add_columns, aside, raw_texts
from ledgerlift.session import stage

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Size of the table that tells in one look-up whether two words can follow each other in an item.
_PAIR_BITS = 22
#: Document words handled together.
_BLOCK_WORDS = 400_000


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(WORD_TABLE).split() if raw else []


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.items)}
        coded = [(place[i], [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        #: state -> (length of the window, items that hold it); a window is met at a state on the chain of links
        self.windows: dict[int, dict[int, set[int]]] = {}
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        for item, ids in coded:
            size = min(window, len(ids))
            for _, state in self._ends(ids, size):
                self.windows.setdefault(state, {}).setdefault(size, set()).add(item)
        self.above = self._nearest_above()
        self.pairs = np.zeros(1 << _PAIR_BITS, dtype=bool)
        for _, ids in coded:
            a = np.array(ids, dtype=np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7_919) & ((1 << _PAIR_BITS) - 1)

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _ends(self, ids: list[int], size: int):
        """(place of the last word, state) of each passage of ``size`` words of an item."""
        state = 0
        for k, w in enumerate(ids):
            state = self.next[state][w]
            if k + 1 >= size:
                at = state
                while self.length[self.link[at]] >= size:
                    at = self.link[at]
                yield k, at

    def _nearest_above(self) -> list[int]:
        """For each state the first state on its chain of links, itself included, that ends a window."""
        above = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            above[s] = s if s in self.windows else above[self.link[s]] if s else -1
        return above

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words in which each can follow the one before it in some item; every window lies in one."""
        known = ids >= 0
        if self.shortest > 1:
            ok = known[:-1] & known[1:]
            at = np.flatnonzero(ok)
            ok[at] = self.pairs[self._pair(ids[at], ids[at + 1])]
            more = 1
        else:
            ok, more = known, 0
        edge = np.diff(np.concatenate(([0], ok.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + more
        long = end - start >= self.shortest
        return list(zip(start[long].tolist(), end[long].tolist(), strict=True))

    def stream(self, ids: list[int], base: int):
        """(start, end, items) of each window met in a run of words."""
        state = length = 0
        for k, w in enumerate(ids, base + 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(w, 0)
            length = length + 1 if state else 0
            at = self.above[state]
            while at > 0:
                for size, items in self.windows[at].items():
                    if size <= length:
                        yield k - size, k, items
                at = self.above[self.link[at]]


def _shards(items: DataFrame, window: int, shard_words: int) -> list[Automaton]:
    """Automata of bounded size.  The items are read shard by shard, in the order of their ids."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").dropDuplicates().orderBy("item_id", "text")
    shards, now, held = [], [], 0
    for row in rows.toLocalIterator():
        words = words_of(row["text"].encode()) if row["text"] else []
        if now and held + len(words) > shard_words:
            shards.append(Automaton(now, window))
            now, held = [], 0
        if words:
            now.append((row["item_id"] if row["item_id"] is not None else "null", words))
            held += len(words)
    if now:
        shards.append(Automaton(now, window))
    return shards


def match_items(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = 250_000, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (text) with ``n_words``, ``hit_items`` (sorted ids) and ``hit_spans`` (maximal runs of hit words).

    ``items`` has (item_id, text).  Columns named in ``drop`` are left out of the result.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    spark = docs.sparkSession
    shards = _shards(items, window, shard_words)
    last = len(shards) - 1
    out = _marked(docs, spark.sparkContext.broadcast(shards[0]) if shards else None, drop if last < 1 else ())
    for k, shard in enumerate(shards[1:], 1):
        first = stage(out, "contamination")
        again = _marked(first.withColumnsRenamed({"hit_items": "_items", "hit_spans": "_spans"}), spark.sparkContext.broadcast(shard), drop if k == last else ())
        out = again.withColumns({
            "hit_items": F.array_sort(F.array_union("_items", "hit_items")), "hit_spans": F.concat("_spans", "hit_spans"),
        }).drop("_items", "_spans")
    if len(shards) > 1:
        # runs that touch or overlap become one
        out = out.withColumn("hit_spans", F.expr("""
            aggregate(array_sort(hit_spans), cast(array() as array<struct<first:int,length:int>>), (a, s) ->
                if(size(a) > 0 and element_at(a, -1).first + element_at(a, -1).length >= s.first,
                   concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'length',
                       cast(greatest(element_at(a, -1).first + element_at(a, -1).length, s.first + s.length) - element_at(a, -1).first as int)))),
                   concat(a, array(s))))"""))
    return out


def _marked(docs: DataFrame, shared, drop: tuple[str, ...]) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        raws = raw_texts(batch)
        counts, items, spans = [], [], []
        todo: list[np.ndarray] = []
        held = 0
        get = shared.value.vocabulary.get if shared else None
        for k, raw in enumerate(raws):
            words = words_of(raw)
            counts.append(len(words))
            if shared:
                todo.append(np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words)))
                held += len(words)
            if not shared:
                items.append([])
                spans.append([])
            elif held >= _BLOCK_WORDS or k + 1 == len(raws):
                for found, runs in _hits(shared.value, todo):
                    items.append(found)
                    spans.append(runs)
                todo, held = [], 0
        span = pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32())]))
        return [pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]

    return add_columns(docs, "n_words bigint, hit_items array<string>, hit_spans array<struct<first:int,length:int>>", rows, drop)


def _hits(automaton: Automaton, docs: list[np.ndarray]):
    """For each document its items and runs of hit words."""
    gap = np.array([-1])
    ids = np.concatenate([x for d in docs for x in (d, gap)])
    begin = np.cumsum([0, *(len(d) + 1 for d in docs)])
    found: dict[int, tuple[set[int], list[list[int]]]] = {}
    for s, e in automaton.candidates(ids):
        for first, end, items in automaton.stream(ids[s:e].tolist(), s):
            doc = int(np.searchsorted(begin, first, side="right")) - 1
            seen, runs = found.setdefault(doc, (set(), []))
            seen |= items
            runs.append([first - int(begin[doc]), end - int(begin[doc])])
    for doc in range(len(docs)):
        if doc not in found:
            yield [], []
            continue
        seen, runs = found[doc]
        merged: list[list[int]] = []
        for first, end in sorted(runs):
            if merged and merged[-1][1] >= first:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([first, end])
        yield sorted(automaton.items[i] for i in seen), [{"first": a, "length": b - a} for a, b in merged]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = 250_000) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated instead of the text and the lists."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["length"])
    return match_items(docs, items, window, shard_words, drop=("text",)).withColumns({
        "n_hit": hit, "n_items": F.size("hit_items").cast("bigint"), "items_sha256": F.sha2(F.array_join("hit_items", ","), 256),
    }).withColumn("contaminated", F.col("n_hit") > 0).drop("hit_items", "hit_spans")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, min_span: int | None = None, max_coverage: float = 0.5, shard_words: int = 250_000) -> DataFrame:
    """``docs`` without item passages.

    Runs of at least ``min_span`` hit words (default: every run) are cut from the text, from the first
    character of the first word to the last of the last.  A document with more than ``max_coverage`` of its
    words hit is removed.  Other texts stay as they are, byte for byte; the columns are those of ``docs``.
    """
    least = 1 if min_span is None else min_span
    docs, back = aside(docs, "n_words", "hit_items", "hit_spans", "_items", "_spans", "_cut")
    marked = match_items(docs, items, window, shard_words)
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["length"])
    kept = marked.where(hit <= F.col("n_words") * F.lit(max_coverage))

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        raws, spans = raw_texts(batch), batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()
        return [pa.array([_cut(r, [s for s in runs if s["length"] >= least]) for r, runs in zip(raws, spans, strict=True)], pa.binary()).cast(pa.string())]

    out = add_columns(kept, "_cut string", rows).withColumn("text", F.col("_cut"))
    return out.select(*docs.columns).withColumnsRenamed(back)


def _cut(raw: bytes | None, runs: list[dict]) -> bytes | None:
    if not raw or not runs:
        return raw
    at = [m.span() for m in _WORDS.finditer(raw.lower())]
    parts, last = [], 0
    for run in runs:
        parts.append(raw[last:at[run["first"]][0]])
        last = at[run["first"] + run["length"] - 1][1]
    return b"".join([*parts, raw[last:]])
