"""Periodic runs of words inside a text: seeds, diagonals and a table of what each lag has covered.

A run is a stretch of words whose smallest period is ``q`` (words ``q`` apart are the same), at least
``max(12, 2 * q)`` words long, that no neighbouring word extends.  Its words and the words ``q`` further on
agree over ``max(12 - q, q)`` places or more, six at least whatever ``q`` is.  So:

1. *Seeds.*  The 6-grams of a text are indexed; two occurrences ``q`` words apart are a seed on the diagonal of
   lag ``q``.  For lags from 24 on the grams double with the lag (12 words from lag 24 on, 24 from 48 on ...): half
   of what must agree there.  Only grams whose halves repeat are looked at again, so in ordinary prose the
   longer grams cost next to nothing.
2. *Extend.*  Lag by lag and from left to right, a seed is extended both ways as far as the words agree.  The
   table keeps for each lag how far it has been covered; seeds before that place aren't extended again.
3. A stretch that a smaller lag has already given, with the same borders, has a smaller period and is left out.

Texts that are periodic throughout would have a number of seeds that grows with the square of their length.
For lags from 24 on, grams that lie in a run of at most half their own length are therefore passed over,
but for one at the head of each such run: a stretch of agreement that consists of such grams only
lies in one run, its partner in the next, and then contains the head of the latter.  What is left are at most
a few seeds for each place and lag class, and nothing is lost.

Each text is worked through alone, in the task that read it; nothing is shuffled.

Defined cases: null and empty texts and texts without words have no run and collapse to the empty text;
repeated rows and rows that share an id are judged each for itself; a null id stays null; an empty table
stays empty; columns of ``docs`` named like a result are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlift.llm.bins import mix
from ledgerlift.llm.common import add_columns, raw_texts

#: Shortest run; the overlap that every run guarantees; the lag from which grams grow with the lag.
SHORTEST, SEED, GROWN = 12, 6, 24
#: Words that are worked on together (a longer text is worked on alone).
_WORDS = 1 << 18
SCHEMA = "n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def _agree(words: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from ``a`` and ``b`` on agree, going right (``step`` 1) or left (-1), ``most`` at most."""
    done, size = 0, 16
    while done < most:
        n = min(size, most - done)
        x, y = (words[a + done:a + done + n], words[b + done:b + done + n]) if step > 0 else (words[a - done - n + 1:a - done + 1][::-1], words[b - done - n + 1:b - done + 1][::-1])
        differ = x != y
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + n, size * 4
    return done


class _Finder:
    """The runs of several texts laid end to end; ``bounds`` has where each begins and the last ends."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.words, self.bounds = words, bounds
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.found: list[Run] = []
        self.borders: set[tuple[int, int]] = set()

    def extend(self, seeds: np.ndarray, lags: np.ndarray, k: int, chained: bool) -> None:
        """Extend seeds (first place, lag) of ``k`` words; ``chained`` if every seed of a diagonal is present."""
        order = np.lexsort((seeds, lags))
        seeds, lags = seeds[order], lags[order]
        head = np.ones(len(seeds), dtype=bool)
        head[1:] = (lags[1:] != lags[:-1]) | (seeds[1:] != seeds[:-1] + 1)
        at = np.flatnonzero(head)
        if chained:  # neighbouring seeds show how long the agreement is
            long = np.diff(np.append(at, len(seeds))) + k - 1
            at = at[long >= np.maximum(lags[at], SHORTEST - lags[at])]
        covered: dict[int, int] = {}
        for place, lag in zip(seeds[at].tolist(), lags[at].tolist(), strict=True):
            if place < covered.get(lag, -1):
                continue
            d = self.doc[place]
            left = _agree(self.words, place - 1, place - 1 + lag, place - int(self.bounds[d]), -1)
            right = _agree(self.words, place + k, place + k + lag, int(self.bounds[d + 1]) - place - k - lag, 1)
            begin, end = place - left, place + k + right
            covered[lag] = end
            if end - begin >= max(lag, SHORTEST - lag) and (begin, end + lag) not in self.borders:
                self.borders.add((begin, end + lag))
                self.found.append((begin, end + lag - begin, lag))

    def periodic(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the ``k`` words from each place on lie in a run of a period up to ``k / 2``, and the heads of such runs."""
        edge, heads = np.zeros(len(self.words) + 1, dtype=np.int32), []
        for begin, length, period in self.found:
            if period <= k // 2 and length >= k:
                edge[begin] += 1
                edge[begin + length - k + 1] -= 1
                if period - 1 + k <= length:
                    heads.append(begin + period - 1)
        return np.cumsum(edge[:-1]) > 0, np.unique(np.array(heads, dtype=np.int64))

    def run(self) -> list[Run]:
        n = np.diff(self.bounds)
        longest = int(n.max(initial=0))
        if longest < SHORTEST:
            return []
        ends = self.bounds[1:][self.doc]
        gram = mix(self.doc.astype(np.uint64), 31)  # grams of different texts differ
        size = len(self.words) - SEED + 1
        for j in range(SEED):
            gram[:size] = mix(gram[:size] ^ self.words[j:j + size].astype(np.uint64), j)
        places = np.flatnonzero(np.arange(len(self.words)) + SEED <= ends)
        k, low, high = SEED, 1, GROWN
        while 2 * low <= longest and len(places):
            order = np.argsort(gram[places], kind="stable")
            place, key = places[order], gram[places[order]]
            same = key[1:] == key[:-1]
            again = np.zeros(len(place), dtype=bool)
            again[1:] |= same
            again[:-1] |= same
            place, key = place[again], key[again]
            seeds, lags = self.pairs(place, key, k, low, high)
            self.extend(seeds, lags, k, low == 1)
            # the next grams are twice as long: both halves must repeat
            low, high = high, 2 * high
            if low > GROWN or k * 2 <= low // 2:
                flag = np.zeros(len(self.words) + k, dtype=bool)
                flag[place] = True
                places = np.sort(place[flag[place + k]])
                places = places[places + 2 * k <= ends[places]]
                longer = np.zeros(len(self.words), dtype=np.uint64)
                longer[places] = mix(mix(gram[places], 41) ^ gram[places + k], 43)
                gram, k = longer, 2 * k
        return self.found

    def pairs(self, place: np.ndarray, key: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Seeds with lags in ``[low, high)``; ``place`` and ``key`` sorted by key, then place."""
        none = np.zeros(0, dtype=np.int64)
        first, lag = [none], [none]
        inside, heads = self.periodic(k) if low > 1 else (np.zeros(len(self.words), dtype=bool), none)
        plain = ~inside[place]
        p, g = place[plain], key[plain]
        left, step = np.arange(len(p)), 1
        while len(left):
            left = left[left + step < len(p)]
            left = left[(g[left + step] == g[left]) & (p[left + step] - p[left] < high)]
            far = p[left + step] - p[left]
            first.append(p[left][far >= low])
            lag.append(far[far >= low])
            step += 1
        if len(heads) and len(place):
            where = np.full(len(self.words), -1, dtype=np.int64)
            where[place] = np.arange(len(place))
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for at in where[heads[where[heads] >= 0]].tolist():
                begin_at = int(begin[np.searchsorted(begin, at, side="right") - 1])
                earlier = place[begin_at:at]
                earlier = earlier[np.searchsorted(earlier, place[at] - high, side="right"):np.searchsorted(earlier, place[at] - low, side="right")]
                first.append(earlier)
                lag.append(place[at] - earlier)
        return np.concatenate(first), np.concatenate(lag)


def find(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs (start, length, period) of each text, given as its words, by start, then period."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    bounds = np.cumsum([0, *map(len, texts)])
    words = np.fromiter((ids[w] for t in texts for w in t), np.int64, int(bounds[-1]))
    out: list[list[Run]] = [[] for _ in texts]
    for begin, length, period in _Finder(words, bounds).run():
        d = int(np.searchsorted(bounds, begin, side="right")) - 1
        out[d].append((begin - int(bounds[d]), length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The text with only the first period of every run, its words joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period) and ``collapsed``, the text with each run's first period only."""

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        n, runs, collapsed = [], [], []
        held: list[list[bytes]] = []

        def work() -> None:
            for words, found in zip(held, find(held), strict=True):
                n.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                collapsed.append(collapse(words, found))
            held.clear()

        size = 0
        for raw in raw_texts(batch):
            words = (raw or b"").split()  # of bytes: at space and \x09-\x0D
            if held and size + len(words) > _WORDS:
                work()
                size = 0
            held.append(words)
            size += len(words)
        work()
        return [pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())]

    return add_columns(docs, SCHEMA, rows)
