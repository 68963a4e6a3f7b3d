"""Random forests of which each tree grows in one task, from a packed copy of all rows.

Spark's forests send the statistics of every open node from every task, and a forest with small leaves has as many
nodes as rows: a pass over a million nodes shuffles more than the table, there are some thirty passes, and the finished
forest has to fit on the driver and in each task.  Here numbers become places among at most ``BINS`` cuts, a byte each, and the rows are packed in blocks.  A task
gets all blocks and some trees, grows them level by level, asks them about the rows and gives back the sum of their
answers for each row; no tree leaves its task, and no row is left out.  A task holds the packed table (a byte or two a
column, and the facts) and some hundred bytes a row while a tree grows, which is why callers turn to Spark's
forests above ``MOST_ROWS`` rows.

As in Spark's forests, a tree draws each row as often as a Poisson number says, looks at a random few of the features
at each node, and splits where the sum of squared errors (Gini impurity for two classes, which is the same) falls most.
Draws follow the seed, the forest and the tree, and rows are in hash order, so a retried task grows the same trees.
Leaves of the same class aren't merged, so that a probability is what the smallest leaves say.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.session import stage

#: Rows of a block (a power of two), places a number can have, quantiles that the cuts between them are chosen from.
BLOCK_BITS, BINS, QUANTILES = 16, 32, 1000
#: Cells of statistics that are worked out at once, rows that are asked at once.
CELLS, ASKED = 1 << 22, 1 << 15
#: Rows whose packed copy a task may hold.
MOST_ROWS = 10_000_000

_PARTIAL = "out int, task int, block bigint, sums binary"


@dataclass(frozen=True)
class Forest:
    """Trees that are added up in result ``out``.

    ``classes`` are the weights of rows whose target is 0 and 1; None is a forest of values.  With a ``fold`` column, rows
    of fold ``number`` aren't seen and they alone are asked; ``seen`` names a 0/1 column of the rows that are seen.
    """

    out: int
    target: str
    trees: int
    least: int
    tried: int
    depth: int
    seed: int
    classes: tuple[float, float] | None = None
    fold: str | None = None
    number: int = 0
    seen: str | None = None


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows dealt over all cores: a small table makes as large a forest as its trees are many, and would be one task.

    Rows are in hash order in each task, so that a retried one draws the same samples.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.withColumn("_h", F.xxhash64(*by)).repartition(tasks, "_h").sortWithinPartitions("_h").drop("_h")


def cuts(values: Sequence[float]) -> np.ndarray:
    """At most ``BINS - 1`` cuts between the different ones of sorted values, so that the pieces hold alike many."""
    distinct, counts = np.unique(np.asarray(values, float), return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(distinct) <= BINS:
        return middles
    upto, share = np.cumsum(counts), len(values) / BINS
    return middles[np.unique(np.abs(upto[:-1, None] - share * np.arange(1, BINS)).argmin(0))]


def _number(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The rows written in hash order, with their number ``_row``: rows of a block have numbers that follow each other."""
    return stage(spread(df, by).withColumn("_row", F.monotonically_increasing_id()), label)


def _pack(rows: DataFrame, numeric: Sequence[str], levels: dict[str, int], facts: dict[str, str]) -> DataFrame:
    """A row for each block: ``_block``, how many rows, the places of all columns (column by column) and each fact as bytes."""
    points = [i / QUANTILES for i in range(QUANTILES + 1)]
    present = rows.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), points, 10_000).alias(c) for c in numeric]).first() if numeric else {}
    edges = {c: cuts(present[c] or [0.0]) for c in numeric}
    kind = _kind(levels)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        places = [np.searchsorted(edges[c], column(c).astype(float)).astype(kind) for c in numeric] + [column(c).astype(kind) for c in levels]
        return pa.table({
            "block": [int(column("_row")[0]) >> BLOCK_BITS], "n": [table.num_rows], "places": [b"".join(p.tobytes() for p in places)],
            **{c: [column(c).astype(t).tobytes()] for c, t in facts.items()},
        })

    wanted = rows.select("_row", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*numeric, *levels, *facts])], F.shiftright("_row", BLOCK_BITS).alias("_block"))
    schema = "block bigint, n bigint, places binary" + "".join(f", {c} binary" for c in facts)
    return stage(wanted.groupBy("_block").applyInArrow(pack, schema), "forest-blocks")


def _kind(levels: dict[str, int]) -> str:
    return "u1" if max([BINS, *levels.values()]) <= 256 else "u2"


def _slots(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys that a shuffle with ``n`` partitions deals one to each."""
    found, start = {}, 0
    while len(found) < n:
        keys = spark.range(start, start + 30 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
        for r in keys.groupBy("p").agg(F.min("id").alias("id")).collect():
            found.setdefault(r["p"], r["id"])
        start += 30 * n
    return [found[p] for p in range(n)]


def _dealt(blocks: DataFrame, forests: Sequence[Forest], together: int):
    """All blocks for each task, and what trees of which forest are its own, by key."""
    work = [(f, first, min(first + together, forest.trees)) for f, forest in enumerate(forests) for first in range(0, forest.trees, together)]
    keys = _slots(blocks.sparkSession, len(work))
    copies = blocks.withColumn("_task", F.explode(F.array(*[F.lit(k).cast("bigint") for k in keys]))).repartition(len(work), "_task")
    return copies.groupBy("_task"), {k: (i, *w) for i, (k, w) in enumerate(zip(keys, work))}


class _Table:
    """The packed rows as arrays."""

    def __init__(self, batches: Iterator[pa.RecordBatch], facts: dict[str, str], columns: int, kind: str):
        table = pa.Table.from_batches(list(batches)).sort_by("block")
        self.blocks, self.task = table.column("block").to_pylist(), table.column("_task")[0].as_py()
        self.ends = np.cumsum([0, *table.column("n").to_pylist()])
        self.n = int(self.ends[-1])
        self.places = np.empty((columns, self.n), kind)
        for i, part in enumerate(table.column("places")):
            self.places[:, self.ends[i]:self.ends[i + 1]] = np.frombuffer(part.as_buffer(), kind).reshape(columns, -1)
        self.facts = {c: np.concatenate([np.frombuffer(part.as_buffer(), t) for part in table.column(c)]) for c, t in facts.items()}

    def answers(self, out: int, task: int, sums: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
        for i, block in enumerate(self.blocks):
            part = sums[self.ends[i]:self.ends[i + 1]].astype(kind).tobytes()
            yield pa.RecordBatch.from_pydict({"out": pa.array([out], pa.int32()), "task": pa.array([task], pa.int32()), "block": pa.array([block], pa.int64()), "sums": pa.array([part], pa.binary())})


def _trees(table: _Table, forests: Sequence[Forest], sizes: Sequence[int], f: int, first: int, last: int) -> Iterator[tuple]:
    forest = forests[f]
    seen = np.ones(table.n, bool) if forest.fold is None else table.facts[forest.fold] != forest.number
    if forest.seen:
        seen &= table.facts[forest.seen] == 1
    rows = np.flatnonzero(seen)
    target = table.facts[forest.target].astype(float)[rows]
    for tree in range(first, last):
        rng = np.random.default_rng([forest.seed, f, tree])
        drawn = rng.poisson(1.0, len(rows))
        used = np.flatnonzero(drawn)
        yield grow(table.places, sizes, rows[used], drawn[used].astype(float), target[used], forest, rng)


def grow(places: np.ndarray, sizes: Sequence[int], rows: np.ndarray, count: np.ndarray, target: np.ndarray, forest: Forest, rng: np.random.Generator) -> tuple:
    """A tree as arrays by node: column, value flipped, cut, left child (the right one follows), answer; and its depth.

    ``sizes`` has 0 for a column of numbers, how many levels for a category; each level is a feature of its own.  A row goes right if its place, with the
    bits of the value flipped, is above the cut; leaves send every row to themselves.
    """
    least, n = forest.least, places.shape[1]
    wide = [BINS if s == 0 else s for s in sizes]
    ends = np.cumsum([0, *[max(1, s) for s in sizes]])
    plain, flat = not any(sizes), places.reshape(-1)
    middle = 0.0 if forest.classes or not len(rows) else float((count * target).sum() / count.sum())
    target = target - middle
    no, yes = forest.classes or (1.0, 1.0)
    weigh = (lambda c, s: (no * (c - s) + yes * s, yes * s)) if forest.classes else (lambda c, s: (c, s))
    summed = count * target
    tiny = 1e-12 * float((summed * target).sum())
    node = np.zeros(len(rows), np.int64)
    counts, sums = np.array([count.sum()]), np.array([summed.sum()])
    levels, base, depth = [], 0, 0
    while True:
        k = len(counts)
        weight, total = weigh(counts, sums)
        answer = np.divide(total, weight, out=np.zeros(k), where=weight > 0) + middle
        split = np.zeros(k, bool)
        column, flip, cut = np.zeros(k, np.int64), np.zeros(k, places.dtype), np.full(k, np.iinfo(places.dtype).max, places.dtype)
        left = np.arange(base, base + k)
        open_ = counts >= 2 * least
        if forest.classes:
            open_ &= (sums > 0) & (sums < counts)
        if depth < forest.depth and open_.any():
            number = np.cumsum(open_) - 1
            if not open_.all():
                keep = np.flatnonzero(open_.take(node))
                rows, count, summed, node = rows.take(keep), count.take(keep), summed.take(keep), number.take(node.take(keep))
            at = np.flatnonzero(open_)
            c_all, s_all, parent = counts[at], sums[at], (total[at] ** 2 / weight[at])
            best, found = parent + tiny, np.full(len(at), -1)
            b_cut, b_count, b_sum = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at))
            step = max(1, CELLS // max(int(ends[-1]), *wide))
            for low in range(0, len(at), step):
                high = min(low + step, len(at))
                if step >= len(at):
                    mine = (rows, count, summed, node)
                else:
                    own = np.flatnonzero((node >= low) & (node < high))
                    mine = (rows.take(own), count.take(own), summed.take(own), node.take(own) - low)
                r, n_, s_, g = mine
                some = high - low
                chosen = None
                if forest.tried < ends[-1]:
                    chosen = np.argpartition(rng.random((some, int(ends[-1])), np.float32), forest.tried - 1, axis=1)[:, :forest.tried]
                if plain and chosen is not None:
                    # each node looks at columns of its own
                    looks = ((chosen[:, slot], BINS, 0, None) for slot in range(forest.tried))
                else:
                    marked = np.full((some, int(ends[-1])), chosen is None)
                    if chosen is not None:
                        np.put_along_axis(marked, chosen, True, axis=1)
                    looks = ((c, wide[c], size, marked[:, ends[c]:ends[c + 1]]) for c, size in enumerate(sizes))
                for c, width, size, looked in looks:
                    place = places[c].take(r) if looked is not None else flat.take((c * n).take(g) + r)
                    key = g * width + place
                    lc = np.bincount(key, n_, some * width).reshape(some, width)
                    ls = np.bincount(key, s_, some * width).reshape(some, width)
                    if size == 0:
                        lc, ls = lc.cumsum(1), ls.cumsum(1)
                    fits = (lc >= least) & (lc <= c_all[low:high, None] - least)
                    if looked is not None:
                        fits &= looked
                    i, j = np.nonzero(fits)  # few of the cuts leave enough rows on both sides deep in the tree
                    if not len(i):
                        continue
                    one_c, one_s = lc[i, j], ls[i, j]
                    lw, lt = weigh(one_c, one_s)
                    rw, rt = weigh(c_all[low + i] - one_c, s_all[low + i] - one_s)
                    gain = np.full((some, width), -np.inf)
                    gain[i, j] = lt * lt / lw + rt * rt / rw
                    top = gain.argmax(1)
                    line = np.arange(some)
                    gains = gain[line, top]
                    better = np.flatnonzero(gains > best[low:high])
                    w, t = low + better, top[better]
                    best[w], found[w], b_cut[w] = gains[better], c if looked is not None else c[better], t
                    b_count[w], b_sum[w] = lc[better, t], ls[better, t]
            hit = found >= 0
            h = at[hit]
            split[h] = True
            isin = np.array([s > 0 for s in sizes])[found[hit]]
            column[h] = found[hit]
            flip[h] = np.where(isin, b_cut[hit], 0)
            cut[h] = np.where(isin, 0, b_cut[hit])
            left[h] = base + k + 2 * np.arange(len(h))
        levels.append((column, flip, cut, left, answer))
        if not split.any():
            return (*(np.concatenate(x) for x in zip(*levels)), depth)
        if not hit.all():
            keep = np.flatnonzero(hit.take(node))
            rows, count, summed, node = rows.take(keep), count.take(keep), summed.take(keep), node.take(keep)
        node = at.take(node)
        place = flat.take((column * n).take(node) + rows)
        if not plain:
            place ^= flip.take(node)
        node = (left - (base + k)).take(node) + (place > cut.take(node))
        l_c, l_s = b_count[hit], b_sum[hit]
        counts = np.stack([l_c, c_all[hit] - l_c], 1).reshape(-1)
        sums = np.stack([l_s, s_all[hit] - l_s], 1).reshape(-1)
        base, depth = base + k, depth + 1


def ask(tree: tuple, flat: np.ndarray, columns: int, categories: bool) -> np.ndarray:
    """The tree's answers for rows whose places follow each other row by row."""
    column, flip, cut, left, answer, depth = tree
    m = len(flat) // columns
    node, start = np.zeros(m, np.int64), np.arange(0, m * columns, columns)
    out, still = np.zeros(m), None
    for level in range(depth):
        place = flat.take(start + column.take(node))
        if categories:
            place = place ^ flip.take(node)
        node = left.take(node) + (place > cut.take(node))
        if level % 4 == 3 and level + 1 < depth:
            # rows that have come to a leaf are through
            ended = left.take(node) == node
            if ended.sum() * 4 > len(node):
                index = np.flatnonzero(ended)
                out[index if still is None else still[index]] = answer.take(node[index])
                index = np.flatnonzero(~ended)
                still = index if still is None else still[index]
                node, start = node[index], start[index]
    out[slice(None) if still is None else still] = answer.take(node)
    return out


def _asked(trees: Sequence[tuple], places: np.ndarray, index: np.ndarray, categories: bool, swap: tuple[int, np.ndarray] | None = None) -> np.ndarray:
    """Sum of the trees' answers for the rows of an index; ``swap`` has a column that is taken from other rows."""
    out = np.zeros(len(index))
    for low in range(0, len(index), ASKED):
        part = places[:, index[low:low + ASKED]]
        if swap:
            part[swap[0]] = places[swap[0]].take(swap[1][low:low + ASKED])
        flat = np.ascontiguousarray(part.T).reshape(-1)
        for tree in trees:
            out[low:low + ASKED] += ask(tree, flat, len(places), categories)
    return out


def _added(parts: pa.Table, kind: str) -> np.ndarray:
    """Sums of all tasks, in the order of the tasks."""
    total = 0.0
    for part in parts.sort_by("task").column("sums"):
        total = total + np.frombuffer(part.as_buffer(), kind).astype(float)
    return total


def grown(df: DataFrame, by: Sequence[str], numeric: Sequence[str], levels: dict[str, int], facts: dict[str, str], forests: Sequence[Forest], *, together: int = 10) -> DataFrame:
    """The rows with the mean answer of each result's trees, ``_out0``, ``_out1``, ...; rows nobody asked have 0.

    ``levels`` has how many levels a category has, whose column holds their numbers from 0; ``facts`` the targets, folds and marks with
    their types in numpy.  ``together`` trees share a task.
    """
    rows = _number(df, by, "forest")
    sizes, kind, columns = [0] * len(numeric) + list(levels.values()), _kind(levels), len(numeric) + len(levels)
    dealt, work = _dealt(_pack(rows, numeric, levels, facts), forests, together)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(batches, facts, columns, kind)
        task, f, first, last = work[table.task]
        forest = forests[f]
        index = np.arange(table.n) if forest.fold is None else np.flatnonzero(table.facts[forest.fold] == forest.number)
        sums = np.zeros(table.n)
        for tree in _trees(table, forests, sizes, f, first, last):
            sums[index] += _asked([tree], table.places, index, bool(levels))
        yield from table.answers(forest.out, task, sums / forest.trees, "f8")

    outs = sorted({forest.out for forest in forests})

    def rowwise(parts: pa.Table) -> pa.Table:
        block = parts.column("block")[0].as_py()
        sums = {f"_out{o}": _added(parts.filter(pc.equal(parts.column("out"), o)), "f8") for o in outs}
        return pa.table({"_row": (block << BLOCK_BITS) + np.arange(len(sums[f"_out{outs[0]}"]))} | sums)

    parts = stage(dealt.applyInArrow(answers, _PARTIAL), "forest-answers")
    answered = parts.groupBy("block").applyInArrow(rowwise, "_row bigint" + "".join(f", _out{o} double" for o in outs))
    return rows.join(answered, "_row").drop("_row")


def importance(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, forest: Forest, *, repeats: int = 5, seed: int = 42, together: int = 10) -> DataFrame:
    """Loss of a forest's accuracy on its own rows when one feature is dealt anew among them: mean and spread over the repeats."""
    rows = _number(df, by, "forest")
    width, facts = len(features), {label: "u1"}
    blocks = _pack(rows, features, {}, facts)
    dealt, work = _dealt(blocks, [forest], together)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(batches, facts, width, _kind({}))
        task, f, first, last = work[table.task]
        trees = list(_trees(table, [forest], [0] * width, f, first, last))
        everyone = np.arange(table.n)
        yield from table.answers(0, task, _asked(trees, table.places, everyone, False), "f4")
        for r in range(repeats):
            for c in range(width):
                # every task deals alike
                other = np.random.default_rng([seed, r, c]).permutation(table.n)
                yield from table.answers(1 + r * width + c, task, _asked(trees, table.places, everyone, False, (c, other)), "f4")

    def right(parts: pa.Table) -> pa.Table:
        truth = np.frombuffer(parts.column(label)[0].as_buffer(), "u1")
        said = _added(parts, "f4") / forest.trees > 0.5
        return pa.table({"out": parts.column("out")[:1], "hits": [int((said == truth).sum())], "n": [len(truth)]})

    parts = stage(dealt.applyInArrow(answers, _PARTIAL), "forest-answers")
    hits = parts.join(blocks.select("block", label), "block").groupBy("out", "block").applyInArrow(right, "out int, hits bigint, n bigint")
    rates = stage(hits.groupBy("out").agg((F.sum("hits") / F.sum("n")).alias("rate")), "forest-rates")  # one row a feature and repeat
    whole = rates.filter("out = 0").select("rate").scalar()
    drops = rates.filter("out > 0").select(F.pmod(F.col("out") - 1, F.lit(width)).alias("_f"), (whole - F.col("rate")).alias("drop"))
    names = F.array(*map(F.lit, features))
    return drops.groupBy("_f").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).select(
        F.element_at(names, F.col("_f") + 1).alias("feature"), "importance_mean", "importance_std"
    )
