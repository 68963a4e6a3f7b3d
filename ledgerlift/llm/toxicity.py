"""Toxicity by a chain of linear models.

The categories are predicted one after the other: each is a logistic regression over character grams,
and each later one also sees the probabilities of those before it.  In training these probabilities are
out of fold, so a later model learns from predictions as good as those it will get.

Features are grams of 4 to 6 bytes within words (a leading space marks a word's begin), hashed to
``BUCKETS``; the ``features`` buckets whose presence tells the last category best are used, with
log(1 + count).  Training uses a bounded, documented sample: at most ``sample`` labelled documents with
and without the last category each, those with the smallest hashes of their ids, weighted back to the shares
of all labelled documents.  The threshold is that of the best F1 in a histogram of (score, label) over all
labelled documents, with out-of-fold scores for the sample's.  All documents are scored.

Defined cases: null and empty texts have no features and get the models' base probabilities, and are
never called toxic; a null label leaves a document out of that category's training; labelled ids without
a document and several labels for one id (the largest counts) are no fault; without labels of both kinds a
category's probability is its share of ones, or 0; repeated rows get equal results; an empty table stays
empty; columns that bear a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import WORD_TABLE, add_columns, likely, raw_texts, small_batches
from ledgerlift.session import stage

_BITS = 20
BUCKETS = 1 << _BITS
_SIZES = (4, 5, 6)
_SLICE = 1 << 20
FOLDS, SAMPLE, FEATURES = 3, 10_000, 512
#: Steps of the histogram's log odds, and how far it reaches to both sides.
_STEPS, _REACH = 1000, 20
_MIX = 0x9E3779B97F4A7C15

#: Words that tell what kind of toxicity a labelled English document holds.
INSULT = ("idiot", "moron", "loser", "clown", "fool", "jerk", "imbecile", "dumbass", "bastard")
CONTEMPT = ("stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "garbage", "filth", "vermin")


def _slices(raws: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: number of the first, the start of each in the slice, and (bucket at each gram's place, its place)."""
    first = 0
    while first < len(raws):
        parts, held, k = [], 0, first
        while k < len(raws) and (k == first or held + len(raws[k] or b"") < _SLICE):
            parts.append((raws[k] or b"").translate(WORD_TABLE))
            held += len(parts[-1]) + 1
            k += 1
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        yield first, starts, b" " + b" ".join(parts) + b" " * 9
        first = k


def _grams(block: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the grams of one size after the other."""
    n = len(block) - 8
    eight = np.ndarray((n,), dtype="<u8", buffer=block, strides=(1,))
    space = np.frombuffer(block, dtype=np.uint8) == 32
    gap = space[1:n + 1] | space[2:n + 2]
    for size in range(3, max(_SIZES) + 1):
        if size > 3:
            gap = gap | space[size - 1:n + size - 1]
        if size in _SIZES:
            at = np.flatnonzero(~gap)
            value = (eight[at] & np.uint64((1 << 8 * size) - 1)) * np.uint64(_MIX + 2 * size)
            yield at, (value >> np.uint64(64 - _BITS)).astype(np.int64)


def _presence(sample: DataFrame, label: str) -> DataFrame:
    """(bucket, n_yes, n_no): documents of the sample that hold it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            labels = np.array(batch.column(batch.schema.get_field_index(label)).to_pylist(), dtype=np.int64)
            for first, starts, block in _slices(raw_texts(batch)):
                keys = np.unique(np.concatenate([(np.searchsorted(starts, at, side="right") - 1) * BUCKETS + b for at, b in _grams(block)]))
                doc = np.minimum(keys >> _BITS, len(starts) - 2)
                yes = labels[first + doc] > 0
                found[0] += np.bincount(keys[yes] & (BUCKETS - 1), minlength=BUCKETS)
                found[1] += np.bincount(keys[~yes] & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(found.any(axis=0))
        for k in range(0, len(at), 50_000):
            part = at[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found[0][part]), pa.array(found[1][part])], names=["bucket", "n_yes", "n_no"])

    return small_batches(sample).select("text", label).mapInArrow(count, "bucket bigint, n_yes bigint, n_no bigint").groupBy("bucket").agg(F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no"))


def _counted(docs: DataFrame, place: np.ndarray, drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` with ``idx`` and ``val``, the features of each text; ``place`` gives a bucket's feature or -1."""
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        idx, val = [], []
        for i, v in features(raw_texts(batch), shared.value):
            idx.append(i.tolist())
            val.append(v.tolist())
        return [pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64()))]

    return add_columns(docs, "idx array<int>, val array<double>", rows, drop)


def features(raws: list[bytes | None], place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, log(1 + count)) of each text."""
    for _, starts, block in _slices(raws):
        keys = []
        for at, buckets in _grams(block):
            f = place[buckets]
            hit = np.flatnonzero(f >= 0)
            keys.append((np.searchsorted(starts, at[hit], side="right") - 1) * len(place) + f[hit])
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        edges = np.searchsorted(keys, np.arange(len(starts)) * len(place))
        for k in range(len(starts) - 1):
            part = slice(edges[k], edges[k + 1])
            yield keys[part] % len(place), np.log1p(n[part])


class Chain:
    """The fitted models; small enough to send to every worker."""

    def __init__(self, categories: tuple[str, ...], place: np.ndarray, weights: list[tuple[np.ndarray, float]], limit: float):
        self.categories, self.place, self.weights, self.limit = categories, place, weights, limit

    def scores(self, raws: list[bytes | None]) -> np.ndarray:
        """Probabilities, a column for each category."""
        width = int(self.place.max()) + 1
        out = np.zeros((len(raws), len(self.categories)))
        for row, (i, v) in enumerate(features(raws, self.place)):
            for k, (w, bias) in enumerate(self.weights):
                z = bias + float(w[i] @ v) + float(w[width:width + k] @ out[row, :k])
                out[row, k] = 1 / (1 + np.exp(-z)) if z > -700 else 0.0
        return out


def weak_categories(text: str = "text", label: str = "toxic") -> dict:
    """Labels for the chain: what kind of words a toxic document uses (null if it uses none listed), then toxic itself."""
    words = lambda w: F.col(text).rlike(r"(?i)\b(" + "|".join(w) + r")\b")
    some = words(INSULT) | words(CONTEMPT)
    kind = lambda w: F.when(F.col(label) == 0, 0).when(some, words(w).cast("int"))
    return {"insult": kind(INSULT), "contempt": kind(CONTEMPT), "toxic": F.col(label)}


def regress(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, steps: int = 300, rate: float = 0.1, shrink: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over sparse rows (places, values), by full-batch Adam steps; ``weight`` is what each row counts."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum() if len(y) else weight
    share = float(weight @ y) if len(y) and 0 < y.mean() < 1 else float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(width), float(np.log(p / (1 - p)))
    row = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    col, val = np.concatenate([i for i, _ in x]).astype(np.int64), np.concatenate([v for _, v in x])
    w = np.zeros(width + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col] * val, len(x)) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g = np.append(np.bincount(col, off[row] * val, width) + shrink * w[:-1], off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _fit_all(rows: DataFrame, y: str, width: int, folds: int) -> list[tuple[np.ndarray, float]]:
    """The model of all rows with a label, then one without each fold; every model is a task over the bounded sample."""
    models = F.array(F.lit(-1), *[F.when(F.col("fold") != f, f) for f in range(folds)])
    each = rows.where(F.col(y).isNotNull()).select(F.explode(F.array_compact(models)).alias("model"), F.col(y).cast("double").alias("y"), "weight", "idx", "val", "before")

    def train(key, table):
        before = table["before"].to_pylist()
        last = width - (len(before[0]) if before else 0)
        x = [(np.array([*i, *range(last, width)], dtype=np.int64), np.array([*v, *b])) for i, v, b in zip(table["idx"].to_pylist(), table["val"].to_pylist(), before, strict=True)]
        w, bias = regress(x, table["y"].to_numpy(), width, weight=table["weight"].to_numpy())
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([w.tolist()], pa.list_(pa.float64())), "bias": pa.array([bias])})

    found = {r["model"]: (np.array(r["w"]), r["bias"]) for r in each.groupBy("model").applyInArrow(train, "model int, w array<double>, bias double").collect()}
    empty = regress([], np.zeros(0), width)
    return [found.get(f, empty) for f in range(-1, folds)]


def _with_out_of_fold(rows: DataFrame, models: list[tuple[np.ndarray, float]], width: int) -> DataFrame:
    """``rows`` with one more probability in ``before``, from the model that hasn't seen the row."""

    def predict(batch: pa.RecordBatch) -> list[pa.Array]:
        column = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        out = []
        for fold, i, v, b in zip(column["fold"], column["idx"], column["val"], column["_before"], strict=True):
            w, bias = models[fold]
            z = bias + float(w[np.array(i, dtype=np.int64)] @ np.array(v, dtype=float)) + float(w[width:] @ np.array(b, dtype=float)) if i or b else bias
            out.append([*b, float(1 / (1 + np.exp(-z))) if z > -700 else 0.0])
        return [pa.array(out, pa.list_(pa.float64()))]

    return add_columns(rows.withColumnRenamed("before", "_before"), "before array<double>", predict, ("_before",))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Trains a chain on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic)."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for kind in (0, 1):
        part = one.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample rows of two numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(stage(chosen, "labelled")), "doc_id").dropDuplicates(["doc_id"])
    cats = weak_categories()
    names = tuple(cats)
    texts = stage(texts.withColumns({n: c for n, c in cats.items() if n != "toxic"}).repartition(16, "doc_id"), "labelled-texts")
    known = docs.select("doc_id").join(one, "doc_id").dropDuplicates(["doc_id"])
    taken, total = ({r["toxic"]: r["n"] for r in df.groupBy("toxic").agg(F.count("*").alias("n")).collect()} for df in (texts, known))
    n_yes, n_no = total.get(1, 0), total.get(0, 0)
    weigh = [total.get(k, 0) / max(taken.get(k, 0), 1) for k in (0, 1)]  # labelled documents that one of the sample stands for
    place = np.full(BUCKETS, -1, dtype=np.int32)
    # chi-square of presence, for features that speak for the category or against it
    a, b = F.col("n_yes") * F.lit(weigh[1]), F.col("n_no") * F.lit(weigh[0])
    chi = F.pow(a * F.lit(float(n_no)) - b * F.lit(float(n_yes)), F.lit(2.0)) / ((a + b) * (F.lit(float(n_yes + n_no) + 1) - a - b))
    best = _presence(texts, "toxic").orderBy(chi.desc(), "bucket").limit(n_features).collect() if n_yes and n_no else []
    for k, r in enumerate(sorted(best, key=lambda r: r["bucket"])):
        place[r["bucket"]] = k
    width = max(len(best), 1)
    if not best:
        place[0] = 0
    counted = _counted(texts.withColumn("filled", F.coalesce(F.col("text") != "", F.lit(False))), place).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds))).withColumn("weight", F.when(F.col("toxic") > 0, F.lit(weigh[1])).otherwise(F.lit(weigh[0])))
    base = stage(counted.select("doc_id", "fold", "weight", "filled", *names, "idx", "val"), "features")
    weights: list[tuple[np.ndarray, float]] = []
    rows = base.withColumn("before", F.array().cast("array<double>"))
    for k, name in enumerate(names):
        whole, *others = _fit_all(rows, name, width + k, folds)
        weights.append(whole)
        rows = stage(_with_out_of_fold(rows, others, width), "chain")
    seen = rows.where("filled").select(F.element_at("before", -1).alias("p"), names[-1])
    if taken != total:  # labelled documents that the sample leaves out
        rest = one.join(texts.select("doc_id"), "doc_id", "left_anti")
        more = score(likely(docs.select("doc_id", "text"), rest, "doc_id").where("text <> ''"), Chain(names, place, weights, 0.5)).select("doc_id", F.col(f"p_{names[-1]}").alias("p"))
        seen = seen.unionByName(more.join(rest, "doc_id").select("p", names[-1]))
    return Chain(names, place, weights, _limit(_histogram(seen, names[-1])))


def _histogram(seen: DataFrame, label: str) -> list[tuple[float, float, int, int]]:
    """(least score, largest score, documents, of these with the label) of each step of the log odds; at most 2 * _STEPS * _REACH + 1 rows."""
    odds = F.log(F.try_divide(F.col("p"), 1 - F.col("p")))  # null at 0 and 1
    step = F.round(F.least(F.greatest(F.coalesce(odds, F.when(F.col("p") > 0.5, _REACH).otherwise(-_REACH)), F.lit(-_REACH)), F.lit(_REACH)) * _STEPS).cast("int")
    found = seen.groupBy(step.alias("step")).agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("*").alias("n"), F.sum(label).alias("yes"))
    return [(r["low"], r["high"], r["n"], r["yes"]) for r in found.orderBy(F.desc("step")).collect()]


def _limit(steps: list[tuple[float, float, int, int]]) -> float:
    """Where the best F1 is reached; between the two neighbouring steps."""
    yes, n = sum(s[3] for s in steps), sum(s[2] for s in steps)
    if not yes or yes == n:
        return 0.5
    best, at, right, above = -1.0, 0.5, 0, 0
    for k, (low, _, size, hits) in enumerate(steps):
        right, above = right + hits, above + size
        f1 = 2 * right / (above + yes)
        if f1 > best:
            best, at = f1, (low + (steps[k + 1][1] if k + 1 < len(steps) else 0.0)) / 2
    return at


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the text, with ``p_<category>`` for each category and ``toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        raws = raw_texts(batch)
        p = shared.value.scores(raws)
        some = np.array([bool(r) for r in raws], dtype=bool)
        return [*(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1])), pa.array((p[:, -1] >= shared.value.limit) & some, pa.bool_())]

    schema = ", ".join([*(f"p_{c} double" for c in chain.categories), "toxic boolean"])
    return add_columns(docs, schema, rows, ("text",))
