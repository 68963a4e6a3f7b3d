"""Near-duplicate documents: n-gram Jaccard join with filters under several token orders.

A text's set is its distinct shingles of ``width`` words (A-Z lower-cased, words split at white space).
Two sets with at least ``percent`` per cent Jaccard similarity share at least ``percent`` per cent of the
larger one, so under *any* order of all shingles their prefixes of ``n - ceil(percent * n / 100) + 1``
shingles share one.  Several orders give several such filters; a pair must pass all of them before it is
verified.  Every order puts frequent shingles last: first by powers of two of what a shingle's counter has
above the usual, so common passages don't fill the prefixes.  Equally frequent ones come in the first order by how
common their words are, so chance meetings of common words don't fill them either, in every other order by a
hash of its own: what meets by chance in one order mostly doesn't in the next.  Counts are over all documents, in
tables of fixed size; they only shape the orders, never the result.

1. One pass counts shingles and words and gives each text's size and set digest; equal sets become one class.
2. A second pass sends the prefixes of each order to bins; texts that repeat inside a task are sent once.
3. A shingle's list of documents goes on to a bin by its smallest document, and gives there the pairs whose
   sizes and places in the order allow the similarity, once for all shingles that the bin has seen.  Lists with
   very many such pairs give links to their smallest document only (a star).  Pairs are intersected over the
   orders, mapped to classes and verified.
4. What stars leave open is decided in blocks: documents of a star outside its centre's component are
   compared with all its documents, blocks against blocks, inside tasks; only links come out.
5. Components of the verified links, in which classes and so all copies are included.

No pair with the similarity is lost: small lists are enumerated, large ones are covered by 3 and 4 together.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; with
fewer than ``width`` words the whole sequence is one shingle; a null id has a null component; rows
that share an id are one node, each with its own size; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm import bins
from ledgerlift.llm.common import likely, maybe, raw_texts, small_batches, stage_packed
from ledgerlift.llm.components import components
from ledgerlift.session import stage

WIDTH, PERCENT, ORDERS = 4, 85, 2
#: Lists with more than LIST / 2 similar-sized partners for each document, and more pairs than LIST documents have,
#: give stars; documents in a block; counters of the frequency table; pairs looked at together.
LIST, BLOCK, COUNTERS, _PAIRS = 32, 256, 1 << 20, 1 << 19
_SLICE = 1 << 18
_SPACE = b" \t\n\r\x0b\x0c"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c in _SPACE else c for c in range(256))
_RANDOM = np.random.RandomState(20_011).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(pow(int(_BASE), -1, 2**64)), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _words(raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of texts: the hashes of their words, and where in these each text begins and the last ends."""
    global _POWERS
    first = 0
    while first < len(raws):
        parts, held, k = [], 0, first
        while k < len(raws) and (k == first or held + len(raws[k] or b"") < _SLICE):
            parts.append((raws[k] or b"").translate(_TABLE))
            held += len(parts[-1]) + 1
            k += 1
        block = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        first = k
        if len(block) > len(_POWERS[0]):
            _POWERS = _powers(len(block) + _SLICE), _inverse_powers(len(block) + _SLICE)
        space = block == 32
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_RANDOM[block] * _POWERS[0][:len(block)], dtype=np.uint64)))
        yield bins.mix((sums[end] - sums[begin]) * _POWERS[1][begin]), np.searchsorted(begin, starts)


def _short(words: np.ndarray) -> np.ndarray:
    """The one shingle of fewer words than a shingle has."""
    out = np.zeros(1, dtype=np.uint64)
    for j in range(len(words)):
        out = bins.mix(out ^ words[j:j + 1], 100 + j)
    return out


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """The shingle that begins at each word."""
    run = np.zeros(len(words), dtype=np.uint64)
    for j in range(min(width, len(words))):
        run[:len(words) - j] = bins.mix(run[:len(words) - j] ^ words[j:], j)
    return run


def shingles(raws: list[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    for words, bounds in _words(raws):
        run = _runs(words, width)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= width:
                s = np.sort(run[a:b - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                yield _short(words[a:b]) if b > a else np.zeros(0, dtype=np.uint64)


def scored(raws: list[bytes | None], width: int, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted different shingles of each text, and how common their words are; ``common`` by word counter."""
    for words, bounds in _words(raws):
        run, own = _runs(words, width), common[_counter(words)].astype(np.uint64)
        total = np.zeros(len(words), dtype=np.uint64)
        for j in range(min(width, len(words))):
            total[:len(words) - j] += own[j:]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= width:
                order = np.argsort(run[a:b - width + 1])
                s = run[a:b - width + 1][order]
                new = np.concatenate(([True], s[1:] != s[:-1]))
                yield s[new], total[a:b - width + 1][order][new]
            else:
                yield (_short(words[a:b]), np.zeros(1, dtype=np.uint64)) if b > a else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)  # COUNTERS is 2 to the 20


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefix(s: np.ndarray, words: np.ndarray, classes: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first shingles of a set under an order, in that order."""
    p = prefix_length(len(s), percent)
    key = (classes[_counter(s)].astype(np.uint64) << np.uint64(58)) | (bins.mix(s, 200 + order) >> np.uint64(16 if order == 0 else 6))
    if order == 0:
        key |= words << np.uint64(48)
    first = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[first[np.argsort(key[first])]]


def signatures(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(doc_id, n, digest) of each row; the class of each counter of shingles; how common the words of each counter are."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, COUNTERS), dtype=np.uint32)
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def count() -> None:
            for k, parts in enumerate(held):
                if parts:
                    counts[k] += np.bincount(np.concatenate(parts), minlength=COUNTERS).astype(np.uint32)
                    parts.clear()

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            n, digests = [], []
            for words, bounds in _words(raw_texts(batch)):
                held[1].append(_counter(words))
                run, seen = _runs(words, width), []
                for a, b in zip(bounds, bounds[1:], strict=False):
                    s = np.sort(run[a:b - width + 1]) if b - a >= width else _short(words[a:b]) if b > a else np.zeros(0, dtype=np.uint64)
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
                    seen.append(s)
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                held[0].append(_counter(np.concatenate(seen)))
            if sum(map(len, held[1])) > 1 << 19:
                count()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names=names)
        count()
        size = COUNTERS // 64
        parts = [c[k * size:(k + 1) * size].tobytes() for c in counts for k in range(64)] if counts.any() else []
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=names)

    names = ["doc_id", "n", "digest", "part", "counts"]
    both = stage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(sign, "doc_id bigint, n bigint, digest binary, part int, counts binary"), "signatures")

    def add(key, table):
        total = np.zeros(COUNTERS // 64, dtype=np.uint64)
        for c in table["counts"]:
            total += np.frombuffer(c.as_py(), dtype=np.uint32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    # added up in two steps, so no task reads the counters of more than a share of all tasks
    parts = both.where("part is not null").select("part", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("lot"), "counts")
    parts = parts.groupBy("part", "lot").applyInArrow(add, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    total = np.zeros((2, COUNTERS), dtype=np.uint32)
    for row in parts.toLocalIterator():  # 128 rows, 8 MB in all
        size = COUNTERS // 64
        k, at = divmod(row["part"], 64)
        total[k, at * size:(at + 1) * size] = np.frombuffer(row["counts"], dtype=np.uint32)
    # a counter is shared by many rare shingles: what stands out of their number and its spread tells frequent ones
    own, noise = total[0].astype(np.float64), float(np.median(total[0]))
    excess = own - noise - 3 * np.sqrt(noise)
    classes = np.where(excess > 1, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0)
    common = np.round(np.log2(total[1].astype(np.float64) + 1) * 8)
    return both.where("part is null").select("doc_id", "n", "digest"), classes.astype(np.uint8), common.astype(np.uint8)


def _prefix_rows(docs: DataFrame, classes: np.ndarray, common: np.ndarray, n_bins: int, width: int, percent: int, orders: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((classes, common))  # 2 MB

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = bins.Packer(n_bins), set()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, (s, words) in zip(ids, scored(raw_texts(batch), width, shared.value[1]), strict=True):
                if doc_id is None or prefix_length(len(s), percent) == len(s) + 1:
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if digest in seen:
                    continue  # one of its class is sent
                seen.add(digest)
                for order in range(orders):
                    prefix = _prefix(s, words, shared.value[0], order, percent)
                    left = len(s) - np.arange(len(prefix), dtype=np.uint64)  # shingles from this one on
                    packer.add(order, prefix, doc_id, (np.uint64(len(s)) << np.uint64(32)) | left)
                if packer.full:
                    yield from packer.rows()
        yield from packer.rows()

    return docs.select("doc_id", "text").mapInArrow(emit, bins.SCHEMA)


def _lists(keys: np.ndarray, docs: np.ndarray, size: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """The entries sorted into lists of a shingle each: keys, docs, size, left, the list's number, partners behind each entry, lists with too many pairs.

    Partners of an entry stand behind it in its list, up to the largest size that can be similar.
    """
    order = np.lexsort((docs, size, keys))
    keys, docs, size, left = keys[order], docs[order], size[order], left[order]
    group = np.cumsum(np.concatenate(([False], keys[1:] != keys[:-1])))
    n = np.bincount(group)
    band = group.astype(np.int64) << np.int64(34)
    last = np.searchsorted(band + size, band + 100 * size // percent, side="right")
    partners = last - np.arange(len(keys)) - 1
    starry = np.bincount(group, partners) > np.maximum(LIST * LIST // 2, LIST // 2 * n)
    return keys, docs, size, left, group, partners, starry


def _pairs_of(keys: np.ndarray, docs: np.ndarray, size: np.ndarray, left: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the pairs that lists of one bin give, each once.

    Pairs whose sizes, or whose places in the order, leave no room for the similarity are left out: if the
    first shingle that two sets share has ``left`` of each set from it on, they share at most the smaller of these.
    """
    keys, docs, size, left, _, partners, _ = _lists(keys, docs, size, left, percent)
    some = np.flatnonzero(partners)
    cuts = np.searchsorted(np.cumsum(partners[some]), np.arange(0, partners.sum() + _PAIRS, _PAIRS), side="left")
    found = np.zeros((0, 2), dtype=np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(some)], strict=False):
        x = some[a:b]
        if not len(x):
            continue
        k = partners[x]
        i = np.repeat(x, k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        room = np.minimum(left[i], left[j])
        good = (100 * room >= percent * (size[i] + size[j] - room)) & (docs[i] != docs[j])
        one, two = docs[i[good]], docs[j[good]]
        rows = np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1)
        found = np.unique(np.concatenate((found, rows)), axis=0)
    return found[:, 0], found[:, 1]


def candidates(prefixes: DataFrame, orders: int, percent: int, n_bins: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of pairs that pass every order, and (a, b) of stars: centre and document.

    Near copies meet under many shingles, which lie in different bins.  So lists are first dealt out again by their
    smallest document, under which the same documents mostly meet; pairs are made there, once for all their shingles.
    A star's rows are dealt by centre and document, so each leaves once, and a large star is many tasks' work.
    """
    again = -(-n_bins // 2)
    schema = pa.schema([("kind", pa.int32()), ("bin", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("notes", pa.binary())])

    def entries(table):
        keys, docs, notes = bins.joined(table, keys=np.uint64, docs=np.int64, notes=np.uint64)
        return keys, docs, (notes >> np.uint64(32)).astype(np.int64), (notes & np.uint64(2**32 - 1)).astype(np.int64)

    def deal(key, table):
        keys, docs, size, left, group, partners, starry = _lists(*entries(table), percent)
        least = np.minimum.reduceat(docs, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))[group]
        short = (~starry & (np.bincount(group, partners) > 0))[group]
        notes = (size[short].astype(np.uint64) << np.uint64(32)) | left[short].astype(np.uint64)
        rows = [(key[0].as_py(), *r) for r in bins.dealt(least[short].astype(np.uint64), again, [keys[short], docs[short], notes])]
        star = np.unique(np.stack([least, docs], axis=1)[starry[group] & (docs != least)], axis=0)
        spread = bins.mix(star[:, 0].astype(np.uint64), 5) ^ star[:, 1].astype(np.uint64)
        rows += [(key[0].as_py() + orders, *r) for r in bins.dealt(spread, again, [star[:, 0], star[:, 1], np.zeros(len(star), dtype=np.uint64)])]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()

    def meet(key, table):
        kind = key[0].as_py()
        keys, docs, size, left = entries(table)
        if kind >= orders:
            a, b = np.unique(np.stack([keys.astype(np.int64), docs]), axis=1)
        else:
            a, b = _pairs_of(keys, docs, size, left, percent)
        return pa.table({"kind": pa.array(np.full(len(a), kind % orders), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "star": pa.array(np.full(len(a), kind >= orders), pa.bool_())})

    dealt = prefixes.groupBy("kind", "bin").applyInArrow(deal, bins.SCHEMA)
    rows = stage(dealt.groupBy("kind", "bin").applyInArrow(meet, "kind int, a bigint, b bigint, star boolean").distinct(), "candidates")
    stars = rows.where("star").select("a", "b").distinct()
    # a pair that is short of an order may still meet in one of its long lists, where pairs aren't enumerated
    ends = stage(rows.where("star").select("kind", F.explode(F.array("a", "b")).alias("doc")).distinct().groupBy("doc").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("long")), "long-lists")
    short = rows.where("not star").groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("has"))
    full = (1 << orders) - 1
    whole, part = short.where(F.col("has") == full), short.where(F.col("has") != full)
    part = part.join(ends.withColumnsRenamed({"doc": "a", "long": "la"}), "a").join(ends.withColumnsRenamed({"doc": "b", "long": "lb"}), "b")
    part = part.where(F.col("has").bitwiseOR(F.col("la").bitwiseAND(F.col("lb"))) == full)
    return whole.select("a", "b").unionByName(part.select("a", "b")), stars


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (doc_id, text) are similar."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        for batch in batches:
            left, right = raw_texts(batch, "text_a"), raw_texts(batch, "text_b")
            good = []
            for k, (x, y) in enumerate(zip(left, right, strict=True)):
                if last is None or last[0] != x:
                    last = x, next(shingles([x], width))
                if _similar(last[1], next(shingles([y], width)), percent):
                    good.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["a", "b"])

    whole = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def _blocks(stars: DataFrame, comps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between a star's documents outside its centre's component and all its documents."""
    comp = comps.withColumnsRenamed({"node": "doc", "component": "comp"})
    members = stars.select(F.col("a").alias("star"), F.col("b").alias("doc")).unionByName(stars.select(F.col("a").alias("star"), F.col("a").alias("doc")).distinct())
    members = members.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    members = members.join(comp.select(F.col("doc").alias("star"), F.col("comp").alias("own")), "star", "left").withColumn("out", F.col("comp") != F.coalesce("own", "star"))
    size = members.groupBy("star").agg(F.count("*").alias("n"), F.count(F.when(F.col("out"), 1)).alias("n_out")).where("n_out > 0")
    lots = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    members = members.join(size.select("star", lots("n").alias("all_lots"), lots("n_out").alias("out_lots")), "star")
    members = stage(members.withColumn("lot", F.xxhash64("doc")), "open")
    if members.isEmpty():
        return comps.select(F.col("node").alias("a"), F.col("component").alias("b")).limit(0)
    # each document meets, as one of all, every lot of open ones; an open one meets every lot of all
    every = F.explode(F.sequence(F.lit(0), F.col("out_lots") - 1))
    rows = members.select("star", F.pmod("lot", "all_lots").alias("lot_all"), every.alias("lot_out"), F.lit(False).alias("is_out"), "doc", "comp").unionByName(
        members.where("out").select("star", F.explode(F.sequence(F.lit(0), F.col("all_lots") - 1)).alias("lot_all"), F.pmod("lot", "out_lots").alias("lot_out"), F.lit(True).alias("is_out"), "doc", "comp"))
    rows = rows.join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")

    def compare(key, table):
        docs, comp, out = table["doc"].to_numpy(), table["comp"].to_numpy(), table["is_out"].to_numpy(zero_copy_only=False)
        sets = list(shingles(table["text"].combine_chunks().cast(pa.binary()).to_pylist(), width))
        n = np.array([len(s) for s in sets], dtype=np.int64)
        tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), n)
        x, y = np.flatnonzero(out), np.flatnonzero(~out)
        same = np.zeros((len(x), len(y)), dtype=np.float32)
        for first in range(0, len(tokens), 8192):  # a stripe of shingles at a time
            part = (inverse >= first) & (inverse < first + 8192)
            m = np.zeros((len(sets), 8192), dtype=np.float32)
            m[row[part], inverse[part] - first] = 1
            same += m[x] @ m[y].T
        total = n[x][:, None] + n[y][None, :] - same
        i, j = np.nonzero((100 * same >= percent * total) & (comp[x][:, None] != comp[y][None, :]))
        # one link for each two components is enough
        _, one = np.unique(np.stack([comp[x[i]], comp[y[j]]]), axis=1, return_index=True)
        return pa.table({"a": pa.array(docs[x[i[one]]], pa.int64()), "b": pa.array(docs[y[j[one]]], pa.int64())})

    return rows.groupBy("star", "lot_all", "lot_out").applyInArrow(compare, "a bigint, b bigint")


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    signed, classes, common = signatures(small_batches(docs), width)
    entries = signed.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    first = signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = stage(signed.where("n > 0 and doc_id is not null").join(first, "digest").select("doc_id", "rep").distinct(), "classes")
    n_bins = bins.count(int(entries))
    pairs, stars = candidates(_prefix_rows(docs, classes, common, n_bins, width, percent, orders), orders, percent, n_bins)

    def of_classes(df: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            df = df.join(reps.select(F.col("doc_id").alias(c), F.col("rep").alias(f"rep_{c}")), c)
        return df.where("rep_a <> rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()

    pairs, stars = stage(of_classes(pairs), "pairs"), stage(of_classes(stars), "stars")
    asked = stage(pairs.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "asked")
    wanted = stage(asked.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    texts = stage_packed(likely(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), wanted, "doc_id").join(wanted, "doc_id", "left_semi"), "texts")
    links = stage(verified(asked, texts, width, percent), "verified")
    copies = reps.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if not stars.isEmpty():
        links = links.unionByName(_blocks(stars, components(links.unionByName(copies)), texts, width, percent))
    comps = components(links.unionByName(copies))
    return signed.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS, by_row: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id.

    Rows with an empty set or a null id stay.  Of rows that share the smallest id one stays, the smallest text first.
    With ``by_row`` rows that share an id are nodes of their own, so each goes only if its own text is a near copy.
    """
    again = stage(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    alike = again.isEmpty()
    if by_row and not alike:
        return _keep_rows(docs, width, percent, orders)
    out = link(docs, width, percent, orders)
    # whole rows are joined only where an id may be concerned
    gone = stage(out.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    marked = maybe(docs, gone, "doc_id")
    kept = marked.where("not __maybe").drop("__maybe").unionByName(marked.where("__maybe").drop("__maybe").join(gone, "doc_id", "left_anti").select(*docs.columns))
    if alike:
        return kept
    marked = kept.join(again.withColumn("__shared", F.lit(True)), "doc_id", "left")
    alone, shared = marked.where("__shared is null").select(*docs.columns), marked.where("__shared").select(*docs.columns)
    least = shared.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("none"), "text")).alias("__least"))
    one = shared.join(least, "doc_id").where(F.col("text").eqNullSafe(F.col("__least.text"))).select(*docs.columns).dropDuplicates(["doc_id"])
    return alone.unionByName(one)


def _keep_rows(docs: DataFrame, width: int, percent: int, orders: int) -> DataFrame:
    """:func:`keep_one` over rows that share ids, by numbers of their own; written once, so the numbers stay."""
    numbered = stage_packed(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    own = numbered.where("doc_id is not null").select(F.col("__row").alias("doc_id"), "text")
    nodes = stage(link(own, width, percent, orders).select(F.col("doc_id").alias("__row"), "component_id"), "nodes")
    several = nodes.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = stage(nodes.join(several, "component_id").join(numbered.select("__row", "doc_id"), "__row"), "members")
    first = members.join(members.groupBy("component_id").agg(F.min("doc_id").alias("doc_id")), ["component_id", "doc_id"])
    # texts only where the smallest id has several rows of a group
    ties = stage(first.join(first.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "component_id").select("__row", "component_id"), "ties")
    told = likely(numbered.select("__row", "text"), ties, "__row").join(ties, "__row").groupBy("component_id").agg(F.min(F.struct("text", "__row")).alias("least"))
    kept = first.join(ties, "component_id", "left_anti").select("__row").unionByName(told.select("least.__row"))
    gone = stage(members.join(kept, "__row", "left_anti").select("__row"), "gone")
    marked = maybe(numbered, gone, "__row")
    return marked.where("not __maybe").select(*docs.columns).unionByName(marked.where("__maybe").join(gone, "__row", "left_anti").select(*docs.columns))
