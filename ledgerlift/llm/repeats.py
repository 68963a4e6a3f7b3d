"""Exact repeats between documents, byte by byte, with two-stage suffix sorting.

Every byte that is covered by a string of ``LEAST`` bytes which also starts in a document with a smaller id is
removed.  Matches don't cross documents, and strings are judged on the input.

1. Equal texts are one content, represented by its smallest id; its other copies are covered whole.  A content's
   name is a 64-bit hash; where two different MD5 digests have one name, both get another.
2. In each window of ``LEAST`` bytes the ``GRAM``-byte gram with the smallest hash is its *anchor*: equal windows have
   equal anchors at equal places.  Each content's different anchors (about one for 16 bytes) go to bins by
   hash; only anchors of two or more contents can be part of a match.
3. Around each such anchor its context, the 31 windows that hold it, goes to a bin: anchors of few contents by the
   smallest of these, so that neighbouring anchors of the same documents meet in one bin and give one
   range; anchors of more than ``FEW`` by their own hash.  Equal contexts decide each other at once.  The others are joined into a text whose suffixes are sorted in two stages:
   suffixes smaller than their successor are sorted directly, all others are induced by scanning the
   buckets of their first bytes; neighbours with a common prefix of ``LEAST`` bytes form a group, and all
   members but those of its smallest document are covered.
4. Covered ranges are merged, first in their bin, then by content, cut out and digested.

Sizes.  The bins of both exchanges follow the number of entries; a task sorts about ``CHUNK`` contexts at a
time, and an anchor with many more place by place.  Texts without a covered byte aren't shuffled for step 4.
Anchors of one content only, the bulk of a corpus, are never sent beyond step 2.

Defined cases: null and empty texts have 0 bytes and nothing to remove; texts shorter than ``LEAST`` bytes
stay; rows with a null id cover nothing and stay as they are; rows that share an id don't cover each other;
an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm import bins
from ledgerlift.llm.common import maybe, raw_texts, small_batches
from ledgerlift.session import stage

LEAST, GRAM = 50, 20
_SPAN = LEAST - GRAM  # an anchor's window starts at most so many bytes before it
_WIDE = 2 * _SPAN + GRAM  # bytes of a context
#: Contexts that a bin should hold, contexts sorted together, bytes whose grams are hashed together.
BIN_CONTEXTS, CHUNK, _SLICE = 100_000, 8_000, 1 << 18
#: Contents up to which an anchor travels with its neighbours.
FEW = 64
_CONTEXTS = "bin bigint, keys binary, docs binary, owners binary, places binary, rooms binary, contexts binary"


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over ``width`` neighbours, for each start."""
    done, size = x, 1
    while 2 * size <= width:
        done = best(done[:-size], done[size:])
        size *= 2
    return best(done[:len(x) - width + 1], done[width - size:]) if size < width else done


def anchors(raws: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of each text's anchors."""
    first = 0
    while first < len(raws):
        parts, held, k = [], 0, first
        while k < len(raws) and (k == first or held + len(raws[k] or b"") < _SLICE):
            parts.append(raws[k] or b"")
            held += len(parts[-1])
            k += 1
        first = k
        block = b"".join(parts)
        starts = np.cumsum([0, *map(len, parts)])
        n = len(block) - GRAM + 1
        if len(block) < LEAST:
            for _ in parts:
                yield np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        eight = np.ndarray((n + GRAM - 8,), dtype="<u8", buffer=block, strides=(1,))
        h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += eight[8:n + 8]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h += eight[GRAM - 8:]
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h |= np.uint64(1)
        least = _sliding(h, _SPAN + 1, np.minimum)
        inside = np.zeros(len(least), dtype=bool)
        for a, b in zip(starts, starts[1:], strict=False):
            inside[a:max(a, b - LEAST + 1)] = True
        least[~inside] = 0
        pad = np.zeros(_SPAN, dtype=np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), _SPAN + 1, np.maximum) == h)
        found = h[at]
        edges = np.searchsorted(at, starts)
        for a, b, s in zip(edges, edges[1:], starts, strict=False):
            yield at[a:b] - s, found[a:b]


def sort_suffixes(text: bytes, wide: int, depth: int) -> np.ndarray:
    """Starts of all suffixes of a text of strings ``wide`` bytes each, in order.

    Each string ends in something larger than any byte; the order is right for at least ``depth`` bytes of
    those suffixes that have as many.
    """
    n = len(text)
    t = np.frombuffer(text, dtype=np.uint8)
    following = np.full(n, 256, dtype=np.int16)
    following[:-1] = t[1:]
    following[wide - 1::wide] = 256
    # smaller than the successor; in a run of one byte as at the run's end
    same = following == t
    smaller = t < following
    ends = np.flatnonzero(~same)
    smaller = smaller[ends][np.searchsorted(ends, np.arange(n))]
    # first stage: the smaller ones are sorted directly, eight bytes at a time, ties only
    beyond = text + b"\0" * (depth + 16)
    words = np.ndarray((n + depth + 8,), dtype=">u8", buffer=beyond, strides=(1,))
    order = np.flatnonzero(smaller)
    key = words[order].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    order, key = order[by], key[by]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    for at in range(8, depth, 8):
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        key = words[order[tied] + at].astype(np.uint64)
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        key, group = key[by], group[tied]
        new[tied] |= np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
    # second stage: all others, bucket by bucket in the order of first bytes
    first = t[order]
    cut = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    result: list[np.ndarray] = []

    def hand_on(found: np.ndarray, own: int) -> np.ndarray:
        """Predecessors that this scan places: into later buckets, in order; returned are those of its own."""
        before = found[found % wide > 0] - 1
        before = before[~smaller[before]]
        lead = t[before]
        for c in np.unique(lead[lead > own]):
            induced[c].append(before[lead == c])
        return before[lead == own]

    for c in range(256):
        part = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(part):
            result.append(part)
            part = hand_on(part, c)
        if cut[c] < cut[c + 1]:
            part = order[cut[c]:cut[c + 1]]
            result.append(part)
            hand_on(part, c)
    return np.concatenate(result)


def _covered(contexts: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For contexts (rows of bytes), windows first to last allowed: which are covered, as a table of booleans."""
    text = contexts.tobytes()
    order = sort_suffixes(text, _WIDE, LEAST)
    row, start = np.divmod(order, _WIDE)
    fits = (start >= low[row]) & (start <= high[row])
    order, row, start = order[fits], row[fits], start[fits]
    out = np.zeros((len(docs), _SPAN + 1), dtype=bool)
    if not len(order):
        return out
    # common prefixes of neighbours: of LEAST bytes or not
    words = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    equal = np.ones(len(order) - 1, dtype=bool)
    for at in (*range(0, LEAST - 8, 8), LEAST - 8):
        same = np.flatnonzero(equal)
        equal[same] = words[order[same] + at] == words[order[same + 1] + at]
    group = np.concatenate(([0], np.cumsum(~equal)))
    begin = np.concatenate(([0], np.flatnonzero(~equal) + 1))
    smallest = np.minimum.reduceat(docs[row], begin)
    hit = docs[row] > smallest[group]
    out[row[hit], start[hit]] = True
    return out


def _crowded(contexts: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """As :func:`_covered`, for many contexts of one anchor: equal windows hold it at equal places, so each
    place's windows are sorted on their own, in memory that doesn't grow with their length."""
    out = np.zeros((len(docs), _SPAN + 1), dtype=bool)
    for s in range(_SPAN + 1):
        row = np.flatnonzero((low <= s) & (s <= high))
        if len(row) < 2:
            continue
        words = [np.ascontiguousarray(contexts[row, s + at:s + at + 8]).view(np.uint64).ravel() for at in (*range(0, LEAST - 8, 8), LEAST - 8)]
        order = np.lexsort(words)
        equal = np.ones(len(row) - 1, dtype=bool)
        for w in words:
            equal &= w[order[1:]] == w[order[:-1]]
        owner = docs[row[order]]
        begin = np.concatenate(([0], np.flatnonzero(~equal) + 1))
        smallest = np.repeat(np.minimum.reduceat(owner, begin), np.diff(np.append(begin, len(row))))
        out[row[order], s] = owner > smallest
    return out


def _judge(keys: np.ndarray, docs: np.ndarray, owners: np.ndarray, places: np.ndarray, rooms: np.ndarray, contexts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(content, from, to) of the covered ranges that one bin's contexts show."""
    low, high = np.maximum(_SPAN - places, 0), rooms.astype(np.int64) - GRAM
    # equal contexts, cut alike, are one; all but its smallest document's are covered
    wide = np.concatenate((contexts, low.astype(np.uint8)[:, None], rooms[:, None]), axis=1)
    names = np.ascontiguousarray(wide).view(np.dtype((np.void, wide.shape[1]))).ravel()
    digest = keys.copy()
    for at in range(0, _WIDE, 8):
        digest = bins.mix(digest ^ np.ascontiguousarray(contexts[:, at:at + 8]).view(np.uint64).ravel(), at)
    digest = bins.mix(digest ^ (low.astype(np.uint64) << np.uint64(8)) ^ rooms.astype(np.uint64), 999)
    order = np.lexsort((docs, digest, keys))
    owners = owners[order]
    keys, docs, places, low, high, digest, names = keys[order], docs[order], places[order], low[order], high[order], digest[order], names[order]
    contexts = contexts[order]
    head = np.concatenate(([True], (digest[1:] != digest[:-1]) | (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])))
    smallest = docs[head][np.cumsum(head) - 1]
    whole = docs > smallest
    yield owners[whole], (places - _SPAN + low)[whole], (places - _SPAN + high + LEAST)[whole]
    # the rest: contexts of anchors that have several
    heads = np.flatnonzero(head)
    several = np.concatenate(([True], keys[heads][1:] != keys[heads][:-1]))
    n = np.diff(np.append(np.flatnonzero(several), len(heads)))
    heads = heads[np.repeat(n > 1, n)]
    if not len(heads):
        return
    cut = np.flatnonzero(np.concatenate(([True], keys[heads][1:] != keys[heads][:-1])))
    edges = [0]
    for begin, c in zip(cut.tolist(), [*cut[1:].tolist(), len(heads)], strict=True):
        if c - begin > CHUNK and begin > edges[-1]:
            edges.append(begin)  # an anchor with very many contexts stands alone
        if c - edges[-1] >= CHUNK or c == len(heads):
            edges.append(c)
    class_of = np.cumsum(head) - 1
    for a, b in zip(edges, edges[1:], strict=False):
        at = heads[a:b]
        if not len(at):
            continue
        hit = (_crowded if len(at) > 2 * CHUNK and keys[at[0]] == keys[at[-1]] else _covered)(contexts[at], docs[at], low[at], high[at])
        # every occurrence in the smallest document has what its context has
        of = {int(class_of[k]): r for r, k in enumerate(at.tolist()) if hit[r].any()}
        if not of:
            continue
        wanted = np.zeros(int(class_of[-1]) + 1, dtype=bool)
        wanted[list(of)] = True
        occ = np.flatnonzero(wanted[class_of] & ~whole)
        table = hit[[of[int(class_of[k])] for k in occ]]
        edge = np.diff(np.pad(table.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, s = np.nonzero(edge == 1)
        _, e = np.nonzero(edge == -1)
        yield owners[occ[r]], places[occ[r]] - _SPAN + s, places[occ[r]] - _SPAN + e - 1 + LEAST


def _merged_by(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) sorted; an owner's ranges that touch or overlap become one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    head = np.concatenate(([True], owner[1:] != owner[:-1]))
    # every owner's ranges are put behind all of the owner's before, so one running maximum serves
    wide = int(end.max()) + 1
    shift = (np.cumsum(head) - 1) * wide
    reach = np.maximum.accumulate(end + shift)
    new = head.copy()
    new[1:] |= start[1:] + shift[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(owner) - 1)
    return owner[new], start[new], (reach - shift)[last]


def _table(rows: list[tuple], number: str, *columns: str) -> pa.Table:
    """Rows of a number and of bytes."""
    fields = pa.schema([(number, pa.int64()), *((c, pa.binary()) for c in columns)])
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)], schema=fields) if rows else fields.empty_table()


def covered_ranges(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """(content, ranges): byte ranges of a content's smallest document; ranges hold pairs of 64-bit numbers.

    ``docs`` has (doc_id, content, text), ``contents`` (content, rep, n_bytes).
    """
    entries = contents.agg(F.sum("n_bytes")).first()[0] or 0
    n_bins = bins.count(int(entries) // 15)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = bins.Packer(n_bins), set()
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), raw_texts(batch)
            new = [k for k, c in enumerate(ids) if c not in seen and not seen.add(c)]
            for k, (_, found) in zip(new, anchors([raws[k] for k in new]), strict=True):
                if len(found):
                    packer.add(0, np.unique(found), ids[k])
                if packer.full:
                    yield from packer.rows()
        yield from packer.rows()

    lots = -(-n_bins // 4)

    def shared(key, table):
        keys, owners = bins.unpack(table)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(begin, len(keys)))
        # owners are sorted within a key
        route = np.where(n > FEW, bins.mix(keys[begin], 80), bins.mix(owners[begin].astype(np.uint64), 81))
        keep = np.repeat(n > 1, n)
        rows = bins.dealt(owners[keep].astype(np.uint64), lots, [owners[keep], keys[keep], np.repeat(route, n)[keep]])
        return _table(rows, "lot", "owners", "keys", "routes")

    def of_content(key, table):
        owners, keys, routes = bins.joined(table, owners=np.int64, keys=np.uint64, routes=np.uint64)
        order = np.lexsort((keys, owners))
        owners, keys, routes = owners[order], keys[order], routes[order]
        begin = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        ends = np.append(begin[1:], len(owners))
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary())
        return pa.table({"content": pa.array(owners[begin], pa.int64()), "n": pa.array(ends - begin, pa.int64()), "anchors": cut(keys), "routes": cut(routes)})

    known = docs.where("doc_id is not null")
    found = known.select("content", "text").mapInArrow(emit, bins.SCHEMA).groupBy("kind", "bin").applyInArrow(shared, "lot bigint, owners binary, keys binary, routes binary")
    found = stage(found.groupBy("lot").applyInArrow(of_content, "content bigint, n bigint, anchors binary, routes binary"), "anchors")
    total = found.agg(F.sum("n")).first()[0] or 0
    context_bins = max(1, -(-int(total) // BIN_CONTEXTS))
    wanted = found.join(contents.select("content", F.col("rep").alias("doc_id")), "content")

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            ids, names, lists, routes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "content", "anchors", "routes"))
            raws = raw_texts(batch)
            for doc_id, name, own, route, raw, (at, h) in zip(ids, names, lists, routes, raws, anchors(raws), strict=True):
                own = np.frombuffer(own, dtype=np.uint64)
                where = np.minimum(np.searchsorted(own, h), len(own) - 1)
                good = own[where] == h
                at, h, where = at[good], h[good], where[good]
                padded = np.frombuffer(b"\0" * _SPAN + raw + b"\0" * LEAST, dtype=np.uint8)
                view = np.lib.stride_tricks.sliding_window_view(padded, _WIDE)[at]
                held.append((np.frombuffer(route, dtype=np.uint64)[where], h, np.full(len(at), doc_id, dtype=np.int64), np.full(len(at), name, dtype=np.int64), at.astype(np.int64), np.minimum(len(raw) - at, LEAST).astype(np.uint8), view))
                n += len(at)
                if n >= 250_000:
                    yield pack(held)
                    held, n = [], 0
        if n:
            yield pack(held)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return _table(bins.dealt(columns[0], context_bins, columns[1:]), "bin", "keys", "docs", "owners", "places", "rooms", "contexts").to_batches()[0]

    def judge(key, table):
        keys, docs, owners, places, rooms, around = bins.joined(table, keys=np.uint64, docs=np.int64, owners=np.int64, places=np.int64, rooms=np.uint8, contexts=np.uint8)
        parts = list(_judge(keys, docs, owners, places, rooms, around.reshape(-1, _WIDE)))
        found = _merged_by(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        return _table(bins.dealt(found[0].astype(np.uint64), lots, list(found)), "lot", "owners", "starts", "ends")

    def merge(key, table):
        owners, starts, ends = _merged_by(*bins.joined(table, owners=np.int64, starts=np.int64, ends=np.int64))
        begin = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
        both = np.stack([starts, ends], axis=1)
        return pa.table({"content": pa.array(owners[begin], pa.int64()), "ranges": pa.array([both[a:b].tobytes() for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(owners)], strict=True)], pa.binary())})

    texts = known.join(wanted, ["content", "doc_id"])
    judged = texts.select("doc_id", "content", "anchors", "routes", "text").mapInArrow(contexts, _CONTEXTS).groupBy("bin").applyInArrow(judge, "lot bigint, owners binary, starts binary, ends binary")
    return judged.groupBy("lot").applyInArrow(merge, "content bigint, ranges binary")


def _name(text: Column) -> Column:
    """A content's name."""
    return F.xxhash64(text)


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, content) of each row and (content, rep, n_bytes) of each different text."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _name(text).alias("content"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    contents = docs.where("doc_id is not null").groupBy("content", "digest").agg(F.min("doc_id").alias("rep"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("n_bytes"))
    contents = stage(contents, "contents")
    # names that several digests share: for n texts about n * n / 2 ** 65 of them
    several = stage(contents.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content").join(contents, "content").select("content", "digest", F.xxhash64("digest").alias("other")), "shared-names")
    if several.isEmpty():
        return docs.drop("digest"), contents.drop("digest")

    def renamed(df: DataFrame) -> DataFrame:
        return df.join(several, ["content", "digest"], "left").withColumn("content", F.coalesce("other", "content")).drop("other", "digest")

    return renamed(docs), renamed(contents)


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` (doc_id, text).

    ``with_text`` adds ``kept``, the bytes that are left.
    """
    docs, contents = _named(small_batches(docs))
    long = contents.where(F.col("n_bytes") >= LEAST)
    ranges = stage(covered_ranges(docs, long), "ranges")
    copies = docs.where("doc_id is not null").select("doc_id", "content").join(long.select("content", "rep"), "content").where("doc_id > rep").select("content").distinct()
    info = stage(ranges.join(copies, "content", "full").join(long.select("content", "rep"), "content").select("content", "rep", "ranges"), "info")
    marked = maybe(docs, info, "content")
    none = {"rep": F.lit(None).cast("bigint"), "ranges": F.lit(None).cast("binary")}
    joined = marked.where("__maybe").drop("__maybe").join(info, "content", "left").select("doc_id", "text", "rep", "ranges")
    judged = joined.unionByName(marked.where("not __maybe").withColumns(none).select("doc_id", "text", "rep", "ranges"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, lists = batch.column(batch.schema.get_field_index("rep")).to_pylist(), batch.column(batch.schema.get_field_index("ranges")).to_pylist()
            ids = batch.column(0).to_pylist()
            n, removed, spans, kept = [], [], [], []
            for doc_id, rep, own, raw in zip(ids, reps, lists, raw_texts(batch), strict=True):
                raw = raw or b""
                n.append(len(raw))
                if rep is None or doc_id is None or (doc_id == rep and not own):
                    start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
                elif doc_id > rep:
                    start, end = np.array([0]), np.array([len(raw)])
                else:
                    start, end = np.frombuffer(own, dtype=np.int64).reshape(-1, 2).T
                removed.append(int((end - start).sum()))
                spans.append(len(start))
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if with_text else columns, names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return judged.mapInArrow(cut, schema)
