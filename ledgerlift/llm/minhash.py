"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard similarity of full sets.

A text's set is its distinct shingles of ``width`` words (A-Z lower-cased, words split at white space).  Two
permutations of the 32-bit numbers make the whole signature: ``s`` scatters the shingles, and coordinate ``k`` is
the least ``p(s(x) - k)`` over the set, that is the least under ``p`` shifted circularly by ``k`` places.

1. One pass gives each text's size, set digest and the keys of its bands (``rows`` coordinates each).  Texts
   with equal sets are one class; one text stands for it.
2. Bands of classes meet by key.  Buckets of up to ``BUCKET`` classes give their pairs of comparable sizes, each different
   bucket once however many bands show it; larger buckets give a star, every class against the smallest one.
3. Pairs and stars are verified on the full sets.  What a star leaves open (classes outside its centre's
   component) is compared block by block with all its classes, inside tasks; only links come out.
4. Components of the verified links, in which classes and so all copies are included.

A pair of similarity ``s`` shares a band with probability ``1 - (1 - s ** rows) ** bands``: with 5 rows and 56 bands
2 in 10 thousand million pairs at 0.8 are missed, and fewer above; no candidate is dropped for any other reason.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; with
fewer than ``width`` words the whole sequence is one shingle; a null id has a null component; rows that
share an id are one node, each with its own size; an empty table stays empty; further columns of ``docs`` are
not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm import bins
from ledgerlift.llm.common import likely, raw_texts, small_batches, stage_packed
from ledgerlift.llm.components import components
from ledgerlift.llm.near import shingles
from ledgerlift.session import stage

WIDTH, PERCENT, ROWS, BANDS = 2, 80, 5, 56
#: Classes of a bucket whose pairs are listed; classes in a block; shingles permuted together.
BUCKET, BLOCK, _PIECE = 32, 256, 1 << 16


def scatter(sets: np.ndarray) -> np.ndarray:
    """The first permutation, of 64-bit shingles, and the 32 bits of it that are used."""
    return (bins.mix(sets, 900) >> np.uint64(32)).astype(np.uint32)


def permute(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers."""
    np.multiply(x, np.uint32(0x9E3779B1), out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0x85EBCA77), out=out)
    np.right_shift(out, np.uint32(13), out=spare)
    np.bitwise_xor(out, spare, out=out)
    return np.multiply(out, np.uint32(0xC2B2AE3D), out=out)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of ``coordinates`` numbers for each of the sets, none of which is empty."""
    out = np.full((coordinates, len(sets)), 2**32 - 1, dtype=np.uint32)
    if not sets:
        return out.T
    size = np.array([len(s) for s in sets])
    places, begin = scatter(np.concatenate(sets)), np.concatenate(([0], np.cumsum(size)))
    for first in range(0, len(places), _PIECE):  # a piece may begin and end inside a set
        piece = places[first:first + _PIECE]
        a, b = int(np.searchsorted(begin, first, side="right")) - 1, int(np.searchsorted(begin, first + len(piece)))
        cuts = np.maximum(begin[a:b] - first, 0)
        x, y, z = (np.empty_like(piece) for _ in range(3))
        for k in range(coordinates):
            np.subtract(piece, np.uint32(k), out=x)
            np.minimum(out[k, a:b], np.minimum.reduceat(permute(x, y, z), cuts), out=out[k, a:b])
    return out.T


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each signature."""
    keys = np.empty((len(signature), signature.shape[1] // rows), dtype=np.uint64)
    for band in range(keys.shape[1]):
        key = np.full(len(signature), band, dtype=np.uint64)
        for r in range(rows):
            key = bins.mix(key ^ signature[:, band * rows + r].astype(np.uint64), r)
        keys[:, band] = key
    return keys


def signed(docs: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n, digest, bands) of each row: size and digest of the set, and the keys of its bands (null where the task has given the set before)."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sets = list(shingles(raw_texts(batch), width))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            fresh = []
            for k, (s, digest, doc_id) in enumerate(zip(sets, digests, batch.column(0).to_pylist(), strict=True)):
                if len(s) and doc_id is not None and digest not in seen:
                    seen.add(digest)
                    fresh.append(k)
            keys = band_keys(signatures([sets[k] for k in fresh], rows * bands), rows)
            lists: list[np.ndarray | None] = [None] * len(sets)
            for k, row in zip(fresh, keys, strict=True):
                lists[k] = row.view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64())),
            ], names=["doc_id", "n", "digest", "bands"])

    return small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(sign, "doc_id bigint, n bigint, digest binary, bands array<bigint>")


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, rep, n, bands) of each different set, and (doc_id, rep) of the rows that others stand for."""
    told = rows.where("n > 0 and doc_id is not null")
    reps = told.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"))
    reps = stage(reps, "classes")
    # only sets with several rows are looked up by digest, from a table that Spark may broadcast or split
    several = reps.where("copies > 1").select("digest", "rep")
    return reps, told.select("doc_id", "digest").join(several, "digest").where("doc_id <> rep").select("doc_id", "rep").distinct()


def buckets(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of pairs to verify, and (a, b) of stars: centre and class."""
    rows = stage(reps.select("rep", "n", F.explode("bands").alias("key")), "bands")
    found = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
    found = stage(found, "buckets")
    members = likely(rows, found, "key").join(found, "key")
    # listed buckets hold BUCKET classes at most, and near copies share the same bucket in many bands
    listed = members.where(F.col("size") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("list")).select("list").distinct()
    pairs = listed.select(F.explode(F.expr(
        f"flatten(transform(list, (x, i) -> transform(filter(slice(list, i + 2, size(list)), y -> 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)), y -> struct(x.rep as a, y.rep as b))))",
    )).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    stars = members.where((F.col("size") > BUCKET) & (F.col("rep") != F.col("least"))).select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    return stage(pairs, "pairs"), stage(stars, "stars")


def same_enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (doc_id, text) have similar sets."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] | None = None
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(raw_texts(batch, "text_a"), raw_texts(batch, "text_b"), strict=True)):
                if last is None or last[0] != x:
                    last = x, next(shingles([x], width))
                if same_enough(last[1], next(shingles([y], width)), percent):
                    good.append(k)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    whole = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def open_pairs(stars: DataFrame, comps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between a star's classes outside its centre's component and all its classes, from blocks of both."""
    comp = comps.withColumnsRenamed({"node": "doc", "component": "comp"})
    centres = stars.select("a").distinct()
    members = stars.select(F.col("a").alias("star"), F.col("b").alias("doc")).unionByName(centres.select(F.col("a").alias("star"), F.col("a").alias("doc")))
    members = members.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    own = centres.withColumnRenamed("a", "star").join(comp.withColumnRenamed("doc", "star"), "star", "left").select("star", F.coalesce("comp", "star").alias("own"))
    members = members.join(own, "star").withColumn("out", F.col("comp") != F.col("own"))
    size = members.groupBy("star").agg(F.count("*").alias("n"), F.count(F.when(F.col("out"), 1)).alias("n_out")).where("n_out > 0")
    lots = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    members = stage(members.join(size.select("star", lots("n").alias("lots"), lots("n_out").alias("out_lots")), "star").withColumn("lot", F.xxhash64("doc")), "open")
    # every class meets each lot of open ones, every open class each lot of all
    every = members.select("star", F.pmod("lot", "lots").alias("lot_all"), F.explode(F.sequence(F.lit(0), F.col("out_lots") - 1)).alias("lot_out"), F.lit(False).alias("is_out"), "doc", "comp")
    out = members.where("out").select("star", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot_all"), F.pmod("lot", "out_lots").alias("lot_out"), F.lit(True).alias("is_out"), "doc", "comp")
    rows = every.unionByName(out).join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")

    def compare(key, table):
        docs, comp, is_out = table["doc"].to_numpy(), table["comp"].to_numpy(), table["is_out"].to_numpy(zero_copy_only=False)
        sets = list(shingles(table["text"].combine_chunks().cast(pa.binary()).to_pylist(), width))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        inside = np.flatnonzero(~is_out)
        inside = inside[np.argsort([len(sets[j]) for j in inside], kind="stable")]
        sizes = np.array([len(sets[j]) for j in inside])
        for i in np.flatnonzero(is_out).tolist():
            low, high = np.searchsorted(100 * sizes, percent * len(sets[i])), np.searchsorted(percent * sizes, 100 * len(sets[i]), side="right")
            for j in inside[low:high].tolist():
                two = (int(comp[i]), int(comp[j]))
                # one link for each two components is enough
                if two[0] != two[1] and two not in found and same_enough(sets[i], sets[j], percent):
                    found[two] = int(docs[i]), int(docs[j])
        return pa.table({"a": pa.array([a for a, _ in found.values()], pa.int64()), "b": pa.array([b for _, b in found.values()], pa.int64())})

    return rows.groupBy("star", "lot_all", "lot_out").applyInArrow(compare, "a bigint, b bigint")


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text); kept is the smallest id of each component."""
    known = stage(signed(docs, width, rows, bands), "signatures")
    reps, copies = classes(known)
    pairs, stars = buckets(reps, percent)
    asked = stage(pairs.unionByName(stars).distinct(), "asked")
    wanted = stage(asked.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # rows that share an id may differ: only the one with the class's set stands for the class
    texts = stage_packed(likely(texts, wanted, "doc_id").join(wanted, "doc_id", "left_semi"), "texts")
    links = stage(verified(asked, texts, width, percent), "verified")
    copies = stage(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    if not stars.isEmpty():
        links = stage(links.unionByName(open_pairs(stars, components(links), texts, width, percent)), "all-links")
    comps = components(links.unionByName(copies))
    out = known.select("doc_id", "n").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
