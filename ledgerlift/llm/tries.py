"""Which filters of a corpus do the work: exact duplicates by radix tries, and every order of filters from one mask a document.

Five filters judge each document once and leave a bit each where it fails: A under 100 words, B few different
words, C many capitals, D symbols, E a text that a smaller id has too.  What a filter removes depends on those
before it, so all 120 orders are reported; the documents are reduced to counts by part, mask and label first,
and the orders are computed from these few rows.

Filter E, over whole texts:

1. The tasks that read the documents go through each batch by ascending id.  A row whose text the task has already
   seen with a smaller id is a duplicate there and then, only the others' texts are sent on; so a group of copies
   that holds a third of all rows shrinks to a few rows a task, one a batch at worst.
2. *Adaptive prefixes.*  Texts are counted by their first eight characters; where a prefix holds more than ``GROUP``
   bytes of text, its texts are counted again by twice as many characters, until no prefix is that heavy or the
   texts end.  Only rows under heavy prefixes take part in the next count.
3. The rows are range-partitioned and sorted by their prefix.  Each task inserts the whole texts of one prefix after
   the other into a compressed trie (edges hold strings, a node's children differ in their first byte), whose
   terminals hold the least id; a row is a duplicate if its terminal's id is smaller than its own.

Defined cases: a null text is the empty text; a null id is neither smaller nor larger than another and its
row is no duplicate; rows with the same id and text are none of each other, each counts as a document; a
null part is the empty string; a document is good (toxic) if any row of ``labels`` with its id says 1, and neither
without such a row; an empty table gives no rows; further columns, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import raw_texts, small_batches, stage_packed
from ledgerlift.session import stage

FILTERS = "ABCDE"
#: Bytes of text under one prefix, bytes of text for one task, and characters of the first prefixes.
GROUP, TASK_BYTES, FIRST = 8 << 20, 32 << 20, 8
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOL = re.compile(rb"[#$%&*|]")


def own_mask(raw: bytes) -> int:
    """The bits of the filters A to D that the text fails."""
    words = raw.split()  # of bytes: at space and \x09-\x0D
    mask = len(words) < 100
    mask |= (100 * len(set(words)) < 80 * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 10 * len(raw.decode("utf-8", "replace"))) << 2
    return mask | (_SYMBOL.search(raw) is not None) << 3


class Trie:
    """A compressed trie; a terminal holds the least id of the texts that end there."""

    __slots__ = ("root",)

    def __init__(self):
        self.root: list = [b"", {}, None]  # string on the edge to it, children by first byte, least id

    def insert(self, text: bytes, doc_id: int) -> list:
        """Insert and return the terminal."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                leaf = [text[at:], {}, doc_id]
                node[1][text[at]] = leaf
                return leaf
            edge = child[0]
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same = _common(edge, text, at)
            middle = [edge[:same], {edge[same]: child}, None]
            child[0] = edge[same:]
            node[1][text[at]] = middle
            node, at = middle, at + same
        if node[2] is None or doc_id < node[2]:
            node[2] = doc_id
        return node


def _common(edge: bytes, text: bytes, at: int) -> int:
    """How long the edge and the text from ``at`` on agree; they differ somewhere, or the text ends."""
    low, high = 0, min(len(edge), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(edge[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _judge(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask, again, n_bytes, prefix, text): ``again`` where the task has seen the text with a smaller id; else the text is sent on."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, tuple[int, int]] = {}  # by digest: least id so far, mask
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), raw_texts(batch)
            masks, again, texts = [0] * len(ids), [False] * len(ids), [None] * len(ids)
            for k in sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)):
                raw, doc_id = raws[k] or b"", ids[k]
                digest = hashlib.blake2b(raw, digest_size=16).digest()
                seen = least.get(digest)
                masks[k] = seen[1] if seen else own_mask(raw)
                if doc_id is None:
                    continue
                again[k] = seen is not None and seen[0] < doc_id
                if not again[k]:
                    texts[k] = raw
                    least[digest] = doc_id, masks[k]
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(again, pa.bool_()),
                pc.binary_length(text).cast(pa.int64()), pc.utf8_slice_codeunits(text, 0, FIRST), text,
            ], names=["doc_id", "part", "mask", "again", "n_bytes", "prefix", "text"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return small_batches(rows).mapInArrow(judge, "doc_id bigint, part string, mask int, again boolean, n_bytes bigint, prefix string, text string")


def _prefixed(rows: DataFrame) -> DataFrame:
    """``rows`` (text, n_bytes, prefix of ``FIRST`` characters), each with the shortest prefix that is not heavy."""
    size, done = FIRST, None
    while True:
        heavy = rows.groupBy("prefix").agg(F.sum("n_bytes").alias("bytes"), F.max("n_bytes").alias("longest"))
        heavy = stage(heavy.where((F.col("bytes") > GROUP) & (F.col("longest") > size)).select("prefix"), "heavy-prefixes")
        if heavy.isEmpty():
            return rows if done is None else done.unionByName(rows)
        light = rows.join(heavy, "prefix", "left_anti").select(*rows.columns)
        done = light if done is None else done.unionByName(light)
        size *= 2
        rows = rows.join(heavy, "prefix", "left_semi").withColumn("prefix", F.substring("text", 1, size)).select(*light.columns)


def _in_tries(rows: DataFrame) -> DataFrame:
    """(doc_id, part, mask, again) of rows that come sorted by prefix, equal prefixes in one task."""

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, prefix, held = Trie(), None, []

        def flags() -> pa.RecordBatch:
            out = [[d for d, _, _, _ in held], [p for _, p, _, _ in held], [m for _, _, m, _ in held], [node[2] < d for d, _, _, node in held]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.bool_()), strict=True)], names=["doc_id", "part", "mask", "again"])

        for batch in batches:
            for doc_id, part, mask, raw, own in zip(*(batch.column(k).to_pylist() for k in range(3)), raw_texts(batch), raw_texts(batch, "prefix"), strict=True):
                if own != prefix:
                    if held:
                        yield flags()
                    trie, prefix, held = Trie(), own, []
                held.append((doc_id, part, mask, trie.insert(raw, doc_id)))
        if held:
            yield flags()

    return rows.select("doc_id", "part", "mask", "text", "prefix").mapInArrow(walk, "doc_id bigint, part string, mask int, again boolean")


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of each row of ``docs`` (doc_id, text and the column ``part``): bit ``k`` is set if it fails filter ``k``."""
    judged = stage_packed(_judge(docs, part), "judged")
    asked = judged.where("n_bytes is not null")
    total = asked.agg(F.sum("n_bytes")).first()[0] or 0
    ranged = _prefixed(asked).repartitionByRange(max(1, -(-int(total) // TASK_BYTES)), "prefix").sortWithinPartitions("prefix")
    rows = judged.where("n_bytes is null").select("doc_id", "part", "mask", "again").unionByName(_in_tries(ranged))
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.col("again").cast("int") * 16).alias("mask"))


def counted(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and those labelled good and toxic."""
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return flagged.join(told, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """Each part, order of filters and step: what is kept, removed, redundant, failed by this filter only, lost, and the filter's share over all orders."""
    steps = [(
        "".join(FILTERS[k] for k in order), step + 1, 1 << order[step], sum(1 << k for k in order[:step]),
    ) for order in permutations(range(len(FILTERS))) for step in range(len(FILTERS))]
    # a mask has at most 32 values, so a part's counts are one short row
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("__counts"))
    table = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "earlier"), s, strict=True)) for s in steps])), "array<struct<filter_order string, step int, bit int, earlier int>>")
    rows = parts.select("part", "__counts", F.explode(table).alias("s")).select("part", "__counts", "s.*")

    def total(value: str, where: str):
        return F.expr(f"aggregate(filter(__counts, c -> {where}), 0L, (x, c) -> x + {value})")

    removed = "c.mask & bit != 0 and c.mask & earlier = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("c.n", "c.mask & (earlier | bit) = 0").alias("kept"), total("c.n", removed).alias("removed"),
        total("c.n", "c.mask & bit != 0 and c.mask & earlier != 0").alias("redundant"), total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.good", removed).alias("good_lost"), total("c.toxic", removed).alias("toxic_lost"),
        # of all orders, the filter comes first among those that the document fails in one of as many
        total("c.n * (120 div bit_count(c.mask))", "c.mask & bit != 0").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The interaction of the five filters over ``docs``, by ``part``; see :func:`orders`."""
    return orders(stage(counted(masks(docs, part), labels), "mask-counts"))
