"""Hierarchical best-fit packing of token sequences.

Texts become token ids and an end id; a document longer than a sequence is cut into whole sequences,
its first piece taking what is left over.  Pieces are packed where they are made: each task packs blocks
of pieces best-fit, largest first.  Sequences that are (nearly) full are final.  The pieces of all others
are items of the next level, where the leftovers of all tasks meet in groups and are packed again; a
level's underfull sequences become items of the next, in ``fan_in`` times fewer groups, until one is left.

Sizes.  A level has at least a group for every ``BLOCK_PIECES`` items and deals them by a hash with a salt
of its own, so a group's memory is bounded, every group mixes sizes of all tasks and no leftover is held
back.  After best-fit no two leftovers of a group fit together, so at most one is half full or less.  More
items than one group holds are dealt anew while that makes at least a thousandth fewer sequences; a level
that makes none fewer isn't taken.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an
empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlift.llm.common import slices, small_batches
from ledgerlift.session import stage

LENGTH, END_ID = 1024, 2
#: Pieces packed together; words whose ids a worker remembers; bytes of text encoded together.
BLOCK_PIECES, REMEMBERED, SLICE_BYTES = 200_000, 250_000, 8 << 20
#: Fixed: the words and signs a byte-level vocabulary of this family is merged within.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, place bigint"


def _unit_bytes() -> dict[str, int]:
    """The printable sign a byte-level vocabulary writes for each byte, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    Where white space is single spaces and line feeds between other characters, no token of a
    byte-level vocabulary crosses it except a word's leading space; such texts are encoded word by word
    and words are remembered.  All other texts are encoded whole, by the file's own tokenizer.  New words
    are merged by rank from the same file's vocabulary, which gives the same ids several times faster
    where ids follow the order of merges (checked when the file is read).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary, units = told["model"]["vocab"], _unit_bytes()
        self.special = [t["content"] for t in told["added_tokens"]]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
        order = [vocabulary[m] for m in merged]
        ranks = {bytes(units[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        self.merger = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if order == sorted(order) else None
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        #: ids of " word", or of "\\nword" for a line's first; None for words that must not be encoded alone
        self.known: dict[bytes, bytes | None] = {}
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Remembers new words; each occurs once in ``words``."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        together = [w for w in words if w[:1] != b"\n"]
        text = (b" " + b" ".join(together)).decode()
        if self.merger is None or not text.isprintable() or b"" in together or any(t in text for t in self.special):
            alone, together = words, []
        else:
            alone = [w for w in words if w[:1] == b"\n"]
        for w in alone:
            head = w[:1] == b"\n"
            plain = w[head:].decode()
            if not plain or not plain.isprintable():  # it has white space of its own
                self.known[w] = None
            elif self.merger is None or any(t in plain for t in self.special):
                self.known[w] = self.feed + self.whole(plain) if head else self.whole(" " + plain)
            else:
                self.known[w] = (self.feed if head else b"") + array("I", self.merger.encode_ordinary(plain if head else " " + plain)).tobytes()
        if together:
            ids = np.array(self.merger.encode_ordinary(text), dtype=np.uint32)
            size = np.fromiter(map(len, together), dtype=np.int64, count=len(together)) + 1
            ends = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(size)) + 1)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(together, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def __call__(self, raws: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an array of binary values."""
        plain = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(b""), pc.fill_null(raws, b""), b"\n"), b"\n", b" \n")
        split = pc.split_pattern(plain, b" ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in words if w and w not in self.known]:
            self._learn(new)
        self.known[b""] = None
        found = list(map(self.known.get, words))
        if missing := [w for w, f in zip(words, found, strict=True) if f is None and w and w not in self.known]:
            self._learn(missing)  # the memory was cleared meanwhile
            found = list(map(self.known.get, words))
        bad = np.array([f is None for f in found], dtype=bool)
        size = np.array([len(f) // 4 if f else 0 for f in found], dtype=np.int64)
        begin = np.cumsum(size) - size
        pool = np.frombuffer(b"".join([f for f in found if f]), dtype=np.uint32)
        index = coded.indices.to_numpy()
        skip = len(self.feed)
        for k, raw in enumerate(raws):
            own = index[offsets[k] + 1:offsets[k + 1]]  # the first is the empty word before the text
            if not raw.is_valid or not len(raw.as_buffer() or b""):
                yield b""
            elif bad[own].any():
                yield self.whole(raw.as_py().decode())
            else:
                n = size[own]
                ends = np.cumsum(n)
                yield pool[np.repeat(begin[own] - ends + n, n) + np.arange(ends[-1])].tobytes()[skip:]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks."""
    return Encoder(path)


def cut(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of one document's ids."""
    n = len(ids) // 4
    first = n % length or min(n, length)
    edges = [0, *range(first, n + 1, length)]
    return [(a, b - a, zlib.crc32(ids[4 * a:4 * b])) for a, b in zip(edges, edges[1:], strict=False)]


def best_fit(sizes: list[int], length: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    """Bin and place of each item, largest first into the fullest bin it fits; and the fill of each bin."""
    bins, places = [0] * len(sizes), [0] * len(sizes)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms: list[int] = []  # rooms that some bin has, in order
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            b, room = len(fills), length
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins, places, fills


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, spare: int = 8, fan_in: int = 16) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            nonlocal made, held
            bins, places, fills = best_fit([h[3] for h in held], length)
            base = (part << 32) + made
            made += len(fills)
            columns = list(zip(*held, strict=True))
            held = []
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([base + b for b in bins], pa.int64()), pa.array(places, pa.int64())], names=names)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            raws = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            for first, last in slices(raws, SLICE_BYTES):
                for doc_id, coded in zip(ids[first:last], encode(raws[first:last]), strict=True):
                    held += [(doc_id, k, *p) for k, p in enumerate(cut(coded + end, length))]
                    if len(held) >= BLOCK_PIECES:
                        yield emit()
        if held:
            yield emit()

    names = StructType.fromDDL(_PIECE).names
    placed = stage(small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pieces, _PIECE), "pieces")
    moves = _levels(placed, length, spare, fan_in)
    return placed.join(moves, ["bin", "place"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"), F.coalesce("at", "place").cast("bigint").alias("offset"),
    )


def _levels(placed: DataFrame, length: int, spare: int, fan_in: int) -> DataFrame:
    """(bin, place, sequence, at): where the pieces go that the higher levels of the packing take."""
    underfull = placed.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < length - spare).select("bin")
    items = stage(placed.select("bin", "place", "length", F.col("bin").alias("sequence"), F.col("place").alias("at")).join(underfull, "bin"), "leftovers")
    moves = items.limit(0)
    groups = (placed.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0) + 1  # a task's own number stands in the upper half of a bin's
    for salt in count():
        # each sequence has one piece at 0
        n, before = items.agg(F.count("*"), F.count_if(F.col("at") == 0)).first()
        if not n:
            break
        least = -(-n // BLOCK_PIECES)
        groups = max(-(-groups // fan_in), least)
        level = stage(_level(items.withColumn("grp", F.pmod(F.xxhash64("bin", "place", F.lit(salt)), F.lit(groups))), length, spare), "leftovers")
        after = level.where("at = 0").count()
        if after < before:
            moves = moves.unionByName(level.where("not carried").drop("carried"))
            items = level.where("carried").drop("carried")
        if groups == 1 or groups == least and 1000 * (before - after) < before:
            break
    return stage(moves.unionByName(items).select("bin", "place", "sequence", "at"), "moves")


def _level(items: DataFrame, length: int, spare: int) -> DataFrame:
    """One level over pieces (grp, bin, place, length): their sequence and place there, and whether that is handed on.

    New sequences have negative numbers, made from their first piece, so they are unique whatever tasks do.
    """

    def place(key, table):
        table = table.sort_by([("bin", "ascending"), ("place", "ascending")])
        own, old = table["bin"].to_pylist(), table["place"].to_pylist()
        bins, places, fills = best_fit(table["length"].to_pylist(), length)
        names: dict[int, int] = {}
        for b, n, at in zip(bins, own, old, strict=True):
            names.setdefault(b, -(n * length + at) - 1)
        return pa.table({
            "bin": table["bin"], "place": table["place"], "length": table["length"], "sequence": pa.array([names[b] for b in bins], pa.int64()),
            "at": pa.array(places, pa.int64()), "carried": pa.array([length - fills[b] > spare for b in bins], pa.bool_()),
        })

    schema = "bin bigint, place bigint, length bigint, sequence bigint, at bigint, carried boolean"
    return items.select("grp", "bin", "place", "length").groupBy("grp").applyInArrow(place, schema)
