"""Exchange of many small keyed numbers between tasks, packed.

Keys are 64-bit hashes; an entry may carry one more 64-bit number.  Each task sorts its (key, document) entries into bins by key and emits one row per
bin with the arrays as bytes; bins are then grouped by an ordinary shuffle.  A key's entries always meet in
one bin, and a bin holds a bounded number of entries on average because the number of bins follows the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries that one bin should hold, and entries that a task gathers before it emits rows.
BIN_ENTRIES, TASK_ENTRIES = 1 << 19, 1 << 19
SCHEMA = "kind int, bin bigint, keys binary, docs binary, notes binary"
_NONE = np.zeros(0, dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def count(entries: int) -> int:
    """Bins for so many entries."""
    return max(1, -(-entries // BIN_ENTRIES))


class Packer:
    """Gathers entries and packs them into rows."""

    def __init__(self, bins: int):
        self.bins = bins
        self.held: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        self.n = 0

    def add(self, kind: int, keys: np.ndarray, doc: int, notes: np.ndarray | None = None) -> None:
        self.held.setdefault(kind, []).append((keys, doc, _NONE if notes is None else notes))
        self.n += len(keys)

    @property
    def full(self) -> bool:
        return self.n >= TASK_ENTRIES

    def rows(self) -> Iterator[pa.RecordBatch]:
        for kind, parts in self.held.items():
            keys = np.concatenate([k for k, _, _ in parts]).astype(np.uint64)
            docs = np.repeat(np.array([d for _, d, _ in parts], dtype=np.int64), [len(k) for k, _, _ in parts])
            notes = np.concatenate([x for _, _, x in parts])
            place = (mix(keys, 77) >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)
            order = np.argsort(place.astype(np.int32 if self.bins > 32767 else np.int16), kind="stable")
            keys, docs = keys[order], docs[order]
            if len(notes):
                notes = notes[order]
            edges = np.searchsorted(place[order], np.arange(self.bins + 1, dtype=np.uint64))
            at = [b for b in range(self.bins) if edges[b] < edges[b + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()),
                pa.array([keys[edges[b]:edges[b + 1]].tobytes() for b in at], pa.binary()), pa.array([docs[edges[b]:edges[b + 1]].tobytes() for b in at], pa.binary()),
                pa.array([notes[edges[b]:edges[b + 1]].tobytes() for b in at], pa.binary()),
            ], names=["kind", "bin", "keys", "docs", "notes"])
        self.held, self.n = {}, 0


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and documents of a bin, each different pair once, sorted."""
    keys = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in table["keys"].to_pylist()])
    docs = np.concatenate([np.frombuffer(d, dtype=np.int64) for d in table["docs"].to_pylist()])
    order = np.argsort(docs, kind="stable")
    order = order[np.argsort(keys[order], kind="stable")]
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def dealt(route: np.ndarray, n: int, columns: list[np.ndarray]) -> list[tuple]:
    """For each of ``n`` bins that ``route`` (64-bit numbers) leads to, its number and its part of each column as bytes."""
    if not len(route):
        return []
    place = (mix(route.astype(np.uint64), 79) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    at, begin = np.unique(place[order], return_index=True)
    columns = [c[order] for c in columns]
    return [(int(b), *(c[x:y].tobytes() for c in columns)) for b, x, y in zip(at.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True)]


def joined(table: pa.Table, **columns: type) -> list[np.ndarray]:
    """The named binary columns of a table, each as one array."""
    return [np.frombuffer(b"".join(table[c].to_pylist()), dtype=d) for c, d in columns.items()]
