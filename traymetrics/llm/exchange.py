"""Which keys occur more than once? A shuffle of packed keys that answers per document.

Tasks turn documents into keys (hashes of windows or anchors). The keys of a stretch of documents
travel packed, a few bytes each, one row per bucket of the key space; a bucket task finds the repeated
keys and answers with them for each document. A key that repeats inside a stretch is answered there
at once and travels a single time, so a passage in a third of all documents adds one key per stretch
to its bucket, and buckets stay even.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traymetrics.llm.rolling import mix

STRETCH = 2_000_000  # keys gathered before they are packed
BUCKET_KEYS = 1_500_000  # keys a bucket is meant to hold

_MARK, _MULTI = np.uint64(1), np.uint64(2)  # the two low bits of a key's first word
_TWO = np.uint64(2)

_PACKED = "bucket int, docs binary, counts binary, keys binary, shared binary"


def trim(keys: np.ndarray, width: int) -> np.ndarray:
    """The bits of a first word that travel in ``width`` bytes, flags cleared."""
    keep = (1 << (8 * min(width, 8))) - 4
    return keys & np.uint64(keep)


def _pack(first: np.ndarray, second: np.ndarray | None, width: int) -> np.ndarray:
    """(n, width) bytes."""
    head = first.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : min(width, 8)]
    if second is None:
        return head
    return np.concatenate([head, second.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width - 8]], 1)


def unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    words = np.zeros((len(raw), 16), np.uint8)
    words[:, : min(width, 8)] = raw[:, :8]
    if width > 8:
        words[:, 8:width] = raw[:, 8:]
    words = words.view("<u8")
    return words[:, 0].copy(), words[:, 1].copy() if width > 8 else None


def _sorted_groups(first: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys and, along it, where a new key begins; flags don't matter."""
    bare = first >> _TWO
    order = np.argsort(bare, kind="stable") if second is None else np.lexsort((second, bare))
    bare = bare[order]
    new = np.ones(len(order), bool)
    new[1:] = bare[1:] != bare[:-1]
    if second is not None:
        second = second[order]
        new[1:] |= second[1:] != second[:-1]
    return order, new


def _buckets(first: np.ndarray, count: int) -> np.ndarray:
    return ((first >> np.uint64(10)) % np.uint64(count)).astype(np.int64)


def _rows(bucket: np.ndarray, doc: np.ndarray, ids: np.ndarray, packed: np.ndarray, shared: np.ndarray, shared_bucket: np.ndarray) -> pa.RecordBatch:
    """Exchange rows: per bucket the keys in document order, with documents and how many keys each has."""
    order = np.lexsort((doc, bucket))
    bucket, doc, packed = bucket[order], doc[order], packed[order]
    by_shared = np.argsort(shared_bucket, kind="stable")
    shared, shared_bucket = shared[by_shared], shared_bucket[by_shared]
    out: list[list] = [[], [], [], [], []]
    for b in np.union1d(bucket, shared_bucket):
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        slo, shi = np.searchsorted(shared_bucket, [b, b + 1])
        mine, counts = np.unique(doc[lo:hi], return_counts=True)
        values = (int(b), ids[mine].tobytes(), counts.astype(np.int32).tobytes(), packed[lo:hi].tobytes(), shared[slo:shi].tobytes())
        for column, value in zip(out, values):
            column.append(value)
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["bucket", "docs", "counts", "keys", "shared"])


class _Stretch:
    """Keys of a stretch of documents."""

    def __init__(self, width: int, buckets: int, once_per_doc: bool):
        self.width, self.buckets, self.once = width, buckets, once_per_doc
        self.turn = 0
        self.clear()

    def clear(self):
        self.size, self.first, self.second, self.doc, self.ids = 0, [], [], [], []

    def add(self, ids: np.ndarray, doc: np.ndarray, first: np.ndarray, second: np.ndarray | None, mark: np.ndarray | None):
        """``doc`` says for each key which of ``ids`` it comes from."""
        first = trim(first, self.width)
        self.first.append(first if mark is None else first | mark.astype(np.uint64))
        self.second.append(second)
        self.doc.append(doc + sum(map(len, self.ids)))
        self.ids.append(ids)
        self.size += len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.clear()
            return
        first, doc, ids = np.concatenate(self.first), np.concatenate(self.doc), np.concatenate(self.ids)
        second = None if self.second[0] is None else np.concatenate(self.second)
        self.clear()
        order, new = _sorted_groups(first, second)
        first, doc = first[order], doc[order]
        second = None if second is None else second[order]
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        marked = np.bitwise_or.reduceat(first & _MARK, heads)
        counts = np.diff(np.append(heads, len(first)))
        if self.once:  # how many documents, not how many places
            lowest, highest = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
            multi = lowest != highest
        else:
            multi = counts > 1
        keys = (first[heads] & ~_MARK) | marked
        key2 = None if second is None else second[heads]
        single = ~multi
        alone = _pack(keys[single], None if key2 is None else key2[single], self.width)
        common = _pack(keys[multi] | _MULTI, None if key2 is None else key2[multi], self.width)
        yield _rows(_buckets(keys[single], self.buckets), doc[heads[single]], ids, alone, common, _buckets(keys[multi], self.buckets))
        local = multi[group]
        if local.any():  # answered here; the row only passes through
            pair = np.unique(group[local] * np.int64(len(ids)) + doc[local])
            g, d = pair // len(ids), pair % len(ids)
            self.turn += 1
            answered = _pack(keys[g], None if key2 is None else key2[g], self.width)
            aside = np.full(len(g), -1 - (self.turn * 7919 + int(keys[0] >> np.uint64(20)) % 7919) % 100_003)
            yield _rows(aside, d, ids, answered, answered[:0], aside[:0])


def _answers(rows: pa.Table, width: int, need_mark: bool, count: int) -> pa.Table:
    """The repeated keys of one bucket, packed for each of ``count`` parts of the documents."""
    columns = [rows.column(c).to_pylist() for c in ("docs", "counts", "keys", "shared")]
    if rows.column("bucket")[0].as_py() < 0:
        first = second = None
    else:
        both = b"".join(columns[2]) + b"".join(columns[3])
        first, second = unpack(both, width)
        order, new = _sorted_groups(first, second)
        heads = np.flatnonzero(new)
        flags = np.bitwise_or.reduceat(first[order] & np.uint64(3), heads) if len(heads) else np.zeros(0, np.uint64)
        repeated = (np.diff(np.append(heads, len(first))) > 1) | (flags & _MULTI > 0)
        if need_mark:
            repeated &= flags & _MARK > 0
        hit = np.zeros(len(first), bool)
        hit[order] = repeated[np.cumsum(new) - 1]
    ids, sizes, parts, at = [], [], [], 0
    for docs, counts, keys, _ in zip(*columns):
        packed = np.frombuffer(keys, np.uint8).reshape(-1, width)
        counts = np.frombuffer(counts, np.int32).astype(np.int64)
        mine = np.ones(len(packed), bool) if first is None else hit[at : at + len(packed)]
        at += len(packed)
        per_doc = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=mine, minlength=len(counts)).astype(np.int64)
        some = per_doc > 0
        ids.append(np.frombuffer(docs, np.int64)[some])
        sizes.append(per_doc[some])
        parts.append(packed[mine].tobytes())
    docs, sizes = _flat(ids, np.int64), _flat(sizes, np.int64)
    keys = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    part = (mix(docs.astype(np.uint64)) % np.uint64(count)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys = keys[np.argsort(np.repeat(part, sizes), kind="stable")]
    docs, sizes, part = docs[order], sizes[order], part[order]
    out: list[list] = [[], [], [], []]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for p in np.unique(part):
        lo, hi = np.searchsorted(part, [p, p + 1])
        for column, value in zip(out, (int(p), docs[lo:hi].tobytes(), sizes[lo:hi].tobytes(), keys[ends[lo] : ends[hi]].tobytes())):
            column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(out, [pa.int32(), *[pa.binary()] * 3])], ["part", "docs", "counts", "keys"])


def _flat(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _documents(rows: pa.Table, width: int) -> pa.Table:
    """(doc_id, keys), one row for each document of a part."""
    docs, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("docs", "counts"))
    keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint8).reshape(-1, width)
    ids, which = np.unique(docs, return_inverse=True)
    keys = keys[np.argsort(np.repeat(which, counts), kind="stable")]
    sizes = np.bincount(which, weights=counts, minlength=len(ids)).astype(np.int64) * width
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    column = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "keys": column})


Keys = tuple[np.ndarray, np.ndarray, np.ndarray, "np.ndarray | None", "np.ndarray | None"]


def repeated_keys(docs: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[Keys]], width: int, keys: int, once_per_doc: bool = False, need_mark: bool = False) -> DataFrame:
    """(doc_id, keys): for each document that has some, its packed keys that occur again.

    ``keys_of`` gives (doc ids, index into them for each key, first words, second words, marks) of
    pieces of a batch. ``keys`` is about how many there are. ``once_per_doc`` counts documents
    instead of places. ``need_mark`` asks that a key be marked in one place at least; keys repeated
    inside a stretch are answered without, so the answer may hold a little more.
    """
    buckets = max(1, -(-keys // BUCKET_KEYS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch = _Stretch(width, buckets, once_per_doc)
        for batch in batches:
            for piece in keys_of(batch):
                stretch.add(*piece)
                if stretch.size >= STRETCH:
                    yield from stretch.flush()
        yield from stretch.flush()

    packed = docs.mapInArrow(task, _PACKED)
    answers = packed.groupBy("bucket").applyInArrow(lambda rows: _answers(rows, width, need_mark, buckets), "part int, docs binary, counts binary, keys binary")
    return answers.groupBy("part").applyInArrow(lambda rows: _documents(rows, width), "doc_id long, keys binary")


def known_keys(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """All keys in a column of packed keys, sorted by first word, flags cleared."""
    first, second = unpack(b"".join(x for x in column.to_pylist() if x), width)
    first &= ~np.uint64(3)
    order = np.argsort(first) if second is None else np.lexsort((second, first))
    return first[order], None if second is None else second[order]


def among(first: np.ndarray, second: np.ndarray | None, known: tuple[np.ndarray, np.ndarray | None]) -> np.ndarray:
    """Which keys (trimmed) are among the known."""
    if not len(known[0]) or not len(first):
        return np.zeros(len(first), bool)
    if second is None:
        at = np.minimum(np.searchsorted(known[0], first), len(known[0]) - 1)
        return known[0][at] == first
    both = np.concatenate([known[0], first]), np.concatenate([known[1], second])
    order = np.lexsort((both[1], both[0]))
    a, b = both[0][order], both[1][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    has = np.zeros(group[-1] + 1, bool)
    has[group[order < len(known[0])]] = True
    out = np.zeros(len(order), bool)
    out[order] = has[group]
    return out[len(known[0]) :]
