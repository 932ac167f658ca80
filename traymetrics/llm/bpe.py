"""Operator 2, byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes the words of a slice of its part of the corpus that it has not met yet, lays their bytes
out as one chain of symbols, and keeps an inverted index from rank to the places whose pair has that rank. The ranks are
replayed in order; each merge touches only its two neighbours and enters their new pairs in the
index. Words repeat, so what a task has replayed is remembered; its ids then stand for every occurrence.
Words do not influence one another, so parts of the corpus need no exchange.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import query, table
from traymetrics.llm.rolling import slices

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
CACHED_WORDS = 500_000  # words a Python worker remembers (about 100 MB); only speed depends on it
CACHED_LENGTH = 64
_SHIFT = 24  # ids are below 2**24


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank; the file has a few megabytes at most and is read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {r: t for t, r in ranks.items()}
        self.letters = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << _SHIFT | b] = rank
        self.known: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (packed, four bytes each), all merges replayed together in rank order."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum([len(w) for w in words])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        # the index of the bytes' own pairs: places sorted by rank
        rank = np.where(after >= 0, self.byte_pairs[data, data[np.maximum(after, 0)]], -1)
        places_by_rank = np.argsort(rank, kind="stable")
        found, starts = np.unique(rank[places_by_rank], return_index=True)
        index = {r: p.tolist() for r, p in zip(found.tolist(), np.split(places_by_rank, starts[1:]))}
        index.pop(-1, None)
        symbols, after, before = self.letters[data].tolist(), after.tolist(), before.tolist()
        self._merge(symbols, after, before, index)
        ids = np.array(symbols)
        alive = ids >= 0
        packed = ids[alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [packed[x:y] for x, y in zip([0, *stops], stops)]

    def _merge(self, symbols: list[int], after: list[int], before: list[int], index: dict[int, list[int]]) -> None:
        """Apply every merge; a symbol that was merged into its left neighbour becomes -1."""
        rank_of = self.pairs.get
        order = list(index)
        heapify(order)
        while order:
            rank = heappop(order)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for done, i in enumerate(places, 1):
                j = after[i]
                if j < 0 or rank_of(symbols[i] << _SHIFT | symbols[j]) != rank:
                    continue  # an earlier merge took one of the two
                k, p, least = after[j], before[i], rank
                symbols[i], symbols[j], after[i] = rank, -1, k
                if p >= 0:
                    new = rank_of(symbols[p] << _SHIFT | rank)
                    if new is not None:
                        if new < least:
                            least = new
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(order, new)
                if k >= 0:
                    before[k] = i
                    new = rank_of(rank << _SHIFT | symbols[k])
                    if new is not None:
                        if new < least:
                            least = new
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heappush(order, new)
                if least < rank:  # a lower rank appeared: it goes first, the other places wait
                    index[rank] = places[done:]
                    heappush(order, rank)
                    break

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed in four bytes each (little-endian)."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, split = self.known, self.split
        parts = [split(text) for text in texts]
        new = [w for w in set().union(*parts) if w not in known] if parts else []
        todo = []
        for w in new:
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                todo.append((w, raw))
            else:
                known[w] = rank.to_bytes(4, "little")
        known.update(zip((w for w, _ in todo), self.replay([raw for _, raw in todo])))
        out = [b"".join(map(known.__getitem__, p)) for p in parts]
        for w in new:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _share(docs: DataFrame, path: str | None):
    """The table of ranks as a broadcast, with a name that only an equal table has."""
    ranks = read_ranks(path or public_tokenizers.path(RANK_FILE))
    name = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        name.update(len(token).to_bytes(4, "little") + token + rank.to_bytes(4, "little"))
    return docs.sparkSession.sparkContext.broadcast((name.hexdigest(), ranks))


def _codec(shared, pattern: str) -> Codec:
    """One codec per Python worker; another table or pattern replaces it."""
    table, ranks = shared.value
    if (table, pattern) not in _codecs:
        _codecs.clear()
        _codecs[table, pattern] = Codec(ranks, pattern)
    return _codecs[table, pattern]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    values = batch.column(batch.schema.get_field_index(column))
    for lo, hi, _, _ in slices(values):
        yield lo, hi, [t or "" for t in values.slice(lo, hi - lo).to_pylist()]


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids", checked: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int): the ids of the text, null counting as empty.

    A column of that name in ``docs`` is replaced. No special tokens; one text may have any length.
    ``checked`` names a further column: whether the ids decode to the text's bytes.
    """
    shared = _share(docs, ranks_path)
    added = {ids: F.lit(None).cast("array<int>")} | ({checked: F.lit(None).cast("boolean")} if checked else {})
    docs, names = docs.drop(*added), list(added)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for lo, hi, texts in _texts(batch, text):
                rows = batch.slice(lo, hi - lo)
                coded = codec.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(a) // 4 for a in coded])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                columns = [*rows.columns, column]
                if checked:
                    columns.append(pa.array([codec.decode(a) == t.encode() for a, t in zip(coded, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names, *names])

    return docs.mapInArrow(task, docs.withColumns(added).schema)


def decode(coded: DataFrame, ranks_path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with a binary column: the bytes the ids stand for (null ids: no bytes)."""
    shared = _share(coded, ranks_path)
    coded = coded.drop(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r: t for t, r in shared.value[1].items()}
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids))
            column = pa.array((b"".join(map(tokens.__getitem__, r.as_py() or ())) for r in rows), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return coded.mapInArrow(task, coded.select("*", F.lit(None).cast("binary").alias(out)).schema)


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256, encoded and decoded in one pass."""
    shared = _share(docs, ranks_path)
    docs = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for lo, hi, texts in _texts(batch, "_text"):
                coded = codec.encode(texts)
                columns = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(a) // 4 for a in coded], pa.int64()),
                    pa.array([hashlib.sha256(a).hexdigest() for a in coded], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(a)).hexdigest() for a in coded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(task, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op2_byte_bpe")
def op2_byte_bpe(spark, folder):
    return round_trip(table(spark, folder, "documents"))
