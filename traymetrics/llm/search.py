"""Operator 13, ranked lexical search by multi-query common-subexpression evaluation.

Every item is a bag of terms, and a document's score for it is the sum of what its terms contribute.
Items share terms, so the sums share parts. Terms held by exactly the same items are one class, whose
sum over a document is kept once (a partial accumulator). Pairs of accumulators that several items
add are mined and fused, the most shared first, each into a new accumulator that stands for both in
those items. The result is a directed graph: an accumulator is the sum of two earlier ones, an item
the sum of the few that are left to it.

Two passes over the documents: one counts (documents, terms, document frequencies), one evaluates the
graph. A document's accumulators never leave its task; a task gives back the best documents of each
item. Items are taken in blocks of bounded size, each with passes of its own.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from traymetrics.llm.common import back_to_null, id_or_null, land, query, table
from traymetrics.llm.rolling import per_word, slices, span_hashes, words

BLOCK_BYTES = 1 << 20  # of item texts whose terms travel to the tasks at a time
MINED = 16  # widely shared classes of an item looked at for pairs; only the cost depends on it
CELLS = 1 << 22  # accumulators times documents evaluated at a time in a task
BEST = 10
SALTS = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[buf]
    return low, *words(low, bounds, _TERM)


def terms_of(text: str | None) -> set[bytes]:
    """The distinct terms of a text (A-Z lower-cased); null has none."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    low, starts, ends, _ = _spans(buf, np.array([0, len(buf)]))
    data = low.tobytes()
    return {data[a:b] for a, b in zip(starts.tolist(), ends.tolist())}


class Vocabulary:
    """Terms of a block of items; finds them among the words of a slice, compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = ends - [len(t) for t in terms]
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.data, self.hashes, self.starts, self.sizes, self.index = data, hashes[order], starts[order], (ends - starts)[order], order
        self.alike = int(np.unique(hashes, return_counts=True)[1].max()) if terms else 0  # terms of one hash

    def __len__(self) -> int:
        return len(self.index)

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the term each span holds, or -1."""
        found = np.full(len(starts), -1, np.int64)
        if not len(self) or not len(starts):
            return found
        hashes, sizes = span_hashes(low, starts, ends), ends - starts
        first = np.searchsorted(self.hashes, hashes)
        for k in range(self.alike):
            at = np.minimum(first + k, len(self) - 1)
            maybe = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == sizes))
            if not len(maybe):
                continue
            n = sizes[maybe]
            heads = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(heads, n)
            same = low[np.repeat(starts[maybe], n) + inside] == self.data[np.repeat(self.starts[at[maybe]], n) + inside]
            equal = np.logical_and.reduceat(same, heads)
            found[maybe[equal]] = self.index[at[maybe[equal]]]
        return found

    def counts(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences), sorted by row, and the number of all terms of each row."""
        low, starts, ends, first = _spans(buf, bounds)
        term, row = self.find(low, starts, ends), per_word(first)[0]
        known = term >= 0
        pairs, times = np.unique(row[known] * len(self) + term[known], return_counts=True)
        return pairs // max(len(self), 1), pairs % max(len(self), 1), times, np.diff(first)


class SharedSums:
    """The graph of accumulators for items given as sets of terms."""

    def __init__(self, items: list[set[bytes]], mined: int = MINED):
        held: dict[bytes, int] = defaultdict(int)
        for i, terms in enumerate(items):
            for t in terms:
                held[t] |= 1 << i
        self.terms = sorted(held)
        classes = {bits: k for k, bits in enumerate(sorted(set(held.values())))}
        self.class_of = np.array([classes[held[t]] for t in self.terms], np.int64)
        self.classes = len(classes)
        holders = list(classes)
        self.sums: list[tuple[int, int]] = []
        self._fuse(holders, len(items), mined)
        parts: list[list[int]] = [[] for _ in items]
        for node, bits in enumerate(holders):
            while bits:
                low = bits & -bits
                parts[low.bit_length() - 1].append(node)
                bits ^= low
        self.with_parts = np.array([i for i, p in enumerate(parts) if p], np.int64)
        self.parts = np.array([n for p in parts for n in p], np.int64)
        self.part_starts = np.cumsum([0] + [len(p) for p in parts if p])[:-1]

    @property
    def nodes(self) -> int:
        return self.classes + len(self.sums)

    def _fuse(self, holders: list[int], n: int, mined: int) -> None:
        """Fuse the pair that most items share, again and again, until no two items share one."""
        wide: list[list[int]] = [[] for _ in range(n)]
        for node in sorted(range(len(holders)), key=lambda k: -holders[k].bit_count()):
            bits = holders[node] if holders[node].bit_count() > 1 else 0
            while bits:
                low = bits & -bits
                i = low.bit_length() - 1
                if len(wide[i]) < mined:
                    wide[i].append(node)
                bits ^= low
        near: dict[int, set[int]] = defaultdict(set)
        for group in wide:
            for a, b in combinations(sorted(group), 2):
                near[a].add(b)
                near[b].add(a)
        queue = [(-(holders[a] & holders[b]).bit_count(), a, b) for a in near for b in near[a] if a < b]
        queue = [x for x in queue if x[0] < -1]
        heapify(queue)
        while queue:
            claimed, a, b = heappop(queue)
            both = holders[a] & holders[b]
            shared = both.bit_count()
            if shared < 2:
                continue
            if shared < -claimed:
                heappush(queue, (-shared, a, b))
                continue
            node = len(holders)
            holders.append(both)
            holders[a] ^= both
            holders[b] ^= both
            self.sums.append((a, b))
            around = [x for x in (near[a] | near[b]) - {a, b} if (holders[x] & both).bit_count() > 1]
            for x in around:
                near[x].add(node)
                heappush(queue, (-(holders[x] & both).bit_count(), x, node))
            near[node] = set(around)

    def evaluate(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
        """Scores of items (``with_parts``) by documents 0 .. width - 1, from what their terms contribute."""
        held = np.zeros((self.nodes, width), np.int64)
        np.add.at(held, (self.class_of[term], row), value)
        for k, (a, b) in enumerate(self.sums, self.classes):
            np.add(held[a], held[b], out=held[k])
        return np.add.reduceat(held[self.parts], self.part_starts, axis=0)


class _Best:
    """The best documents of each item: greatest score, then least doc_id."""

    def __init__(self, items: int, best: int):
        self.best, self.least = best, np.ones(items, np.int64)
        self.kept = (np.zeros(0, np.int64),) * 3
        self.waiting: list[tuple] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.waiting.append((item, ids[doc], scores[item, doc]))
        self.size += len(item)
        if self.size > 1 << 18:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, doc, score = map(np.concatenate, zip(self.kept, *self.waiting))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.best
        last = place == self.best - 1
        self.least[item[last]] = score[last]
        self.kept, self.waiting, self.size = (item[keep], doc[keep], score[keep]), [], 0
        return self.kept


def _blocks(items: DataFrame, limit: int) -> Iterator[list[Row]]:
    """Items in blocks of about ``limit`` bytes, rows of one item together; one block at a time is on the driver."""
    rows = items.filter("text IS NOT NULL").select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-total // limit) or 1
    if count > 1:
        rows = land(rows.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(count))).repartition("_block"), "items")
    for b in range(count):
        yield (rows.filter(F.col("_block") == b) if count > 1 else rows).orderBy("item_id", "text").collect()


def _corpus(docs: DataFrame, vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and documents that hold each term of the vocabulary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        seen = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for _, _, buf, bounds in slices(batch.column(1)):
                _, term, _, sizes = known.counts(buf, bounds)
                seen[:-2] += np.bincount(term, minlength=len(known))
                seen[-2:] += (sizes > 0).sum(), sizes.sum()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "seen"])

    n = len(vocabulary.value)
    total = np.zeros(n + 2, np.int64)
    for r in docs.mapInArrow(task, "term long, seen long").groupBy("term").agg(F.sum("seen").alias("seen")).collect():  # a row per term of the block
        total[r["term"]] = r["seen"]
    return int(total[-2]), int(total[-1]), total[:-2]


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)


def _search_block(docs: DataFrame, items: list[Row], kind: str, best: int) -> DataFrame:
    """(item_id, rank, doc, score): the best documents of each item of a block, whose ids are of type ``kind``."""
    sc = docs.sparkSession.sparkContext
    terms: dict = defaultdict(set)
    for r in items:
        terms[r["item_id"]] |= terms_of(r["text"])
    names = list(terms)
    graph = SharedSums([terms[i] for i in names])
    if not graph.terms:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc long, score long")
    vocabulary = sc.broadcast(Vocabulary(graph.terms))
    documents, length, holding = _corpus(docs, vocabulary)
    shared = sc.broadcast((graph, weights(documents, holding)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (sums, weight) = vocabulary.value, shared.value
        found = _Best(len(sums.with_parts), best)
        width = max(1, min(512, CELLS // max(sums.nodes, 1)))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, buf, bounds in slices(batch.column(1)):
                row, term, times, sizes = known.counts(buf, bounds)
                m = 100 - 90 + 90 * sizes[row] * documents // max(length, 1)
                value = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m))
                some = np.unique(row)
                for k in range(0, len(some), width):
                    part = some[k : k + width]
                    a, b = np.searchsorted(row, [part[0], part[-1] + 1])
                    found.add(sums.evaluate(np.searchsorted(part, row[a:b]), term[a:b], value[a:b], len(part)), ids[lo + part])
        item, doc, score = found.settle()
        yield pa.RecordBatch.from_arrays([pa.array(sums.with_parts[item]), pa.array(doc), pa.array(score)], ["item", "doc", "score"])

    found = docs.mapInArrow(task, "item long, doc long, score long").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = [F.desc("score"), F.col("doc")]
    for keys in (["item", "_salt"], ["item"]):  # tasks give the best of each item; groups of tasks first
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
    numbered = docs.sparkSession.createDataFrame(list(enumerate(names)), f"item long, item_id {kind}")
    return found.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc", "score")  # numbered: at most a block


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``best`` documents with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns don't matter. A null or
    empty text has no terms: such a document is found by nothing and not counted, such an item finds
    nothing. Rows that share an item_id, null included, are one item with the terms of all. Repeated
    rows of a document are documents of their own; equal scores go by doc_id, null first.
    """
    slim = docs.select(id_or_null().alias("doc"), F.col("text").alias("text"))
    out = None
    kind = items.schema["item_id"].dataType.simpleString()
    for block in _blocks(items, block_bytes):
        part = land(_search_block(slim, block, kind, best), "found")  # one block's terms at a time in the tasks
        out = part if out is None else out.union(part)
    return out.select("item_id", "rank", back_to_null("doc").alias("doc_id"), "score")


_SQL_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    "op13_search",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SQL_TERMS}') AS w FROM documents),
    sizes AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
    t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SQL_TERMS}')) AS term FROM benchmark),
    weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, total GROUP BY term),
    s AS (SELECT i.item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // l))))) AS BIGINT) AS score
        FROM i JOIN t USING (term) JOIN weight USING (term) JOIN sizes USING (r), total GROUP BY ALL),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM ranked WHERE k <= 10
    """,
)
def op13_search(spark, folder):
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark").select("item_id", "text"))
