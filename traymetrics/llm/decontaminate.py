"""Operator 3, benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words. Of the hashes of K consecutive words, the least in
each stretch of W is kept as a fingerprint, for the benchmark and for the documents. A shared run of
K + W - 1 = 10 words always shares a fingerprint. Fingerprints of documents that the benchmark has
too are extended: every window of ten words around the hit is looked up among the benchmark's
windows and compared word by word. An item of fewer words is one window; for its length every run of
that many words is a fingerprint, which is winnowing with a stretch of one.

The benchmark is used in blocks of bounded size, each broadcast once while all documents pass by;
documents never move, so neither a hot source nor a passage in every document makes a large task.
What travels of a block is its text, the bounds of its words, and for each length the sorted hashes
of its windows with their places, about five bytes for each byte of text. One block is in use at a
time: between blocks the marked documents are landed.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from traymetrics.llm.common import drop_landed, land, query, table
from traymetrics.llm.rolling import covered, gram_hashes, per_word, runs, slices, sliding_min, span_hashes, words

WINDOW = 10
K = 5
BLOCK_BYTES = 16 << 20  # of benchmark text in one broadcast

_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _windows(text: list[bytes], size: int) -> list[bytes]:
    n = min(size, len(text))
    return [b" ".join(text[i : i + n]) for i in range(len(text) - n + 1)] if n else []


class _Words:
    """Words of a slice of texts with their hashes."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf = _LOWER[buf]
        self.starts, self.ends, self.first = words(self.buf, bounds, _WORD)
        self.row, self.row_end = per_word(self.first)
        self.hashes = span_hashes(self.buf, self.starts, self.ends)
        self.bytes = self.buf.tobytes()

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose n words lie in one text, and the hash there."""
        hashes = gram_hashes(self.hashes, n)
        places = np.flatnonzero(np.arange(len(hashes)) + n <= self.row_end[: len(hashes)])
        return places, hashes[places]

    def fingerprints(self, window: int, k: int) -> np.ndarray:
        """Places of the least hash of k words in each stretch of window - k + 1, rightmost on ties."""
        w = window - k + 1
        hashes = gram_hashes(self.hashes, k)
        back = np.arange(len(hashes))[::-1].astype(np.uint64)
        bits = np.uint64(max(1, len(hashes)).bit_length())
        least = sliding_min((hashes >> bits << bits) | back, w)  # the place sits in the low bits
        inside = np.flatnonzero(np.arange(len(least)) + window <= self.row_end[: len(least)])
        chosen = least[inside] & ((np.uint64(1) << bits) - np.uint64(1))
        return np.unique(len(hashes) - 1 - chosen.astype(np.int64))

    def text(self, place: int, n: int) -> bytes:
        return b" ".join(self.bytes[s:e] for s, e in zip(self.starts[place : place + n], self.ends[place : place + n]))


def _place_bits(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which x are among the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == x


class _Index:
    """Words, places of windows by their sorted hashes, and fingerprints of one block of the benchmark."""

    def __init__(self, items: list[Row], window: int, k: int):
        self.window, self.k, self.ids = window, k, [r["item_id"] for r in items]
        column = pa.array([r["text"] or "" for r in items], pa.string())
        none = np.zeros(0, np.int64)
        starts, ends, owners, texts, marks, grams = [none], [none], [none], [], [np.zeros(0, np.uint64)], defaultdict(list)
        n_words = n_bytes = 0
        for lo, _, buf, bounds in slices(column):
            w = _Words(buf, bounds)
            counts = np.diff(w.first)
            fingerprints = w.fingerprints(window, k)
            if len(fingerprints):
                marks.append(gram_hashes(w.hashes, k)[fingerprints])
            at, hashes = w.grams(window)
            grams[window].append((hashes, at + n_words))
            for d in np.flatnonzero((counts > 0) & (counts < window)):
                n = int(counts[d])
                grams[n].append((gram_hashes(w.hashes[w.first[d] : w.first[d + 1]], n), np.array([w.first[d] + n_words])))
            starts.append(w.starts + n_bytes)
            ends.append(w.ends + n_bytes)
            owners.append(w.row + lo)
            texts.append(w.bytes)
            n_words, n_bytes = n_words + len(w.starts), n_bytes + len(w.bytes)
        self.starts, self.ends, self.owner = (np.concatenate(x).astype(np.int32) for x in (starts, ends, owners))
        self.bytes, self.marks = b"".join(texts), np.unique(np.concatenate(marks))
        self.by_length = {n: self._sorted(n, *map(np.concatenate, zip(*parts))) for n, parts in grams.items() if sum(len(h) for h, _ in parts)}

    def _sorted(self, n: int, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order and their places; of equal windows of one item the first."""
        order = np.lexsort((places, self.owner[places], hashes))
        hashes, places = hashes[order], places[order].astype(np.int32)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (self.owner[places[1:]] == self.owner[places[:-1]])
        for i in np.flatnonzero(again):
            again[i] = self.text(places[i], n) == self.text(places[i - 1], n)
        return hashes[~again], places[~again]

    def text(self, place: int, n: int) -> bytes:
        return b" ".join(self.bytes[s:e] for s, e in zip(self.starts[place : place + n], self.ends[place : place + n]))

    def hits(self, w: _Words) -> Iterator[tuple[int, int, set]]:
        """(word place, words, items) of every window that occurs in the texts."""
        seen: dict[tuple[int, bytes], set] = {}
        for n, (known, at) in self.by_length.items():
            if n == self.window:
                marks = w.fingerprints(self.window, self.k)
                if not len(marks):
                    continue
                marks = marks[_place_bits(gram_hashes(w.hashes, self.k)[marks], self.marks)]
                around = (marks[:, None] - np.arange(self.window - self.k + 1)[None, :]).ravel()
                around = np.unique(around[around >= 0])
                hashes = gram_hashes(w.hashes, n)
                around = around[around < len(hashes)]
                around = around[around + n <= w.row_end[around]]
                places = around[_place_bits(hashes[around], known)]
            else:
                places, _ = w.grams(n)
                hashes = gram_hashes(w.hashes, n)
                places = places[_place_bits(hashes[places], known)]
            lows, highs = (np.searchsorted(known, hashes[places], side) for side in ("left", "right"))
            for p, lo, hi in zip(places.tolist(), lows.tolist(), highs.tolist()):
                words_here = w.text(p, n)
                found = seen.get((n, words_here))
                if found is None:
                    found = seen[n, words_here] = {self.ids[self.owner[q]] for q in at[lo:hi] if self.text(q, n) == words_here}
                if found:
                    yield p, n, found


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[Row]]:
    """The benchmark in blocks of about ``limit`` bytes; one block at a time is on the driver."""
    rows = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-total // limit) or 1
    if count == 1:
        yield rows.collect()
        return
    rows = land(rows.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count))).repartition("_block"), "items")
    for b in range(count):
        yield rows.filter(F.col("_block") == b).drop("_block").collect()


_SPANS, _ITEMS, _COUNT = "_hit_spans", "_hit_items", "_word_count"


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``_word_count``, ``_hit_spans`` (first and end word, flat) and ``_hit_items``.

    A null text has no words; an item without words or with a null text has no window; an item with
    a null id marks words but is not listed. Items that share an id count once.
    """
    docs = docs.drop(_SPANS, _ITEMS, _COUNT)
    extra = {_COUNT: F.lit(0).cast("long"), _SPANS: F.array().cast("array<int>"), _ITEMS: F.array().cast("array<string>")}
    out = docs.withColumns(extra)
    schema = out.schema
    before = None
    for number, items in enumerate(_blocks(benchmark, block_bytes)):
        if number:
            out, last = land(out, "marked"), before
            before = out
            if last is not None:
                drop_landed(last)
        shared = docs.sparkSession.sparkContext.broadcast(_Index(items, window, k))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for lo, hi, buf, bounds in slices(columns[text]):
                    rows = {n: c.slice(lo, hi - lo) for n, c in columns.items()}
                    w = _Words(buf, bounds)
                    spans: list[list] = [[] for _ in range(hi - lo)]
                    listed: list[set] = [set() for _ in range(hi - lo)]
                    for place, n, found in index.hits(w):
                        d = w.row[place]
                        spans[d].append((place - w.first[d], n))
                        listed[d] |= found
                    counts = np.diff(w.first)
                    old_spans, old_items = rows[_SPANS].to_pylist(), rows[_ITEMS].to_pylist()
                    for d in range(hi - lo):
                        if not spans[d]:
                            spans[d], listed[d] = old_spans[d], old_items[d]
                            continue
                        pairs = [(a, b - a) for a, b in zip(old_spans[d][::2], old_spans[d][1::2])] + spans[d]
                        hit = np.zeros(counts[d], bool)
                        for length in {n for _, n in pairs}:
                            hit |= covered(counts[d], np.array([a for a, n in pairs if n == length]), length)
                        spans[d] = np.stack(runs(hit), 1).ravel().tolist()
                        listed[d] = sorted({str(i) for i in listed[d] if i is not None} | set(old_items[d]))
                    rows |= {_COUNT: pa.array(counts, pa.int64()), _SPANS: pa.array(spans, pa.list_(pa.int32())), _ITEMS: pa.array(listed, pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))

        out = out.mapInArrow(task, schema)
    return out


def hit_words():
    """Words inside the spans, as a column."""
    return F.aggregate(F.transform(_SPANS, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


_SQL_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op3_decontaminate",
    rf"""
    WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    dw AS (SELECT doc_id, regexp_extract_all(t, '{_SQL_WORDS}') AS w FROM low),
    iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SQL_WORDS}') AS w FROM benchmark),
    iwin AS (SELECT item_id, least(10, len(w)) AS n, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS g FROM iw WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM iwin),
    dwin AS (SELECT doc_id, n, unnest([{{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}} FOR i IN range(1, len(w) - n + 2)]) AS s FROM dw, sizes WHERE len(w) >= n),
    hit AS (SELECT doc_id, s.i AS i, n, item_id FROM dwin JOIN (SELECT DISTINCT item_id, n, g FROM iwin) USING (n) WHERE s.g = g),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op3_decontaminate(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, table(spark, folder, "benchmark"))
    hits = marked.select("doc_id", F.col(_COUNT).alias("n_words"), hit_words().alias("n_hit"), F.size(_ITEMS).cast("long").alias("n_items"), F.sha2(F.array_join(_ITEMS, ","), 256).alias("items_sha256"))
    return hits.withColumn("contaminated", F.col("n_hit") > 0)
