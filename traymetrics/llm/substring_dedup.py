"""Operator 5, substring dedup by fixed-block anchors.

Every document is cut into blocks of B words that do not overlap; they are the index. All rolling
windows of B words are probes. With 2 B - 1 words or more a repeat holds a whole block of either
document, so one of its probes hits a block elsewhere. A hit is extended: the windows of full length
around it are compared, by 126-bit hashes of their words, with those around all other hits; a run of
repeated windows is a maximal exact repeat, and its words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import back_to_null, id_or_null, land, query, table
from traymetrics.llm.exchange import among, known_keys, repeated_keys, trim
from traymetrics.llm.rolling import covered, gram_hashes, mix, per_word, slices, span_hashes, words

WINDOW = 35
PROBE_BYTES = 5  # of a probe's hash that travel; a false hit only costs a comparison
EXACT_BYTES = 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WORD = ~_SPACE
_OTHER_BASE = 0xA0761D6478BD642F


class _Slice:
    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.first = words(buf, bounds, _WORD)
        self.row, self.row_end = per_word(self.first)
        self.hashes = span_hashes(buf, self.starts, self.ends)

    def inside(self, n: int) -> np.ndarray:
        """Places of windows of n words that lie in one text."""
        return np.flatnonzero(np.arange(len(self.hashes)) + n <= self.row_end)

    def exact(self, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows."""
        other = mix(self.hashes * np.uint64(_OTHER_BASE))
        return trim(gram_hashes(self.hashes, n)[places], 8), gram_hashes(other, n, _OTHER_BASE)[places]


def _ids(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    return batch.column(0).slice(lo, hi - lo).to_numpy()


def substring_dedup(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (text).

    A word goes if a window of ``window`` words over it occurs at another place too, in any document
    (rows that repeat a doc_id are separate documents). A null text has no words. Words are kept as
    they are and joined by one space.
    """
    block = (window + 1) // 2
    docs = docs.select(id_or_null(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def probes(batch):
        for lo, hi, buf, bounds in slices(batch.column(1)):
            s = _Slice(buf, bounds)
            at = s.inside(block)
            is_block = (at - s.first[s.row[at]]) % block == 0
            yield _ids(batch, lo, hi), s.row[at], gram_hashes(s.hashes, block)[at], None, is_block

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hits = land(repeated_keys(docs, probes, PROBE_BYTES, total // 6, need_mark=True), "hits")

    def extended(batch):
        for lo, hi, buf, bounds in slices(batch.column(1)):
            s = _Slice(buf, bounds)
            at = s.inside(block)
            hit = at[among(trim(gram_hashes(s.hashes, block)[at], PROBE_BYTES), None, known_keys(batch.column(2).slice(lo, hi - lo), PROBE_BYTES))]
            near = covered(len(s.row), np.maximum(hit - (window - block), 0), window - block + 1)
            places = s.inside(window)
            places = places[near[places]]
            yield _ids(batch, lo, hi), s.row[places], *s.exact(places, window), None

    found = docs.join(hits, "doc_id").select("doc_id", "text", "keys")
    repeats = land(repeated_keys(found, extended, EXACT_BYTES, total // 12), "repeats")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(1)):
                s = _Slice(buf, bounds)
                known = known_keys(batch.column(2).slice(lo, hi - lo), EXACT_BYTES)
                gone = np.zeros(len(s.row), bool)
                if len(known[0]):
                    places = s.inside(window)
                    first, second = s.exact(places, window)
                    gone = covered(len(s.row), places[among(first, second, known)], window)
                data, stay = buf.tobytes(), ~gone
                texts = []
                for d in range(hi - lo):
                    a, b = s.first[d], s.first[d + 1]
                    here = stay[a:b]
                    texts.append(b" ".join(data[x:y] for x, y in zip(s.starts[a:b][here].tolist(), s.ends[a:b][here].tolist())))
                counts = np.diff(s.first)
                removed = np.bincount(s.row[gone], minlength=hi - lo)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    out = docs.join(repeats, "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", back_to_null())


@query(
    "op5_substring_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, unnest([{'i': i, 'g': array_to_string(w[i:i + 34], ' ')} FOR i IN range(1, len(w) - 33)]) AS s FROM w WHERE len(w) >= 35),
    rep AS (SELECT doc_id, i FROM (SELECT doc_id, s.i AS i, count(*) OVER (PARTITION BY s.g) AS c FROM win) WHERE c > 1),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM rep) GROUP BY doc_id),
    word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
    kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) USING (doc_id, p) GROUP BY word.doc_id)
    SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op5_substring_dedup(spark, folder):
    out = substring_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
