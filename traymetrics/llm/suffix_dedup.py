"""Operator 4, suffix-array dedup by longest-previous-factor arrays.

A suffix array over all bytes of a corpus can't be shuffled, so suffixes are dealt by content first.
Every window of 50 bytes has an anchor, the least-hashed K bytes in it; equal windows have equal
anchors at equal places. Consecutive windows of one anchor are one segment of text. Anchors that no
other document has are dropped before any text moves, and equal segments become one.

The segments of an anchor meet in one task. There the suffixes that start a window are sorted by
their first 50 bytes (ranks are doubled from 8 to 16, 32 and 50 bytes) and, among equals, by their
least document. Along this order the previous smaller document of a suffix lies in its own run of
equals or shares less than 50 bytes, and no next smaller one can share more; so the run's first
member is the earlier match that the longest-previous-factor array points to. Windows with an
earlier match are removed from every later document; the first copy stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import back_to_null, drop_landed, id_or_null, land, query, table
from traymetrics.llm.exchange import among, known_keys, repeated_keys, trim
from traymetrics.llm.rolling import SLICE_BYTES, byte_gram_hashes, slices, sliding_min

WINDOW = 50
K = 24  # bytes of an anchor
ANCHOR_BYTES = 5  # of an anchor's hash that travel; a false match only costs a comparison
PLACE_BITS = 21  # a piece of text has fewer bytes
BUCKET_BYTES = 2 << 20  # of segments sorted at once
BROADCAST_COPIES = 500_000  # ids of whole copies (16 bytes each) up to which they are broadcast; more are joined by shuffle
HOT_ANCHOR = 8192  # segments; an anchor with more is resolved window by window


def _pieces(column: pa.Array, window: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offset in the row, bytes, bounds); long texts overlap by window - 1 bytes."""
    for lo, hi, buf, bounds in slices(column):
        if len(buf) <= SLICE_BYTES:
            yield lo, hi, 0, buf, bounds
            continue
        for at in range(0, len(buf) - window + 1, SLICE_BYTES - window + 1):
            part = buf[at : at + SLICE_BYTES]
            yield lo, hi, at, part, np.array([0, len(part)])


def segments(buf: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor hash) of the runs of windows that share an anchor."""
    hashes = byte_gram_hashes(buf, k)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), window - k + 1)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + window <= bounds[1:][rows])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    anchor = (least[starts] & low).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    return rows[starts[heads]], starts[heads], np.diff(np.append(heads, len(starts))), hashes[anchor[heads]]


def _gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans one after another, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return buf[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _ranks(first << np.uint64(32) | second)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Rank of the ``window`` bytes at each start, in byte order; equal bytes have equal ranks.

    Ranks of 8 bytes are doubled until the window is covered; only places that are needed stay in range.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(window + 8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + window, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n + window]
    rank, have = _ranks(word), 8
    while have * 2 <= window:
        rank = _joined(rank[:-have], rank[have:])
        have *= 2
    if have < window:
        rank = _joined(rank[starts], rank[starts + window - have])
        return rank
    return rank[starts]


def previous_factors(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each suffix's run of equals in suffix order (its own, if it is the first)."""
    if not len(rank):
        return doc
    order = np.lexsort((doc, rank))
    new = np.ones(len(order), bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    out = np.empty_like(doc)
    out[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


_EARLIER = "anchor long, content long, spans array<struct<at:int,n:int,doc:long>>"


def _earlier(rows: pa.Table, window: int) -> pa.Table:
    """Per segment: stretches of windows and the first document that has them, where a later one has them too."""
    texts = rows.column("segment").combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    counts = np.diff(offsets) - window + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    least, most = rows.column("least").to_numpy(), rows.column("most").to_numpy()
    first = previous_factors(suffix_ranks(data, offsets[owner] + inside, window), least[owner])
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(owner)))
    useful = first[heads] < most[owner[heads]]
    heads, sizes = heads[useful], sizes[useful]
    per = np.bincount(owner[heads], minlength=len(counts))
    some = np.flatnonzero(per)
    spans = pa.StructArray.from_arrays([pa.array(inside[heads].astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(first[heads])], ["at", "n", "doc"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per[some])]).astype(np.int32)), spans)
    take = pa.array(some)
    return pa.table({"anchor": rows.column("anchor").take(take), "content": rows.column("content").take(take), "spans": lists})


def _hot_earlier(hot: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many segments: windows are grouped one by one, spread over all tasks."""
    count = F.octet_length("segment") - (window - 1)
    each = hot.select("anchor", "content", "least", "most", F.posexplode(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring("segment", i, F.lit(window)))).alias("at", "bytes"))
    first = each.groupBy("bytes").agg(F.min("least").alias("doc"))
    back = each.join(first, "bytes").filter("doc < most")
    return back.groupBy("anchor", "content").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), "doc")).alias("spans"))


def _later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, size) of the documents whose whole text a smaller doc_id has."""
    rows = land(docs.select("doc_id", "tag", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha")), "digests")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("least"))
    return land(rows.join(first, "sha").filter("doc_id > least").select("doc_id", "tag", "size").distinct(), "copies")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, key: str = "doc_id", text: str = "text", hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (start, end, removed runs of bytes), kept (binary).

    A byte goes if one of the ``window`` bytes over it also starts in a document with a smaller
    doc_id; a null doc_id is the smallest, and rows of one doc_id do not remove each other's bytes.
    A null text is empty. Texts shorter than the window stay whole.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(id_or_null(key).alias("doc_id"), value.alias("text"), F.xxhash64(value).alias("tag"))
    copies = _later_copies(docs)
    some = copies.select("doc_id", "tag")
    sources = docs.join(F.broadcast(some) if copies.count() <= BROADCAST_COPIES else some, ["doc_id", "tag"], "left_anti").select("doc_id", "text", "tag")

    def anchors(batch):
        ids = batch.column(0)
        for lo, hi, _, buf, bounds in _pieces(batch.column(1), window):
            row, _, _, anchor = segments(buf, bounds, window, k)
            yield ids.slice(lo, hi - lo).to_numpy(), row, anchor, None, None

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    hits = land(repeated_keys(sources, anchors, ANCHOR_BYTES, total * 2 // (window - k + 1), once_per_doc=True), "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, base, buf, bounds in _pieces(batch.column(1), window):
                row, start, count, anchor = segments(buf, bounds, window, k)
                known = known_keys(batch.column(3).slice(lo, hi - lo), ANCHOR_BYTES)
                some = among(trim(anchor, ANCHOR_BYTES), None, known)
                row, start, count, anchor = row[some], start[some], count[some], anchor[some]
                data, offsets = _gather(buf, start, count + window - 1)
                text_column = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                take = pa.array(row + lo)
                columns = [batch.column(0).take(take), batch.column(2).take(take), pa.array(start - bounds[row] + base), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), text_column]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "start", "n", "anchor", "segment"])

    found = sources.join(hits, "doc_id").select("doc_id", "text", "tag", "keys")
    cuts = found.mapInArrow(cut, "doc_id long, tag long, start long, n int, anchor long, segment binary")
    cuts = land(cuts.withColumn("content", F.xxhash64("segment")), "segments")

    # a segment is named by the hashes of its anchor and of its text, 128 bits
    distinct = land(cuts.groupBy("anchor", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("n").alias("n")), "distinct")
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.max("most").alias("_most"), F.min("least").alias("_least"))
    sizes = land(sizes.filter("_least < _most").select("anchor", "c"), "anchors")
    # all documents have the same segment around the anchor: no text is needed
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("n"), F.col("least").alias("doc")))
    earlier = distinct.join(sizes.filter("c = 1"), "anchor").select("anchor", "content", whole.alias("spans"))
    several = distinct.drop("n").join(sizes.filter("c > 1"), "anchor")
    texts = cuts.select("anchor", "content", F.col("doc_id").alias("least"), "segment").join(several, ["anchor", "content", "least"])
    texts = land(texts.groupBy("anchor", "content").agg(F.first("segment").alias("segment"), F.first("least").alias("least"), F.first("most").alias("most"), F.first("c").alias("c")), "texts")
    size = texts.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(size // BUCKET_BYTES + 1))
    earlier = earlier.union(texts.filter(F.col("c") <= hot_anchor).withColumn("bucket", bucket).groupBy("bucket").applyInArrow(lambda rows: _earlier(rows, window), _EARLIER))
    hot = texts.filter(F.col("c") > hot_anchor)
    if not hot.isEmpty():
        earlier = earlier.union(_hot_earlier(hot, window))
    earlier = land(earlier, "earlier")
    drop_landed(distinct, sizes, texts)

    placed = cuts.select("doc_id", "tag", "start", "anchor", "content").join(earlier, ["anchor", "content"])
    spans = placed.select("doc_id", "tag", "start", F.explode("spans").alias("s")).filter("s.doc < doc_id")
    from_, to = F.col("start") + F.col("s.at"), F.col("start") + F.col("s.at") + F.col("s.n") + (window - 1)
    gone = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(from_.cast("long").alias("a"), to.cast("long").alias("b"))).alias("gone"))
    copied = copies.filter(F.col("size") >= window).select("doc_id", "tag", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))).alias("gone"))
    gone = land(gone.union(copied), "gone")
    drop_landed(cuts, earlier, hits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(2)
            for lo, hi, buf, bounds in slices(batch.column(1)):
                kept, runs = [], []
                for d in range(hi - lo):
                    text = buf[bounds[d] : bounds[d + 1]].tobytes()
                    merged: list[list[int]] = []
                    pairs = gone[lo + d]
                    if pairs.is_valid:
                        a, b = (pairs.values.field(n).to_numpy() for n in ("a", "b"))
                        order = np.argsort(a)
                        for x, y in zip(a[order].tolist(), b[order].tolist()):
                            if merged and x <= merged[-1][1]:
                                merged[-1][1] = max(merged[-1][1], y)
                            else:
                                merged.append([x, y])
                    ends = [0, *(e for m in merged for e in m), len(text)]
                    kept.append(b"".join(text[x:y] for x, y in zip(ends[::2], ends[1::2])))
                    runs.append([{"start": x, "end": y} for x, y in merged])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    out = docs.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "gone")
    return out.mapInArrow(keep, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumn("doc_id", back_to_null())


@query(
    "op4_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
    win AS (SELECT doc_id, unnest([{'i': i, 'g': x[2 * i + 1:2 * i + 100]} FOR i IN range(0, len(x) // 2 - 49)]) AS s FROM d WHERE len(x) >= 100),
    hit AS (SELECT doc_id, i FROM (SELECT doc_id, s.i AS i, min(doc_id) OVER (PARTITION BY s.g) AS m FROM win) WHERE m < doc_id),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit)),
    runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE q IS NULL OR q < p - 1) AS r FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS t FROM (SELECT doc_id, unnest([x[2 * i + 1:2 * i + 2] FOR i IN range(0, len(x) // 2)]) AS b, unnest(range(0, len(x) // 2)) AS p FROM d)
             ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(r, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
    FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op4_suffix_dedup(spark, folder):
    out = suffix_dedup(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
