"""Links between texts whose sets of word shingles overlap by a given share, for the near-dedup stage.

Bits of a SimHash only estimate how similar two texts are, so a stage that has to find every pair at
a similarity joins the sets themselves. Shingles have one order for all texts: those that a sample
shows to be common come last. Two sets with Jaccard similarity ``t`` or more have a shingle in common
among the first ``n - ceil(t n) + 1`` of each, whatever the order is, so only these prefixes meet;
the places of the meeting shingle tell some pairs apart, maps of the sets' bits most others. What is
left is compared set by set.

Only connections are asked for. Long lists are compared with one of their members first, again and
again while the pairs not yet connected are more than the prefixes' rows and get fewer by half;
lists whose members are all connected are done. Afterwards the pairs that are not yet connected are
built. All of these are compared, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import drop_landed, land, null_as_empty
from traymetrics.llm.components import components
from traymetrics.llm.exchange import repeated_keys, trim, unpack
from traymetrics.llm.rolling import gram_hashes, mix, per_word, slices, span_hashes, words
from traymetrics.operators.ordering import BROADCAST_ROWS

SHINGLE = 5
SIMILARITY = 0.8
SAMPLE = 20_000  # texts that tell which shingles are common; the order changes costs, never links
COMMON = 4  # texts of the sample that hold a common shingle
MOST_COMMON = 100_000
LONG = 8  # members of a list that is compared with one of them first
WIDTH = 5  # bytes of a shingle while prefixes look for one another
PAIRS = 1  # pairs per prefix row above which that is done again
BITS = 4  # places of a set's map for each of its shingles, at least

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_SLACK = 1e-9


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts of a slice, and where each text's hashes begin.

    Lower-cased (A-Z), cut at ASCII white space. A text of fewer words is one shingle, as is one without.
    """
    low = _LOWER[buf]
    starts, ends, first = words(low, bounds, _WORD)
    counts = np.diff(first)
    wide = np.maximum(counts, size)
    at = np.concatenate([[0], np.cumsum(wide)])
    row, _ = per_word(first)
    values = np.zeros(at[-1], np.uint64)  # short texts are filled up with zeros
    values[at[row] + np.arange(len(row)) - first[row]] = span_hashes(low, starts, ends)
    owner = np.repeat(np.arange(len(counts)), wide - size + 1)
    firsts = np.concatenate([[0], np.cumsum(wide - size + 1)])
    hashes = gram_hashes(values, size)[at[owner] + np.arange(len(owner)) - firsts[owner]]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have equal numbers."""
    return mix(np.add.reduceat(mix(hashes + np.uint64(1)), first[:-1]) + np.diff(first).astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def bit_maps(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 bits that say which places the hashes of each set take, and where each map begins.

    A map has the least power of two of places that gives every hash ``BITS`` of them. Places are the
    low bits of a hash, so a map of twice the places folds into one half of it laid on the other.
    """
    n = np.diff(first)
    places = np.maximum(64, 1 << np.ceil(np.log2(BITS * n)).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(places >> 6)])
    owner = np.repeat(np.arange(len(n)), n)
    place = (mix(hashes.copy()) & (places[owner] - 1).astype(np.uint64)).astype(np.int64)
    taken = np.zeros(begins[-1] * 64, bool)
    taken[begins[owner] * 64 + place] = True
    return np.packbits(taken, bitorder="little").view(np.uint64), begins


def _mapped(texts: DataFrame, schema: str, fn: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """Columns of ``texts`` but the last, which is the text, and what ``fn`` makes of slices of it."""
    names = [f.split()[0] for f in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.columns[-1]):
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], *fn(buf, bounds)], names)

    return texts.mapInArrow(task, schema)


def _sets(buf: np.ndarray, bounds: np.ndarray, size: int) -> list[pa.Array]:
    hashes, first = shingle_sets(buf, bounds, size)
    return [_lists(hashes, first)]


def _common(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many sampled texts hold, and the number of these texts."""
    share = SAMPLE / max(1, texts.count())
    some = texts.filter(F.pmod(F.xxhash64("text_sha256"), F.lit(1 << 40)) < share * (1 << 40)) if share < 1 else texts
    sets = _mapped(some.select("text"), "s array<long>", lambda buf, bounds: _sets(buf, bounds, size))
    counted = sets.select(F.explode("s").alias("h")).groupBy("h").count().filter(F.col("count") >= COMMON)
    rows = counted.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    hashes, counts = (rows.column(c).to_numpy() for c in ("h", "count"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prefixes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_sha256, node, n, prefix, map): the set's number, size, first shingles in order and bit map."""
    text = null_as_empty()
    texts = docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(texts, size))

    def fn(buf: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        hashes, first = shingle_sets(buf, bounds, size)
        known, counts = shared.value
        rank = np.zeros(len(hashes), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            rank = np.where(known[at] == hashes, counts[at], 0)
        owner, _ = per_word(first)
        ordered = hashes[np.lexsort((hashes, rank, owner))]
        n = np.diff(first)
        most = n - np.ceil(similarity * n - _SLACK).astype(np.int64) + 1
        kept = np.arange(len(ordered)) - first[owner] < most[owner]
        return [pa.array(_nodes(hashes, first)), pa.array(n), _lists(ordered[kept], np.concatenate([[0], np.cumsum(most)])), _lists(*bit_maps(hashes, first))]

    return _mapped(texts, "doc_id long, text_sha256 string, node long, n long, prefix array<long>, map array<long>", fn)


def _missed(one: Column, other: Column) -> Column:
    """Places that the first map takes and the second doesn't."""
    bits = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(bits, F.lit(0), lambda total, b: total + b)


def _folded(wide: Column, other: Column) -> Column:
    """The first map at the places of the second, if that has half as many."""
    half = F.size(other)
    return F.when(F.size(wide) <= half, wide).otherwise(F.zip_with(F.slice(wide, F.lit(1), half), F.slice(wide, half + 1, half), lambda x, y: x.bitwiseOR(y)))


def _told_apart(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose maps leave room for similar sets; a pair of similar sets is never lost.

    Each place that only one map takes holds a shingle that the other set lacks, so a set's size less
    these places bounds what both have in common. A map takes a sixteenth of its set's bytes.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    maps = found.select("node", "n", "map").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    left, right = (maps.withColumnsRenamed({"node": c, "n": f"n{c}", "map": f"m{c}"}) for c in "ab")
    rows = pairs.join(left, "a").join(right, "b").withColumn("_total", F.col("na") + F.col("nb"))
    rows = rows.filter(F.least("na", "nb") * (1 + similarity) >= similarity * F.col("_total") - _SLACK)
    # maps fold once, which does for sets of like sizes; at a low similarity others are left to the sets
    alike = (F.size("ma") <= 2 * F.size("mb")) & (F.size("mb") <= 2 * F.size("ma"))
    rows = rows.select("a", "b", "na", "nb", "_total", alike.alias("_alike"), _folded(F.col("ma"), F.col("mb")).alias("ma"), _folded(F.col("mb"), F.col("ma")).alias("mb"))
    common = F.least(F.col("na") - _missed(F.col("ma"), F.col("mb")), F.col("nb") - _missed(F.col("mb"), F.col("ma")))
    return rows.filter(~F.col("_alike") | (common * (1 + similarity) >= similarity * F.col("_total") - _SLACK)).select("a", "b")


def _compared(pairs: DataFrame, docs: DataFrame, found: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; only sets of nodes that maps don't tell apart travel."""
    met = land(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "met")
    pairs = land(_told_apart(met, found, similarity), "pairs")
    drop_landed(met)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = found.select("node", "text_sha256").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_sha256").alias("_wanted_sha")).withColumnRenamed("node", "_node")
    wanted = land(wanted, "wanted")
    text = null_as_empty()
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.sha2(text, 256).alias("_sha"), text.alias("_text")).join(few, F.col("_sha") == F.col("_wanted_sha"))
    sets = _mapped(texts.select("_node", "_text"), "node long, s array<long>", lambda buf, bounds: _sets(buf, bounds, size))
    sets = sets.dropDuplicates(["node"])  # dealt by node once, for both sides
    left, right = (sets.withColumnsRenamed({"node": c, "s": f"s{c}"}) for c in "ab")
    rows = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))  # in the JVM: a pair of whole sets never waits in a batch
    out = land(rows.filter(common * (1 + similarity) >= similarity * (F.size("sa") + F.size("sb")) - _SLACK).select("a", "b"), "similar")
    drop_landed(pairs, wanted)
    return out


def _may_be_similar(similarity: float):
    """Of two places of one shingle, x and y: whether what follows them can still make the sets similar."""
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return rest * (1 + similarity) >= similarity * (F.col("x.n") + F.col("y.n")) - _SLACK


def _meeting(found: DataFrame) -> DataFrame:
    """(h, node, n, pos): the shingles of prefixes that other prefixes have too, as keys of ``WIDTH`` bytes.

    The keys are looked up packed; what occurs once never travels as a row. Keys that are cut short
    only let a few more pairs meet.
    """

    def keys_of(batch: pa.RecordBatch) -> Iterator:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        yield batch.column(0).to_numpy(), np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().view(np.uint64), None, None

    rows = found.select("node", "n", "prefix")
    keys = repeated_keys(found.select("node", "prefix"), keys_of, WIDTH, rows.agg(F.sum(F.size("prefix"))).first()[0] or 0, once_per_doc=True)
    rows = rows.join(keys.withColumnRenamed("doc_id", "node"), "node").select("node", "n", "prefix", "keys")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (batch.column(k).to_numpy() for k in (0, 1))
            found: list[tuple] = []
            for k, (prefix, known) in enumerate(zip(batch.column(2), batch.column(3))):
                h = trim(prefix.values.to_numpy().view(np.uint64), WIDTH)
                pos = np.flatnonzero(np.isin(h, trim(unpack(known.as_py(), WIDTH)[0], WIDTH)))
                found.append((h[pos], pos, np.full(len(pos), k)))
            h, pos, row = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[row]), pa.array(n[row]), pa.array(pos.astype(np.int32))], ["h", "node", "n", "pos"])

    return rows.mapInArrow(task, "h long, node long, n long, pos int")


def links(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(a, b): links between nodes of ``found`` (prefixes of ``docs``) that connect all that is similar."""
    rows = _meeting(found)
    rows = rows.groupBy("h", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    rows = land(rows, "met")
    members = rows.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    rows = land(rows.join(members, "h"), "lists")
    total = rows.count()

    got, before, salt = None, None, 0
    labelled = rows.withColumn("label", F.col("node"))
    while True:
        if got is not None:
            sizes = labelled.groupBy("h", "label").count().groupBy("h").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("same"))
            apart = sizes.agg(F.sum((F.col("all").cast("double") * F.col("all") - F.col("same")) / 2)).first()[0] or 0.0
            if apart <= PAIRS * total or (before is not None and apart > before / 2):
                break
            before = apart
        salt += 1
        long = labelled.filter(F.col("members") > LONG)
        centre = long.groupBy("h").agg(F.min_by(F.struct("node", "n", "pos", "label"), F.xxhash64("node", "h", F.lit(salt))).alias("y"))
        pairs = long.select("h", F.struct("node", "n", "pos", "label").alias("x")).join(centre, "h").filter("x.label <> y.label").filter(_may_be_similar(similarity))
        more = _compared(pairs, docs, found, similarity, size)
        got = more if got is None else got.union(more)
        labels = components(got)
        fresh = land(labelled.drop("label").join(labels, "node", "left").select("h", "node", "n", "pos", "members", F.coalesce("label", "node").alias("label")), "labelled")
        # lists whose members are all connected have no pair left
        mixed = fresh.groupBy("h").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("h")
        labelled = land(fresh.join(mixed, "h", "left_semi"), "labelled")
        drop_landed(fresh)

    groups = labelled.select("h", "label").distinct()
    apart = groups.withColumnRenamed("label", "la").join(groups.withColumnRenamed("label", "lb"), "h").filter("la < lb")
    member = lambda name, label: labelled.select("h", F.col("label").alias(label), F.struct("node", "n", "pos").alias(name))
    pairs = apart.join(member("x", "la"), ["h", "la"]).join(member("y", "lb"), ["h", "lb"])
    pairs = pairs.filter(_may_be_similar(similarity))
    more = _compared(pairs, docs, found, similarity, size)
    return got.union(more)
