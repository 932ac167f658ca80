"""Operator 8, SimHash near-dedup by a binary trie joined with itself.

A fingerprint has a bit for each of 64 votes over the hashes of a text's shingles. Two fingerprints
link if they differ in few bits. The fingerprints are the leaves of a binary trie. Pairs of its nodes
are walked down together, the bits in which their paths differ are added up, and a pair whose sum
exceeds the budget is dropped with everything below it.

The budget is split so that few pairs survive: of ``bits`` differing bits, at most half lie in the
upper or in the lower 32 bits. So two tries are walked, one for each half on top, with half the
budget on the way through the first 32 levels and the whole budget below.

The top levels are walked by Spark: a node's block of fingerprints joins the blocks of the nodes at
most half the budget away. A node of many fingerprints is several blocks. Below, a task walks a pair
of blocks level by level over sorted arrays, and gives back only links that connect what was not
connected before, never all pairs. Equal fingerprints count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import back_to_null, id_or_null, land, query, table
from traymetrics.llm.components import components
from traymetrics.llm.rolling import slices

SHINGLE = 4
BITS = 4  # fingerprints link at this many differing bits or fewer
SEED = 42
BLOCK = 4096  # fingerprints of a trie node that one task row carries
LEAF = 12  # below this many on each side, a pair of trie nodes is compared outright


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Lower-cased (A-Z), cut at ASCII white space; a bit is 1 if set in over half the shingles' hashes."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), len(parts)
    if n <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64, n - size + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text", carried: str | None = None) -> DataFrame:
    """(doc_id, fp) and the string column ``carried``: fp as a signed long; a null text has none of its words and fingerprint 0."""
    more = [carried] if carried else []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(1)):
                data = buf.tobytes()
                prints = np.array([fingerprint(data[a:b], size, seed) for a, b in zip(bounds[:-1], bounds[1:])], np.uint64)
                rest = [batch.column(2 + k).slice(lo, hi - lo) for k in range(len(more))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(prints.view(np.int64)), *rest], ["doc_id", "fp", *more])

    schema = ", ".join(["doc_id long, fp long", *(f"{c} string" for c in more)])
    return docs.select(id_or_null(key).alias("doc_id"), F.col(text).alias("text"), *more).mapInArrow(task, schema)


class Joined:
    """Groups of places; ``link`` says whether it connected two groups."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _bits_set(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def walk(a: np.ndarray, b: np.ndarray, bits: int, depth: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in sorted a and b that differ in at most ``bits``, and in at most half of them in the upper 32.

    The two arrays are the leaves below two nodes at ``depth``. The frontier holds pairs of nodes as
    ranges (a_lo, a_hi, b_lo, b_hi); each level splits them at the next bit.
    """
    half = bits // 2
    front = np.array([[0, len(a), 0, len(b)]], np.int64)
    while len(front):
        small = (front[:, 1] - front[:, 0] <= LEAF) & (front[:, 3] - front[:, 2] <= LEAF)
        if depth == 64:
            small[:] = True
        yield from _compare(a, b, front[small], bits, half, same)
        front = front[~small]
        if not len(front):
            return
        bit = np.uint64(63 - depth)
        depth += 1
        mask = ~((np.uint64(1) << bit) - np.uint64(1))
        cut = lambda x, lo, hi: _split(x, lo, hi, bit)
        am, bm = cut(a, front[:, 0], front[:, 1]), cut(b, front[:, 2], front[:, 3])
        parts = [np.stack([x0, x1, y0, y1], 1) for x0, x1 in ((front[:, 0], am), (am, front[:, 1])) for y0, y1 in ((front[:, 2], bm), (bm, front[:, 3]))]
        front = np.concatenate(parts)
        front = front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3])]
        if same:  # each unordered pair of nodes once
            front = front[front[:, 0] <= front[:, 2]]
        differ = (a[front[:, 0]] ^ b[front[:, 2]]) & mask
        upper = _bits_set(differ >> np.uint64(32))
        front = front[(upper <= half) & (_bits_set(differ) <= bits)]


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place in each range whose ``bit`` is set; all bits above it agree in a range."""
    ones = np.concatenate([[0], np.cumsum((x >> bit) & np.uint64(1))]).astype(np.int64)
    return hi - (ones[hi] - ones[lo])


def _compare(a, b, front, bits, half, same):
    """Every pair below small pairs of nodes, in pieces of bounded size."""
    for at in range(0, len(front), 1 << 14):
        f = front[at : at + (1 << 14)]
        na, nb = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
        which = np.repeat(np.arange(len(f)), na * nb)
        k = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        i, j = f[which, 0] + k // nb[which], f[which, 2] + k % nb[which]
        if same:
            ok = i < j
            i, j = i[ok], j[ok]
        x = a[i] ^ b[j]
        ok = (_bits_set(x >> np.uint64(32)) <= half) & (_bits_set(x) <= bits)
        yield i[ok], j[ok]


def block_links(a: np.ndarray, b: np.ndarray, bits: int, depth: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is linked within and between two sorted blocks."""
    joined, out = Joined(len(a) + (0 if same else len(b))), []
    for i, j in walk(a, b, bits, depth, same):
        shift = 0 if same else len(a)
        out += [(x, y) for x, y in zip(i.tolist(), j.tolist()) if joined.link(x, y + shift)]
    got = np.array(out, np.int64).reshape(-1, 2)
    return a[got[:, 0]], b[got[:, 1]]


_HALF = np.uint64(32)


def _turned(x: np.ndarray, side: int) -> np.ndarray:
    return (x << _HALF) | (x >> _HALF) if side else x


def links(prints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` (one row each) that connect all that is linked."""
    spark = prints.sparkSession
    n = prints.count()
    depth = max(0, min(24, (n // block).bit_length()))  # levels walked by Spark
    turned = F.when(F.col("side") == 1, F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))).otherwise(F.col("fp"))
    node = F.shiftrightunsigned(F.col("t"), 64 - depth) if depth else F.lit(0).cast("long")
    rows = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("t", turned).withColumn("node", node).drop("fp")
    sizes = rows.groupBy("side", "node").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("t"), F.ceil(F.col("size") / block))  # a full node is several blocks
    blocks = rows.join(sizes, ["side", "node"]).withColumn("part", part).groupBy("side", "node", "part").agg(F.collect_list("t").alias("leaves"))
    blocks = land(blocks, "trie")
    masks = [sum(1 << k for k in bits_on) for d in range(bits // 2 + 1) for bits_on in combinations(range(depth), d)]
    left = blocks.select("side", F.col("node").alias("a_node"), F.col("part").alias("a_part"), F.col("leaves").alias("a"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    left = left.withColumn("node", F.col("a_node").bitwiseXOR(F.col("mask"))).filter("node >= a_node").drop("mask")
    right = blocks.withColumnsRenamed({"leaves": "b", "part": "b_part"})
    pairs = left.join(right, ["side", "node"]).filter("node > a_node OR b_part >= a_part")
    pairs = pairs.select("side", "a", "b", ((F.col("node") == F.col("a_node")) & (F.col("a_part") == F.col("b_part"))).alias("same"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side, a, b, same in zip(*(batch.column(i) for i in range(4))):
                x, y = (np.sort(v.values.to_numpy().view(np.uint64)) for v in (a, b))
                got = [_turned(g, side.as_py()).view(np.int64) for g in block_links(x, y, bits, depth, same.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(g) for g in got], ["a", "b"])

    pairs = pairs.repartition(max(1, min(16 * spark.sparkContext.defaultParallelism, n // block + 1))) if n > block else pairs
    return pairs.mapInArrow(task, "a long, b long")


def name_groups(least: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Rows of ``least`` (one for each fingerprint ``fp``) + root, the least fingerprint reachable over links."""
    labels = components(land(links(least.select("fp"), bits, block), "found"))
    return least.join(labels.withColumnsRenamed({"node": "fp", "label": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, bits: int = BITS, seed: int = SEED, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id.

    The component is named by the smallest doc_id reachable over links, a null doc_id being the
    smallest of all. Texts without words share fingerprint 0 and link like any other.
    """
    rows = land(fingerprints(docs, size, seed, key, text), "prints")
    least = land(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    labelled = name_groups(least, bits, block)
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id")).join(labelled.select("root", "fp"), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(back_to_null("doc_id").alias("doc_id"), "fp", back_to_null("component_id").alias("component_id"))


@query("op8_simhash")
def op8_simhash(spark, folder):
    found = near_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
