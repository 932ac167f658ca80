"""Operator 11, toxicity by a linear classifier over character n-grams with naive Bayes scaling.

A text's features are the n-grams of its characters (3 to 7, inside words, a word's ends counting as
characters) that it holds, once each, hashed to ``1 << BITS`` places. Over labelled texts each
feature's log-count ratio between the classes is estimated as naive Bayes does, and becomes the
feature's value; a ridge logistic regression on those values learns which of them to trust.

The fit uses about ``LABELLED`` labelled documents, drawn by a hash of doc_id, and of their n-grams
the ``FEATURES`` whose odds differ most between the classes for their spread. Counting them is a Spark
job over the whole texts; the driver solves for a thousand weights. All documents are scored in one
pass without a shuffle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import drop_landed, land, query, table
from traymetrics.llm.rolling import gram_hashes, slices

SIZES = (3, 4, 5, 6, 7)
BITS = 20
LABELLED = 20_000  # labelled documents the fit uses, about
FEATURES = 1_024
SMOOTHING = 1.0
RIDGE = 1.0
THRESHOLD = 0.5

_PLACES = 1 << BITS
_SPACE = np.uint32(0x20)


def characters(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a slice, a space before each text and at the end, and where each text begins.

    A character is the number its UTF-8 bytes make; Latin letters are lower-cased, controls are spaces.
    """
    first = (buf & 0xC0) != 0x80
    lead = np.flatnonzero(first)
    count = np.concatenate([[0], np.cumsum(first)])[bounds]
    sizes = np.diff(np.append(lead, len(buf)))
    code = buf[lead].astype(np.uint32)
    for k in (1, 2, 3):
        more = sizes > k
        code[more] = code[more] << np.uint32(8) | buf[lead[more] + k]
    upper = ((code >= 0x41) & (code <= 0x5A)) | ((code >= 0xC380) & (code <= 0xC39E) & (code != 0xC397))
    code[upper] += 32
    code[code < 0x20] = _SPACE
    starts = count[:-1] + np.arange(len(bounds) - 1)
    out = np.full(len(code) + len(bounds), _SPACE)
    out[np.arange(len(code)) + np.repeat(np.arange(1, len(bounds)), np.diff(count))] = code
    return out, starts


def grams(buf: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs of a slice, sorted by row; only places that are ``wanted``, if given."""
    code, starts = characters(buf, bounds)
    spaces = np.concatenate([[0], np.cumsum(code == _SPACE)])
    values = code.astype(np.uint64) + np.uint64(1)
    found = []
    for n in SIZES:
        hashes = gram_hashes(values, n)
        if not len(hashes):
            continue
        keep = spaces[n - 1 : len(code)] == spaces[1 : len(code) - n + 2]  # no space inside
        place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        if wanted is not None:
            keep &= wanted[place]
        at = np.flatnonzero(keep)
        found.append((np.searchsorted(starts, at, "right") - 1) * _PLACES + place[at])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // _PLACES, pairs % _PLACES


@dataclass
class Toxicity:
    """Places, the weights of their naive Bayes values, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._wanted = np.zeros(_PLACES, bool)
        self._wanted[self.places] = True

    def score(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row, place = grams(buf, bounds, self._wanted)
        total = np.bincount(row, self.weights[np.searchsorted(self.places, place)], minlength=len(bounds) - 1)
        return _sigmoid(total + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, columns: int, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse rows by L-BFGS: weights and bias (not penalised)."""

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        s = np.bincount(row, x[column] * value, minlength=len(y)) + x[-1]
        g = _sigmoid(s) - y
        return np.logaddexp(0, np.where(y > 0, -s, s)).sum() + ridge / 2 * x[:-1] @ x[:-1], np.append(np.bincount(column, g[row] * value, minlength=columns) + ridge * x[:-1], g.sum())

    x = np.append(np.zeros(columns), np.log(y.sum() / (len(y) - y.sum())))
    f, g = loss(x)
    steps: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=10)
    for _ in range(200):
        d, kept = -g, []
        for s, t in reversed(steps):
            kept.append(s @ d / (s @ t))
            d = d - kept[-1] * t
        d = d * (steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.abs(g).sum()))
        for (s, t), k in zip(steps, reversed(kept)):
            d = d + s * (k - t @ d / (s @ t))
        rate = 1.0
        while True:
            after, slope = loss(x + rate * d)
            if after <= f + 1e-4 * rate * (g @ d) or rate < 1e-9:
                break
            rate /= 2
        if rate * d @ (slope - g) > 1e-12:
            steps.append((rate * d, slope - g))
        gain = f - after
        x, f, g = x + rate * d, after, slope
        if gain <= 1e-7 * abs(f):
            break
    return x[:-1], float(x[-1])


def held_out(name: str = "doc_id") -> Column:
    """Whether a document's label may not be learnt from; a null id counts as held out."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count(rows: DataFrame) -> DataFrame:
    """(place, yes, no): labelled texts of each class that hold an n-gram."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, _PLACES), np.int64)
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(1)):
                row, place = grams(buf, bounds)
                label = batch.column(2).slice(lo, hi - lo).to_numpy()[row]
                for k in (0, 1):
                    seen[k] += np.bincount(place[label == k], minlength=_PLACES)
        at = np.flatnonzero(seen.any(0))
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[1, part]), pa.array(seen[0, part])], ["place", "yes", "no"])

    return rows.mapInArrow(task, "place long, yes long, no long").groupBy("place").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def _telling(rows: DataFrame, yes: int, no: int, features: int, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Places, sorted, of the n-grams that tell the classes apart best, and their log-count ratios."""
    seen = land(_count(rows), "grams")
    total = seen.agg(F.sum("yes"), F.sum("no")).first()
    ratio = F.log((F.col("yes") + smoothing) / (total[0] + smoothing * _PLACES)) - F.log((F.col("no") + smoothing) / (total[1] + smoothing * _PLACES))
    cells = [(F.col("yes"), yes), (F.col("no"), no)]
    odds = [F.log((c + 0.5) / (n - c + 0.5)) for c, n in cells]
    spread = sum((1 / (c + 0.5) + 1 / (n - c + 0.5) for c, n in cells), F.lit(0.0))
    best = seen.filter("yes + no > 1").select("place", ratio.alias("ratio"), (F.abs(odds[0] - odds[1]) / F.sqrt(spread)).alias("z"))
    found = sorted((r["place"], r["ratio"]) for r in best.orderBy(F.desc("z"), "place").limit(features).collect())
    drop_landed(seen)
    return np.array([p for p, _ in found], np.int64), np.array([r for _, r in found])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, features: int = FEATURES, smoothing: float = SMOOTHING, ridge: float = RIDGE) -> Toxicity | float:
    """A classifier from ``labels`` (doc_id, toxic), or the share of toxic ones where they hold one class only.

    Held-out rows, null or contradicting labels and null doc_ids teach nothing. Without any label the
    share is 0.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("_most")).filter("label = _most")
    count = known.count()
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 40)) / float(1 << 40) < labelled / max(count, 1)
    chosen = known.filter(share).select("doc_id", F.col("label").cast("int").alias("label"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = land(slim.filter(F.col("doc_id").isNotNull() & share & ~held_out()).join(chosen, "doc_id"), "labelled")
    n, yes = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or yes in (0, n):
        return float(yes / n) if n else 0.0
    places, ratio = _telling(rows, yes, n - yes, features, smoothing)
    wanted = np.zeros(_PLACES, bool)
    wanted[places] = True

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(1)):
                row, place = grams(buf, bounds, wanted)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                held = np.searchsorted(places, place).astype("<i4")
                packed = pa.array([held[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), packed], ["doc_id", "label", "held"])

    table = rows.mapInArrow(task, "doc_id long, label int, held binary").toArrow().sort_by([("doc_id", "ascending"), ("held", "ascending")])  # ``labelled`` rows
    drop_landed(rows)
    held = [np.frombuffer(b, "<i4") for b in table.column("held").to_pylist()]
    row, column = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held).astype(np.int64)
    weights, bias = logistic(row, column, ratio[column], table.column("label").to_numpy().astype(float), len(places), ridge)
    return Toxicity(places, weights * ratio, bias)


def score(docs: DataFrame, model: Toxicity | float, name: str = "_toxic") -> DataFrame:
    """``docs`` with a column, the probability that the text is toxic; null counts as empty."""
    docs = docs.drop(name)
    if not isinstance(model, Toxicity):
        return docs.withColumn(name, F.lit(float(model)))
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.weights, model.bias))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Toxicity(*shared.value)
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(batch.schema.get_field_index("text"))):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(classifier.score(buf, bounds))], [*rows.schema.names, name])

    return docs.mapInArrow(task, docs.withColumn(name, F.lit(None).cast("double")).schema)


@query("op11_toxicity")
def op11_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_toxic").alias("score"), (F.col("_toxic") >= THRESHOLD).cast("int").alias("predicted"))
