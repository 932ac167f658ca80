"""Operator 10, quality classifier by co-training.

Two views of a document are classified on their own: its text (shares of kinds of bytes, word and
line shapes, repetition) and its page metadata (language, source, stated length). Each is a
regularised logistic regression. Over some rounds each classifier labels documents of a pool without
labels, and those of which its calibrated score is sure join the other one's training rows. In the
end both views are calibrated on labelled rows kept out of the training, combined by a regression
over their calibrated logits, and score every document.

A second model of the same making tells toxic documents by ``labels.toxic``. Shares and shapes don't
show them, words do: its text view also weighs the words of the whole text whose documents are
toxic more or less often than others among the labelled ones it is trained on.

Only the fit uses samples, of documented size; they are drawn by a hash of doc_id. All documents are
scored in one pass without a shuffle, with a model of a few hundred numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.llm.common import query, table
from traymetrics.llm.rolling import per_word, slices, span_hashes, words

LABELLED = 20_000  # labelled documents the fit uses, about
POOL = 20_000  # unlabelled documents the fit uses, about
ROUNDS = 4
EXCHANGED = 2_000  # pseudo-labels of each class a view may give the other in a round
SURE = 0.97  # calibrated probability a pseudo-label needs
THRESHOLD = 0.5  # of the combined probability of good quality
SOURCES = 64  # places sources are hashed to
LANGUAGES = 16
TELLING = 20_000  # words the toxic text view weighs, at most
CHI_SQUARE = 25.0  # between a word and the label, from which a word is weighed

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "loud": b"!?",
    "bar": b"|",
    "sign": b"#$%&*@^~=+<>",
    "other": b"\"'()/[\\]_`{}-",
    "high": bytes(range(128, 256)),
}
_KIND_OF = np.full(256, len(_KINDS), np.uint8)
for _k, _bytes in enumerate(_KINDS.values()):
    _KIND_OF[list(_bytes)] = _k
_N_KINDS = len(_KINDS) + 1


def text_features(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of numbers for each text of a slice; an empty text has zeros."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * _N_KINDS + _KIND_OF[buf], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
    shares = kinds / np.maximum(sizes, 1)[:, None]
    starts, ends, first = words(buf, bounds, ~_SPACE)
    row, _ = per_word(first)
    counts = np.diff(first)
    many = np.maximum(counts, 1)
    hashes = span_hashes(buf, starts, ends)
    order = np.lexsort((hashes, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=n)
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    repeated = np.bincount(row[same], minlength=n)
    lengths = ends - starts
    total = np.bincount(row, lengths, minlength=n)
    short = np.bincount(row[lengths <= 3], minlength=n)
    long = np.bincount(row[lengths >= 12], minlength=n)
    tail = _KIND_OF[buf[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    odd_tail = np.bincount(row[np.isin(tail, [7, 8, 9])], minlength=n)
    lines = kinds[:, 4] + (sizes > 0)
    shape = [
        np.log1p(counts),
        np.log1p(total / many),
        distinct / many,
        np.log1p(counts) * distinct / many,
        repeated / many,
        short / many,
        long / many,
        odd_tail / many,
        np.log1p(counts / np.maximum(lines, 1)),
        kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1),
    ]
    raw = np.concatenate([shares, np.stack(shape, 1)], 1)
    return np.concatenate([raw, np.sqrt(raw)], 1)


def word_hashes(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) runs of letters and digits, and the row of each."""
    low = _LOWER[buf]
    starts, ends, first = words(low, bounds, _LETTER)
    return span_hashes(low, starts, ends), per_word(first)[0]


def word_features(buf: np.ndarray, bounds: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Sums of the log-odds of the words in ``telling`` (rows of ``_telling``), for and against, their numbers and the greatest."""
    n = len(bounds) - 1
    hashes, row = word_hashes(buf, bounds)
    at = np.minimum(np.searchsorted(telling["word"], hashes), len(telling) - 1)
    hit = telling["word"][at] == hashes
    pairs, counts = np.unique(row[hit] * len(telling) + at[hit], return_counts=True)
    row, weight = pairs // len(telling), telling["odds"][pairs % len(telling)]
    greatest = np.zeros(n)
    np.maximum.at(greatest, row, weight)
    out = [greatest]
    for side in (weight > 0, weight < 0):
        out += [np.bincount(row[side], weight[side] * np.log1p(counts[side]), minlength=n), np.log1p(np.bincount(row[side], minlength=n))]
    return np.stack(out, 1)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """One row for each document: hashed language and source (null is a value), stated length."""
    out = np.zeros((len(lang), LANGUAGES + SOURCES + 3))
    for i, (a, b, c) in enumerate(zip(lang, source, n_chars)):
        out[i, zlib.crc32(repr(a).encode()) % LANGUAGES] = 1
        out[i, LANGUAGES + zlib.crc32(repr(b).encode()) % SOURCES] = 1
        size = np.log1p(max(c or 0, 0))
        out[i, -3:] = size, size * size / 10, c is None
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, by Newton steps."""

    ridge: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, spread = x.mean(0), x.std(0)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        a = self._design(x)
        penalty = np.full(a.shape[1], self.ridge)
        penalty[-1] = 1e-6
        self.weights = np.zeros(a.shape[1])
        for _ in range(25):
            p = _sigmoid(a @ self.weights)
            step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.weights


@dataclass
class View:
    """A classifier and its calibration."""

    model: Logistic
    calibration: Logistic

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.logits(self.model.logits(x)[:, None])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x))


_NO_WORDS = np.zeros(0, [("word", np.uint64), ("odds", np.float64)])


@dataclass
class CoTrained:
    text: View
    meta: View
    both: Logistic
    exchanged: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels each view gave, by round
    telling: np.ndarray = field(default_factory=lambda: _NO_WORDS)  # words the text view weighs

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text, metadata) probabilities of good quality."""
        a, b = self.text.logits(text), self.meta.logits(meta)
        return _sigmoid(self.both.logits(np.stack([a, b], 1))), _sigmoid(a), _sigmoid(b)


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, exchanged: int = EXCHANGED, sure: float = SURE) -> CoTrained:
    """``views`` and ``pool`` hold (text, metadata) rows; ``held`` marks labelled rows for calibration."""
    x = [v[~held] for v in views]
    labels = [y[~held], y[~held]]
    free = np.ones(len(pool[0]), bool)
    log = []
    for turn in range(rounds + 1):
        fitted = []
        for k in (0, 1):
            model = Logistic().fit(x[k], labels[k])
            fitted.append(View(model, Logistic(0.01).fit(model.logits(views[k][held])[:, None], y[held])))
        if turn == rounds or not free.any():
            break
        given = []
        for k in (0, 1):
            p = fitted[k].score(pool[k])
            chosen = []
            for good in (True, False):
                confidence = np.where(free, p if good else 1 - p, 0.0)
                best = np.argsort(-confidence, kind="stable")[:exchanged]
                chosen.append(best[confidence[best] >= sure])
            for rows, value in zip(chosen, (1.0, 0.0)):
                x[1 - k] = np.concatenate([x[1 - k], pool[1 - k][rows]])
                labels[1 - k] = np.concatenate([labels[1 - k], np.full(len(rows), value)])
            given.append(np.concatenate(chosen))
        for rows in given:
            free[rows] = False
        log.append((len(given[0]), len(given[1])))
        if not sum(map(len, given)):
            break
    a, b = (fitted[k].logits(views[k][held]) for k in (0, 1))
    return CoTrained(fitted[0], fitted[1], Logistic(0.1).fit(np.stack([a, b], 1), y[held]), log)


_FEATURES = ("lang", "source", "n_chars")


def _views(batch: pa.RecordBatch, lo: int, hi: int, buf: np.ndarray, bounds: np.ndarray, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    column = lambda n: batch.column(batch.schema.get_field_index(n)).slice(lo, hi - lo).to_pylist()
    text = text_features(buf, bounds)
    if len(telling):
        text = np.concatenate([text, word_features(buf, bounds, telling)], 1)
    return text, meta_features(*map(column, _FEATURES))


def _draw(name: str, salt: int):
    """A number in [0, 1) for each row, from its doc_id."""
    return F.pmod(F.xxhash64(F.col(name), F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)


def _telling(docs: DataFrame) -> np.ndarray:
    """Hashes, sorted, and log-odds of words that tell the labels of the rows (text, label) apart, of those not held out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(0)):
                hashes, row = word_hashes(buf, bounds)
                pairs = np.unique(np.stack([row.astype(np.uint64), hashes], 1), axis=0)
                label = batch.column(1).slice(lo, hi - lo).to_numpy()[pairs[:, 0].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64)), pa.array(label)], ["word", "label"])

    rows = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0).select("text", "label")
    n, yes = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or yes in (0.0, n):
        return _NO_WORDS
    seen = rows.mapInArrow(task, "word long, label double").groupBy("word").agg(F.count(F.lit(1)).alias("all"), F.sum("label").alias("yes"))
    share, gap = F.col("all") / n, F.col("yes") / yes - (F.col("all") - F.col("yes")) / (n - yes)
    chi = gap * gap / (share * (1 - share) * (1 / yes + 1 / (n - yes)))
    odds = F.log((F.col("yes") + 0.5) / (yes + 1)) - F.log((F.col("all") - F.col("yes") + 0.5) / (n - yes + 1))
    best = seen.filter(F.col("all") < n).select("word", chi.alias("chi"), odds.alias("odds")).filter(F.col("chi") >= CHI_SQUARE)
    rows = best.orderBy(F.desc("chi"), "word").limit(TELLING).collect()
    return np.sort(np.array([(r["word"] % (1 << 64), r["odds"]) for r in rows], _NO_WORDS.dtype), order="word")


def _sample(docs: DataFrame, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Features and labels (None for the pool) of a bounded sample, by doc_id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(batch.schema.get_field_index("text"))):
                rows = [pa.array([r.tobytes() for r in v], pa.binary()) for v in _views(batch, lo, hi, buf, bounds, telling)]
                kept = [batch.column(batch.schema.get_field_index(n)).slice(lo, hi - lo) for n in ("doc_id", "label")]
                yield pa.RecordBatch.from_arrays([*kept, *rows], ["doc_id", "label", "a", "b"])

    rows = docs.mapInArrow(task, "doc_id long, label double, a binary, b binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    table_of = lambda n: np.frombuffer(b"".join(rows.column(n).to_pylist())).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
    return table_of("a"), table_of("b"), list(zip(rows.column("doc_id").to_pylist(), rows.column("label").to_pylist()))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, target: str = "quality") -> CoTrained | float:
    """A co-trained model, or the share of positive labels where they do not hold both classes.

    ``target`` is the column of ``labels`` to learn, quality or toxic. A doc_id with contradicting
    labels, a null label or a null doc_id is not used. Without labels the share is 1 for quality and 0
    for toxic: nothing is known against any document.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.min(target).alias("q"), F.max(target).alias("r")).filter("q = r")
    count, good = known.agg(F.count(F.lit(1)), F.avg(F.col("q").cast("double"))).first()
    if not count or good in (0.0, 1.0):
        return float(target == "quality") if good is None else good
    total = docs.count()
    slim = docs.select("doc_id", "text", *_FEATURES)
    chosen = known.filter(_draw("doc_id", 1) < labelled / count).select("doc_id", F.col("q").cast("double").alias("label"))
    with_label = slim.join(F.broadcast(chosen), "doc_id")  # about ``labelled`` rows of two numbers
    without = slim.filter("doc_id IS NOT NULL").filter(_draw("doc_id", 2) < min(1.0, pool / max(total, 1))).join(F.broadcast(chosen), "doc_id", "left_anti")
    telling = _telling(with_label) if target == "toxic" else _NO_WORDS
    a, b, rows = _sample(with_label.unionByName(without.withColumn("label", F.lit(None).cast("double"))), telling)
    y = np.array([np.nan if v is None else v for _, v in rows])
    has = ~np.isnan(y)
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i, _ in rows], bool)[has]
    y = y[has]
    if min(len(set(y[held])), len(set(y[~held]))) < 2:
        return good
    model = cotrain((a[has], b[has]), y, held, (a[~has], b[~has]), rounds)
    model.telling = telling
    return model


_SCORES = ("_quality", "_text_quality", "_meta_quality")


def score(docs: DataFrame, model: CoTrained | float, toxic: CoTrained | float | None = None) -> DataFrame:
    """``docs`` with three columns: combined, text and metadata probability of good quality.

    With a model of toxic documents also their combined probability of being toxic.
    """
    names = [*_SCORES, "_toxic"] if toxic is not None else [*_SCORES]
    docs = docs.drop(*names)
    if not isinstance(model, CoTrained) and not isinstance(toxic, CoTrained):
        return docs.withColumns({c: F.lit(float(toxic if c == "_toxic" else model)) for c in names})
    shared = docs.sparkSession.sparkContext.broadcast((model, toxic))

    def scores_of(m, *where) -> tuple[np.ndarray, ...]:
        if isinstance(m, CoTrained):
            return m.score(*_views(*where, m.telling))
        return (np.full(where[2] - where[1], float(m)),) * 3

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in slices(batch.column(batch.schema.get_field_index("text"))):
                good, bad = shared.value
                scores = list(scores_of(good, batch, lo, hi, buf, bounds))
                if bad is not None:
                    scores.append(scores_of(bad, batch, lo, hi, buf, bounds)[0])
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, scores)], [*rows.schema.names, *names])

    return docs.mapInArrow(task, docs.withColumns({c: F.lit(None).cast("double") for c in names}).schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the scores, ``_accepted`` by quality, and ``_toxic``, the probability of being toxic.

    ``docs`` has doc_id, text, lang, source and n_chars, any of them null: a null text is empty, a
    null lang or source is a value of its own. Further columns pass through. Labels without a column
    toxic tell nothing of it.
    """
    toxic = fit(docs, labels, target="toxic") if "toxic" in labels.columns else 0.0
    return score(docs, fit(docs, labels), toxic).withColumn("_accepted", F.col("_quality") >= threshold)


@query("op10_quality")
def op10_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", *_FEATURES)
    scored = classify(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", *[F.col(c).alias(c[1:]) for c in _SCORES], F.col("_accepted").alias("accepted"), F.col("_toxic").alias("toxic"))
