"""Bit maps of shingle sets: they tell most pairs apart and never two similar sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traymetrics.llm import similar


def sets_of(seed):
    """Sets of 1 to 900 hashes, each a changed copy of an earlier one or new."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        if out and rng.random() < 0.6:
            old = out[rng.integers(len(out))]
            kept = old[rng.random(len(old)) < rng.choice([0.5, 0.85, 0.95])]
            new = rng.integers(0, 1 << 63, rng.integers(0, 1 + len(old) // 8), dtype=np.uint64)
            each = np.unique(np.concatenate([kept, new]))
        else:
            each = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64))
        out.append(each if len(each) else np.array([7], np.uint64))
    return out


def test_each_hash_has_its_place():
    sets = sets_of(1)
    first = np.cumsum([0, *map(len, sets)])
    hashes = np.concatenate(sets)
    before = hashes.copy()
    words, begins = similar.bit_maps(hashes, first)
    assert (hashes == before).all()
    for k, each in enumerate(sets):
        places = 64 * (begins[k + 1] - begins[k])
        assert similar.BITS * len(each) <= places and (places == 64 or places < 2 * similar.BITS * len(each))
        taken = {int(h) % int(places) for h in similar.mix(each.copy())}
        assert taken == {i for i in range(places) if int(words[begins[k] + i // 64]) >> (i % 64) & 1}


@pytest.mark.parametrize("similarity", [0.8, 0.3])
def test_similar_sets_are_never_told_apart(spark, similarity):
    sets = sets_of(2)
    words, begins = similar.bit_maps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    rows = [(k, len(s), [int(w) for w in words[begins[k] : begins[k + 1]].view(np.int64)]) for k, s in enumerate(sets)]
    found = spark.createDataFrame(rows + rows[:5], "node long, n long, map array<long>")
    pairs = spark.range(len(sets)).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id"), F.lit(len(sets)))).alias("b")).filter(f"a < b and b < {len(sets)}")
    kept = {tuple(r) for r in similar._told_apart(pairs, found, similarity).collect()}
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    near = {k for k, v in both.items() if v >= similarity * (len(sets[k[0]]) + len(sets[k[1]]) - v)}
    assert near and near <= kept
    assert len(kept) < len(both) / 2
