"""Masks and images against brute-force bitmaps."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from traymetrics.operators import images as M
from traymetrics.operators import masks as K

RUNS = "event_id string, region_id string, item_id string, y int, x0 int, x1 int"


def test_smallest_region_takes_the_pixel(spark):
    runs = spark.createDataFrame(
        [("e", "r1", "a", 0, 0, 6), ("e", "r2", "b", 0, 4, 8), ("e", "r3", "a", 0, 0, 2), ("e", "r4", None, 0, 7, 10), ("e", "r1", "a", 0, 0, 6)], RUNS
    )
    buckets, totals = K.assign_pixels(runs)
    assert {r.item_id: r.pixels for r in buckets.collect()} == {"a": 4, "b": 3, None: 3}
    t = totals.first()
    assert (t.union_pixels, t.overlap_pixels, t.unclassified_pixels) == (10, 5, 3)


def test_tasks_of_pixel_assignment_grow_with_the_runs(spark):
    rng = np.random.default_rng(11)
    rows = [
        (None if a == 9 else f"e{a}", None if b == 7 else f"r{b}", None if b == 3 else f"i{b % 4}", None if c == 5 else int(c), int(x), int(x + n))
        for a, b, c, x, n in zip(rng.integers(0, 10, 1500), rng.integers(0, 8, 1500), rng.integers(0, 6, 1500), rng.integers(0, 30, 1500), rng.integers(-1, 6, 1500))
    ]
    rows += rows[:200]
    buckets, totals = K.assign_pixels(spark.createDataFrame(rows, RUNS), rows=50)
    assert buckets.rdd.getNumPartitions() >= 20  # about 1,300 runs have an event and a region
    masks = {}
    for e, r, item, y, x0, x1 in rows:
        if e and r:
            masks.setdefault((e, r, item), set()).update((-1 if y is None else y, x) for x in range(x0, x1))
    expected, over = {}, {}
    for e, y, x in {(e, *p) for (e, _, _), px in masks.items() for p in px if p[0] >= 0}:
        on = [(len(px), item is None, item or "", min(px), r) for (k, r, item), px in masks.items() if k == e and (y, x) in px]
        key = (e, min(on)[2] or None)
        expected[key] = expected.get(key, 0) + 1
        over[e] = over.get(e, 0) + (len(on) > 1)
    assert {(b.event_id, b.item_id): b.pixels for b in buckets.collect()} == expected
    assert {t.event_id: t.overlap_pixels for t in totals.collect()} == over


def test_merge_keeps_smaller_of_two_heavy_overlaps(spark):
    rows = [("e", 1, 0, "a", (0.0, 0.0, 10.0, 10.0)), ("e", 2, 0, "b", (1.0, 1.0, 10.0, 10.0)), ("e", 1, 1, None, (50.0, 50.0, 60.0, 60.0))]
    df = spark.createDataFrame(rows, "event_id string, pass int, idx int, item_id string, box struct<x0: double, y0: double, x1: double, y1: double>")
    assert {(r["pass"], r.idx, r.item_id) for r in K.merge_boxes(df).collect()} == {(2, 0, "b"), (1, 1, None)}


def test_ten_thousand_boxes_of_one_photo(spark):
    rng = np.random.default_rng(5)
    x, y, w, h = rng.integers(0, 4000, 10_000), rng.integers(0, 3000, 10_000), rng.choice([1, 20, 60, 900], 10_000), rng.choice([2, 20, 60, 700], 10_000)
    rows = [("e", 1, k, None if k % 3 else f"i{k % 7}", tuple(map(float, (a, b, a + c, b + d)))) for k, (a, b, c, d) in enumerate(zip(x, y, w, h))] + [("f", 1, k, "i", (0.0, 0.0, 10.0, 10.0)) for k in range(2_000)]
    df = spark.createDataFrame(rows, "event_id string, pass int, idx int, item_id string, box struct<x0: double, y0: double, x1: double, y1: double>")
    begun = time.time()
    got = {(r.event_id, r.idx) for r in K.merge_boxes(df).collect()}
    assert time.time() - begun < 30
    box = np.array([r[4] for r in rows[:10_000]])
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    kept = np.zeros(0, int)
    for k in sorted(range(10_000), key=lambda k: (area[k], *box[k], rows[k][3] is None, rows[k][3] or "", k)):
        a, b = box[kept], box[k]
        both = np.maximum(0, np.minimum(a[:, 2], b[2]) - np.maximum(a[:, 0], b[0])) * np.maximum(0, np.minimum(a[:, 3], b[3]) - np.maximum(a[:, 1], b[1]))
        if not np.any(both / (area[kept] + area[k] - both) > 0.5):
            kept = np.append(kept, k)
    assert got == {("e", int(k)) for k in kept} | {("f", 0)}


def to_rows(bitmap):
    out = []
    for y in range(bitmap.shape[0]):
        edges = np.diff(np.concatenate(([0], bitmap[y].astype(int), [0])))
        out += [(y, int(a), int(b)) for a, b in zip(np.where(edges == 1)[0], np.where(edges == -1)[0])]
    return out


def from_rows(rows, h, w):
    out = np.zeros((h, w), bool)
    for y, spans in rows.items():
        for a, b in spans:
            out[y, a:b] = True
    return out


def components(b):
    label, n = np.zeros(b.shape, int), 0
    for y, x in zip(*np.where(b)):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        label[y, x] = n
        while stack:
            i, j = stack.pop()
            for p, q in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= p < b.shape[0] and 0 <= q < b.shape[1] and b[p, q] and not label[p, q]:
                    label[p, q] = n
                    stack.append((p, q))
    return label, n


def hull_brute(b):
    """A pixel is in the hull when no line through two foreground pixels strictly separates it."""
    pts = np.argwhere(b)[:, ::-1]
    out = np.zeros_like(b)
    for y in range(b.shape[0]):
        for x in range(b.shape[1]):
            d = pts - np.array([x, y])
            if (d == 0).all(1).any():
                out[y, x] = True
                continue
            ang = np.sort(np.arctan2(d[:, 1], d[:, 0]))
            gaps = np.diff(np.concatenate((ang, [ang[0] + 2 * math.pi])))
            out[y, x] = gaps.max() <= math.pi + 1e-9
    return out


@pytest.mark.parametrize("seed", range(6))
def test_region_steps_match_bitmaps(seed):
    rng = np.random.default_rng(seed)
    h, w = 20, 26
    b = rng.random((h, w)) < 0.25
    b[5:12, 6:15] = True
    a = np.array(to_rows(b))
    rows = M.rows_by_y(a[:, 0], a[:, 1], a[:, 2])
    label, n = components(b)
    sizes = np.bincount(label.ravel(), minlength=n + 1)
    keep = [k for k in range(1, n + 1) if sizes[k] >= max(3, 0.1 * sizes[1:].max())]
    kept = M.drop_specks(rows, 3, 0.1)
    assert (from_rows(kept, h, w) == np.isin(label, keep)).all()
    hull = M.hull_rows(kept, w)
    assert (from_rows(hull, h, w) == hull_brute(np.isin(label, keep))).all()
    wide = from_rows(M.dilate(rows, w, h, 2), h, w)
    padded = np.pad(b, 2)
    want = np.zeros_like(b)
    for dy in range(5):
        for dx in range(5):
            want |= padded[dy : dy + h, dx : dx + w]
    assert (wide == want).all()


def test_thin_hull_and_dish_region(spark):
    assert M.hull_rows({0: [(0, 1)], 1: [(9, 10)]}, 12) == {0: [(0, 1)], 1: [(9, 10)]}
    runs = spark.createDataFrame([("d", y, 30, 90) for y in range(30, 90)] + [("bad", 5, 5, 6)], "event_id string, y int, x0 int, x1 int")
    boxes = spark.createDataFrame([("d", 28.0, 28.0, 92.0, 92.0, 128, 128), ("bad", 60.0, 60.0, 100.0, 100.0, 128, 128), ("none", 0.0, 0.0, 50.0, 50.0, 128, 128)], "event_id string, bx0 double, by0 double, bx1 double, by1 double, width_px int, height_px int")
    got = {r.event_id: (r.px, r.reason) for r in M.dish_regions(runs, boxes).groupBy("event_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("px"), F.max("reason").alias("reason")).collect()}
    assert got["bad"] == (None, "dish_mask_empty") and got["none"] == (None, "dish_mask_empty")
    square = np.zeros((128, 128), bool)
    square[28:92, 28:92] = True
    yy, xx = np.mgrid[0:128, 0:128]
    r = 32 + 2
    square |= ((xx + 0.5 - 60) / r) ** 2 + ((yy + 0.5 - 60) / r) ** 2 <= 1
    assert got["d"] == (int(square.sum()), None)


def test_reference_mask_and_fill(spark):
    runs = spark.createDataFrame([("k", y, 0, 50) for y in range(0, 40)] + [("m", y, 20, 60) for y in range(20, 60)], "event_id string, y int, x0 int, x1 int")
    boxes = spark.createDataFrame([("k", 0.0, 0.0, 50.0, 40.0, 100, 100), ("m", 18.0, 18.0, 62.0, 62.0, 100, 100)], "event_id string, bx0 double, by0 double, bx1 double, by1 double, width_px int, height_px int")
    got = {r.event_id: (r.reference_pixels, r.touches_edge) for r in M.reference_masks(runs, boxes).collect()}
    assert got == {"k": (2000, True), "m": (1600, False)}
    corner = spark.createDataFrame([("e", "a", y, 0, 10 - y) for y in range(10)], "event_id string, label string, y int, x0 int, x1 int")
    assert M.hull_fill(corner, ["event_id", "label"], 20).first().fill_percent == 100.0


def test_mask_decode_rejects(spark):
    data = lambda *v: bytearray(v)
    rows = [("ok", 2, 3, 1, data(0, 255, 255, 0, 0, 255), 3, 2, 3), ("soft", 1, 2, 1, data(7, 255), 2, 1, 1), ("empty", 1, 2, 1, data(0, 0), 2, 1, 0), ("count", 1, 2, 1, data(255, 255), 2, 1, 1), ("size", 1, 2, 1, data(0, 255), 9, 1, 1), ("color", 1, 1, 3, data(255, 0, 255), 1, 1, 1)]
    df = spark.createDataFrame(rows, "id string, height int, width int, nChannels int, data binary, want_width int, want_height int, declared_pixels int")
    runs, rejects = M.mask_runs(df)
    assert {(r.id, r.y, r.x0, r.x1) for r in runs.collect()} == {("ok", 0, 1, 3), ("ok", 1, 2, 3)}
    assert {r.id: r.reason for r in rejects.collect()} == {"soft": "mask_not_binary", "empty": "mask_empty", "count": "mask_count_mismatch", "size": "mask_dimension_mismatch", "color": "mask_not_greyscale"}
