"""Per-image work that needs Python: dish regions, reference masks, photo metrics, mask decoding.

Spark groups the runs by image; each task call sees one image, whose size bounds its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.session import materialize

# fixed values
MIN_BOX_COVERAGE, MIN_REGION_FRACTION, MAX_REGION_FRACTION, BOX_MARGIN_FRACTION = 0.5, 0.02, 0.95, 0.05
SPECK_FRAME_FRACTION, SPECK_LARGEST_FRACTION = 0.0005, 0.02
REFERENCE_MARGIN_FRACTION, REFERENCE_LARGEST_FRACTION = 0.02, 0.1


def merge_intervals(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def rows_by_y(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    rows: dict[int, list[tuple[int, int]]] = {}
    for yy, a, b in zip(y.tolist(), x0.tolist(), x1.tolist()):
        rows.setdefault(yy, []).append((a, b))
    return {k: merge_intervals(v) for k, v in rows.items()}


def crop(rows: dict, x0: int, y0: int, x1: int, y1: int) -> dict:
    out = {}
    for y, spans in rows.items():
        if y0 <= y < y1:
            kept = [(max(a, x0), min(b, x1)) for a, b in spans if a < x1 and b > x0]
            if kept:
                out[y] = kept
    return out


def drop_specks(rows: dict, min_pixels: float, largest_fraction: float) -> dict:
    """Remove 4-connected pieces below a size; runs of neighboring rows connect where they overlap."""
    nodes = [(y, a, b) for y in sorted(rows) for a, b in rows[y]]
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    index: dict[int, list[int]] = {}
    for i, (y, _, _) in enumerate(nodes):
        index.setdefault(y, []).append(i)
    for y, below in index.items():
        above = index.get(y - 1, [])
        j = 0
        for i in below:
            _, a, b = nodes[i]
            while j < len(above) and nodes[above[j]][2] <= a:
                j += 1
            k = j
            while k < len(above) and nodes[above[k]][1] < b:
                parent[root(above[k])] = root(i)
                k += 1
    size: dict[int, int] = {}
    for i, (_, a, b) in enumerate(nodes):
        size[root(i)] = size.get(root(i), 0) + b - a
    if not size:
        return {}
    least = max(min_pixels, largest_fraction * max(size.values()), 1)
    out: dict[int, list[tuple[int, int]]] = {}
    for i, (y, a, b) in enumerate(nodes):
        if size[root(i)] >= least:
            out.setdefault(y, []).append((a, b))
    return out


def hull_rows(rows: dict, width: int) -> dict:
    """Filled convex hull of the pixel centres, as one run per row."""
    pts = sorted({p for y, spans in rows.items() for p in ((spans[0][0], y), (spans[-1][1] - 1, y))})
    if not pts:
        return {}

    def chain(points):
        out: list[tuple[int, int]] = []
        for px, py in points:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (py - out[-2][1]) - (out[-1][1] - out[-2][1]) * (px - out[-2][0]) <= 0:
                out.pop()
            out.append((px, py))
        return out

    corners = chain(pts)[:-1] + chain(pts[::-1])[:-1] or pts[:1]
    ys = range(min(p[1] for p in corners), max(p[1] for p in corners) + 1)
    lo, hi = {y: np.inf for y in ys}, {y: -np.inf for y in ys}
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        if ay == by:
            lo[ay], hi[ay] = min(lo[ay], ax, bx), max(hi[ay], ax, bx)
            continue
        for y in range(min(ay, by), max(ay, by) + 1):
            x = ax + (y - ay) * (bx - ax) / (by - ay)
            lo[y], hi[y] = min(lo[y], x), max(hi[y], x)
    out = {}
    for y in ys:
        a, b = max(0, int(np.ceil(lo[y] - 1e-9))), min(width - 1, int(np.floor(hi[y] + 1e-9)))
        if a <= b:
            out[y] = [(a, b + 1)]
    return out


def dilate(rows: dict, width: int, height: int, r: int) -> dict:
    """Square dilation by r pixels."""
    spread: dict[int, list[tuple[int, int]]] = {}
    for y, spans in rows.items():
        wide = [(max(0, a - r), min(width, b + r)) for a, b in spans]
        for k in range(max(0, y - r), min(height, y + r + 1)):
            spread.setdefault(k, []).extend(wide)
    return {y: merge_intervals(v) for y, v in spread.items()}


def count(rows: dict) -> int:
    return sum(b - a for spans in rows.values() for a, b in spans)


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def ellipse_rows(box, grow: int, width: int, height: int) -> dict:
    """Pixels whose centre lies in the ellipse inscribed in the box, grown by some pixels."""
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    rx, ry = (box[2] - box[0]) / 2 + grow, (box[3] - box[1]) / 2 + grow
    if rx <= 0 or ry <= 0:
        return {}
    xs = np.arange(max(0, int(np.floor(cx - rx))), min(width - 1, int(np.ceil(cx + rx))) + 1)
    dx = ((xs + 0.5 - cx) / rx) ** 2
    out = {}
    for y in range(max(0, int(np.floor(cy - ry))), min(height - 1, int(np.ceil(cy + ry))) + 1):
        hit = xs[dx + ((y + 0.5 - cy) / ry) ** 2 <= 1]
        if hit.size:
            out[y] = [(int(hit[0]), int(hit[-1]) + 1)]
    return out


def dish_region(rows: dict, width: int, height: int, box) -> tuple[dict, int, str | None]:
    """(region rows, region pixels, reason when unusable) of one dish mask and its pixel box."""
    grow = max(2, half_up(0.01 * max(width, height)))
    margin = max(grow, BOX_MARGIN_FRACTION * max(box[2] - box[0], box[3] - box[1]))
    cut = crop(
        rows,
        max(0, int(np.floor(box[0] - margin))),
        max(0, int(np.floor(box[1] - margin))),
        min(width, int(np.ceil(box[2] + margin))),
        min(height, int(np.ceil(box[3] + margin))),
    )
    kept = drop_specks(cut, SPECK_FRAME_FRACTION * width * height, SPECK_LARGEST_FRACTION)
    if not kept:
        return {}, 0, "dish_mask_empty"
    region = dilate(hull_rows(kept, width), width, height, grow)
    px, frame = count(region), width * height
    in_frame = max(0.0, min(width, box[2]) - max(0.0, box[0])) * max(0.0, min(height, box[3]) - max(0.0, box[1]))
    for bad, reason in (
        (px < MIN_REGION_FRACTION * frame, "region_too_small"),
        (px > MAX_REGION_FRACTION * frame, "region_too_large"),
        (px < MIN_BOX_COVERAGE * in_frame, "region_incomplete"),
    ):
        if bad:
            return {}, px, reason
    for y, spans in ellipse_rows(box, grow, width, height).items():
        region[y] = merge_intervals(region.get(y, []) + spans)
    return region, count(region), None


def _per_image(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per image with its distinct runs as three arrays (as long as the image has runs)."""
    packed = runs.groupBy(*keys).agg(F.collect_set(F.struct("y", "x0", "x1")).alias("_r"))
    return packed.select(*keys, F.col("_r.y").alias("ys"), F.col("_r.x0").alias("x0s"), F.col("_r.x1").alias("x1s"))


def _with_boxes(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    b = boxes.select("event_id", "bx0", "by0", "bx1", "by1", "width_px", "height_px")
    return b.join(_per_image(runs, ["event_id"]), "event_id", "left")


def _rows(r) -> dict:
    return {} if r.ys is None else rows_by_y(np.asarray(r.ys), np.asarray(r.x0s), np.asarray(r.x1s))


def dish_regions(dish_runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """G-5: the clip region of each image as runs; an unusable region gives one row with its reason.

    ``boxes`` has event_id, bx0, by0, bx1, by1 (pixels), width_px, height_px.
    """
    kind = dict(boxes.dtypes)["event_id"]
    cols = ["event_id", "y", "x0", "x1", "region_px", "reason"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                region, px, reason = dish_region(_rows(r), int(r.width_px), int(r.height_px), (r.bx0, r.by0, r.bx1, r.by1))
                if reason is not None:
                    out.append((r.event_id, None, None, None, px, reason))
                else:
                    out.extend((r.event_id, y, a, b, px, None) for y in sorted(region) for a, b in region[y])
            yield pd.DataFrame(out, columns=cols)

    schema = f"event_id {kind}, y int, x0 int, x1 int, region_px long, reason string"
    return _with_boxes(dish_runs, boxes).mapInPandas(build, schema)


def reference_masks(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """G-6: cleaned reference area of each calibration frame: pixels, edge touch and box fill."""
    kind = dict(boxes.dtypes)["event_id"]

    def one(r):
        w, h = int(r.width_px), int(r.height_px)
        m = REFERENCE_MARGIN_FRACTION * max(r.bx1 - r.bx0, r.by1 - r.by0) + 1
        x0, y0 = max(0, int(np.floor(r.bx0 - m))), max(0, int(np.floor(r.by0 - m)))
        x1, y1 = min(w, int(np.ceil(r.bx1 + m))), min(h, int(np.ceil(r.by1 + m)))
        hull = hull_rows(drop_specks(crop(_rows(r), x0, y0, x1, y1), 0, REFERENCE_LARGEST_FRACTION), w)
        n = count(hull)
        edge = 0 in hull or h - 1 in hull or any(s[0][0] == 0 or s[-1][1] == w for s in hull.values())
        area = (r.bx1 - r.bx0) * (r.by1 - r.by0)
        return r.event_id, n, bool(edge), n / area if area > 0 else None

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=["event_id", "reference_pixels", "touches_edge", "box_fill"])

    return _with_boxes(runs, boxes).mapInPandas(clean, f"event_id {kind}, reference_pixels long, touches_edge boolean, box_fill double")


def hull_fill(runs: DataFrame, keys: list[str], width: int) -> DataFrame:
    """A-28: share of its convex hull that each group's union covers, in percent."""
    types = dict(runs.dtypes)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_rows(r) for r in pdf.itertuples(index=False)]
            yield pdf[keys].assign(fill_percent=[100.0 * count(r) / count(hull_rows(r, width)) for r in rows])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", fill_percent double"
    return _per_image(runs, keys).mapInPandas(fill, schema)


def grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Luminance of raw image bytes (grey, or blue-green-red)."""
    px = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return px[:, :, 0]
    return 0.114 * px[:, :, 0] + 0.587 * px[:, :, 1] + 0.299 * px[:, :, 2]


def photo_metrics(images: DataFrame) -> DataFrame:
    """G-9: mean luminance and variance of the 4-neighbour Laplacian, one image per row.

    ``images`` has id, height, width, nChannels, data as the image source gives them. The images are
    measured at their own size (the reference first shrinks them), so thresholds need retuning.
    """
    kind = dict(images.dtypes)["id"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g = grey(r.height, r.width, r.nChannels, r.data)
                lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
                n = lap.size
                sharp = float((lap * lap).sum() / n - (lap.sum() / n) ** 2) if n else 0.0
                out.append((r.id, r.width, r.height, float(g.mean()) if g.size else 0.0, sharp))
            yield pd.DataFrame(out, columns=["id", "width_px", "height_px", "brightness", "sharpness"])

    return images.select("id", "height", "width", "nChannels", "data").mapInPandas(
        measure, f"id {kind}, width_px int, height_px int, brightness double, sharpness double"
    )


def _mask_fault(px: np.ndarray, on: np.ndarray, want: tuple[int, int], declared: int) -> str | None:
    """Why a decoded mask (height, width, channels) is rejected; ``on`` marks its pixels of 255."""
    total = int(on.sum())
    faults = {
        "mask_dimension_mismatch": lambda: (px.shape[1], px.shape[0]) != want,
        "mask_not_greyscale": lambda: (px != px[:, :, :1]).any(),
        "mask_not_binary": lambda: ((px[:, :, 0] != 0) & ~on).any(),
        "mask_empty": lambda: total == 0,
        "mask_count_mismatch": lambda: total != declared,
    }
    return next((name for name, holds in faults.items() if holds()), None)


def mask_runs(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-10: (runs, rejects) of mask images that must match their declared size and pixel count.

    ``images`` has id, height, width, nChannels, data, want_width, want_height, declared_pixels.
    A mask may hold only 0 and 255; any other value is rejected, never thresholded. Images are decoded
    once, for both results, and leave the task one at a time.
    """
    kind = dict(images.dtypes)["id"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                height, width, channels, data, *want, declared = (c[k].as_py() for c in batch.columns[1:])
                px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                on = px[:, :, 0] == 255
                reason = _mask_fault(px, on, tuple(want), declared)
                if reason is None:
                    edges = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                    (y, x0), x1 = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
                    places = [pa.array(v.astype(np.int32)) for v in (y, x0, x1)]
                else:
                    places = [pa.nulls(1, pa.int32())] * 3
                n = len(places[0])
                ids = batch.column(0).take(pa.array(np.full(n, k)))
                yield pa.RecordBatch.from_arrays([ids, *places, pa.array([reason] * n, pa.string())], ["id", "y", "x0", "x1", "reason"])

    df = images.select("id", "height", "width", "nChannels", "data", "want_width", "want_height", "declared_pixels")
    df = materialize(df.mapInArrow(decode, f"id {kind}, y int, x0 int, x1 int, reason string"))
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull()).select("id", "reason")
