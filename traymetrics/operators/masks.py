"""Pixel masks as run-length rows (event_id, region_id, item_id, y, x0, x1); x1 is exclusive.

Work is interval algebra keyed by (event, row). One image row holds at most its width in distinct
pixels, which bounds every per-row list below.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traymetrics.functions.geometry import area_estimate, box_area, box_iou, box_to_pixels, clamp_box
from traymetrics.functions.numbers import finite_positive

# fixed values
MERGE_IOU = 0.5
COUNTING_RULE = "smallest-first-v1"
NEIGHBOR_CLIP_MIN_FRACTION = 0.001
EVENT_ROWS = 100_000  # runs of one task


def normalize_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint runs per (keys, y): copies dropped first, touching runs merged."""
    unique = runs.filter(F.col("x1") > F.col("x0")).groupBy(*keys, "y", "x0").agg(F.max("x1").alias("x1"))
    w = Window.partitionBy(*keys, "y").orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = unique.withColumn("_new", F.when(F.col("x0") <= reach, 0).otherwise(1))
    blocks = starts.withColumn("_b", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.groupBy(*keys, "y", "_b").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_b")


def by_event(runs: DataFrame, rows: int) -> DataFrame:
    """Runs dealt by event over as many tasks as their number asks for, so that a task's share stays the same."""
    tasks = max(runs.sparkSession.sparkContext.defaultParallelism, math.ceil(runs.count() / rows))
    return runs.repartition(tasks, "event_id")


def assign_pixels(runs: DataFrame, rows: int = EVENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """G-1: each pixel goes to the smallest region that covers it.

    Ties go by item id (null last), first pixel, then region id. Returns (buckets: event, item,
    pixels; totals: event, union, overlap, unclassified). Rows are split at run boundaries, never
    exploded to pixels. Runs are shuffled once, by event, about
    ``rows`` to a task; an event is one image, so its runs are few.
    """
    region = Window.partitionBy("event_id", "region_id")
    owned = by_event(runs.filter(F.col("event_id").isNotNull() & F.col("region_id").isNotNull()), rows).withColumn("item_id", F.min("item_id").over(region))
    flat = normalize_runs(owned, ["event_id", "region_id", "item_id"])
    order = F.struct(
        F.sum(F.col("x1") - F.col("x0")).over(region).alias("mask_pixels"),
        F.col("item_id").isNull().alias("no_item"),
        F.coalesce("item_id", F.lit("")).alias("item"),
        F.min(F.struct("y", "x0")).over(region).alias("first_pixel"),  # in raster order
        "region_id",
    )
    ranked = flat.select("event_id", "y", "x0", "x1", order.alias("_o")).filter(F.col("y").isNotNull())
    row = Window.partitionBy("event_id", "y")
    edges = F.sort_array(F.array_union(F.collect_set("x0").over(row), F.collect_set("x1").over(row)))  # at most width + 1 numbers
    parts = ranked.withColumn("_edges", edges).select(
        "event_id",
        "y",
        "_o",
        F.explode(
            F.filter(
                F.transform("_edges", lambda e, i: F.struct(e.alias("s"), F.get(F.col("_edges"), i + 1).alias("e"))),
                lambda p: (p["s"] >= F.col("x0")) & (p["s"] < F.col("x1")),
            )
        ).alias("_p"),
    )
    won = (
        parts.groupBy("event_id", "y", F.col("_p.s").alias("s"), F.col("_p.e").alias("e"))
        .agg(F.min("_o").alias("_w"), F.count(F.lit(1)).alias("_n"))
        .select("event_id", F.when(~F.col("_w.no_item"), F.col("_w.item")).alias("item_id"), (F.col("e") - F.col("s")).alias("_len"), "_n")
    )
    per = won.groupBy("event_id", "item_id").agg(
        F.sum("_len").alias("pixels"), F.sum(F.when(F.col("_n") > 1, F.col("_len")).otherwise(0)).alias("_over")
    )
    totals = per.groupBy("event_id").agg(
        F.sum("pixels").alias("union_pixels"),
        F.sum("_over").alias("overlap_pixels"),
        F.coalesce(F.sum(F.when(F.col("item_id").isNull(), F.col("pixels"))), F.lit(0)).alias("unclassified_pixels"),
    )
    return per.drop("_over"), totals


def merge_boxes(boxes: DataFrame, iou: float = MERGE_IOU) -> DataFrame:
    """G-2: keep boxes smallest first, each only if its IoU with every kept box is within the limit.

    ``boxes`` has event_id, pass, idx, item_id, box (x0, y0, x1, y1 in pixels). The boxes of one photo are
    one group. Kept boxes stand under the cells of a grid they reach, and a box is compared only with
    those that share a cell with it.
    """
    b = F.col("box")
    rows = boxes.select("event_id", "pass", "idx", "item_id", box_area(b).alias("area"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}

    def kept(table: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("area", "x0", "y0", "x1", "y1", "item_id", "pass", "idx")]
        table = table.take(pc.sort_indices(table, order, null_placement="at_end"))
        return table.filter(pa.array(_apart(*(table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")), iou)))

    out = rows.groupBy("event_id").applyInArrow(kept, ", ".join([f"{c} {kinds[c]}" for c in ("event_id", "pass", "idx", "item_id")] + [f"{c} double" for c in ("area", "x0", "y0", "x1", "y1")]))
    return out.select("event_id", "pass", "idx", "item_id", F.struct("x0", "y0", "x1", "y1").alias("box"))


def _apart(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, iou: float) -> np.ndarray:
    """Which boxes, taken in order, overlap none taken before them by more than ``iou``."""
    n = len(x0)
    area = (x1 - x0) * (y1 - y0)
    # cells as wide and high as the usual box, so a box reaches a few
    wide, high = (max(float(np.median(d)), 1e-9) if n else 1.0 for d in (x1 - x0, y1 - y0))
    cells: dict[tuple[int, int], list[int]] = {}
    taken = np.zeros(n, bool)
    for i in range(n):
        reach = [(cx, cy) for cx in range(int(x0[i] // wide), int(x1[i] // wide) + 1) for cy in range(int(y0[i] // high), int(y1[i] // high) + 1)]
        near = np.array(sorted({k for c in reach for k in cells.get(c, ())}), np.int64)
        if len(near):
            both = np.maximum(0.0, np.minimum(x1[near], x1[i]) - np.maximum(x0[near], x0[i])) * np.maximum(0.0, np.minimum(y1[near], y1[i]) - np.maximum(y0[near], y0[i]))
            union = area[near] + area[i] - both
            if np.any((union > 0) & (both > 0) & (both / np.where(union > 0, union, 1.0) > iou)):
                continue
        taken[i] = True
        for c in reach:
            cells.setdefault(c, []).append(i)
    return taken


def split_target(pieces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G-3: (counted pieces, pieces on other dishes, per-event counts and flags).

    ``pieces`` carries on_target and box_ok; an unusable box fails its region only when a single
    pass contributed pieces, and unusable boxes of other dishes are ignored.
    """
    sources = pieces.groupBy("event_id").agg((F.min("pass") == F.max("pass")).alias("_single"))
    df = pieces.join(sources, "event_id")
    counted = df.filter(F.col("on_target") & (F.col("box_ok") | F.col("_single"))).drop("_single")
    counted = counted.withColumn("status", F.when(F.col("box_ok"), F.lit("skipped")).otherwise(F.lit("failed")))
    excluded = df.filter(~F.col("on_target") & F.col("box_ok")).drop("_single")
    kept = F.col("on_target") & (F.col("box_ok") | F.col("_single"))
    other = ~F.col("on_target") & F.col("box_ok")
    stats = df.groupBy("event_id").agg(
        F.count_if(kept).alias("counted_boxes"), F.count_if(other).alias("excluded_boxes"), F.bool_or(other).alias("neighbor_food_excluded")
    )
    return counted, excluded, stats


def clip_runs(runs: DataFrame, region: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G-4: (runs inside the event's dish region, kept and removed pixels per region).

    ``region`` has event_id, y, x0, x1; events without one are not clipped here.
    """
    keys = ["event_id", "region_id"]
    flat = normalize_runs(runs, keys)
    r = normalize_runs(region, ["event_id"]).select("event_id", "y", F.col("x0").alias("_r0"), F.col("x1").alias("_r1"))
    inside = (
        flat.join(r, ["event_id", "y"])
        .filter((F.col("x0") < F.col("_r1")) & (F.col("_r0") < F.col("x1")))
        .select(*keys, "y", F.greatest("x0", "_r0").alias("x0"), F.least("x1", "_r1").alias("x1"))
    )
    kept = inside.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("kept_pixels"))
    total = flat.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("_t"))
    counts = total.join(kept, keys, "left").select(
        *keys,
        F.coalesce("kept_pixels", F.lit(0)).alias("kept_pixels"),
        (F.col("_t") - F.coalesce("kept_pixels", F.lit(0))).alias("removed_pixels"),
    )
    return inside, counts


def count_status(regions: DataFrame) -> DataFrame:
    """G-7: count and attempt status of each event from its regions' outcomes.

    ``regions`` has event_id, outcome (counted, failed, outside, other_dish), ambiguous.
    """
    n = regions.groupBy("event_id").agg(
        F.count_if(F.col("outcome") == "counted").alias("counted"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "outside").alias("outside"),
        F.count_if(F.col("outcome") == "other_dish").alias("other_dish"),
        F.bool_or("ambiguous").alias("ambiguous"),
    )
    c, f, o = F.col("counted"), F.col("failed"), F.col("outside")
    return n.withColumn(
        "count_status",
        F.when((c == 0) & (f == 0), F.lit("empty")).when(c == 0, F.lit("unavailable")).when(f > 0, F.lit("partial")).otherwise(F.lit("complete")),
    ).withColumn(
        "status",
        F.when((c == 0) & (f == 0) & (o > 0), F.lit("needs_review"))
        .when((c == 0) & (f == 0), F.lit("succeeded"))
        .when(c == 0, F.lit("failed"))
        .when((f > 0) | F.col("ambiguous"), F.lit("needs_review"))
        .otherwise(F.lit("succeeded")),
    )


def build_measurements(buckets: DataFrame, baselines: DataFrame, cals: DataFrame | None = None) -> DataFrame:
    """G-8: one measurement per non-empty bucket, with the auxiliary baseline ratio and calibrated area.

    ``baselines`` has item_id, baseline_id, expected_area_px; ``cals`` has event_id, calibration_id, cm2_per_px.
    """
    b = baselines.filter(finite_positive("expected_area_px")).select("item_id", "baseline_id", "expected_area_px")
    df = buckets.filter(F.col("pixels") > 0).join(b, "item_id", "left")
    base, px = F.col("expected_area_px"), F.col("pixels")
    df = df.withColumns(
        {
            "raw_waste_fraction": px / base,
            "display_waste_percent": F.least(px / base, F.lit(1.0)) * 100.0,
            "unavailable_reason": F.when(base.isNotNull(), F.lit(None).cast("string"))
            .when(F.col("item_id").isNull(), F.lit("unclassified_food"))
            .otherwise(F.lit("no_baseline_auxiliary_only")),
            "quality_flags": F.array_compact(F.array(F.lit("ai_estimate"), F.when(px / base > 1, F.lit("above_baseline")))),
            "method": F.lit("mask_pixel_count"),
        }
    )
    if cals is not None:
        c = cals.select("event_id", "calibration_id", "cm2_per_px")
        df = df.join(c, "event_id", "left").withColumn("area_cm2", area_estimate(px, "cm2_per_px")).drop("cm2_per_px")
    return df.withColumnRenamed("expected_area_px", "baseline_area_px")


def localization_stats(answers: DataFrame, dishes: DataFrame) -> DataFrame:
    """G-11: boxes per pass, failed passes, and the IoU of the two passes' dish boxes (3 decimals).

    ``answers`` has event_id, pass, boxes (null when the pass failed); ``dishes`` has event_id, pass, box
    (0-1000 order ymin, xmin, ymax, xmax), width_px, height_px; of several boxes of a pass the least counts.
    """
    from traymetrics.functions.numbers import js_round

    per = answers.groupBy("event_id").agg(
        F.max(F.when(F.col("pass") == 1, F.col("boxes"))).alias("pass1_boxes"),
        F.max(F.when(F.col("pass") == 2, F.col("boxes"))).alias("pass2_boxes"),
        F.count_if(F.col("boxes").isNull()).alias("failed_passes"),
    )
    px = dishes.withColumn("_b", box_to_pixels(clamp_box("box"), "width_px", "height_px")).filter(F.col("_b.reason").isNull())
    pair = px.groupBy("event_id").agg(
        F.min(F.when(F.col("pass") == 1, F.col("_b"))).alias("_b1"), F.min(F.when(F.col("pass") == 2, F.col("_b"))).alias("_b2")
    )
    both = F.col("_b1").isNotNull() & F.col("_b2").isNotNull()
    return per.join(pair, "event_id", "left").select(
        *per.columns,
        (F.col("_b1").isNotNull() | F.col("_b2").isNotNull()).alias("dish_found"),
        F.when(both, js_round(box_iou("_b1", "_b2"), 3)).alias("pass_agreement_iou"),
    )


def mask_agreement(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """A-21: per image, true / false positives, misses, IoU, Dice and count errors of two run tables.

    Intersections come from interval overlaps of disjoint runs on (event, y); no pixel is exploded.
    """
    p, t = normalize_runs(pred, ["event_id"]), normalize_runs(truth, ["event_id"])
    size = F.sum(F.col("x1") - F.col("x0"))
    hit = (
        p.join(t.select("event_id", "y", F.col("x0").alias("_t0"), F.col("x1").alias("_t1")), ["event_id", "y"])
        .filter((F.col("x0") < F.col("_t1")) & (F.col("_t0") < F.col("x1")))
        .groupBy("event_id")
        .agg(F.sum(F.least("x1", "_t1") - F.greatest("x0", "_t0")).alias("tp"))
    )
    np_, nt = p.groupBy("event_id").agg(size.alias("_p")), t.groupBy("event_id").agg(size.alias("_q"))
    df = np_.join(nt, "event_id", "full").join(hit, "event_id", "left").na.fill(0, ["_p", "_q", "tp"])
    fp, fn, tp = F.col("_p") - F.col("tp"), F.col("_q") - F.col("tp"), F.col("tp")
    return df.select(
        "event_id",
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
        F.try_divide(tp, tp + fp + fn).alias("iou"),
        F.try_divide(2 * tp, F.col("_p") + F.col("_q")).alias("dice"),
        F.abs(F.col("_p") - F.col("_q")).alias("absolute_error"),
        F.try_divide(F.abs(F.col("_p") - F.col("_q")), F.col("_q")).alias("relative_error"),
    )


def agreement_means(per_image: DataFrame) -> DataFrame:
    """A-21: means over images, one row."""
    return per_image.agg(
        F.count(F.lit(1)).alias("images"), *[F.avg(c).alias(f"mean_{c}") for c in ("iou", "dice", "absolute_error", "relative_error")]
    )


def label_mask_eval(runs: DataFrame, reference: DataFrame, canvas: Column) -> DataFrame:
    """A-28: per (event, label): pieces, union pixels, frame percent, recall and IoU against the reference.

    The fill percent of the convex hull comes from ``images.hull_fill`` on the same runs.
    """
    keys = ["event_id", "label"]
    pieces = runs.groupBy(*keys).agg(F.count_distinct("region_id").alias("pieces"))
    r = normalize_runs(runs, keys)
    q = normalize_runs(reference, keys)
    size = F.sum(F.col("x1") - F.col("x0"))
    hit = (
        r.join(q.select(*keys, "y", F.col("x0").alias("_q0"), F.col("x1").alias("_q1")), [*keys, "y"])
        .filter((F.col("x0") < F.col("_q1")) & (F.col("_q0") < F.col("x1")))
        .groupBy(*keys)
        .agg(F.sum(F.least("x1", "_q1") - F.greatest("x0", "_q0")).alias("_hit"))
    )
    df = (
        r.groupBy(*keys).agg(size.alias("pixels"))
        .join(pieces, keys)
        .join(q.groupBy(*keys).agg(size.alias("_ref")), keys, "left")
        .join(hit, keys, "left")
    )
    h = F.when(F.col("_ref").isNotNull(), F.coalesce("_hit", F.lit(0)))
    return df.select(
        *keys,
        "pieces",
        "pixels",
        (F.lit(100.0) * F.col("pixels") / canvas).alias("frame_percent"),
        F.try_divide(h, F.col("_ref")).alias("recall"),
        F.try_divide(h, F.col("pixels") + F.col("_ref") - h).alias("iou"),
    )
