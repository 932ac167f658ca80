"""Which captures and measurements count, and the first reason why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.functions.geometry import COORDINATE_SPACE, positive_int, same_geometry
from traymetrics.functions.numbers import finite_nonneg, finite_positive, is_finite

# fixed values
DISQUALIFYING_FLAGS = ["blurred", "no_plate", "multiple_dishes", "incompatible_geometry", "ambiguous_items"]
MEASUREMENT_REASONS = ["unknown_item", "invalid_remaining", "missing_baseline", "invalid_baseline", "above_baseline"]


def measurement_reason() -> Column:
    """V-1: first failing reason of a measurement; null when it counts."""
    frac = F.col("raw_waste_fraction")
    return (
        F.when(F.col("item_id").isNull() | (F.col("item_id") == ""), F.lit("unknown_item"))
        .when(~finite_nonneg("remaining_area_px"), F.lit("invalid_remaining"))
        .when(F.col("baseline_area_px").isNull(), F.lit("missing_baseline"))
        .when(~finite_positive("baseline_area_px"), F.lit("invalid_baseline"))
        .when(F.array_contains("quality_flags", "above_baseline"), F.lit("above_baseline"))
        .when(is_finite(frac) & (frac > 1), F.lit("above_baseline"))
    )


def capture_reason() -> Column:
    """V-2: why a capture does not count; null when it does."""
    return F.when(F.col("state") != "succeeded", F.lit("capture_not_succeeded")).when(
        ~F.coalesce(F.col("geometry.coordinate_space") == COORDINATE_SPACE, F.lit(False)), F.lit("incompatible_geometry")
    )


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def valid_mask_count(mask="mask_count", geometry="geometry", capture_flags="capture_flags", menu_id="menu_id", menu_version="menu_version") -> Column:
    """V-3: a validated exclusive mask with full provenance for this capture and menu version."""
    m, g = F.col(mask), F.col(geometry)
    px = m["pixels_wasted"]
    disq = F.array(*[F.lit(v) for v in DISQUALIFYING_FLAGS])
    rule = (
        (F.col("method") == "mask_pixel_count")
        & m["validated"]
        & (m["assignment"] == "exclusive")
        & (px >= 0)
        & positive_int(g["width_px"])
        & positive_int(g["height_px"])
        & (px <= g["width_px"] * g["height_px"])
        & (g["coordinate_space"] == COORDINATE_SPACE)
        & same_geometry(m["geometry"], g)
        & (m["menu_id"] == F.col(menu_id))
        & (m["menu_version"] == F.col(menu_version))
        & ~_blank(m["mask_object_id"])
        & ~_blank(m["classification_version"])
        & ~_blank(m["segmentation_version"])
        & ~_blank(m["processing_version"])
        & ~F.arrays_overlap(F.coalesce(F.col(capture_flags), F.array().cast("array<string>")), disq)
        & ~F.arrays_overlap(F.coalesce(F.col("quality_flags"), F.array().cast("array<string>")), disq)
    )
    return F.coalesce(rule, F.lit(False))


def summary_reason() -> Column:
    """V-4: the summary view's own order (invalid first, ratio computed when absent)."""
    ratio = F.coalesce(F.col("raw_waste_fraction"), F.when(F.col("baseline_area_px") > 0, F.col("remaining_area_px") / F.col("baseline_area_px")))
    return (
        F.when(~finite_nonneg("remaining_area_px"), F.lit("invalid_value"))
        .when(F.col("item_id").isNull(), F.lit("unknown_item"))
        .when(~finite_positive("baseline_area_px"), F.lit("missing_baseline"))
        .when(ratio > 1, F.lit("above_baseline"))
    )


def visible_captures(captures: DataFrame, visibility: DataFrame, views: DataFrame) -> DataFrame:
    """V-20: hidden captures out, captures before the hall's cutoff out."""
    hidden = visibility.filter("hidden").select("event_id")
    cutoffs = views.filter(F.col("cleared_at").isNotNull()).select("hall_id", F.col("cleared_at").alias("_cut"))
    return (
        captures.join(hidden, "event_id", "left_anti")
        .join(cutoffs, "hall_id", "left")
        .filter(F.col("_cut").isNull() | (F.col("captured_at") >= F.col("_cut")))
        .drop("_cut")
    )


def retryable_captures(captures: DataFrame, visibility: DataFrame) -> DataFrame:
    """V-21: failed or needs-review captures, hidden ones included and marked."""
    marks = visibility.select("event_id", F.col("hidden").alias("_h"))
    return (
        captures.filter(F.col("state").isin("failed", "needs_review"))
        .join(marks, "event_id", "left")
        .withColumn("hidden", F.coalesce("_h", F.lit(False)))
        .drop("_h")
    )


def find_orphans(images: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    """V-22: uploads that never became final and are older than the limit (unknown time is old)."""
    asked = F.coalesce(F.col("requested_at"), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    old = asked <= now - F.make_dt_interval(secs=F.lit(max_age_seconds))
    return images.filter(F.col("state").isin("pending_upload", "uploaded", "failed") & old)
