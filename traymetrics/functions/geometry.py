"""Image geometry, boxes, calibration and waste-ratio expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from traymetrics.functions.numbers import as_col, finite_positive, is_finite, js_round

# fixed values
COORDINATE_SPACE = "topdown-normalized-v1"
NATIVE_WIDTH_PX, NATIVE_HEIGHT_PX, DIAGONAL_FOV_DEG = 1920, 1080, 78.0
MIN_REFERENCE_PX, MIN_SCORE, MIN_BOX_FILL, MAX_REFERENCE_FRACTION = 1000, 0.85, 0.35, 0.6


def geometry_key(g="geometry") -> Column:
    """F-28, count form: '1024x1024 topdown-normalized-v1'."""
    c = as_col(g)
    return F.concat(
        c["width_px"].cast("string"), F.lit("x"), c["height_px"].cast("string"), F.lit(" "), c["coordinate_space"]
    )


def geometry_json(g="geometry") -> Column:
    """F-28, provenance form: a JSON list of the five fields, nulls kept."""
    c = as_col(g)

    def text(v: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), v, F.lit('"')), F.lit("null"))

    def num(v: Column) -> Column:
        return F.coalesce(v.cast("string"), F.lit("null"))

    return F.concat(
        F.lit("["),
        F.concat_ws(
            ",", text(c["coordinate_space"]), num(c["width_px"]), num(c["height_px"]), text(c["plate_shape"]), num(c["plate_diameter_px"])
        ),
        F.lit("]"),
    )


def same_geometry(a, b) -> Column:
    """Null-safe equality of the five geometry fields."""
    x, y = as_col(a), as_col(b)
    out = F.lit(True)
    for f in ("coordinate_space", "width_px", "height_px", "plate_shape", "plate_diameter_px"):
        out = out & x[f].eqNullSafe(y[f])
    return out


def positive_int(c) -> Column:
    x = as_col(c).cast("double")
    return finite_positive(x) & F.coalesce(x == F.floor(x), F.lit(False))


def geometry_ok(g="geometry") -> Column:
    """V-7 geometry part."""
    c = as_col(g)
    diameter = c["plate_diameter_px"]
    fits = diameter.isNull() | (finite_positive(diameter) & (diameter <= F.greatest(c["width_px"], c["height_px"])))
    return (
        F.coalesce(c["coordinate_space"] == COORDINATE_SPACE, F.lit(False))
        & positive_int(c["width_px"])
        & positive_int(c["height_px"])
        & (c["plate_shape"].isNull() | c["plate_shape"].isin("round", "tray", "other"))
        & F.coalesce(fits, F.lit(False))
    )


def max_plausible_area(g="geometry") -> Column:
    """F-27: the canvas, or the plate disc when it is smaller."""
    c = as_col(g)
    canvas = (c["width_px"] * c["height_px"]).cast("double")
    return F.least(canvas, F.coalesce(F.pi() * F.pow(c["plate_diameter_px"] / 2.0, F.lit(2.0)), canvas))


def waste_parts(px, baseline, estimated_baseline: Column | None = None) -> dict[str, Column]:
    """F-22: ratio, clamped percent, flags and reason for one measured item."""
    p, b = as_col(px).cast("double"), as_col(baseline).cast("double")
    ok = finite_positive(b)
    raw = F.when(ok, p / b)
    est = F.lit(False) if estimated_baseline is None else estimated_baseline
    flags = F.array_compact(
        F.array(
            F.lit("ai_estimate"),
            F.when(~ok, F.lit("missing_baseline")),
            F.when(ok & est, F.lit("estimated_baseline")),
            F.when(raw > 1, F.lit("above_baseline")),
        )
    )
    return {
        "raw_waste_fraction": raw,
        "display_waste_percent": F.when(ok, F.lit(100.0) * F.least(F.greatest(p / b, F.lit(0.0)), F.lit(1.0))),
        "quality_flags": flags,
        "unavailable_reason": F.when(b.isNull(), F.lit("missing_baseline")).when(~ok, F.lit("invalid_baseline")),
    }


def clamp_box(box) -> Column:
    return F.transform(as_col(box), lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1000.0)))


def box_to_pixels(box, width, height) -> Column:
    """F-23: [ymin, xmin, ymax, xmax] on 0-1000 to pixel x0, y0, x1, y1 with a reject reason."""
    b, w, h = as_col(box), as_col(width).cast("double"), as_col(height).cast("double")
    four = F.coalesce(F.size(b) == 4, F.lit(False))
    at = lambda i: F.get(b, F.lit(i))
    ymin, xmin, ymax, xmax = at(0), at(1), at(2), at(3)
    finite = is_finite(ymin) & is_finite(xmin) & is_finite(ymax) & is_finite(xmax)
    in_range = F.forall(b, lambda v: (v >= 0) & (v <= 1000))
    ordered = (xmax > xmin) & (ymax > ymin)
    x0, y0, x1, y1 = xmin * w / 1000.0, ymin * h / 1000.0, xmax * w / 1000.0, ymax * h / 1000.0
    reason = (
        F.when(~four, F.lit("box_not_4_numbers"))
        .when(~finite, F.lit("box_nonfinite"))
        .when(~F.coalesce(in_range, F.lit(False)), F.lit("box_out_of_range"))
        .when(~ordered, F.lit("box_reversed_or_empty"))
        .when(((x1 - x0) < 1) | ((y1 - y0) < 1), F.lit("box_under_one_pixel"))
    )
    keep = lambda v: F.when(reason.isNull(), v)
    return F.struct(
        keep(x0).alias("x0"), keep(y0).alias("y0"), keep(x1).alias("x1"), keep(y1).alias("y1"), reason.alias("reason")
    )


def box_area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def box_iou(a, b) -> Column:
    """F-24: intersection over union of two pixel boxes (structs x0, y0, x1, y1)."""
    p, q = as_col(a), as_col(b)
    ix = F.greatest(F.lit(0.0), F.least(p["x1"], q["x1"]) - F.greatest(p["x0"], q["x0"]))
    iy = F.greatest(F.lit(0.0), F.least(p["y1"], q["y1"]) - F.greatest(p["y0"], q["y0"]))
    inter = ix * iy
    union = box_area(p) + box_area(q) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def mean_abs_diff(a, b) -> Column:
    """F-26: mean absolute difference; infinite when lengths differ or are zero."""
    x, y = as_col(a), as_col(b)
    same = (F.size(x) == F.size(y)) & (F.size(x) > 0)
    total = F.aggregate(
        F.zip_with(x, y, lambda p, q: F.abs(p.cast("double") - q.cast("double"))), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(same, total / F.size(x)).otherwise(
        F.lit(float("inf"))
    )


# F-25: camera calibration


def calibration_k(area_cm2, pixels) -> Column:
    return as_col(area_cm2) / as_col(pixels)


def native_focal_px() -> float:
    return math.hypot(NATIVE_WIDTH_PX, NATIVE_HEIGHT_PX) / 2 / math.tan(math.radians(DIAGONAL_FOV_DEG / 2))


def focal_px(width, height, source_width=NATIVE_WIDTH_PX, source_height=NATIVE_HEIGHT_PX) -> Column:
    """Focal length in pixels after a center crop and resize from the source frame."""
    scale = F.greatest(as_col(width) / F.lit(float(source_width)), as_col(height) / F.lit(float(source_height)))
    return js_round(F.lit(native_focal_px() * source_width / NATIVE_WIDTH_PX) * scale, 3)


def camera_height(k, fx, fy) -> Column:
    return F.sqrt(as_col(fx) * as_col(fy)) * F.sqrt(as_col(k))


def calibration_flags(n, box_area_px, touches_edge, fully_visible, low_confidence, score, canvas_px) -> Column:
    pixels = as_col(n).cast("double")
    weak = (
        as_col(low_confidence)
        | F.coalesce(as_col(score) < MIN_SCORE, F.lit(False))
        | F.coalesce(F.try_divide(pixels, as_col(box_area_px)) < MIN_BOX_FILL, F.lit(True))
        | (pixels < MIN_REFERENCE_PX)
        | (pixels > F.lit(MAX_REFERENCE_FRACTION) * as_col(canvas_px))
    )
    return F.array_compact(
        F.array(
            F.when(as_col(touches_edge) | ~as_col(fully_visible), F.lit("reference_touches_edge")),
            F.when(weak, F.lit("reference_low_confidence")),
        )
    )


def area_estimate(pixels, cm2_per_px) -> Column:
    """Calibrated area, four decimals half-up."""
    return js_round(as_col(pixels) * as_col(cm2_per_px), 4)
