"""Per-service and per-plate summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traymetrics.functions.geometry import geometry_json, geometry_key
from traymetrics.functions.numbers import finite_nonneg, finite_positive, js_round
from traymetrics.functions.text import readable_item_name
from traymetrics.operators.eligibility import (
    MEASUREMENT_REASONS,
    capture_reason,
    measurement_reason,
    summary_reason,
    valid_mask_count,
)
from traymetrics.operators.impact import MEASUREMENT_ORDER, date_spine, with_periods
from traymetrics.operators.joins import unique_portions
from traymetrics.operators.lookups import small
from traymetrics.operators.picking import counted_attempts, first_per_id, latest_attempts, mode_with_ties
from traymetrics.session import materialize

# fixed values
PIXEL_REASONS = [
    "not_analyzed",
    "analysis_failed",
    "needs_review",
    "partial_segmentation",
    "count_unavailable",
    "legacy_estimate",
    "incompatible_geometry",
]


def per_attendee(amount: Column, attendance: Column) -> Column:
    return F.when(finite_positive(attendance), amount / attendance)


def summarize_service(captures: DataFrame, measurements: DataFrame, services: DataFrame, attendance: DataFrame) -> DataFrame:
    """A-1: one row per service: counts, exclusions by reason, area-weighted percent, per attendee.

    The overall percent is 100 * sum / sum over eligible rows, never a mean of percents.
    """
    caps = captures.withColumn("_cr", capture_reason())
    per_cap = caps.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("capture_count"),
        F.count_if(F.col("_cr").isNull()).alias("succeeded_capture_count"),
        F.count_if(F.col("_cr").isNotNull()).alias("excluded_capture_count"),
        F.count_if(F.col("_cr") == "capture_not_succeeded").alias("x_capture_not_succeeded"),
        F.count_if(F.col("_cr") == "incompatible_geometry").alias("x_incompatible_geometry"),
    )
    rows = _eligible_rows(caps, measurements)
    ok = F.col("_mr").isNull()
    per_row = rows.groupBy("service_id").agg(
        F.count_if(ok).alias("eligible_measurement_count"),
        F.count_if(~ok).alias("excluded_measurement_count"),
        *[F.count_if(F.col("_mr") == r).alias(f"x_{r}") for r in MEASUREMENT_REASONS],
        F.sum(F.when(ok, F.col("remaining_area_px"))).alias("remaining_area_px"),
        F.sum(F.when(ok, F.col("baseline_area_px"))).alias("baseline_area_px"),
    )
    att = attendance.select("service_id", F.col("count").alias("attendance"))
    df = services.select("service_id", "hall_id", "service_date", "meal_label").join(per_cap, "service_id", "left").join(per_row, "service_id", "left").join(att, "service_id", "left")
    counts = ["capture_count", "succeeded_capture_count", "excluded_capture_count", "x_capture_not_succeeded", "x_incompatible_geometry",
              "eligible_measurement_count", "excluded_measurement_count", *[f"x_{r}" for r in MEASUREMENT_REASONS]]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("remaining_area_px", "baseline_area_px")})
    pct_ok = finite_positive("baseline_area_px")
    return df.withColumn(
        "overall_waste_percent", F.when(pct_ok, js_round(100.0 * F.col("remaining_area_px") / F.nullif(F.col("baseline_area_px"), F.lit(0.0)), 1))
    ).withColumn(
        "percent_unavailable_reason",
        F.when(pct_ok, F.lit(None).cast("string")).when(F.col("eligible_measurement_count") == 0, F.lit("no_eligible_measurements")).otherwise(F.lit("zero_denominator")),
    ).withColumn("area_per_attendee", per_attendee(F.col("remaining_area_px"), F.col("attendance"))).withColumn(
        "attendee_unavailable_reason",
        F.when(F.col("attendance").isNull(), F.lit("attendance_missing")).when(F.col("attendance") <= 0, F.lit("attendance_zero")),
    )


def _eligible_rows(caps: DataFrame, measurements: DataFrame) -> DataFrame:
    keep = caps.filter(F.col("_cr").isNull()).select("event_id", "service_id")
    return measurements.join(keep, "event_id").withColumn("_mr", measurement_reason())


def service_items(captures: DataFrame, measurements: DataFrame, names: DataFrame) -> DataFrame:
    """A-1 items: per service and food, sums, percent and share of the service's leftovers (W-12)."""
    rows = _eligible_rows(captures.withColumn("_cr", capture_reason()), measurements).filter(F.col("_mr").isNull())
    per = rows.groupBy("service_id", "item_id").agg(
        F.count(F.lit(1)).alias("eligible_count"), F.sum("remaining_area_px").alias("remaining_area_px"), F.sum("baseline_area_px").alias("baseline_area_px")
    )
    totals = per.groupBy("service_id").agg(F.sum("remaining_area_px").alias("_t"))
    named = names.groupBy("item_id").agg(F.min("display_name").alias("_name"))
    return (
        per.join(totals, "service_id")
        .join(named, "item_id", "left")
        .select(
            "service_id",
            "item_id",
            F.coalesce("_name", readable_item_name("item_id")).alias("display_name"),
            "eligible_count",
            "remaining_area_px",
            "baseline_area_px",
            js_round(100.0 * F.col("remaining_area_px") / F.col("baseline_area_px"), 1).alias("waste_percent"),
            F.when(F.col("_t") > 0, js_round(100.0 * F.col("remaining_area_px") / F.nullif(F.col("_t"), F.lit(0.0)), 1)).alias("share_percent"),
        )
    )


def waste_trend(summaries: DataFrame) -> DataFrame:
    """A-2: trend points by date and service."""
    return summaries.select(
        "hall_id", "service_id", "service_date", "meal_label", "overall_waste_percent", "remaining_area_px", "area_per_attendee", "eligible_measurement_count"
    ).orderBy("service_date", "service_id")


def state_summary(captures: DataFrame, measurements: DataFrame, services: DataFrame, attempts: DataFrame, attendance: DataFrame) -> DataFrame:
    """A-3: the summary view: state buckets, its own eligibility order, unknown area, unrounded percent."""
    per_cap = captures.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("captured_dishes"),
        F.count_if(F.col("state") == "succeeded").alias("analyzed_dishes"),
        F.count_if(F.col("state") == "failed").alias("failed_captures"),
        F.count_if(F.col("state") == "needs_review").alias("needs_review_captures"),
        F.count_if(F.col("state").isin("pending", "processing")).alias("pending_captures"),
    )
    counted = counted_attempts(attempts).select("attempt_id")
    done = captures.filter(F.col("state") == "succeeded").select("event_id", "service_id")
    rows = measurements.join(counted, "attempt_id", "left_semi").join(done, "event_id").withColumn("_r", summary_reason())
    ok = F.col("_r").isNull()
    reasons = {"invalid_value": "invalid_value_measurements", "unknown_item": "unknown_item_measurements", "missing_baseline": "missing_baseline_measurements", "above_baseline": "above_baseline_measurements"}
    per_row = rows.groupBy("service_id").agg(
        F.count_if(ok).alias("eligible_measurements"),
        *[F.count_if(F.col("_r") == r).alias(n) for r, n in reasons.items()],
        F.sum(F.when(ok, F.col("remaining_area_px"))).alias("remaining_area_px"),
        F.sum(F.when(ok, F.col("baseline_area_px"))).alias("baseline_area_px"),
        F.sum(F.when(F.col("_r") == "unknown_item", F.col("remaining_area_px"))).alias("unknown_area_px"),
    )
    att = attendance.select("service_id", F.col("count").alias("attendance"))
    df = services.select("service_id", "hall_id").join(per_cap, "service_id", "left").join(per_row, "service_id", "left").join(att, "service_id", "left")
    zero = [c for c in df.columns if c not in ("service_id", "hall_id", "attendance")]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    return df.withColumn(
        "overall_waste_percent", F.when(F.col("baseline_area_px") > 0, 100.0 * F.col("remaining_area_px") / F.nullif(F.col("baseline_area_px"), F.lit(0.0)))
    ).withColumn("area_per_attendee", F.when(F.col("attendance") > 0, F.col("remaining_area_px") / F.nullif(F.col("attendance"), F.lit(0))))


def pixel_captures(captures: DataFrame, attempts: DataFrame) -> DataFrame:
    """A-4: every capture with its agreed canvas, its pixels and the reason it is not counted."""
    c = counted_attempts(attempts).select(
        "event_id", F.col("attempt_id").alias("_att"), F.col("count_status").alias("_cs"), F.col("capture_pixels_wasted").alias("_px")
    )
    latest = latest_attempts(attempts).select("event_id", F.col("status").alias("_ls"), F.col("count_status").alias("_lcs"))
    done = F.col("state") == "succeeded"
    df = (
        captures.select("event_id", "service_id", "state", geometry_key().alias("geometry_key"))
        .join(c, "event_id", "left")
        .join(latest, "event_id", "left")
        .withColumns({k: F.when(done, F.col(k)) for k in ("_att", "_cs", "_px")})
    )
    agreed = mode_with_ties(df.filter(F.col("_cs").isin("complete", "empty")), ["service_id"], "geometry_key", "agreed_geometry")
    df = df.join(agreed, "service_id", "left")
    none = F.col("_att").isNull()
    review = (F.col("state") == "needs_review") | (F.col("_ls") == "needs_review")
    reason = (
        F.when(none & ((F.col("state") == "failed") | (F.col("_ls") == "failed")), F.lit("analysis_failed"))
        .when(none & review & (F.col("_lcs") == "partial"), F.lit("partial_segmentation"))
        .when(none & review, F.lit("needs_review"))
        .when(none, F.lit("not_analyzed"))
        .when(F.col("_cs").isNull(), F.lit("legacy_estimate"))
        .when(F.col("_cs") == "partial", F.lit("partial_segmentation"))
        .when((F.col("_cs") == "unavailable") | F.col("_px").isNull(), F.lit("count_unavailable"))
        .when(~F.col("geometry_key").eqNullSafe(F.col("agreed_geometry")), F.lit("incompatible_geometry"))
    )
    return df.withColumn("reason", reason).select(
        "event_id",
        "service_id",
        F.col("_att").alias("attempt_id"),
        "agreed_geometry",
        "reason",
        F.when(reason.isNull(), F.col("_px")).alias("pixels"),
        (reason.isNull() & (F.col("_cs") == "empty")).alias("empty_plate"),
    )


def pixel_summary(services: DataFrame, caps: DataFrame, measurements: DataFrame, attendance: DataFrame | None = None) -> DataFrame:
    """A-4: one row per service over ``pixel_captures``."""
    counted = F.col("reason").isNull()
    per = caps.groupBy("service_id").agg(
        F.max("agreed_geometry").alias("agreed_geometry"),
        F.count(F.lit(1)).alias("capture_count"),
        F.count_if(counted).alias("counted_count"),
        F.count_if("empty_plate").alias("empty_plates"),
        F.count_if(~counted).alias("excluded_count"),
        *[F.count_if(F.col("reason") == r).alias(f"x_{r}") for r in PIXEL_REASONS],
        F.coalesce(F.sum("pixels"), F.lit(0)).alias("pixels_wasted"),
    )
    loose = (
        measurements.filter((F.col("method") == "mask_pixel_count") & F.col("item_id").isNull())
        .join(caps.filter(counted).select("attempt_id", "service_id"), "attempt_id")
        .groupBy("service_id")
        .agg(F.sum("remaining_area_px").alias("unclassified_pixels"))
    )
    df = services.select("service_id", "hall_id", "service_date", "meal_label").join(per, "service_id", "left").join(loose, "service_id", "left")
    zero = [c for c in df.columns if c not in ("service_id", "hall_id", "service_date", "meal_label", "agreed_geometry")]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    if attendance is None:
        return df
    att = attendance.select("service_id", F.col("count").alias("attendance"))
    return df.join(att, "service_id", "left").withColumn(
        "pixels_per_attendee", F.when((F.col("attendance") > 0) & (F.col("counted_count") > 0), F.col("pixels_wasted") / F.nullif(F.col("attendance"), F.lit(0)))
    )


def pixel_items(caps: DataFrame, measurements: DataFrame) -> DataFrame:
    """A-4 items: pixels, distinct captures and share of the service's pixels."""
    counted = caps.filter(F.col("reason").isNull())
    totals = counted.groupBy("service_id").agg(F.sum("pixels").alias("_t"))
    rows = measurements.filter((F.col("method") == "mask_pixel_count") & F.col("item_id").isNotNull()).join(
        counted.select("attempt_id", "service_id"), "attempt_id"
    )
    per_event = rows.groupBy("service_id", "item_id", "event_id").agg(F.sum("remaining_area_px").alias("_px"))
    per = per_event.groupBy("service_id", "item_id").agg(F.sum("_px").alias("pixels_wasted"), F.count(F.lit(1)).alias("captures"))
    return per.join(totals, "service_id").select(
        "service_id",
        "item_id",
        "pixels_wasted",
        "captures",
        F.when(F.col("_t") > 0, 100.0 * F.col("pixels_wasted") / F.nullif(F.col("_t"), F.lit(0))).alias("share_percent"),
    )


def portion_benchmark(services: DataFrame, items: DataFrame, captures: DataFrame, measurements: DataFrame, portions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A-5: (every menu item of every service with its pixels per portion or the reason, service counts).

    ``measurements`` are those of the counted attempts.
    """
    svc = small(services.select("service_id", "hall_id", "menu_id", "menu_version"))
    g = F.col("geometry")
    caps = (
        captures.join(svc, ["service_id", "hall_id"])
        .withColumnRenamed("quality_flags", "capture_flags")
        .select("event_id", "service_id", "state", "geometry", "capture_flags", "menu_id", "menu_version")
    )
    menu = materialize(items.select("menu_id", "item_id", "display_name"))  # marks the rows on the menu and is the list of the result
    slim = measurements.join(caps, "event_id").select(
        "measurement_id", "event_id", "attempt_id", "item_id", "remaining_area_px", "baseline_area_px", "raw_waste_fraction", "service_id", "menu_id",
        (F.col("state") == "succeeded").alias("_done"),
        (g["width_px"] * g["height_px"]).alias("_canvas"),
        geometry_json().alias("_key"),
        F.col("mask_count.pixels_wasted").alias("_px"),
        valid_mask_count().alias("_valid"),
    )
    rows = first_per_id(slim, "measurement_id", MEASUREMENT_ORDER).join(menu.select("menu_id", "item_id", F.lit(True).alias("_listed")), ["menu_id", "item_id"], "left")
    # rows are dealt by event once; what its event is found to be stands beside each row, and the narrow rows are frozen
    rows = rows.select("event_id", "attempt_id", "item_id", "service_id", "_done", "_canvas", "_key", "_px", "_valid", "_listed").repartition("event_id")
    event = Window.partitionBy("event_id", "service_id", "_done", "_canvas", "_key")
    total = F.coalesce(F.sum(F.when(F.col("_valid"), F.col("_px"))).over(event), F.lit(0))
    one = F.min("attempt_id").over(event) == F.max("attempt_id").over(event)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(event), "_nv": F.count_if("_valid").over(event), "_usable": F.col("_done") & one & (total <= F.col("_canvas")), "_first": F.row_number().over(event.orderBy("attempt_id")) == 1})
    good, on_menu = F.col("_valid") & F.max("_usable").over(Window.partitionBy("event_id")), F.col("_listed").isNotNull()
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("_bucket", F.when(F.col("_good") & on_menu, F.row_number().over(Window.partitionBy("event_id", "service_id", "item_id", "_good", "_listed").orderBy("attempt_id")) == 1))
    rows = materialize(rows.select("service_id", "item_id", "_key", "_px", "_n", "_nv", "_usable", "_first", "_good", "_listed", "_bucket"))
    events = rows.filter("_first")
    measured = F.col("_usable") & (F.col("_nv") > 0)
    per_service = events.groupBy("service_id").agg(
        F.count_if(measured).alias("measured_dishes"),
        F.sum(F.when(F.col("_usable"), F.col("_n") - F.col("_nv")).otherwise(F.col("_n"))).alias("_dropped"),
        (F.min(F.when(measured, F.col("_key"))) != F.max(F.when(measured, F.col("_key")))).alias("_mixed"),
    )
    off_menu = rows.filter("_good").filter(F.col("_listed").isNull()).groupBy("service_id").agg(F.count(F.lit(1)).alias("_off"))
    buckets = rows.filter("_good").filter("_listed").groupBy("service_id", "item_id").agg(F.sum("_px").alias("_px"), F.count_if("_bucket").alias("_events"))
    listed = svc.join(menu, "menu_id")
    # portions lie by service and item, and the version is compared as a range, so the list is dealt once for both joins
    served_as = unique_portions(portions.repartition("service_id", "item_id")).withColumnRenamed("menu_version", "_v").alias("served_as")
    lies = (F.col("listed.service_id") == F.col("served_as.service_id")) & (F.col("listed.item_id") == F.col("served_as.item_id"))
    df = (
        listed.alias("listed")
        .join(served_as, lies & F.col("menu_version").between(F.col("_v"), F.col("_v")), "left")
        .select("listed.*", "portions_served", "portions_source")
        .join(buckets, ["service_id", "item_id"], "left")
        .join(per_service.select("service_id", "_mixed"), "service_id", "left")
        .withColumn("_mixed", F.coalesce("_mixed", F.lit(False)))
        .withColumn("pixels_wasted", F.when(~F.col("_mixed"), F.col("_px")))
    )
    served = F.col("portions_served")
    reason = (
        F.when(F.col("_mixed"), F.lit("geometries_differ"))
        .when(F.col("pixels_wasted").isNull(), F.lit("no_mask_counts"))
        .when(served.isNull(), F.lit("no_portions"))
        .when((served == 0) & (F.col("pixels_wasted") > 0), F.lit("waste_with_zero_portions"))
        .when(served == 0, F.lit("zero_portions"))
    )
    bench = df.withColumn("unavailable_reason", reason).select(
        "service_id",
        "item_id",
        "display_name",
        served.alias("portions_served"),
        "portions_source",
        "pixels_wasted",
        F.when(F.col("unavailable_reason").isNull(), F.col("pixels_wasted") / F.nullif(served, F.lit(0))).alias("pixels_per_portion"),
        F.coalesce("_events", F.lit(0)).alias("measured_captures"),
        "unavailable_reason",
    )
    dishes = caps.groupBy("service_id").agg(F.count(F.lit(1)).alias("captured_dishes"))
    head = svc.select("service_id").join(dishes, "service_id", "left").join(per_service.drop("_mixed"), "service_id", "left").join(off_menu, "service_id", "left")
    counts = head.select(
        "service_id",
        F.coalesce("captured_dishes", F.lit(0)).alias("captured_dishes"),
        F.coalesce("measured_dishes", F.lit(0)).alias("measured_dishes"),
        (F.coalesce("_dropped", F.lit(0)) + F.coalesce("_off", F.lit(0))).alias("excluded_measurements"),
    )
    return bench, counts


def plate_waste_percent(captures: DataFrame, measurements: DataFrame) -> DataFrame:
    """A-12: per capture, 100 * sum(min(remaining, baseline)) / sum(baseline); a clean plate is 0."""
    usable = (
        F.col("item_id").isNotNull() & (F.col("item_id") != "") & finite_nonneg("remaining_area_px") & finite_positive("baseline_area_px")
    )
    per = measurements.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(usable, F.least("remaining_area_px", "baseline_area_px"))).alias("_r"),
        F.sum(F.when(usable, F.col("baseline_area_px"))).alias("_b"),
    )
    pct = F.when(capture_reason().isNotNull(), F.lit(None).cast("double")).when(F.col("_n").isNull(), F.lit(0.0)).otherwise(
        100.0 * F.col("_r") / F.nullif(F.col("_b"), F.lit(0.0))
    )
    return captures.join(per, "event_id", "left").withColumn("plate_waste_percent", pct).drop("_n", "_r", "_b")


def average_plate_waste(percents: DataFrame, by: list[str]) -> DataFrame:
    """A-13: mean plate percent, one decimal; plates without one are counted apart, not as zero."""
    return percents.groupBy(*by).agg(
        js_round(F.avg("plate_waste_percent"), 1).alias("average_percent"),
        F.count("plate_waste_percent").alias("plates_counted"),
        F.count_if(F.col("plate_waste_percent").isNull()).alias("plates_without_percent"),
    )


def daily_pixels(summary: DataFrame, plates: DataFrame, services: DataFrame, start, end) -> DataFrame:
    """A-14: dense calendar of pixels, dishes and plate percents; a day without counted plates is null.

    The day's percents are kept as their count, sum and missing count, which is all the readers use.
    """
    days = summary.groupBy("service_date").agg(
        F.sum(F.when(F.col("counted_count") > 0, F.col("pixels_wasted"))).alias("pixels_wasted"),
        F.sum("capture_count").alias("captured_dishes"),
        F.sum("counted_count").alias("counted_dishes"),
    )
    svc = services.select("service_id", "service_date")
    pct = plates.drop("service_date").join(svc, "service_id").groupBy("service_date").agg(
        F.count("plate_waste_percent").alias("plates_counted"),
        F.sum("plate_waste_percent").alias("percent_sum"),
        F.count_if(F.col("plate_waste_percent").isNull()).alias("plates_without_percent"),
    )
    spine = date_spine(summary.sparkSession, start, end, "service_date")
    df = spine.join(days, "service_date", "left").join(pct, "service_date", "left")
    zero = ["captured_dishes", "counted_dishes", "plates_counted", "plates_without_percent"]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def plate_percents(plates: DataFrame, services: DataFrame, start, end) -> DataFrame:
    """A-14: the plates of each service date from ``start`` to ``end`` with their percents, nulls included.

    One row a plate rather than one list a day, so a day of any size stays spread.
    """
    days = services.filter(F.col("service_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return plates.drop("service_date").join(days.select("service_id", "service_date"), "service_id").select("service_date", "event_id", "plate_waste_percent")


def period_cards(daily: DataFrame, today) -> DataFrame:
    """A-15: today, this week (from Monday), this month, each with the previous window of equal length."""
    df = with_periods(daily, "service_date", today, previous=True)
    cur, prev = ~F.col("is_previous"), F.col("is_previous")
    plates = F.sum(F.when(cur, F.col("plates_counted")))
    return df.groupBy("period").agg(
        F.min(F.when(cur, F.col("service_date"))).alias("start"),
        F.coalesce(F.sum(F.when(cur, F.col("pixels_wasted"))), F.lit(0)).alias("pixels_wasted"),
        F.sum(F.when(prev, F.col("pixels_wasted"))).alias("previous_pixels_wasted"),
        js_round(F.sum(F.when(cur, F.col("percent_sum"))) / F.nullif(plates, F.lit(0)), 1).alias("average_percent"),
        plates.alias("plates_counted"),
        F.sum(F.when(cur, F.col("plates_without_percent"))).alias("plates_without_percent"),
    )


def menu_days(services: DataFrame) -> DataFrame:
    """A-23: distinct local dates with a menu."""
    return services.select("hall_id", "service_date").distinct()


def sample_status(captures: DataFrame, views: DataFrame) -> DataFrame:
    """A-24: per hall, whether sample data shows, was cleared, or none exists."""
    n = captures.groupBy("hall_id").agg(F.count_if(F.col("source") == "demo").alias("sample_captures"))
    return (
        views.select("hall_id", "cleared_at")
        .join(n, "hall_id", "full")
        .select(
            "hall_id",
            F.coalesce("sample_captures", F.lit(0)).alias("sample_captures"),
            F.when(F.col("cleared_at").isNotNull(), F.lit("cleared")).when(F.col("sample_captures") > 0, F.lit("sample")).otherwise(F.lit("default")).alias("mode"),
        )
    )


def strict_summary(captures: DataFrame, measurements: DataFrame, items: DataFrame, attendance: DataFrame, by: list[str]) -> DataFrame:
    """A-22: the strict variant: every row needs the item's own baseline and no flags at all.

    ``captures`` carries ``empty_plate``, ``geometry_id``, ``service_geometry_id`` and the ``by`` columns;
    ``items`` is (service_id, item_id, baseline_id, baseline_area_px). Groups that mix geometries get no sums.
    """
    base = items.select("service_id", "item_id", F.col("baseline_id").alias("_bid"), F.col("baseline_area_px").alias("_barea"))
    caps = captures.select("event_id", "service_id", "state", "empty_plate", "geometry_id", "service_geometry_id", *by)
    rows = caps.join(measurements.select("event_id", "measurement_id", "item_id", "baseline_id", "remaining_area_px", "baseline_area_px", "quality_flags"), "event_id", "left").join(
        base, ["service_id", "item_id"], "left"
    )
    has = F.col("measurement_id").isNotNull()
    good = F.coalesce(
        has
        & (F.col("baseline_id") == F.col("_bid"))
        & (F.col("baseline_area_px") == F.col("_barea"))
        & finite_nonneg("remaining_area_px")
        & finite_positive("baseline_area_px")
        & (F.col("remaining_area_px") <= F.col("baseline_area_px"))
        & (F.col("geometry_id") == F.col("service_geometry_id"))
        & (F.size("quality_flags") == 0),
        F.lit(False),
    )
    plates = rows.withColumn("_has", has).withColumn("_good", good).groupBy("event_id").agg(
        *[F.first(c).alias(c) for c in ("service_id", "state", "empty_plate", "service_geometry_id", *by)],
        F.count_if("_has").alias("_n"),
        F.count_if("_good").alias("_ng"),
        F.coalesce(F.sum(F.when(F.col("_good"), F.col("remaining_area_px"))), F.lit(0.0)).alias("_r"),
        F.coalesce(F.sum(F.when(F.col("_good"), F.col("baseline_area_px"))), F.lit(0.0)).alias("_b"),
        F.coalesce(F.max(F.when(F.col("_good"), F.col("remaining_area_px"))), F.lit(0.0)).alias("_max"),
    )
    consistent = ~F.col("empty_plate") | (F.col("_max") == 0)
    valid = (F.col("state") == "succeeded") & (F.col("_n") == F.col("_ng")) & consistent & (F.col("empty_plate") | (F.col("_ng") > 0))
    counted = (F.col("state") == "succeeded") & consistent
    pct = F.when(valid, F.when(F.col("empty_plate"), F.lit(0.0)).otherwise(100.0 * F.col("_r") / F.nullif(F.col("_b"), F.lit(0.0))))
    plates = plates.withColumn("_pct", pct).withColumn("_counted", counted)
    sums = plates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("captured_dishes"),
        F.count("_pct").alias("averaged_plates"),
        F.count_if(F.col("_pct") == 0).alias("clean_plates"),
        F.count_if(F.col("_pct").isNull()).alias("excluded_plates"),
        F.avg("_pct").alias("average_plate_percent"),
        F.sum(F.when(F.col("_counted"), F.col("_r")).otherwise(F.lit(0.0))).alias("_rem"),
        F.sum(F.when(F.col("_counted"), F.col("_b")).otherwise(F.lit(0.0))).alias("_base"),
        F.sum(F.when(F.col("_counted"), F.col("_n") - F.col("_ng")).otherwise(F.col("_n"))).alias("excluded_measurements"),
        (F.min("service_geometry_id") == F.max("service_geometry_id")).alias("one_geometry"),
    )
    att = (
        plates.select("service_id", *by).distinct().join(attendance.select("service_id", F.col("count").alias("_a")), "service_id", "left")
        .groupBy(*by)
        .agg(F.when(F.bool_and(F.coalesce(F.col("_a") > 0, F.lit(False))), F.sum("_a")).alias("attendance"))
    )
    one = F.col("one_geometry")
    return sums.join(att, by, "left").select(
        *by,
        "captured_dishes",
        "averaged_plates",
        "clean_plates",
        "excluded_plates",
        "excluded_measurements",
        "one_geometry",
        F.when(one, F.col("_rem")).alias("remaining_area_px"),
        F.when(one, F.col("_base")).alias("baseline_area_px"),
        F.when(one, 100.0 * F.col("_rem") / F.nullif(F.col("_base"), F.lit(0.0))).alias("waste_percent"),
        F.when(one, F.col("average_plate_percent")).alias("average_plate_percent"),
        "attendance",
        F.when(one, F.col("_rem") / F.nullif(F.col("attendance"), F.lit(0))).alias("area_per_attendee"),
    )


def photo_food_totals(scored: DataFrame, regions: DataFrame) -> DataFrame:
    """A-26: per photo and food, pixels, region count and points."""
    boxes = regions.groupBy(F.col("event_id").alias("_e"), F.col("item_id").alias("_i")).agg(F.count(F.lit(1)).alias("boxes"))
    per = scored.groupBy("event_id", "item_id").agg(
        F.sum("pixels").alias("pixels"), *[F.sum(c).alias(c) for c in ("impact_points", "co2_points", "water_points", "nutrition_points")]
    )
    return (
        per.join(boxes, (F.col("event_id") == F.col("_e")) & F.col("item_id").eqNullSafe(F.col("_i")), "left")
        .drop("_e", "_i")
        .withColumn("boxes", F.coalesce("boxes", F.lit(0)))
    )


def photo_point_totals(foods: DataFrame) -> DataFrame:
    """A-26: per photo, one-decimal sums of the points that exist; null when no food has any."""
    return foods.groupBy("event_id").agg(
        F.sum("pixels").alias("pixels"),
        F.sum("boxes").alias("boxes"),
        *[js_round(F.sum(c), 1).alias(c) for c in ("impact_points", "co2_points", "water_points", "nutrition_points")],
    )


def insight_window(captures: DataFrame, by: list[str]) -> DataFrame:
    """A-27: first and last valid capture time."""
    return captures.groupBy(*by).agg(F.min("captured_at").alias("window_start"), F.max("captured_at").alias("window_end"))
