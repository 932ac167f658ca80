"""Row checks before data is stored: each adds ``reason`` (null when the row passes)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.functions.geometry import COORDINATE_SPACE, geometry_ok, positive_int
from traymetrics.functions.impact import CARBON_WEIGHT, WATER_WEIGHT
from traymetrics.functions.numbers import as_col, finite_nonneg, finite_positive, is_finite, js_round
from traymetrics.functions.text import collapse, item_id
from traymetrics.operators.lookups import small
from traymetrics.session import materialize

# fixed values: allowed words and limits
MEALS = ["breakfast", "lunch", "dinner"]
REFERENCE_SOURCES = ["reference_photo", "manual_area", "gemini_estimate"]
CALIBRATION_STATUSES = ["processing", "succeeded", "failed"]
CALIBRATION_FLAGS = ["reference_not_found", "reference_low_confidence", "reference_touches_edge"]
SUBMITTABLE_SOURCES = ["camera", "replay", "manual_upload"]
TIMESTAMP_BASES = ["laptop_trigger", "laptop_received", "laptop_ingest"]
COUNT_STATUSES = ["complete", "empty", "partial", "unavailable"]
HALL_PATTERN = "^[a-z0-9][a-z0-9-]*$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
SHA_PATTERN = "^[0-9a-f]{64}$"
MAX_WINDOW_DAYS = 366


def no(cond: Column) -> Column:
    """True where a rule is not clearly met (null counts as not met)."""
    return ~F.coalesce(cond, F.lit(False))


def filled(c) -> Column:
    return F.coalesce(F.trim(as_col(c)) != "", F.lit(False))


def first_reason(*pairs: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(code)) for bad, code in pairs])


def real_date(text) -> Column:
    """YYYY-MM-DD that names a real calendar date."""
    c = as_col(text)
    d = F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(c.rlike(DATE_PATTERN) & (F.date_format(d, "yyyy-MM-dd") == c), F.lit(False))


def check_menu_items(
    df: DataFrame, key: list[str] | None = None, max_name: int | None = None, max_category: int | None = None, max_description: int | None = None, max_items: int | None = None
) -> DataFrame:
    """V-5: clean text and reject empty, long, clashing or too many items of a meal.

    Rows carry hall_id, service_date, meal_label, name, category, description. Lengths and the number
    of items in a meal are only judged where a limit is given.
    """
    return judge_menu_items(clean_menu_items(df), key, max_name, max_category, max_description, max_items)


def clean_menu_items(df: DataFrame) -> DataFrame:
    """V-5: clean text and the id of each item."""
    clean = df.withColumns({c: collapse(c) for c in ("name", "category", "description")})
    return clean.withColumn("item_id", item_id("hall_id", "service_date", "meal_label", "name"))


def judge_menu_items(
    clean: DataFrame, key: list[str] | None = None, max_name: int | None = None, max_category: int | None = None, max_description: int | None = None, max_items: int | None = None, tasks: int | None = None
) -> DataFrame:
    """V-5: reasons of cleaned items. With ``tasks`` items are counted by so many, and only those that come twice are joined back."""
    meal = key or ["hall_id", "service_date", "meal_label"]
    keys = [*meal, "item_id"]
    if tasks is None:
        per_item = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("_same"))
        clean = clean.join(per_item, keys)
    else:
        clean = clean.dropna(subset=keys)
        per_item = clean.select(*keys).repartition(tasks, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_same"))
        clean = clean.join(small(materialize(per_item.filter("_same > 1"))), keys, "left")
    lengths = [("name", max_name), ("category", max_category), ("description", max_description)]
    rules = [
        (~filled("name"), "name_empty"),
        *[(F.length(c) > limit, f"{c}_too_long") for c, limit in lengths if limit is not None],
        (F.col("item_id").endswith("_"), "name_without_letters"),
        (F.col("_same") > 1, "duplicate_item"),
    ]
    if max_items is not None:
        clean = clean.join(clean.groupBy(*meal).agg(F.count(F.lit(1)).alias("_meal_size")), meal)
        rules.append((F.col("_meal_size") > max_items, "too_many_items"))
    return clean.withColumn("reason", first_reason(*rules)).drop("_same", "_meal_size")


def check_service_key(df: DataFrame, zones: DataFrame) -> DataFrame:
    """V-6: hall id, real date, meal label (normalized) and known time zone. ``zones`` has ``zone``."""
    known = zones.select(F.col("zone").alias("_zone")).distinct()
    meal = F.lower(F.trim("meal_label"))
    return (
        df.withColumn("meal_label", F.when(meal.isin(MEALS), meal).otherwise(F.col("meal_label")))
        .join(known, F.col("hall_timezone") == F.col("_zone"), "left")
        .withColumn(
            "reason",
            first_reason(
                (no(F.col("hall_id").rlike(HALL_PATTERN)), "invalid_hall_id"),
                (~real_date("service_date"), "invalid_date"),
                (no(F.col("meal_label").isin(MEALS)), "invalid_meal"),
                (F.col("_zone").isNull(), "invalid_timezone"),
            ),
        )
        .drop("_zone")
    )


def check_reference_portion(df: DataFrame) -> DataFrame:
    """V-7."""
    g = F.col("geometry")
    area = F.col("expected_area_px")
    return df.withColumn(
        "reason",
        first_reason(
            (~filled("baseline_id"), "missing_baseline_id"),
            (~positive_int("baseline_version"), "invalid_version"),
            (~filled("item_id"), "missing_item_id"),
            (~finite_positive(area), "invalid_area"),
            (~geometry_ok("geometry"), "invalid_geometry"),
            (area > g["width_px"] * g["height_px"], "area_exceeds_image"),
            (no(F.col("source").isin(REFERENCE_SOURCES)), "invalid_source"),
            ((F.col("source") == "reference_photo") & F.col("reference_image_object_id").isNull(), "missing_photo"),
        ),
    )


def check_measurement(df: DataFrame) -> DataFrame:
    """V-8: stored measurement invariants."""
    masked = F.coalesce(F.col("method") == "mask_pixel_count", F.lit(False))
    px = F.col("remaining_area_px")
    return df.withColumn(
        "reason",
        first_reason(
            (~finite_nonneg(px), "invalid_remaining"),
            (F.col("baseline_area_px").isNotNull() & ~is_finite("baseline_area_px"), "invalid_baseline"),
            (masked & (px != F.floor(px)), "mask_count_not_integer"),
            ((F.col("raw_waste_fraction") > 1) & ~F.array_contains("quality_flags", "above_baseline"), "above_baseline_unflagged"),
            (~masked & F.col("display_waste_percent").isNull() & F.col("unavailable_reason").isNull(), "no_percent_no_reason"),
        ),
    )


def check_count_status(counts: DataFrame, measurements: DataFrame) -> DataFrame:
    """V-9: a count's total must agree with its status and with the measured pixels."""
    sums = measurements.groupBy("attempt_id").agg(F.sum("remaining_area_px").alias("_sum"))
    px, status = F.col("capture_pixels_wasted"), F.col("count_status")
    return (
        counts.join(sums, "attempt_id", "left")
        .withColumn("_sum", F.coalesce("_sum", F.lit(0.0)))
        .withColumn(
            "reason",
            first_reason(
                (no(status.isin(COUNT_STATUSES)), "invalid_status"),
                ((px < 0) | (px > F.col("width_px") * F.col("height_px")), "total_outside_image"),
                ((status == "unavailable") & px.isNotNull(), "unavailable_with_total"),
                ((status != "unavailable") & px.isNull(), "total_missing"),
                ((status == "empty") & (px != 0), "empty_not_zero"),
                (status.isin("complete", "partial") & (px != F.col("_sum")), "total_differs_from_measurements"),
            ),
        )
        .drop("_sum")
    )


def check_physical_snapshot(attempts: DataFrame, measurements: DataFrame, cals: DataFrame) -> DataFrame:
    """V-10: an attempt's calibration succeeded and its measurements name the same one."""
    good = cals.filter("status = 'succeeded'").select(F.col("calibration_id").alias("_cid"))
    a = attempts.select("attempt_id", F.col("calibration_id").alias("_acal"))
    other = measurements.filter(F.col("physical").isNotNull()).select("attempt_id", F.col("physical.calibration_id").alias("_mcal"))
    wrong = other.join(a, "attempt_id").filter(~F.col("_mcal").eqNullSafe(F.col("_acal"))).select("attempt_id").distinct().withColumn("_wrong", F.lit(True))
    return (
        attempts.join(good, F.col("calibration_id") == F.col("_cid"), "left")
        .join(wrong, "attempt_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (F.col("calibration_id").isNotNull() & F.col("_cid").isNull(), "calibration_not_succeeded"),
                (F.col("physical_method").isNotNull() & F.col("calibration_id").isNull(), "method_without_calibration"),
                (F.col("_wrong"), "measurement_calibration_differs"),
            ),
        )
        .drop("_cid", "_wrong")
    )


def check_calibration(new: DataFrame, existing: DataFrame) -> DataFrame:
    """V-11: counts inside the canvas, k = area / N, known flags; finished rows never change."""
    old = existing.select(F.col("calibration_id").alias("_id"), F.col("status").alias("_old"))
    n, k = F.col("reference_pixels"), F.col("cm2_per_px")
    want = F.try_divide(F.col("known_area_cm2"), n)
    done = F.col("status") == "succeeded"
    return (
        new.join(old, F.col("calibration_id") == F.col("_id"), "left")
        .withColumn(
            "reason",
            first_reason(
                (no(F.col("status").isin(CALIBRATION_STATUSES)), "invalid_status"),
                (no((n == F.floor(n)) & (n >= 0) & (n <= F.col("width_px") * F.col("height_px"))), "reference_pixels_outside_image"),
                (done & (n <= 0), "reference_pixels_zero"),
                (done & no(F.abs(k - want) <= want * 1e-6), "k_differs"),
                (~F.forall("flags", lambda f: f.isin(CALIBRATION_FLAGS)), "invalid_flag"),
                (F.col("_old").isNotNull() & (F.col("_old") != "processing"), "already_finished"),
            ),
        )
        .drop("_id", "_old")
    )


def factor_quality(waste: DataFrame, nutrition: DataFrame) -> DataFrame:
    """V-12: (issue, factor_key, table) rows over all factor tables."""
    key, table = F.col("factor_key"), F.col("table")

    def issue(df: DataFrame, code: str) -> DataFrame:
        return df.select(F.lit(code).alias("issue"), "factor_key", "table")

    repeated = waste.groupBy("factor_key", "table").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    restaurants = waste.filter(table.isin("east-quad", "halal-bros")).groupBy("factor_key").agg(F.countDistinct("table").alias("n")).filter("n > 1")
    lonely = nutrition.select("factor_key").distinct().join(waste.filter(table != "common-500").select("factor_key").distinct(), "factor_key", "left_anti")
    c, w = F.lit(CARBON_WEIGHT) * F.col("kg_co2e_per_kg"), F.lit(WATER_WEIGHT) * F.col("water_m3_per_kg")
    numbers = finite_nonneg("weight_g_per_cm2") & finite_nonneg("kg_co2e_per_kg") & finite_nonneg("water_m3_per_kg") & finite_nonneg("impact_usd_per_kg")
    rounding = F.abs(F.col("impact_usd_per_kg") - js_round(c + w, 2)) > 1e-9
    largest = F.col("largest_factor") != F.when(c >= w, F.lit("carbon")).otherwise(F.lit("water"))
    none = F.lit(None).cast("string")
    return (
        issue(repeated, "duplicate_key")
        .unionByName(issue(restaurants.withColumn("table", none), "key_in_two_restaurant_tables"))
        .unionByName(issue(lonely.withColumn("table", none), "nutrition_without_waste_row"))
        .unionByName(issue(waste.filter(~numbers), "invalid_number"))
        .unionByName(issue(waste.filter(rounding), "dollars_rounding"))
        .unionByName(issue(waste.filter(largest), "largest_factor"))
        .filter(key.isNotNull())
    )


def check_capture_submission(df: DataFrame) -> DataFrame:
    """V-13: capture fields, then the optional scan fields."""
    scan = F.col("scan")
    opt = lambda c: c.isNull() | (F.trim(c) != "")
    scan_ok = (
        filled(scan["device_id"])
        & F.coalesce(scan["timestamp_basis"].isin(TIMESTAMP_BASES), F.lit(False))
        & opt(scan["original_image_object_id"])
        & opt(scan["source_name"])
        & (scan["original_sha256"].isNull() | scan["original_sha256"].rlike(SHA_PATTERN))
    )
    ids = filled("event_id") & filled("hall_id") & filled("service_id") & filled("image_object_id")
    return df.withColumn(
        "reason",
        first_reason(
            (~ids, "missing_id"),
            (F.try_to_timestamp(F.col("captured_at").cast("string")).isNull(), "invalid_time"),
            (no(F.col("source").isin(SUBMITTABLE_SOURCES)), "invalid_source"),
            (~geometry_ok("geometry"), "invalid_geometry"),
            (scan.isNotNull() & no(scan_ok), "invalid_scan"),
        ),
    )


def whole_number(c) -> Column:
    x = as_col(c).cast("double")
    return is_finite(x) & F.coalesce(x == F.floor(x), F.lit(False))


def check_attendance(df: DataFrame) -> DataFrame:
    """V-14."""
    return df.withColumn(
        "reason",
        first_reason(
            (~(filled("hall_id") & filled("service_id") & F.col("service_date").isNotNull()), "missing_key"),
            (~(whole_number("count") & F.coalesce(F.col("count") >= 0, F.lit(False))), "invalid_count"),
            (no(F.col("source") == "simulated"), "invalid_source"),
            (~(whole_number("configured_min") & whole_number("configured_max")), "invalid_bounds"),
            (~filled("generator_version"), "missing_version"),
        ),
    )


def check_insight(df: DataFrame) -> DataFrame:
    """V-14."""
    text = filled("insight_id") & filled("hall_id") & filled("window_start") & filled("window_end")
    return df.withColumn(
        "reason",
        first_reason(
            (~text, "missing_key"),
            (F.col("metrics").isNull(), "missing_metrics"),
            (~(filled("data_version") & filled("recommendation") & filled("generated_at")), "missing_text"),
            (no(F.col("source").isin("gemini", "fallback_rules")), "invalid_source"),
        ),
    )


def check_menu_bundle(services: DataFrame, items: DataFrame) -> DataFrame:
    """V-14: one verdict per service over its menu's items (matched by service_id)."""
    per = items.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~(filled("item_id") & filled("display_name"))).alias("_blank"),
        F.count_distinct("item_id").alias("_ids"),
        F.min("menu_id").alias("_m0"),
        F.max("menu_id").alias("_m1"),
    )
    key = filled("service_id") & filled("hall_id") & filled("hall_timezone") & filled("menu_id") & F.coalesce(F.col("meal_label").isin(MEALS), F.lit(False))
    return (
        services.join(per, "service_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (~key | no(F.col("menu_version") >= 1) | F.col("service_date").isNull(), "invalid_service"),
                (F.coalesce("_n", F.lit(0)) == 0, "no_items"),
                (F.col("_blank") > 0, "blank_item"),
                ((F.col("_m0") != F.col("menu_id")) | (F.col("_m1") != F.col("menu_id")), "item_of_other_menu"),
                (F.col("_ids") < F.col("_n"), "duplicate_item"),
            ),
        )
        .drop("_n", "_blank", "_ids", "_m0", "_m1")
    )


def parse_window(start: str, end: str, hall: str | None = None, max_days: int | None = None) -> tuple[str, str, str | None]:
    """V-19: check a window's arguments before any data is read; daily views pass 366 as ``max_days``."""
    dates = []
    for v in (start, end):
        try:
            dates.append(datetime.date.fromisoformat(v))
        except (TypeError, ValueError):
            raise ValueError("start and end must be YYYY-MM-DD dates") from None
        if len(v) != 10:
            raise ValueError("start and end must be YYYY-MM-DD dates")
    if dates[0] > dates[1]:
        raise ValueError("start must be on or before end")
    if hall is not None and not hall:
        raise ValueError("hall must not be empty when given")
    if max_days is not None and (dates[1] - dates[0]).days + 1 > max_days:
        raise ValueError(f"the window must cover 1 to {max_days} days")
    return start, end, hall


def photo_quality_verdict(metrics: DataFrame, width: int, height: int, min_brightness: float = 25.0, min_sharpness: float = 15.0) -> DataFrame:
    """V-24: problems of a photo from its measured brightness, sharpness, format and size."""
    problems = F.array_compact(
        F.array(
            F.when(no(F.col("format") == "jpeg"), F.lit("not_jpeg")),
            F.when(no((F.col("width_px") == width) & (F.col("height_px") == height)), F.lit("wrong_size")),
            F.when(F.col("brightness") < min_brightness, F.lit("too_dark")),
            F.when(F.col("sharpness") < min_sharpness, F.lit("blurry")),
        )
    )
    return metrics.withColumn("problems", problems).withColumn("ok", F.size("problems") == 0)


# V-18: texts a dashboard may show. The patterns.
CAUSAL_CLAIMS = (
    r"(?i)\b(dislike[sd]?|don'?t like|do not like|doesn'?t like|unpopular|not popular|hate[sd]?|tastes? (bad|bland|poor)"
    r"|because (students|diners|people|guests|they))\b"
)
MONEY = r"(?i)\$|\b(dollars?|usd)\b"
PHYSICAL_UNITS = r"(?i)\b(kg|kgs|kilograms?|grams?|lbs?|liters?|litres?|gallons?|co2e)\b"
MARKUP = "[*#`]|—"
BARE_POINTS = r"(?i)\bpoints\b"
NAMED_POINTS = "(?i)relative impact points"
ESTIMATE_WORD = r"(?i)\bestimat"
MAX_TEXT, MAX_TEXT_ESTIMATED, MAX_BULLET = 400, 500, 240


def text_allowed(text, max_len, estimates: Column) -> Column:
    """One sentence block: length, no causes, no money, no bare points, no markup, units only as estimates."""
    t = collapse(text)
    limit = max_len if isinstance(max_len, Column) else F.lit(max_len)
    bad = (
        t.rlike(CAUSAL_CLAIMS)
        | t.rlike(MONEY)
        | t.rlike(MARKUP)
        | F.regexp_replace(t, NAMED_POINTS, "").rlike(BARE_POINTS)
        | (t.rlike(PHYSICAL_UNITS) & ~(estimates & t.rlike(ESTIMATE_WORD)))
    )
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= limit) & ~bad, F.lit(False))


RECOMMENDATION_SCHEMA = "text string, bullets array<struct<text: string, metric: string>>"


def guard_recommendation(texts: DataFrame, raw: str = "raw") -> DataFrame:
    """V-18: ``ok`` for a candidate answer.

    Rows carry the answer text, ``allowed_metrics``, ``foods`` (names a metric may start with) and
    ``has_estimates``. A bullet must cite an allowed metric and name the food the metric is about.
    """
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    p = F.from_json(body, RECOMMENDATION_SCHEMA)
    est = F.col("has_estimates")

    def bullet_ok(b: Column) -> Column:
        metric = F.trim(b["metric"])
        about = F.filter(F.col("foods"), lambda f: metric.startswith(F.concat(f, F.lit(": "))))
        named = (F.size(about) == 0) | F.contains(F.lower(collapse(b["text"])), F.lower(F.get(about, F.lit(0))))
        return text_allowed(b["text"], MAX_BULLET, est) & F.coalesce(F.array_contains("allowed_metrics", metric), F.lit(False)) & named

    bullets = p["bullets"]
    limit = F.when(est, F.lit(MAX_TEXT_ESTIMATED)).otherwise(F.lit(MAX_TEXT))
    ok = text_allowed(p["text"], limit, est) & F.size(bullets).between(2, 3) & F.forall(bullets, bullet_ok)
    return texts.withColumn("ok", F.coalesce(ok, F.lit(False)))


