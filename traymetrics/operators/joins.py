"""Joins between captures, attempts, measurements, menus, factors and calibrations.

No side is force-broadcast unless its row count is bounded by construction or counted (``lookup_join``); otherwise the
optimizer decides from measured sizes, and adaptive execution splits skewed join keys.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.functions.dates import local_date, local_hhmm
from traymetrics.functions.geometry import COORDINATE_SPACE, box_iou, positive_int
from traymetrics.functions.numbers import finite_nonneg, finite_positive, js_round
from traymetrics.functions.text import readable_item_name, slug
from traymetrics.operators.lookups import lookup_join, small
from traymetrics.operators.ordering import carry_last, drop_chunks, ordered_chunks
from traymetrics.operators.picking import counted_attempts, first_by_priority, latest_attempts
from traymetrics.session import materialize

# fixed values: which factor table wins for one key, pairs of an observation and a reference that one task makes
FACTOR_TABLE_ORDER = ["east-quad", "halal-bros", "common-500"]
TASK_PAIRS = 10_000_000  # about a second of a core
LIST_ROWS = 10_000  # short ids
GEOMETRY_FIELDS = ["width_px", "height_px", "coordinate_space", "plate_shape", "plate_diameter_px"]


def with_attempts(captures: DataFrame, attempts: DataFrame) -> DataFrame:
    """J-1: each capture with its counted attempt (succeeded captures only) and its latest attempt."""
    counted = counted_attempts(attempts).select("event_id", F.col("attempt_id").alias("_c"))
    latest = latest_attempts(attempts).select(
        "event_id", F.col("attempt_id").alias("latest_attempt_id"), F.col("status").alias("latest_status")
    )
    return (
        captures.join(counted, "event_id", "left")
        .join(latest, "event_id", "left")
        .withColumn("counted_attempt_id", F.when(F.col("state") == "succeeded", F.col("_c")))
        .drop("_c")
    )


def counted_measurements(measurements: DataFrame, counted: DataFrame) -> DataFrame:
    """J-2: only measurements of counted attempts.

    A measurement carries the event of its attempt and an event counts one attempt, so rows meet by event.
    """
    own = counted.select("event_id", F.col("attempt_id").alias("_cid"))
    return measurements.join(own, "event_id").filter(of_attempt("_cid")).select(*measurements.columns)


def of_attempt(counted_id: str) -> Column:
    """The row is of that attempt, for rows that met it by event.

    Said as a range, so the planner does not take it for a join key and rows that lie by event stay there.
    """
    return F.col("attempt_id").between(F.col(counted_id), F.col(counted_id))


def resolve_item_names(ids: DataFrame, items: DataFrame, revisions: DataFrame) -> DataFrame:
    """J-3: (menu_id, item_id) to a name: this menu's item, any stored item, newest archived row, humanized id."""
    own = items.select("menu_id", "item_id", F.col("display_name").alias("_own"))
    any_row = items.groupBy("item_id").agg(F.min_by("display_name", "menu_id").alias("_any"))
    old = revisions.groupBy("item_id").agg(F.max_by("display_name", "menu_version").alias("_old"))
    named = lookup_join(ids, own, ["menu_id", "item_id"])
    for names in (any_row, old):
        named = lookup_join(named, names, ["item_id"])
    return (
        named.withColumn("display_name", F.coalesce("_own", "_any", "_old", readable_item_name("item_id")))
        .drop("_own", "_any", "_old")
    )


def factor_lookup(waste: DataFrame) -> DataFrame:
    """One factor row per key, restaurant tables before the common table."""
    prio = F.coalesce(*[F.when(F.col("table") == t, F.lit(i)) for i, t in enumerate(FACTOR_TABLE_ORDER)], F.lit(99))
    return first_by_priority(waste, "factor_key", prio)


def join_factors(df: DataFrame, waste: DataFrame, nutrition: DataFrame, name: str = "display_name") -> DataFrame:
    """J-4: factors by the slug of the display name; no match leaves nulls."""
    picked = factor_lookup(waste).select(
        F.col("factor_key").alias("_slug"),
        "factor_key",
        F.col("table").alias("factor_table"),
        "weight_g_per_cm2",
        "kg_co2e_per_kg",
        "water_m3_per_kg",
        "impact_usd_per_kg",
    )
    days = nutrition.groupBy(F.col("factor_key").alias("_slug")).agg(F.max("nutrient_days_per_kg").alias("nutrient_days_per_kg"))
    found = lookup_join(df.withColumn("_slug", slug(name)), picked, ["_slug"])
    return lookup_join(found, days, ["_slug"]).drop("_slug")


def unique_portions(portions: DataFrame) -> DataFrame:
    """One usable count per (service, version, item); two or more rows are ambiguous."""
    return portions.groupBy("service_id", "menu_version", "item_id").agg(
        F.when((F.count(F.lit(1)) == 1) & (F.max("count") >= 0), F.max("count")).alias("portions_served"),
        F.when(F.count(F.lit(1)) == 1, F.max("source")).alias("portions_source"),
    )


def join_portions(df: DataFrame, portions: DataFrame) -> DataFrame:
    """J-5."""
    return df.join(unique_portions(portions), ["service_id", "menu_version", "item_id"], "left")


def with_frozen_version(captures: DataFrame, services: DataFrame, counted: DataFrame) -> DataFrame:
    """J-6: the menu version an attempt froze replaces the service's current one."""
    svc = services.select("service_id", "hall_id", "service_date", "meal_label", "menu_id", F.col("menu_version").alias("_cur"))
    frozen = counted.select("event_id", F.col("menu_version").alias("_frozen"))
    return (
        captures.join(svc, ["service_id", "hall_id"])
        .join(frozen, "event_id", "left")
        .withColumn("menu_version", F.when(F.col("_frozen") >= 1, F.col("_frozen")).otherwise(F.col("_cur")))
        .drop("_cur", "_frozen")
    )


def physical_context(counted: DataFrame, captures: DataFrame, cals: DataFrame) -> DataFrame:
    """J-7: per event, the attempt's method or why there is none."""
    size = captures.select("event_id", F.col("geometry.width_px").alias("_w"), F.col("geometry.height_px").alias("_h"))
    cal = cals.select("calibration_id", F.col("width_px").alias("_cw"), F.col("height_px").alias("_ch"))
    mismatch = (F.col("_cw") != F.col("_w")) | (F.col("_ch") != F.col("_h"))
    return (
        counted.select("event_id", "attempt_id", "physical_method", "calibration_id")
        .join(size, "event_id")
        .join(cal, "calibration_id", "left")
        .select(
            "event_id",
            "attempt_id",
            "physical_method",
            F.when(F.col("physical_method").isNotNull(), F.lit(None).cast("string"))
            .when(F.coalesce(mismatch, F.lit(False)), F.lit("incompatible_geometry"))
            .otherwise(F.lit("no_calibration"))
            .alias("physical_context_reason"),
        )
    )


def recompute_area(measurements: DataFrame, cals: DataFrame) -> DataFrame:
    """J-8: the stored area is never trusted; pixels times the named calibration's k, or nothing."""
    usable = cals.filter((F.col("status") == "succeeded") & finite_positive("cm2_per_px")).select(
        F.col("calibration_id").alias("_cid"), F.col("cm2_per_px").alias("_k")
    )
    px = F.col("remaining_area_px")
    ok = F.col("_k").isNotNull() & finite_nonneg(px) & (px == F.floor(px))
    return (
        measurements.withColumn("_pcal", F.col("physical.calibration_id"))
        .join(usable, F.col("_pcal") == F.col("_cid"), "left")
        .withColumn(
            "physical",
            F.when(
                ok,
                F.struct(
                    F.col("_cid").alias("calibration_id"),
                    F.lit("area-calibrated-v1").alias("method"),
                    js_round(px * F.col("_k"), 4).alias("area_cm2"),
                ),
            ),
        )
        .drop("_pcal", "_cid", "_k")
    )


def asof_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, right_key: str, values: list[str]) -> DataFrame:
    """J-9: latest right row at or before each left row, per ``on``; hot keys are split by range.

    ``left`` needs a unique ``row_id``; ``right_key`` is unique in ``right`` and breaks ties.
    """
    payload = F.struct(*[F.col(v) for v in values])
    empty = F.lit(None)
    r = right.select(*on, ts, F.lit(0).alias("_side"), F.col(right_key).cast("string").alias("_id"), payload.alias("_pay"))
    l = left.select(
        *on, ts, F.lit(1).alias("_side"), F.col("row_id").cast("string").alias("_id"), empty.cast(r.schema["_pay"].dataType).alias("_pay")
    )
    both = ordered_chunks(r.unionByName(l), *[F.col(k) for k in on], F.col(ts), F.col("_side"), F.col("_id"))
    filled = drop_chunks(carry_last(both, on, F.col("_pay"), "_hit"))
    return filled.filter("_side = 1").select(*on, ts, F.col("_id").alias("row_id"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def resolve_service(scans: DataFrame, windows: DataFrame, services: DataFrame) -> DataFrame:
    """J-10: scan instant to its hall's meal window (inclusive local HH:MM) to service, with a reason when none.

    ``windows`` (hall_id, meal, start, end) holds every hall's meals; of overlapping ones the first start
    counts, then the first end and meal. An interval join by hall and hour: a window stands under each
    hour it touches, and a scan looks at the few windows of its own hall and hour.
    """
    hours = F.sequence(F.substring("start", 1, 2).cast("int"), F.substring("end", 1, 2).cast("int"))
    w = windows.filter("start <= end").select(F.col("hall_id").alias("_hall"), F.explode(hours).alias("_hour"), F.struct(F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("meal").alias("_meal")).alias("_w"))
    table = w.groupBy("_hall", "_hour").agg(F.array_sort(F.collect_set("_w")).alias("_windows"))  # what a hall serves within an hour
    svc = services.select(
        F.col("hall_id").alias("_at"), F.col("service_date").alias("_date"), F.col("meal_label").alias("_label"), "service_id"
    )
    hit = F.get(F.filter("_windows", lambda x: (x["_start"] <= F.col("local_time")) & (F.col("local_time") <= x["_end"])), F.lit(0))
    return (
        scans.withColumn("local_day", local_date("scanned_at", "hall_timezone"))
        .withColumn("local_time", local_hhmm("scanned_at", "hall_timezone"))
        .join(table, (F.col("hall_id") == F.col("_hall")) & (F.substring("local_time", 1, 2).cast("int") == F.col("_hour")), "left")
        .withColumn("meal", hit["_meal"])
        .drop("_windows", "_hall", "_hour")
        .join(svc, (F.col("hall_id") == F.col("_at")) & (F.col("local_day") == F.col("_date")) & (F.col("meal") == F.col("_label")), "left")
        .drop("_at", "_date", "_label")
        .withColumn(
            "reason",
            F.when(F.col("meal").isNull(), F.lit("no_meal_served")).when(F.col("service_id").isNull(), F.lit("no_menu_saved")),
        )
    )


def geometry_codes(a: dict[str, Column], b: dict[str, Column], tolerance: float = 0.05) -> list[tuple[Column, str]]:
    """J-11: (condition, code) of every geometry difference, from the fields of an observation and of a reference."""
    larger = F.greatest(a["plate_diameter_px"], b["plate_diameter_px"])
    delta = F.abs(a["plate_diameter_px"] - b["plate_diameter_px"]) / larger
    both_d = a["plate_diameter_px"].isNotNull() & b["plate_diameter_px"].isNotNull()
    differs = lambda f: ~a[f].eqNullSafe(b[f])
    return [
        (~(positive_int(a["width_px"]) & positive_int(a["height_px"])), "observation_dimensions"),
        (~(positive_int(b["width_px"]) & positive_int(b["height_px"])), "reference_dimensions"),
        (~a["coordinate_space"].eqNullSafe(F.lit(COORDINATE_SPACE)), "observation_space"),
        (differs("coordinate_space"), "different_space"),
        (differs("width_px") | differs("height_px"), "different_size"),
        (a["plate_shape"] != b["plate_shape"], "different_shape"),
        (both_d & (delta > tolerance), "different_diameter"),
    ]


def geometry_compatibility(
    obs: DataFrame, refs: DataFrame, tolerance: float = 0.05, pairs: int = TASK_PAIRS, list_rows: int = LIST_ROWS, form: Callable[[Column], Column] = lambda codes: codes
) -> DataFrame:
    """J-11: every observation against its item's references; ``reasons`` is what ``form`` makes of the list of codes.

    An item's references of one geometry are held as lists of about ``list_rows`` ids at most. An observation is
    compared with each list once; its pairs are the ids of the list. The pairs of each item are counted first.
    Tasks are as many as give about ``pairs`` to one; the observations of an item with more than that are split
    over parts, each of which meets all its references.
    """
    count = lambda df, n: df.groupBy("item_id").agg(F.count(F.lit(1)).alias(n))
    per = materialize(count(obs, "_n").join(count(refs, "_r"), "item_id").select("item_id", "_r", (F.col("_n") * F.col("_r")).alias("_pairs")))
    tasks = max(obs.sparkSession.sparkContext.defaultParallelism, -(-(per.agg(F.sum("_pairs")).first()[0] or 0) // pairs))
    pieces = lambda n, most, name: small(per.filter(F.col(n) > most).select("item_id", F.ceil(F.col(n) / most).alias(name)))
    large, long = pieces("_pairs", pairs, "_parts"), pieces("_r", list_rows, "_lists")
    parts = F.coalesce("_parts", F.lit(1))
    a, b = ({f: F.col(f"_{side}_{f}") for f in GEOMETRY_FIELDS} for side in "ab")
    flat = lambda side: [F.col("geometry")[f].alias(f"_{side}_{f}") for f in GEOMETRY_FIELDS]
    left = obs.select("*", *flat("a"), F.xxhash64(*obs.columns).alias("_hash")).join(large, "item_id", "left").withColumn("_part", F.pmod("_hash", parts)).drop("_hash", "_parts")
    ids = refs.select("item_id", F.struct("baseline_id").alias("_id"), *flat("b"), F.xxhash64(*refs.columns).alias("_hash")).join(long, "item_id", "left")
    lists = ids.groupBy("item_id", *b.values(), F.pmod("_hash", F.coalesce("_lists", F.lit(1))).alias("_list")).agg(F.collect_list("_id").alias("_ids"))
    lists = lists.withColumn("_ids", F.transform("_ids", lambda x: x["baseline_id"]))  # null ids stay, which a list of bare ids drops
    right = lists.join(large, "item_id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts", "_list")
    # a number of bits picks one of the 128 lists, which are constants: cheaper than building its list
    codes = geometry_codes(a, b, tolerance)
    found = functools.reduce(lambda x, y: x + y, [F.when(c, 1 << i).otherwise(0) for i, (c, _) in enumerate(codes)])
    reasons = [form(F.array(*[F.lit(code) for i, (_, code) in enumerate(codes) if n >> i & 1]).cast("array<string>")) for n in range(1 << len(codes))]
    keys = ["item_id", "_part"]
    met = left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).withColumn("_found", found)
    met = met.withColumns({"reasons": F.get(F.array(*reasons), F.col("_found")), "compatible": F.col("_found") == 0})
    return met.select("item_id", *[c for c in obs.columns if c != "item_id"], F.explode("_ids").alias("baseline_id"), "reasons", "compatible")


def best_baseline(items: DataFrame, refs: DataFrame, geometry: Column | None = None) -> DataFrame:
    """J-12: highest-version valid reference of the same space and size per item row.

    ``items`` carries ``geometry`` unless one is given.
    """
    obs = items if geometry is None else items.withColumn("geometry", geometry)
    r = refs.filter(finite_positive("expected_area_px")).select(
        "item_id",
        F.col("geometry.width_px").alias("_w"),
        F.col("geometry.height_px").alias("_h"),
        F.col("geometry.coordinate_space").alias("_s"),
        "baseline_version",
        "baseline_id",
        "expected_area_px",
    )
    best = r.groupBy("item_id", "_w", "_h", "_s").agg(
        F.max_by(F.struct("baseline_id", "baseline_version", "expected_area_px"), F.struct("baseline_version", "baseline_id")).alias("_b")
    )
    return (
        obs.withColumn("_gw", F.col("geometry.width_px"))
        .withColumn("_gh", F.col("geometry.height_px"))
        .withColumn("_gs", F.col("geometry.coordinate_space"))
        .join(best.withColumnRenamed("item_id", "_i"), (F.col("item_id") == F.col("_i")) & (F.col("_gw") == F.col("_w")) & (F.col("_gh") == F.col("_h")) & (F.col("_gs") == F.col("_s")), "left")
        .select(*obs.columns, "_b.*")
    )


def observations(captures: DataFrame, measurements: DataFrame) -> DataFrame:
    """J-13: each capture with its measurements nested, in id order.

    The nested list is the result itself, so one capture's list is as long as that capture's rows.
    """
    nested = measurements.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("measurement_id", "item_id", "remaining_area_px"))).alias("measurements")
    )
    return captures.join(nested, "event_id", "left").withColumn(
        "measurements", F.coalesce("measurements", F.array().cast(nested.schema["measurements"].dataType))
    )


def capture_images(captures: DataFrame, attempts: DataFrame, measurements: DataFrame, regions: DataFrame, images: DataFrame) -> DataFrame:
    """J-14: finalized photo, overlay and mask references of each capture, one row per reference.

    Masks are the exclusive per-item masks; an attempt without any falls back to its region masks.
    """
    counted = counted_attempts(attempts).select("event_id", F.col("attempt_id").alias("_att"), "overlay_object_id")
    shown = captures.join(counted, "event_id", "left")
    photo = shown.select("event_id", F.lit("photo").alias("kind"), F.col("image_object_id").alias("object_id"), F.lit(None).cast("string").alias("item_id"))
    overlay = shown.select("event_id", F.lit("overlay").alias("kind"), F.col("overlay_object_id").alias("object_id"), F.lit(None).cast("string").alias("item_id"))
    own = measurements.filter(F.col("mask_count.mask_object_id").isNotNull()).select(
        F.col("attempt_id").alias("_att"), F.lit("mask").alias("kind"), F.col("mask_count.mask_object_id").alias("object_id"), "item_id"
    )
    have = own.select("_att").distinct()
    fallback = regions.filter(F.col("mask_object_id").isNotNull()).select(
        F.col("attempt_id").alias("_att"), F.lit("mask").alias("kind"), F.col("mask_object_id").alias("object_id"), "item_id"
    ).join(have, "_att", "left_anti")
    masks = shown.select("event_id", "_att").join(own.unionByName(fallback), "_att").select("event_id", "kind", "object_id", "item_id")
    final = images.filter(F.col("state") == "finalized").select("object_id", "object_key")
    return photo.unionByName(overlay).unionByName(masks).filter(F.col("object_id").isNotNull()).join(final, "object_id")


def region_ids(measurements: DataFrame, regions: DataFrame) -> DataFrame:
    """J-15: ids of the regions behind each measurement; a null item matches null regions."""
    r = regions.groupBy(F.col("attempt_id").alias("_a"), F.col("item_id").alias("_i")).agg(
        F.array_sort(F.collect_set("region_id")).alias("region_ids")
    )
    joined = measurements.join(r, (F.col("attempt_id") == F.col("_a")) & F.col("item_id").eqNullSafe(F.col("_i")), "left")
    return joined.drop("_a", "_i").withColumn("region_ids", F.coalesce("region_ids", F.array().cast("array<string>")))


def allowed_classifications(df: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-16: rows whose item is on the menu (null is always allowed) and the violations."""
    keys = vocabulary.select("menu_id", "item_id").distinct()
    ok = df.filter(F.col("item_id").isNotNull()).join(keys, ["menu_id", "item_id"], "left_semi").unionByName(df.filter(F.col("item_id").isNull()))
    bad = df.filter(F.col("item_id").isNotNull()).join(keys, ["menu_id", "item_id"], "left_anti")
    return ok, bad


def overlapping_boxes(boxes: DataFrame, iou: float = 0.5, tile: float = 64.0) -> DataFrame:
    """J-17: pairs of boxes of one capture with IoU above the limit.

    Boxes meet on (event, tile), so a crowded capture spreads over its tiles instead of pairing
    everything with everything; a pair is taken only in the tile that holds the corner of its overlap.
    """
    def tiles(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile))

    placed = (
        boxes.select("event_id", "box_id", F.struct("x0", "y0", "x1", "y1").alias("box"), "x0", "y0", "x1", "y1")
        .withColumn("_tx", F.explode(tiles("x0", "x1")))
        .withColumn("_ty", F.explode(tiles("y0", "y1")))
        .drop("x0", "y0", "x1", "y1")
    )
    a = placed.select("event_id", "_tx", "_ty", F.col("box_id").alias("a_id"), F.col("box").alias("a"))
    b = placed.select("event_id", "_tx", "_ty", F.col("box_id").alias("b_id"), F.col("box").alias("b"))
    home = (F.floor(F.greatest("a.x0", "b.x0") / tile) == F.col("_tx")) & (F.floor(F.greatest("a.y0", "b.y0") / tile) == F.col("_ty"))
    return (
        a.join(b, ["event_id", "_tx", "_ty"])
        .filter((F.col("a_id") < F.col("b_id")) & home)
        .withColumn("iou", box_iou("a", "b"))
        .filter(F.col("iou") > iou)
        .select("event_id", "a_id", "b_id", "iou")
    )


def detections_vs_truth(detections: DataFrame, truth: DataFrame, by: str = "photo") -> DataFrame:
    """J-18: per photo, counts of correct, missed and wrong foods, as a full outer join of distinct pairs."""
    d = detections.filter(F.col("food").isNotNull()).select(by, "food").distinct().withColumn("_d", F.lit(1))
    t = truth.filter(F.col("food").isNotNull()).select(by, "food").distinct().withColumn("_t", F.lit(1))
    return (
        d.join(t, [by, "food"], "full")
        .groupBy(by)
        .agg(
            F.count_if(F.col("_d").isNotNull() & F.col("_t").isNotNull()).alias("correct"),
            F.count_if(F.col("_d").isNull()).alias("missed"),
            F.count_if(F.col("_t").isNull()).alias("wrong"),
        )
    )


def nest_attempts(attempts: DataFrame, counts: DataFrame, regions: DataFrame, overlays: DataFrame) -> DataFrame:
    """J-19: one record per attempt with its count, regions and overlay."""
    nested = regions.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "item_id", "mask_pixels"))).alias("regions"))
    c = counts.select("attempt_id", F.struct("count_status", "capture_pixels_wasted").alias("segmentation"))
    o = overlays.select("attempt_id", F.col("overlay_object_id").alias("_overlay"))
    return (
        attempts.join(c, "attempt_id", "left")
        .join(nested, "attempt_id", "left")
        .join(o, "attempt_id", "left")
        .withColumn("overlay_object_id", F.coalesce(F.col("_overlay"), F.col("overlay_object_id")) if "overlay_object_id" in attempts.columns else F.col("_overlay"))
        .drop("_overlay")
    )


def active_calibration(settings: DataFrame, cals: DataFrame) -> DataFrame:
    """J-20: a hall's active calibration, only when it succeeded and belongs to that hall."""
    c = cals.filter(F.col("status") == "succeeded").select(
        F.col("calibration_id").alias("_cid"), F.col("hall_id").alias("_hall"), "cm2_per_px"
    )
    on = (F.col("active_calibration_id") == F.col("_cid")) & (F.col("hall_id") == F.col("_hall"))
    return settings.join(c, on, "left").withColumn("usable_calibration_id", F.col("_cid")).drop("_cid", "_hall")


