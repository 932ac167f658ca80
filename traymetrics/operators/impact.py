"""Impact selection, scoring, grouping and totals (missing is never zero)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.functions.dates import as_date, month_start, week_start
from traymetrics.functions.impact import (
    AREA_METHOD,
    NEIGHBOR_FLAG,
    PHYSICAL_COLS,
    POINT_COLS,
    UNKNOWN_FOOD_LABEL,
    WASTE_FACTORS_VERSION,
    impact_points,
    physical_amounts,
    usable_physical,
)
from traymetrics.operators.eligibility import valid_mask_count
from traymetrics.operators.joins import join_factors, of_attempt, unique_portions
from traymetrics.operators.lookups import small
from traymetrics.operators.picking import counted_attempts, first_per_id, top_reason_of
from traymetrics.session import materialize

# fixed values: reason lists in tie order
POINT_REASONS = ["unknown_item", "no_factor"]
PHYSICAL_REASONS = ["no_calibration", "incompatible_geometry", "unknown_item", "no_factor"]
MEASUREMENT_ORDER = ["attempt_id", "item_id", "remaining_area_px", "baseline_area_px", "raw_waste_fraction"]


def select_impact(
    captures: DataFrame,
    services: DataFrame,
    measurements: DataFrame,
    items: DataFrame,
    attempts: DataFrame,
    cals: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """A-6: (measurements that count, one status row per capture).

    Only measurements of the counted attempt are read. A capture is analyzed when it succeeded,
    has one attempt, its valid pixels fit the canvas, and not all of its rows are invalid; a
    capture without rows is an analyzed clean plate. The narrow judged rows are read twice (for
    the captures' status and for the result) and the captures three times, so both are frozen once
    instead of joined again.
    """
    caps = materialize(_captures_in_context(captures, services, counted_attempts(attempts), cals))
    rows = materialize(_judged_rows(caps, measurements, items))
    stats = rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("_valid").alias("_n_valid"),
        F.sum(F.when(F.col("_valid"), F.col("pixels"))).alias("_total"),
        (F.min("attempt_id") != F.max("attempt_id")).alias("_many"),
        F.bool_or(F.col("_valid") & usable_physical("method", "area_cm2")).alias("_any_phys"),
    )
    n, valid = F.coalesce("_rows", F.lit(0)), F.coalesce("_n_valid", F.lit(0))
    analyzed = (
        (F.col("state") == "succeeded")
        & ~F.coalesce(F.col("_many"), F.lit(False))
        & (F.coalesce("_total", F.lit(0)) <= F.col("canvas"))
        & ~((n > 0) & (valid == 0))
    )
    calibrated = ~F.col("uncalibrated") & (F.col("physical_method").isNotNull() | F.coalesce("_any_phys", F.lit(False)))
    status = caps.join(stats, "event_id", "left").select(
        "event_id", "hall_id", "service_id", "service_date", "meal_label", "captured_at", "source", "menu_version",
        "uncalibrated", "context_reason",
        analyzed.alias("analyzed"),
        (analyzed & calibrated).alias("calibrated"),
        (F.col("source") == "demo").alias("sample"),
        F.when(analyzed, n - valid).otherwise(n).alias("excluded_measurements"),
    )
    selected = (
        rows.filter("_valid")
        .join(status.filter("analyzed"), "event_id")
        .select(
            "event_id", "hall_id", "service_id", "service_date", "meal_label", "captured_at", "menu_version", "measurement_id", "item_id",
            F.when(F.col("item_id").isNull(), F.lit(UNKNOWN_FOOD_LABEL)).otherwise(F.col("display_name")).alias("display_name"),
            "pixels",
            F.when(~F.col("uncalibrated"), F.col("method")).alias("method"),
            F.when(~F.col("uncalibrated"), F.col("area_cm2")).alias("area_cm2"),
            F.when(F.col("uncalibrated"), F.coalesce("context_reason", F.lit("no_calibration"))).alias("capture_reason"),
        )
    )
    return selected, status.drop("menu_version", "uncalibrated", "context_reason")


def _captures_in_context(captures: DataFrame, services: DataFrame, counted: DataFrame, cals: DataFrame) -> DataFrame:
    """Captures of a known service with the frozen menu version (J-6) and the physical context (J-7)."""
    svc = services.select("service_id", "hall_id", "service_date", "meal_label", "menu_id", F.col("menu_version").alias("_cur"))
    att = counted.select("event_id", F.col("attempt_id").alias("counted_id"), F.col("menu_version").alias("_frozen"), "physical_method", "calibration_id")
    cal = cals.select("calibration_id", F.col("width_px").alias("_cw"), F.col("height_px").alias("_ch"))
    g = F.col("geometry")
    mismatch = (F.col("_cw") != g["width_px"]) | (F.col("_ch") != g["height_px"])
    return (
        captures.join(small(svc), ["service_id", "hall_id"])
        .join(att, "event_id", "left")
        .join(cal, "calibration_id", "left")
        .select(
            "event_id", "hall_id", "service_id", "service_date", "meal_label", "captured_at", "source", "state", "menu_id", "counted_id",
            "physical_method", "geometry",
            F.col("quality_flags").alias("capture_flags"),
            (g["width_px"] * g["height_px"]).alias("canvas"),
            F.when(F.col("_frozen") >= 1, F.col("_frozen")).otherwise(F.col("_cur")).alias("menu_version"),
            (F.col("counted_id").isNotNull() & F.col("physical_method").isNull()).alias("uncalibrated"),
            F.when(F.coalesce(mismatch, F.lit(False)), F.lit("incompatible_geometry")).otherwise(F.lit("no_calibration")).alias("context_reason"),
        )
    )


def _judged_rows(caps: DataFrame, measurements: DataFrame, items: DataFrame) -> DataFrame:
    """Each row of a counted attempt, first per measurement id, with its verdict (V-3 and on-menu)."""
    own = measurements.join(
        caps.filter((F.col("state") == "succeeded") & F.col("counted_id").isNotNull()).select(
            "event_id", F.col("counted_id").alias("_cid"), "geometry", "capture_flags", "menu_id", "menu_version"
        ),
        "event_id",
    ).filter(of_attempt("_cid"))
    slim = own.select(
        "measurement_id", "event_id", "attempt_id", "item_id", "menu_id", "remaining_area_px", "baseline_area_px", "raw_waste_fraction",
        F.col("mask_count.pixels_wasted").alias("pixels"),
        F.col("physical.method").alias("method"),
        F.col("physical.area_cm2").alias("area_cm2"),
        valid_mask_count().alias("_valid"),
    )
    rows = first_per_id(slim, "measurement_id", MEASUREMENT_ORDER)
    names = items.select("menu_id", "item_id", "display_name")
    return rows.join(names, ["menu_id", "item_id"], "left").select(
        "event_id", "measurement_id", "attempt_id", "item_id", "display_name", "pixels", "method", "area_cm2",
        (F.col("_valid") & (F.col("item_id").isNull() | F.col("display_name").isNotNull())).alias("_valid"),
    )


def selection_counts(caps: DataFrame, by: list[str]) -> DataFrame:
    """A-6 counts."""
    return caps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("captures"),
        F.count_if("analyzed").alias("analyzed_captures"),
        F.count_if(~F.col("analyzed")).alias("excluded_captures"),
        F.coalesce(F.sum("excluded_measurements"), F.lit(0)).alias("excluded_measurements"),
        F.count_if("calibrated").alias("calibrated_captures"),
        F.count_if("sample").alias("sample_captures"),
    )


def score(selected: DataFrame, waste: DataFrame, nutrition: DataFrame) -> DataFrame:
    """F-1, F-2 and J-4 on selected measurements."""
    df = join_factors(selected, waste, nutrition)
    unknown = F.col("item_id").isNull()
    df = df.withColumn("factor_key", F.when(~unknown, F.col("factor_key"))).withColumn("factor_table", F.when(~unknown, F.col("factor_table")))
    return df.withColumns({**impact_points("pixels", unknown), **physical_amounts("area_cm2", "method", unknown, F.col("capture_reason"))}).withColumn(
        "usable_physical", usable_physical("method", "area_cm2")
    )


def impact_aggregates() -> list[Column]:
    """Aggregates behind A-7 and A-8; sums over all-null columns stay null."""
    missing = F.col("impact_points").isNull()
    no_grams = F.col("grams").isNull()
    return [
        F.count(F.lit(1)).alias("measurements"),
        F.coalesce(F.sum("pixels"), F.lit(0)).cast("long").alias("pixels"),
        *[F.sum(c).alias(c) for c in POINT_COLS + PHYSICAL_COLS],
        F.count("impact_points").alias("with_points"),
        *[F.count_if(missing & (F.coalesce("unavailable_reason", F.lit("no_factor")) == r)).alias(f"points_{r}") for r in POINT_REASONS],
        F.count("grams").alias("with_grams"),
        *[
            F.count_if(no_grams & (F.coalesce("physical_unavailable_reason", F.lit("no_calibration")) == r)).alias(f"grams_{r}")
            for r in PHYSICAL_REASONS
        ],
        F.coalesce(F.bool_or("usable_physical"), F.lit(False)).alias("any_usable_physical"),
    ]


def with_reasons(df: DataFrame) -> DataFrame:
    """The top reasons of missing points and grams from their counts."""
    return (
        df.withColumn("unavailable_reason", top_reason_of({r: F.col(f"points_{r}") for r in POINT_REASONS}))
        .withColumn("physical_unavailable_reason", top_reason_of({r: F.col(f"grams_{r}") for r in PHYSICAL_REASONS}))
        .withColumn("physical_method", F.when(F.col("with_grams") > 0, F.lit(AREA_METHOD)))
        .withColumn("waste_factors_version", F.lit(WASTE_FACTORS_VERSION))
    )


def sum_impacts(scored: DataFrame, by: list[str]) -> DataFrame:
    """A-7."""
    return with_reasons(scored.groupBy(*by).agg(*impact_aggregates()))


def impact_coverage(scored: DataFrame, by: list[str]) -> DataFrame:
    """A-8."""
    cols = ["with_points", *[f"points_{r}" for r in POINT_REASONS], "with_grams", *[f"grams_{r}" for r in PHYSICAL_REASONS]]
    return scored.groupBy(*by).agg(*impact_aggregates()).select(*by, *cols)


def group_key() -> Column:
    """A-9: factor key, else the normalized name, else the unknown bucket."""
    return (
        F.when(F.col("item_id").isNull(), F.lit("?unknown"))
        .when(F.col("factor_key").isNotNull(), F.concat(F.lit("f:"), F.col("factor_key")))
        .otherwise(F.concat(F.lit("n:"), F.lower(F.trim("display_name"))))
    )


def portions_source(source: str = "portions_source") -> Column:
    """S-5: demo before csv before manual, as an aggregate."""
    return (
        F.when(F.bool_or(F.col(source) == "demo"), F.lit("demo"))
        .when(F.bool_or(F.col(source) == "csv"), F.lit("csv"))
        .when(F.count(source) > 0, F.lit("manual"))
    )


def food_rows(scored: DataFrame, portions: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """A-9: one row per food with sum-then-divide rates over its portion snapshots.

    One pass: rows are first summed per snapshot (service, version, item), which also thins out a
    hot food before the second shuffle; portions join at that level.
    """
    keys = [*(by or []), "group_key"]
    order = F.struct("service_date", "service_id", "captured_at", "event_id", "measurement_id")
    sums = impact_aggregates()
    names = F.min(F.struct(order.alias("o"), F.col("display_name").alias("n"))).alias("_first")
    snap_keys = list(dict.fromkeys([*keys, "service_id", "menu_version", "item_id"]))
    snaps = scored.withColumn("group_key", group_key()).groupBy(*snap_keys).agg(
        *sums, names, F.max("factor_key").alias("factor_key"), F.max("factor_table").alias("factor_table")
    )
    counted = ["measurements", "pixels", *POINT_COLS, *PHYSICAL_COLS, "with_points", "with_grams"]
    counted += [f"points_{r}" for r in POINT_REASONS] + [f"grams_{r}" for r in PHYSICAL_REASONS]
    again = [F.sum(c).alias(c) for c in counted] + [F.bool_or("any_usable_physical").alias("any_usable_physical")]
    again += [
        F.max("item_id").alias("item_id"),
        F.min("_first")["n"].alias("display_name"),
        F.max("factor_key").alias("factor_key"),
        F.max("factor_table").alias("factor_table"),
    ]
    if portions is None:
        return with_reasons(snaps.groupBy(*keys).agg(*again))
    named = F.col("item_id").isNotNull()
    snaps = snaps.join(unique_portions(portions), ["service_id", "menu_version", "item_id"], "left")
    again += [
        F.when(F.count_if(named) == F.count("portions_served"), F.sum("portions_served")).alias("portions_served"),
        F.min("portions_served").alias("_least"),
        portions_source().alias("_source"),
    ]
    out = with_reasons(snaps.groupBy(*keys).agg(*again))
    known = F.col("portions_served").isNotNull()
    rate = known & (F.col("portions_served") > 0) & (F.col("_least") > 0)
    all_points = F.col("with_points") == F.col("measurements")
    all_grams = F.col("with_grams") == F.col("measurements")
    return (
        out.withColumns(
            {
                "portions_source": F.when(known, F.col("_source")),
                "pixels_per_portion": F.when(rate, F.col("pixels") / F.col("portions_served")),
                "impact_per_portion": F.when(rate & all_points, F.col("impact_points") / F.col("portions_served")),
                "grams_per_portion": F.when(rate & all_grams, F.col("grams") / F.col("portions_served")),
            }
        ).drop("_least", "_source")
    )


def coverage(rows: DataFrame) -> DataFrame:
    """A-11 food part: one row of counts over named foods."""
    named = F.col("item_id").isNotNull()
    return rows.agg(
        F.count_if(named & F.col("factor_key").isNotNull()).alias("items_with_factor"),
        F.count_if(named & F.col("factor_key").isNull()).alias("items_without_factor"),
        F.count_if(named & (F.col("portions_served") > 0)).alias("items_with_portions"),
        F.coalesce(F.bool_or(F.col("portions_source") == "demo"), F.lit(False)).alias("demo_portions"),
    )


def neighbor_captures(captures: DataFrame, attempts: DataFrame) -> DataFrame:
    """A-11 capture part: captures whose counted attempt dropped food of a neighboring dish."""
    counted = counted_attempts(attempts).filter(F.array_contains("quality_flags", NEIGHBOR_FLAG)).select("event_id")
    return captures.filter(F.col("state") == "succeeded").join(counted, "event_id", "left_semi").agg(
        F.count(F.lit(1)).alias("captures_with_neighbor_food_excluded")
    )


def totals_by(scored: DataFrame, caps: DataFrame, by: list[str]) -> DataFrame:
    """A-10: sums per group; analyzed clean plates make an empty total a measured zero."""
    counts = selection_counts(caps, by)
    sums = scored.groupBy(*by).agg(*impact_aggregates())
    df = counts.join(sums, by, "left") if by else counts.crossJoin(F.broadcast(sums))  # no keys: one row each
    n = F.coalesce(F.col("measurements"), F.lit(0))
    count_cols = ["pixels", "with_points", "with_grams", *[f"points_{r}" for r in POINT_REASONS], *[f"grams_{r}" for r in PHYSICAL_REASONS]]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in count_cols})
    df = with_reasons(df)
    clean = (n == 0) & (F.col("analyzed_captures") > 0)
    phys_zero = F.col("grams").isNull() & (F.col("calibrated_captures") > 0) & ~F.coalesce(F.col("any_usable_physical"), F.lit(False))
    df = df.withColumns({c: F.when(clean, F.lit(0.0)).otherwise(F.col(c)) for c in POINT_COLS})
    df = df.withColumn("_pz", phys_zero)
    df = df.withColumns({c: F.when(F.col("_pz"), F.lit(0.0)).otherwise(F.col(c)) for c in PHYSICAL_COLS})
    return (
        df.withColumn("physical_method", F.when(F.col("_pz"), F.lit(AREA_METHOD)).otherwise(F.col("physical_method")))
        .withColumn("physical_unavailable_reason", F.when(~F.col("_pz"), F.col("physical_unavailable_reason")))
        .drop("_pz", "measurements", "any_usable_physical")
    )


def with_periods(df: DataFrame, date: str, today, previous: bool = False) -> DataFrame:
    """A-15/A-16: repeat each row once per headline period its date falls in (today, week, month).

    With ``previous`` also the window of equal length right before each period.
    """
    t, d = as_date(today), F.col(date)
    marks = []
    for name, start in (("today", t), ("week", week_start(t)), ("month", month_start(t))):
        marks.append(F.when(d.between(start, t), F.struct(F.lit(name).alias("period"), F.lit(False).alias("is_previous"))))
        if previous:
            days = F.datediff(t, start) + 1
            marks.append(
                F.when(
                    d.between(F.date_sub(start, days), F.date_sub(start, F.lit(1))),
                    F.struct(F.lit(name).alias("period"), F.lit(True).alias("is_previous")),
                )
            )
    return df.withColumn("_p", F.explode(F.array_compact(F.array(*marks)))).select(df["*"], "_p.*")


def headline_totals(scored: DataFrame, caps: DataFrame, today) -> DataFrame:
    """A-16: totals for today, this week and this month from one read."""
    s = with_periods(scored, "service_date", today).drop("is_previous")
    c = with_periods(caps, "service_date", today).drop("is_previous")
    df = totals_by(s, c, ["period"])
    est = (F.col("grams").isNotNull()) & (F.col("calibrated_captures") > 0)
    return df.select(
        "period",
        "pixels",
        "impact_points",
        "captures",
        "analyzed_captures",
        "sample_captures",
        F.when(est, F.col("grams")).alias("est_grams"),
        F.when(est, F.col("kg_co2e")).alias("est_kg_co2e"),
        F.when(est, F.col("water_litres")).alias("est_water_litres"),
        F.when(est, F.col("calibrated_captures")).alias("est_calibrated_captures"),
    )


def date_spine(spark, start, end, name: str = "date") -> DataFrame:
    """Every date of a window, as rows."""
    return spark.range(1).select(F.explode(F.sequence(as_date(start), as_date(end))).alias(name))


def daily_impact(scored: DataFrame, caps: DataFrame, start, end) -> DataFrame:
    """A-17: one row per local date; null where nothing was analyzed or calibrated."""
    inside = F.col("service_date").between(as_date(start), as_date(end))
    t = totals_by(scored.filter(inside), caps.filter(inside), ["service_date"])
    spine = date_spine(scored.sparkSession, start, end)
    df = spine.join(t, spine["date"] == t["service_date"], "left")
    analyzed = F.coalesce("analyzed_captures", F.lit(0))
    calibrated = F.coalesce("calibrated_captures", F.lit(0))
    return df.select(
        "date",
        F.when(analyzed > 0, F.col("pixels")).alias("pixels"),
        F.when(calibrated > 0, F.col("kg_co2e")).alias("kg_co2e"),
        F.when(analyzed > 0, F.col("co2_points")).alias("co2_points"),
        analyzed.alias("analyzed_captures"),
        calibrated.alias("calibrated_captures"),
    )


def trend_halves(scored: DataFrame, caps: DataFrame, start, end) -> DataFrame:
    """A-18: pixels per analyzed plate in both halves of a window (split at floor(days / 2)), one row."""
    s, e = as_date(start), as_date(end)
    days = F.datediff(e, s) + 1
    mid_end = F.date_add(s, (F.floor(days / 2) - 1).cast("int"))
    first = F.col("service_date") <= mid_end
    inside = F.col("service_date").between(s, e)
    px = scored.filter(inside).agg(
        F.coalesce(F.sum(F.when(first, F.col("pixels"))), F.lit(0)).alias("earlier_pixels"),
        F.coalesce(F.sum(F.when(~first, F.col("pixels"))), F.lit(0)).alias("later_pixels"),
    )
    plates = caps.filter(inside & F.col("analyzed")).agg(
        F.count_if(first).alias("earlier_plates"), F.count_if(~first).alias("later_plates")
    )
    df = px.crossJoin(F.broadcast(plates))  # one row each
    a = F.col("earlier_pixels") / F.nullif(F.col("earlier_plates"), F.lit(0))
    b = F.col("later_pixels") / F.nullif(F.col("later_plates"), F.lit(0))
    change = F.when(a == 0, F.when(b == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise((b - a) / F.nullif(a, F.lit(0.0)))
    return df.select(
        s.alias("earlier_start"),
        mid_end.alias("earlier_end"),
        F.date_add(mid_end, 1).alias("later_start"),
        e.alias("later_end"),
        "earlier_pixels",
        "later_pixels",
        "earlier_plates",
        "later_plates",
        a.alias("earlier_rate"),
        b.alias("later_rate"),
        change.alias("change"),
        F.when((a.isNull()) | b.isNull() | (days < 2), F.lit(None).cast("string"))
        .when(F.abs(change) < 0.05, F.lit("flat"))
        .when(change < 0, F.lit("down"))
        .otherwise(F.lit("up"))
        .alias("direction"),
    )


def pixel_rollup(selected: DataFrame) -> DataFrame:
    """A-25: pixel subtotals by hall, date and meal in one pass."""
    return selected.rollup("hall_id", "service_date", "meal_label").agg(
        F.grouping_id().cast("long").alias("level"), F.sum("pixels").alias("pixels"), F.count(F.lit(1)).alias("measurements")
    )
