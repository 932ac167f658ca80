"""Relative impact points, physical estimates and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traymetrics.functions.numbers import (
    amount_text,
    as_col,
    finite_nonneg,
    js_round,
    sig2_text,
    whole,
)

# fixed values: score weights, pixel unit, labels
PIXELS_PER_POINT_UNIT = 1000.0
CARBON_WEIGHT = 0.19
WATER_WEIGHT = 1.5
AREA_METHOD = "area-calibrated-v1"
LEGACY_VOLUME_METHOD = "volume-dav2-v1"
WASTE_FACTORS_VERSION = "waste-factors-v7"
UNKNOWN_FOOD_LABEL = "Food not on the menu"
RELATIVE_IMPACT_POINTS = "relative impact points"
NEIGHBOR_FLAG = "neighbor_food_excluded"
POINT_COLS = ["co2_points", "water_points", "impact_points", "nutrition_points"]
PHYSICAL_COLS = ["grams", "kg_co2e", "water_litres"]


def null_double() -> Column:
    return F.lit(None).cast("double")


def usable_factor(weight, c, w, usd) -> Column:
    return finite_nonneg(weight) & finite_nonneg(c) & finite_nonneg(w) & finite_nonneg(usd)


def impact_points(
    pixels,
    unknown: Column,
    weight="weight_g_per_cm2",
    c="kg_co2e_per_kg",
    w="water_m3_per_kg",
    usd="impact_usd_per_kg",
    nutrient="nutrient_days_per_kg",
) -> dict[str, Column]:
    """F-1: four points columns and the reason when they are missing (never zero)."""
    usable = usable_factor(weight, c, w, usd) & ~unknown
    base = as_col(pixels).cast("double") / F.lit(PIXELS_PER_POINT_UNIT) * as_col(weight)
    co2 = base * as_col(c)
    water = base * as_col(w)
    return {
        "co2_points": F.when(usable, co2),
        "water_points": F.when(usable, water),
        "impact_points": F.when(usable, F.lit(CARBON_WEIGHT) * co2 + F.lit(WATER_WEIGHT) * water),
        "nutrition_points": F.when(usable & finite_nonneg(nutrient), base * as_col(nutrient)),
        "unavailable_reason": F.when(unknown, F.lit("unknown_item")).when(~usable, F.lit("no_factor")),
    }


def usable_physical(method, area) -> Column:
    """A stored estimate that may be used: a known method and a finite area."""
    return F.coalesce(as_col(method).isin(AREA_METHOD, LEGACY_VOLUME_METHOD), F.lit(False)) & finite_nonneg(area)


def physical_amounts(
    area,
    method,
    unknown: Column,
    capture_reason: Column,
    weight="weight_g_per_cm2",
    c="kg_co2e_per_kg",
    w="water_m3_per_kg",
) -> dict[str, Column]:
    """F-2: grams, kg CO2e and litres from a calibrated area; reasons in fixed order."""
    calibrated = usable_physical(method, area)
    factor = finite_nonneg(weight) & finite_nonneg(c) & finite_nonneg(w)
    ok = ~unknown & calibrated & factor
    grams = as_col(area) * as_col(weight)
    return {
        "grams": F.when(ok, grams),
        "kg_co2e": F.when(ok, grams / 1000.0 * as_col(c)),
        "water_litres": F.when(ok, grams * as_col(w)),
        "physical_method": F.when(ok, F.lit(AREA_METHOD)),
        "physical_unavailable_reason": F.when(unknown, F.lit("unknown_item"))
        .when(~calibrated, F.coalesce(capture_reason, F.lit("no_calibration")))
        .when(~factor, F.lit("no_factor")),
    }


def format_grams(g) -> Column:
    return F.concat(whole(g), F.lit(" g"))


def format_co2e(kg) -> Column:
    k = as_col(kg)
    return F.when(k >= 0.1, F.concat(sig2_text(k), F.lit(" kg CO2e"))).otherwise(
        F.concat(sig2_text(k * 1000.0), F.lit(" g CO2e"))
    )


def format_water(litres) -> Column:
    return F.concat(sig2_text(litres), F.lit(" L water"))


def format_physical_label(grams, kg, litres, estimated: bool = True) -> Column:
    """F-11: '38 g · 1.1 kg CO2e · 18 L water (est.)', null without grams."""
    parts = F.concat_ws(
        " · ",
        format_grams(grams),
        F.when(finite_nonneg(kg), format_co2e(kg)),
        F.when(finite_nonneg(litres), format_water(litres)),
    )
    return F.when(finite_nonneg(grams), F.concat(parts, F.lit(" (est.)" if estimated else "")))


# F-12: the only number strings a recommendation may cite


def format_pixels(px) -> Column:
    return F.concat(whole(px), F.lit(" pixels"))


def format_pixel_rate(px) -> Column:
    return F.concat(amount_text(px), F.lit(" pixels"))


def format_points(p) -> Column:
    return F.concat(amount_text(p), F.lit(" " + RELATIVE_IMPACT_POINTS))


def target_metric(name, px_per_portion) -> Column:
    return F.concat(as_col(name), F.lit(": "), format_pixel_rate(px_per_portion), F.lit(" wasted per portion"))


def most_wasted_metric(name, pixels) -> Column:
    return F.concat(as_col(name), F.lit(": "), format_pixels(pixels), F.lit(" wasted in total"))


def impact_metric(name, points) -> Column:
    return F.concat(as_col(name), F.lit(": "), format_points(points))


def estimated_item_metric(name, kg, litres) -> Column:
    return F.concat(as_col(name), F.lit(": estimated "), format_co2e(kg), F.lit(" and "), format_water(litres))


def estimated_total_metric(amount_text_col: Column, calibrated, analyzed) -> Column:
    return F.concat(
        F.lit("Estimated total: "),
        amount_text_col,
        F.lit(" ("),
        as_col(calibrated).cast("string"),
        F.lit(" of "),
        as_col(analyzed).cast("string"),
        F.lit(" plates calibrated)"),
    )


def short_date(d) -> Column:
    return F.date_format(as_col(d), "MMM d")


def trend_metric(e_px, e_plates, e_start, e_end, l_px, l_plates, l_start, l_end) -> Column:
    def part(px, plates, start, end):
        return F.concat(
            format_pixel_rate(as_col(px) / as_col(plates)), F.lit(" ("), short_date(start), F.lit(" to "), short_date(end), F.lit(")")
        )

    return F.concat(
        F.lit("Pixels wasted per plate: "), part(e_px, e_plates, e_start, e_end), F.lit(" vs "), part(l_px, l_plates, l_start, l_end)
    )


# F-33: factor columns of the documented method


def factor_dollars(c, w) -> dict[str, Column]:
    """Carbon, water and their sum in dollars, each rounded half-up to cents."""
    carbon = F.lit(CARBON_WEIGHT) * as_col(c)
    water = F.lit(WATER_WEIGHT) * as_col(w)
    return {"carbon_usd": js_round(carbon, 2), "water_usd": js_round(water, 2), "impact_usd": js_round(carbon + water, 2)}


# F-20: recipes


def recipe_rows(recipe) -> Column:
    """'ham 0.8; sugar 0.03' to an array of (ingredient, kg)."""
    parts = F.filter(F.transform(F.split(as_col(recipe), ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, r"^(.*?)\s+([0-9.]+)$", 1)).alias("ingredient"),
            F.regexp_extract(p, r"^(.*?)\s+([0-9.]+)$", 2).try_cast("double").alias("kg"),
        ),
    )
