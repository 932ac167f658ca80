"""Impact: selection, scoring, food rows, totals, series, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from traymetrics.catalog.bindings import Tables
from traymetrics.catalog.registry import longs, query, r4
from traymetrics.operators import impact as I
from traymetrics.operators import joins as J
from traymetrics.operators import picking as P

# windows of the registered queries: the data's whole range, and one day for the headline periods
START, END, TODAY = "1995-01-01", "2001-12-31", "1998-04-01"


def selected(t: Tables):
    return I.select_impact(t.captures(), t.services(), t.measurements(), t.menu_items(), t.attempts(), t.calibrations())


def scored(t: Tables):
    sel, caps = selected(t)
    return I.score(sel, t.waste_factors(), t.nutrition_factors()), caps


FOODS_SQL = """
, keyed AS (SELECT *, CASE WHEN item_id IS NULL THEN '?unknown' WHEN factor_key IS NOT NULL THEN 'f:' || factor_key ELSE 'n:' || lower(trim(display_name)) END AS group_key FROM scored),
foods0 AS (
 SELECT group_key, CAST(sum(pixels) AS BIGINT) AS pixels, sum(co2_points) AS co2_points, sum(impact_points) AS impact_points, sum(nutrition_points) AS nutrition_points,
  sum(grams) AS grams, sum(kg_co2e) AS kg_co2e, sum(water_litres) AS water_litres, max(item_id) AS item_id, max(factor_key) AS factor_key, max(factor_table) AS factor_table,
  arg_min(display_name, (service_date, service_id, captured_at, event_id, measurement_id)) AS display_name,
  count(*) AS n, count(impact_points) AS n_points, count(grams) AS n_grams FROM keyed GROUP BY group_key),
snaps AS (SELECT DISTINCT group_key, service_id, menu_version, item_id FROM keyed WHERE item_id IS NOT NULL),
rates AS (
 SELECT group_key, CASE WHEN count(*) = count(portions_served) THEN sum(portions_served) END AS portions_served, min(portions_served) AS least,
  CASE WHEN count(*) = count(portions_served) THEN CASE WHEN bool_or(portions_source = 'demo') THEN 'demo' WHEN bool_or(portions_source = 'csv') THEN 'csv' ELSE 'manual' END END AS portions_source
 FROM snaps LEFT JOIN portion1 USING (service_id, menu_version, item_id) GROUP BY group_key),
foods AS (
 SELECT f.*, CAST(r.portions_served AS BIGINT) AS portions_served, r.portions_source,
  CASE WHEN r.portions_served > 0 AND least > 0 THEN pixels / r.portions_served END AS pixels_per_portion,
  CASE WHEN r.portions_served > 0 AND least > 0 AND n_points = n THEN impact_points / r.portions_served END AS impact_per_portion,
  CASE WHEN r.portions_served > 0 AND least > 0 AND n_grams = n THEN grams / r.portions_served END AS grams_per_portion
 FROM foods0 f LEFT JOIN rates r USING (group_key))
"""


def foods(t: Tables):
    s, _ = scored(t)
    return I.food_rows(s, t.portions())


@query("q01_most_wasted", FOODS_SQL + """
SELECT row_number() OVER (ORDER BY pixels DESC, display_name, coalesce(item_id, ''), group_key) AS rank, group_key, item_id, display_name, pixels,
 round(co2_points, 4) AS co2_points, round(impact_points, 4) AS impact_points, round(grams, 4) AS grams FROM foods""")
def most_wasted(t):
    df = P.rank_most_wasted(foods(t))
    return r4(df.select("rank", "group_key", "item_id", "display_name", "pixels", "co2_points", "impact_points", "grams"), "co2_points", "impact_points", "grams")


@query("a06_select_impact", """
SELECT hall_id, count(*) AS captures, count(*) FILTER (analyzed) AS analyzed_captures, count(*) FILTER (NOT analyzed) AS excluded_captures,
 CAST(sum(excluded_rows) AS BIGINT) AS excluded_measurements, count(*) FILTER (calibrated) AS calibrated_captures, count(*) FILTER (sample) AS sample_captures
FROM caps GROUP BY hall_id""")
def select_counts(t):
    return I.selection_counts(selected(t)[1], ["hall_id"])


@query("a06_selected_measurements", """
SELECT service_id, count(*) AS measurements, CAST(sum(pixels) AS BIGINT) AS pixels, round(sum(area_cm2), 4) AS area_cm2 FROM sel GROUP BY service_id""")
def selected_rows(t):
    df = selected(t)[0].groupBy("service_id").agg(F.count(F.lit(1)).alias("measurements"), F.sum("pixels").alias("pixels"), F.sum("area_cm2").alias("area_cm2"))
    return r4(df, "area_cm2")


@query("a07_sum_impacts", """
SELECT service_id, CAST(sum(pixels) AS BIGINT) AS pixels, round(sum(co2_points), 4) AS co2_points, round(sum(water_points), 4) AS water_points,
 round(sum(impact_points), 4) AS impact_points, round(sum(nutrition_points), 4) AS nutrition_points, round(sum(grams), 4) AS grams,
 round(sum(kg_co2e), 4) AS kg_co2e, round(sum(water_litres), 4) AS water_litres,
 CASE WHEN count(*) FILTER (unavailable_reason IS NOT NULL) = 0 THEN NULL
  WHEN count(*) FILTER (unavailable_reason = 'unknown_item') >= count(*) FILTER (unavailable_reason = 'no_factor') THEN 'unknown_item' ELSE 'no_factor' END AS unavailable_reason,
 CASE WHEN count(grams) > 0 THEN 'area-calibrated-v1' END AS physical_method
FROM scored GROUP BY service_id""")
def sums(t):
    df = I.sum_impacts(scored(t)[0], ["service_id"])
    cols = ["co2_points", "water_points", "impact_points", "nutrition_points", "grams", "kg_co2e", "water_litres"]
    return r4(df.select("service_id", "pixels", *cols, "unavailable_reason", "physical_method"), *cols)


@query("a08_impact_coverage", """
SELECT meal_label, count(impact_points) AS with_points, count(*) FILTER (unavailable_reason = 'unknown_item') AS points_unknown_item,
 count(*) FILTER (unavailable_reason = 'no_factor') AS points_no_factor, count(grams) AS with_grams,
 count(*) FILTER (physical_reason = 'no_calibration') AS grams_no_calibration, count(*) FILTER (physical_reason = 'incompatible_geometry') AS grams_incompatible_geometry,
 count(*) FILTER (physical_reason = 'unknown_item') AS grams_unknown_item, count(*) FILTER (physical_reason = 'no_factor') AS grams_no_factor
FROM scored GROUP BY meal_label""")
def coverage_counts(t):
    return I.impact_coverage(scored(t)[0], ["meal_label"])


@query("a09_food_rows", FOODS_SQL + """
SELECT group_key, item_id, display_name, factor_key, factor_table, pixels, round(impact_points, 4) AS impact_points, round(nutrition_points, 4) AS nutrition_points,
 portions_served, portions_source, round(pixels_per_portion, 4) AS pixels_per_portion, round(impact_per_portion, 4) AS impact_per_portion, round(grams_per_portion, 4) AS grams_per_portion FROM foods""")
def food_rows(t):
    cols = ["impact_points", "nutrition_points", "pixels_per_portion", "impact_per_portion", "grams_per_portion"]
    df = foods(t).select("group_key", "item_id", "display_name", "factor_key", "factor_table", "pixels", "portions_served", "portions_source", *cols)
    return r4(df, *cols)


@query("a09_food_rows_by_service", """
, k AS (SELECT *, CASE WHEN item_id IS NULL THEN '?unknown' WHEN factor_key IS NOT NULL THEN 'f:' || factor_key ELSE 'n:' || lower(trim(display_name)) END AS group_key FROM scored),
f AS (SELECT service_id, group_key, CAST(sum(pixels) AS BIGINT) AS pixels, max(item_id) AS item_id FROM k GROUP BY ALL),
s AS (SELECT DISTINCT service_id, group_key, menu_version, item_id FROM k WHERE item_id IS NOT NULL),
r AS (SELECT service_id, group_key, CASE WHEN count(*) = count(portions_served) THEN sum(portions_served) END AS served, min(portions_served) AS least
 FROM s LEFT JOIN portion1 USING (service_id, menu_version, item_id) GROUP BY ALL)
SELECT service_id, group_key, f.item_id, pixels, CAST(served AS BIGINT) AS portions_served, round(CASE WHEN served > 0 AND least > 0 THEN pixels / served END, 4) AS pixels_per_portion
FROM f LEFT JOIN r USING (service_id, group_key)""")
def food_rows_service(t):
    df = I.food_rows(scored(t)[0], t.portions(), ["service_id"])
    return r4(df.select("service_id", "group_key", "item_id", "pixels", "portions_served", "pixels_per_portion"), "pixels_per_portion")


TOTALS_SQL = """
, cnt AS (SELECT {key}, count(*) AS captures, count(*) FILTER (analyzed) AS analyzed_captures, count(*) FILTER (calibrated) AS calibrated_captures, count(*) FILTER (sample) AS sample_captures FROM {caps} GROUP BY {key}),
sm AS (SELECT {key}, sum(pixels) AS pixels, sum(co2_points) AS co2_points, sum(impact_points) AS impact_points, sum(grams) AS grams, sum(kg_co2e) AS kg_co2e, sum(water_litres) AS water_litres, bool_or(area_cm2 IS NOT NULL) AS any_phys, count(*) AS n FROM {rows} GROUP BY {key}),
tot AS (
 SELECT {key}, captures, analyzed_captures, calibrated_captures, sample_captures, CAST(coalesce(pixels, 0) AS BIGINT) AS pixels,
  CASE WHEN n IS NULL AND analyzed_captures > 0 THEN 0 ELSE co2_points END AS co2_points, CASE WHEN n IS NULL AND analyzed_captures > 0 THEN 0 ELSE impact_points END AS impact_points,
  CASE WHEN grams IS NULL AND calibrated_captures > 0 AND NOT coalesce(any_phys, FALSE) THEN 0 ELSE grams END AS grams,
  CASE WHEN grams IS NULL AND calibrated_captures > 0 AND NOT coalesce(any_phys, FALSE) THEN 0 ELSE kg_co2e END AS kg_co2e,
  CASE WHEN grams IS NULL AND calibrated_captures > 0 AND NOT coalesce(any_phys, FALSE) THEN 0 ELSE water_litres END AS water_litres
 FROM cnt LEFT JOIN sm USING ({key}))
"""


@query("a10_service_totals", TOTALS_SQL.format(key="service_id", caps="caps", rows="scored") + """
SELECT service_id, captures, analyzed_captures, calibrated_captures, pixels, round(co2_points, 4) AS co2_points, round(impact_points, 4) AS impact_points, round(grams, 4) AS grams, round(kg_co2e, 4) AS kg_co2e FROM tot""")
def totals(t):
    s, c = scored(t)
    cols = ["co2_points", "impact_points", "grams", "kg_co2e"]
    return r4(I.totals_by(s, c, ["service_id"]).select("service_id", "captures", "analyzed_captures", "calibrated_captures", "pixels", *cols), *cols)


@query("a10_dashboard_totals", """
SELECT count(*) AS captures, count(*) FILTER (analyzed) AS analyzed_captures, (SELECT CAST(sum(pixels) AS BIGINT) FROM scored) AS pixels,
 (SELECT round(sum(impact_points), 2) FROM scored) AS impact_points, (SELECT round(sum(grams), 2) FROM scored) AS grams FROM caps""")
def totals_all(t):
    s, c = scored(t)
    df = I.totals_by(s, c, [])
    return df.select("captures", "analyzed_captures", "pixels", F.round("impact_points", 2).alias("impact_points"), F.round("grams", 2).alias("grams"))


@query("a11_coverage", FOODS_SQL + """
SELECT count(*) FILTER (item_id IS NOT NULL AND factor_key IS NOT NULL) AS items_with_factor, count(*) FILTER (item_id IS NOT NULL AND factor_key IS NULL) AS items_without_factor,
 count(*) FILTER (item_id IS NOT NULL AND portions_served > 0) AS items_with_portions, coalesce(bool_or(portions_source = 'demo'), FALSE) AS demo_portions,
 (SELECT count(*) FROM cap JOIN counted USING (event_id) WHERE state = 'succeeded' AND neighbor) AS captures_with_neighbor_food_excluded FROM foods""")
def coverage(t):
    return I.coverage(foods(t)).crossJoin(I.neighbor_captures(t.captures(), t.attempts()))


PERIOD_SQL = """
, p AS (SELECT * FROM (VALUES ('today', DATE '1998-04-01', DATE '1998-04-01'), ('week', DATE '1998-03-30', DATE '1998-04-01'), ('month', DATE '1998-04-01', DATE '1998-04-01')) v(period, d0, d1)),
caps_p AS (SELECT p.period, c.* FROM caps c JOIN p ON c.service_date BETWEEN d0 AND d1), rows_p AS (SELECT p.period, c.* FROM scored c JOIN p ON c.service_date BETWEEN d0 AND d1)
"""


@query("a16_headline_totals", PERIOD_SQL + TOTALS_SQL.format(key="period", caps="caps_p", rows="rows_p") + """
SELECT period, pixels, round(impact_points, 4) AS impact_points, captures, analyzed_captures, sample_captures,
 CASE WHEN grams IS NOT NULL AND calibrated_captures > 0 THEN round(grams, 4) END AS est_grams, CASE WHEN grams IS NOT NULL AND calibrated_captures > 0 THEN round(kg_co2e, 4) END AS est_kg_co2e,
 CASE WHEN grams IS NOT NULL AND calibrated_captures > 0 THEN round(water_litres, 4) END AS est_water_litres, CASE WHEN grams IS NOT NULL AND calibrated_captures > 0 THEN calibrated_captures END AS est_calibrated_captures FROM tot""")
def headline(t):
    s, c = scored(t)
    return r4(I.headline_totals(s, c, TODAY), "impact_points", "est_grams", "est_kg_co2e", "est_water_litres")


@query("a17_daily_impact", TOTALS_SQL.format(key="service_date", caps="caps", rows="scored") + """
SELECT d::DATE AS date, CASE WHEN analyzed_captures > 0 THEN pixels END AS pixels, CASE WHEN calibrated_captures > 0 THEN round(kg_co2e, 4) END AS kg_co2e,
 CASE WHEN analyzed_captures > 0 THEN round(co2_points, 4) END AS co2_points, coalesce(analyzed_captures, 0) AS analyzed_captures, coalesce(calibrated_captures, 0) AS calibrated_captures
FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) g(d) LEFT JOIN tot ON tot.service_date = d::DATE""")
def daily(t):
    s, c = scored(t)
    return r4(I.daily_impact(s, c, START, END), "kg_co2e", "co2_points")


@query("a18_trend_halves", """
, h AS (SELECT DATE '1995-01-01' + 1277 AS mid),
e AS (SELECT CAST(sum(CASE WHEN service_date <= mid THEN pixels ELSE 0 END) AS BIGINT) AS earlier_pixels, CAST(sum(CASE WHEN service_date > mid THEN pixels ELSE 0 END) AS BIGINT) AS later_pixels FROM scored, h),
pl AS (SELECT count(*) FILTER (service_date <= mid) AS earlier_plates, count(*) FILTER (service_date > mid) AS later_plates FROM caps, h WHERE analyzed)
SELECT earlier_pixels, later_pixels, earlier_plates, later_plates, round(later_pixels / later_plates / (earlier_pixels / earlier_plates) - 1, 4) AS change,
 CASE WHEN abs(later_pixels / later_plates / (earlier_pixels / earlier_plates) - 1) < 0.05 THEN 'flat' WHEN later_pixels / later_plates < earlier_pixels / earlier_plates THEN 'down' ELSE 'up' END AS direction,
 mid AS earlier_end FROM e, pl, h""")
def halves(t):
    s, c = scored(t)
    df = I.trend_halves(s, c, START, "2001-12-30")
    return r4(df.select("earlier_pixels", "later_pixels", "earlier_plates", "later_plates", "change", "direction", "earlier_end"), "change")


@query("a25_pixel_rollup", """
SELECT hall_id, service_date, meal_label, CAST(grouping(hall_id, service_date, meal_label) AS BIGINT) AS level, CAST(sum(pixels) AS BIGINT) AS pixels, count(*) AS measurements
FROM sel GROUP BY ROLLUP (hall_id, service_date, meal_label)""")
def rollup(t):
    return I.pixel_rollup(selected(t)[0])


@query("w07_rank_targets", FOODS_SQL + """
SELECT row_number() OVER (ORDER BY pixels_per_portion DESC NULLS LAST, display_name, item_id, group_key) AS rank, group_key, display_name, round(pixels_per_portion, 4) AS pixels_per_portion
FROM foods WHERE item_id IS NOT NULL""")
def targets(t):
    return r4(P.rank_targets(foods(t)).select("rank", "group_key", "display_name", "pixels_per_portion"), "pixels_per_portion")


@query("w09_rank_foods", FOODS_SQL + """
SELECT * FROM (SELECT row_number() OVER (ORDER BY impact_points IS NULL, impact_points DESC NULLS LAST, display_name, coalesce(item_id, ''), group_key) AS rank, group_key, display_name, round(impact_points, 4) AS impact_points
FROM foods) WHERE rank <= 8""")
def ranked(t):
    return r4(P.rank_foods(foods(t), "impact_points", 8).select("rank", "group_key", "display_name", "impact_points"), "impact_points")


@query("j04_join_factors", """
SELECT factor_key, tbl AS factor_table, count(*) AS measurements, round(min(weight_g_per_cm2), 4) AS weight_g_per_cm2, round(min(kg_co2e_per_kg), 4) AS kg_co2e_per_kg, round(min(nutrient_days_per_kg), 4) AS nutrient_days_per_kg
FROM menu LEFT JOIN factor f ON f.factor_key = replace(lower(display_name), ' ', '-') LEFT JOIN nutri USING (factor_key) GROUP BY ALL""")
def factors(t):
    df = J.join_factors(t.menu_items(), t.waste_factors(), t.nutrition_factors())
    # names without a waste factor keep a null key; their nutrition row never scores
    df = df.withColumn("nutrient_days_per_kg", F.when(F.col("factor_key").isNotNull(), F.col("nutrient_days_per_kg")))
    out = df.groupBy("factor_key", "factor_table").agg(
        F.count(F.lit(1)).alias("measurements"), *[F.min(c).alias(c) for c in ("weight_g_per_cm2", "kg_co2e_per_kg", "nutrient_days_per_kg")]
    )
    return r4(out, "weight_g_per_cm2", "kg_co2e_per_kg", "nutrient_days_per_kg")


@query("w06_factor_priority", "SELECT factor_key, tbl AS factor_table, round(weight_g_per_cm2, 4) AS weight_g_per_cm2 FROM factor")
def priority(t):
    return r4(J.factor_lookup(t.waste_factors()).select("factor_key", F.col("table").alias("factor_table"), "weight_g_per_cm2"), "weight_g_per_cm2")


@query("f01_impact_points", """
SELECT measurement_id, event_id, CAST(pixels AS BIGINT) AS pixels, round(co2_points, 4) AS co2_points, round(water_points, 4) AS water_points, round(impact_points, 4) AS impact_points, round(nutrition_points, 4) AS nutrition_points, unavailable_reason FROM scored""")
def points(t):
    cols = ["co2_points", "water_points", "impact_points", "nutrition_points"]
    return r4(scored(t)[0].select("measurement_id", "event_id", "pixels", *cols, "unavailable_reason"), *cols)


@query("f02_physical_amounts", """
SELECT measurement_id, event_id, round(grams, 4) AS grams, round(kg_co2e, 4) AS kg_co2e, round(water_litres, 4) AS water_litres, physical_reason AS physical_unavailable_reason FROM scored""")
def physical(t):
    cols = ["grams", "kg_co2e", "water_litres"]
    return r4(scored(t)[0].select("measurement_id", "event_id", *cols, "physical_unavailable_reason"), *cols)
