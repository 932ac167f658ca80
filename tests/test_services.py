"""Golden scenarios and hand-calculated service cases, re-typed as small tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from traymetrics.operators import eligibility as E
from traymetrics.operators import impact as I
from traymetrics.operators import picking as P
from traymetrics.operators import services as S
from traymetrics.schemas import TABLES

GEO = (1024, 1024, "topdown-normalized-v1", None, None)
T0 = datetime.datetime(2026, 10, 3, 16, 0)
DAY = datetime.date(2026, 10, 3)


def capture(event, service="s1", state="succeeded", geo=GEO, flags=(), hall="h"):
    return (event, hall, service, T0, f"img-{event}", geo, "camera", list(flags), state)


def service(sid="s1", version=1, hall="h", meal="lunch"):
    return (sid, hall, "America/Detroit", DAY, meal, f"menu_{sid}", version)


def measurement(mid, event, item, px, base=None, frac=None, flags=(), attempt=None, method="mask_pixel_count", sid="s1", geo=GEO, validated=True, phys=None):
    mask = (int(px) if 0 <= px < 1e12 else 0, f"mask-{mid}", geo, f"menu_{sid}", 1, "c1", "s1", "p1", "exclusive", validated)
    return (mid, event, attempt or f"att-{event}", item, float(px), None, base, frac, None, None, method, list(flags), mask, phys)


def attempt(event, status="succeeded", version=1, at=T0, suffix="", flags=(), cal=None, method=None):
    return (f"att-{event}{suffix}", event, "m", version, None, "model", "p", status, list(flags), at, cal, method, None)


def frame(spark, table, rows):
    return spark.createDataFrame(rows, TABLES[table])


def tables(spark, captures, measurements, services=None, attempts=None, items=()):
    attempts = attempts if attempts is not None else [attempt(c[0]) for c in captures if c[8] == "succeeded"]
    a = frame(spark, "analysis_attempt", attempts).drop("baseline_versions")
    return dict(
        captures=frame(spark, "capture_event", captures), measurements=frame(spark, "food_measurement", measurements), services=frame(spark, "meal_service", services or [service()]), attempts=a,
        items=frame(spark, "menu_item", [(i, m, n, None, None) for i, m, n in items]),
    )


def attendance(spark, *rows):
    return spark.createDataFrame(list(rows), "service_id string, count long")


def test_percent_is_area_weighted(spark):
    t = tables(
        spark,
        [capture("a"), capture("b", "s2")],
        [measurement("1", "a", "x", 40000, 60000.0), measurement("2", "a", "y", 5000, 30000.0), measurement("3", "b", "x", 9000, 10000.0), measurement("4", "b", "y", 1000, 90000.0), measurement("5", "b", "y", 0, 0.0)],
        [service(), service("s2")],
    )
    rows = {r.service_id: r for r in S.summarize_service(t["captures"], t["measurements"], t["services"], attendance(spark, ("s1", 500))).collect()}
    assert (rows["s1"].remaining_area_px, rows["s1"].overall_waste_percent, rows["s1"].area_per_attendee) == (45000.0, 50.0, 90.0)
    assert (rows["s2"].overall_waste_percent, rows["s2"].x_invalid_baseline, rows["s2"].attendee_unavailable_reason) == (10.0, 1, "attendance_missing")


def test_first_failing_reason_wins(spark):
    inf = float("inf")
    rows = [
        measurement("1", "a", None, inf, 1.0), measurement("2", "a", "x", inf, 1.0), measurement("3", "a", "x", 1), measurement("4", "a", "x", 1, 0.0),
        measurement("5", "a", "x", 1, 2.0, 0.5, ["above_baseline"]), measurement("6", "a", "x", 3, 2.0, 1.5), measurement("7", "a", "x", 1, 2.0, 0.5), measurement("8", "a", "", -1, 2.0),
    ]
    df = frame(spark, "food_measurement", rows)
    got = [r.r for r in df.select("measurement_id", E.measurement_reason().alias("r")).orderBy("measurement_id").collect()]
    assert got == ["unknown_item", "invalid_remaining", "missing_baseline", "invalid_baseline", "above_baseline", "above_baseline", None, "unknown_item"]
    view = [r.r for r in df.select("measurement_id", E.summary_reason().alias("r")).orderBy("measurement_id").collect()]
    assert view == ["invalid_value", "invalid_value", "missing_baseline", "missing_baseline", None, "above_baseline", None, "invalid_value"]


def test_plate_percents(spark):
    t = tables(
        spark,
        [capture("a"), capture("clean"), capture("bad", state="failed"), capture("none")],
        [measurement("1", "a", "x", 30000, 20000.0), measurement("2", "a", "y", 10000, 20000.0), measurement("3", "none", None, 5, 9.0)],
    )
    got = {r.event_id: r.plate_waste_percent for r in S.plate_waste_percent(t["captures"], t["measurements"]).collect()}
    assert got == {"a": 75.0, "clean": 0.0, "bad": None, "none": None}
    avg = S.average_plate_waste(S.plate_waste_percent(t["captures"], t["measurements"]), []).first()
    assert (avg.average_percent, avg.plates_counted, avg.plates_without_percent) == (37.5, 2, 2)


def test_pixel_summary_reasons(spark):
    small = (512, 512, "topdown-normalized-v1", None, None)
    caps = [capture("c1"), capture("c2"), capture("empty"), capture("part"), capture("failed", state="failed"), capture("legacy"), capture("small", geo=small), capture("wait", state="processing")]
    status = {"c1": ("complete", 450), "c2": ("complete", 300), "empty": ("empty", 0), "part": ("partial", 10), "legacy": (None, None), "small": ("complete", 9)}
    att = frame(spark, "analysis_attempt", [attempt(e) for e in status] + [attempt("failed", "failed")]).drop("baseline_versions")
    counts = spark.createDataFrame([(f"att-{e}", s, p) for e, (s, p) in status.items()], "attempt_id string, count_status string, capture_pixels_wasted long")
    att = att.join(counts, "attempt_id", "left")
    meas = frame(spark, "food_measurement", [measurement("1", "c1", "fries", 250), measurement("2", "c1", "burger", 200), measurement("3", "c2", "fries", 200), measurement("4", "c2", None, 100)])
    pc = S.pixel_captures(frame(spark, "capture_event", caps), att)
    row = S.pixel_summary(frame(spark, "meal_service", [service()]), pc, meas, attendance(spark, ("s1", 500))).first()
    assert (row.pixels_wasted, row.counted_count, row.empty_plates, row.excluded_count, row.unclassified_pixels, row.pixels_per_attendee) == (750, 3, 1, 5, 100.0, 1.5)
    got = [row[f"x_{r}"] for r in S.PIXEL_REASONS]
    assert got == [1, 1, 0, 1, 0, 1, 1]
    items = {r.item_id: (r.pixels_wasted, r.captures, r.share_percent) for r in S.pixel_items(pc, meas).collect()}
    assert items == {"fries": (450.0, 2, 60.0), "burger": (200.0, 1, pytest.approx(26.6667, abs=1e-3))}


def test_portion_benchmark_ranks_by_rate(spark):
    t = tables(spark, [capture("e1")], [measurement("1", "e1", "a", 200000), measurement("2", "e1", "b", 100000)], items=[("a", "menu_s1", "A"), ("b", "menu_s1", "B"), ("c", "menu_s1", "C")])
    portions = spark.createDataFrame([("s1", 1, "a", 1000, "csv"), ("s1", 1, "b", 100, "csv"), ("s1", 1, "c", 5, "csv")], "service_id string, menu_version long, item_id string, count long, source string")
    bench, counts = S.portion_benchmark(t["services"], t["items"], t["captures"], t["measurements"], portions)
    got = {r.item_id: (r.pixels_per_portion, r.unavailable_reason) for r in bench.collect()}
    assert got == {"a": (200.0, None), "b": (1000.0, None), "c": (None, "no_mask_counts")}
    assert counts.first().measured_dishes == 1


def test_portion_benchmark_deals_rows_by_event_once(spark):
    """What an event is found to be stands beside its rows, so the frozen rows are not dealt by event again."""
    meas = [
        measurement("1", "e1", "a", 200000), measurement("2", "e1", "a", 100000), measurement("3", "e1", "d", 5000), measurement("4", "e2", "a", 700000),
        measurement("5", "e2", "a", 700000), measurement("6", "e3", "a", 1000), measurement("6", "e3", "a", 1000), measurement("7", "e4", "a", 9),
    ]
    t = tables(spark, [capture(e) for e in ("e1", "e2", "e3")] + [capture("e4", state="failed")], meas, items=[("a", "menu_s1", "A"), ("b", "menu_s1", "B")])
    portions = spark.createDataFrame([("s1", 1, "a", 100, "csv")], "service_id string, menu_version long, item_id string, count long, source string")
    bench, counts = S.portion_benchmark(t["services"], t["items"], t["captures"], t["measurements"], portions)
    for df in (bench, counts):
        assert "hashpartitioning(event_id" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.item_id: (r.pixels_wasted, r.pixels_per_portion, r.measured_captures, r.unavailable_reason) for r in bench.collect()}
    assert got == {"a": (301000, 3010.0, 2, None), "b": (None, None, 0, "no_mask_counts")}
    assert counts.collect() == [("s1", 4, 2, 4)]  # e2 is over its image, e4 failed, d is not on the menu


def impact_case(spark, shuffle=False):
    caps = [capture("p1"), capture("p2"), capture("p3"), capture("x", state="failed"), capture("q", "s2")]
    meas = [
        measurement("1", "p1", "steak1", 5000), measurement("2", "p2", "steak1", 3000), measurement("3", "q", "steak2", 2500, sid="s2"), measurement("4", "p1", "pizza", 10000),
        measurement("5", "p2", "tofu", 1000), measurement("6", "p3", None, 2000), measurement("7", "x", "pizza", 999),
    ]
    items = [("steak1", "menu_s1", "Ancho Steak"), ("steak2", "menu_s2", "Ancho  Steak"), ("pizza", "menu_s1", "Pizza"), ("tofu", "menu_s1", "Tofu")]
    portions = [("s1", 1, "steak1", 4, "csv"), ("s2", 1, "steak2", 2, "demo"), ("s1", 1, "pizza", 10, "manual"), ("s1", 1, "tofu", 5, "csv")]
    if shuffle:
        for rows in (caps, meas, items, portions):
            random.Random(7).shuffle(rows)
    t = tables(spark, caps, meas, [service(), service("s2")], items=items)
    waste = spark.createDataFrame(
        [("ancho-steak", "common-500", 9.0, 9.0, 9.0, 9.0), ("ancho-steak", "east-quad", 1.2, 131.69, 1.925, 27.9), ("pizza", "east-quad", 1.0, 16.06, 1.94, 5.9)],
        "factor_key string, table string, weight_g_per_cm2 double, kg_co2e_per_kg double, water_m3_per_kg double, impact_usd_per_kg double",
    )
    nutrition = spark.createDataFrame([("pizza", 0.69)], "factor_key string, nutrient_days_per_kg double")
    cals = spark.createDataFrame([], TABLES["camera_calibration"])
    p = spark.createDataFrame(portions, "service_id string, menu_version long, item_id string, count long, source string")
    sel, status = I.select_impact(t["captures"], t["services"], t["measurements"], t["items"], t["attempts"], cals)
    return I.score(sel, waste, nutrition), status, p


@pytest.mark.parametrize("shuffle", [False, True])
def test_food_rows_sum_then_divide(spark, shuffle):
    scored, status, portions = impact_case(spark, shuffle)
    foods = I.food_rows(scored, portions).cache()
    rows = {r.group_key: r for r in foods.collect()}
    steak = rows["f:ancho-steak"]
    assert (steak.pixels, steak.portions_served, steak.pixels_per_portion, steak.portions_source, steak.item_id) == (10500, 6, 1750.0, "demo", "steak2")
    assert steak.factor_table == "east-quad" and steak.display_name == "Ancho Steak"
    assert rows["n:tofu"].impact_points is None and rows["n:tofu"].unavailable_reason == "no_factor" and rows["n:tofu"].impact_per_portion is None
    assert [r.group_key for r in P.rank_targets(foods).orderBy("rank").collect()] == ["f:ancho-steak", "f:pizza", "n:tofu"]
    assert [r.group_key for r in P.rank_most_wasted(foods).orderBy("rank").collect()] == ["f:ancho-steak", "f:pizza", "?unknown", "n:tofu"]
    totals = I.totals_by(scored, status, []).first()
    assert (totals.pixels, totals.captures, totals.analyzed_captures, totals.excluded_captures) == (23500, 5, 4, 1)
    assert totals.impact_points == pytest.approx(411.26, abs=0.01)
    assert totals.grams is None and totals.physical_unavailable_reason == "no_calibration"
    cover = I.coverage(foods).first()
    assert (cover.items_with_factor, cover.items_without_factor, cover.items_with_portions, cover.demo_portions) == (2, 1, 3, True)
    foods.unpersist()


def test_clean_plates_are_a_measured_zero(spark):
    t = tables(spark, [capture("clean")], [], attempts=[attempt("clean", cal="k", method="area-calibrated-v1")])
    cals = spark.createDataFrame([], TABLES["camera_calibration"])
    sel, status = I.select_impact(t["captures"], t["services"], t["measurements"], t["items"], t["attempts"], cals)
    empty_w = spark.createDataFrame([], "factor_key string, table string, weight_g_per_cm2 double, kg_co2e_per_kg double, water_m3_per_kg double, impact_usd_per_kg double")
    scored = I.score(sel, empty_w, spark.createDataFrame([], "factor_key string, nutrient_days_per_kg double"))
    row = I.totals_by(scored, status, []).first()
    assert (row.pixels, row.impact_points, row.grams, row.calibrated_captures) == (0, 0.0, 0.0, 1)
    none = I.totals_by(scored, status.filter("false"), []).first()
    assert (none.pixels, none.impact_points, none.grams) == (0, None, None)


def test_frozen_menu_version_and_two_attempts(spark):
    t = tables(spark, [capture("a"), capture("b")], [measurement("1", "a", "x", 10), measurement("2", "b", "x", 20, attempt="att-b")], [service(version=3)],
               [attempt("a", version=1), attempt("b", version=2), attempt("b", "failed", at=T0 + datetime.timedelta(hours=1), suffix="-2")], [("x", "menu_s1", "X")])
    cals = spark.createDataFrame([], TABLES["camera_calibration"])
    sel, status = I.select_impact(t["captures"], t["services"], t["measurements"], t["items"], t["attempts"], cals)
    assert [(r.event_id, r.menu_version) for r in sel.collect()] == [("a", 1)]  # b's mask names version 1, its attempt froze 2
    assert {r.event_id: r.analyzed for r in status.collect()} == {"a": True, "b": False}
