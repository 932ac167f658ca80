import pytest
from pyspark.sql import functions as F

from traymetrics.functions import dates as D
from traymetrics.functions import geometry as G
from traymetrics.functions import hashing as H
from traymetrics.functions import impact as M
from traymetrics.functions import numbers as N
from traymetrics.functions import text as X
from traymetrics.operators import validation as V


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def test_impact_points_of_a_pizza(spark):
    f = [F.lit(v) for v in (1.0, 16.06, 1.94, 3.0, 0.69)]
    p = M.impact_points(F.lit(10000), F.lit(False), *f)
    got = one(spark, p["co2_points"], p["water_points"], p["impact_points"], p["nutrition_points"], p["unavailable_reason"])
    assert got[:4] == pytest.approx((160.6, 19.4, 59.614, 6.9)) and got[4] is None
    q = M.impact_points(F.lit(10000), F.lit(True), *f)
    assert one(spark, q["impact_points"], q["unavailable_reason"]) == (None, "unknown_item")


def test_physical_amounts(spark):
    area = G.area_estimate(F.lit(8000), F.lit(46.21 / 18500))
    p = M.physical_amounts(area, F.lit("area-calibrated-v1"), F.lit(False), F.lit(None).cast("string"), F.lit(1.2), F.lit(131.69), F.lit(1.925))
    a, g, k, w = one(spark, area, p["grams"], p["kg_co2e"], p["water_litres"])
    assert (round(a, 2), round(g, 2), round(k, 2), round(w, 1)) == (19.98, 23.98, 3.16, 46.2)
    label = M.format_physical_label(F.lit(37.6), F.lit(1.14), F.lit(18.2))
    assert one(spark, label) == "38 g · 1.1 kg CO2e · 18 L water (est.)"
    none = M.physical_amounts(F.lit(5.0), F.lit(None).cast("string"), F.lit(False), F.lit("incompatible_geometry"), F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert one(spark, none["grams"], none["physical_unavailable_reason"]) == (None, "incompatible_geometry")


def test_names_and_text(spark):
    assert one(spark, X.slug(F.lit("Crème Brûlée  (Vegan)!"))) == "creme-brulee-vegan"
    assert one(spark, X.readable_item_name(F.lit("item_hall-main_2026-10-03_lunch_margherita-flatbread"))) == "Margherita Flatbread"
    assert one(spark, X.baseline_id(F.lit("item_a"), F.lit(3))) == "base_a_v3"
    assert one(spark, X.plain_text(F.lit("Less pizza — more salad 🍕 !"))) == "Less pizza, more salad!"
    assert one(spark, X.cap_text(F.lit("x" * 700))) == "x" * 597 + "..."
    assert one(spark, X.truth_foods(F.lit("Ham (2) & unkown & rice"))) == ["Ham", "rice"]


def test_rounding_and_formats(spark):
    assert one(spark, N.js_round(F.lit(2.5)), N.js_round(F.lit(-2.5)), N.js_round(F.lit(0.25), 1)) == (3.0, -2.0, 0.3)
    assert one(spark, N.sig2_text(F.lit(131.69)), N.sig2_text(F.lit(1234.0)), N.sig2_text(F.lit(0.0456))) == ("130", "1,200", "0.046")
    assert one(spark, N.format_compact(F.lit(1284)), N.format_compact(F.lit(12900)), N.format_compact(F.lit(1_200_000))) == ("1,284", "12.9k", "1.2M")
    assert one(spark, N.format_delta_percent(F.lit(112), F.lit(100)), N.format_delta_percent(F.lit(92), F.lit(100)), N.format_delta_percent(F.lit(5), F.lit(0))) == ("+12%", "−8%", None)
    assert one(spark, N.nice_ceil(F.lit(230.0)), N.nice_ceil(F.lit(0.0)), N.nice_ceil(F.lit(26.0))) == (250.0, 10.0, 50.0)
    assert one(spark, N.format_mass(F.lit(1234.0)), N.format_mass(F.lit(0.27)), N.format_points_display(F.lit(95.68))) == ("1.2 kg", "0.27 g", "95.7")


def test_hashes_match_known_values(spark):
    key = "attendance-gen-v1|demo-seed-1|hall-main|svc_hall-main_2026-10-03_lunch|2026-10-03"
    h = 2166136261
    for ch in key:
        h = (h ^ ord(ch)) * 16777619 % 2**32
    assert one(spark, H.fnv1a32(F.lit(key))) == h
    assert one(spark, H.first_draw(F.lit(195552391))) == pytest.approx(0.8677154274191707)
    count = H.attendance_count(F.lit("hall-main"), F.lit("svc_hall-main_2026-10-03_lunch"), F.lit("2026-10-03").cast("date"), 300, 1200, F.lit("demo-seed-1"))
    assert one(spark, count) == 1081


def test_wall_time_around_clock_changes(spark):
    tz = F.lit("America/Detroit")
    at = lambda d, t: one(spark, D.zoned_to_utc(F.lit(d).cast("date"), F.lit(t), tz).cast("string"))
    assert at("2026-10-03", "12:00") == "2026-10-03 16:00:00"
    assert at("2026-11-01", "01:30") == "2026-11-01 05:30:00"  # twice: the first
    assert at("2026-03-08", "02:30") == "2026-03-08 06:30:00"  # skipped


def test_boxes_and_vectors(spark):
    box = lambda *v: G.box_to_pixels(F.array(*[F.lit(float(x)) for x in v]), F.lit(1000), F.lit(500))
    assert one(spark, box(100, 200, 300, 400)).asDict() == {"x0": 200.0, "y0": 50.0, "x1": 400.0, "y1": 150.0, "reason": None}
    reasons = [one(spark, b)["reason"] for b in (box(1, 2, 3), box(1, 2, float("nan"), 4), box(0, 0, 1001, 5), box(5, 5, 5, 9), box(0, 0, 1, 0.5))]
    assert reasons == ["box_not_4_numbers", "box_nonfinite", "box_out_of_range", "box_reversed_or_empty", "box_under_one_pixel"]
    vec = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(spark, G.mean_abs_diff(vec(1, 2), vec(3, 2))) == 1.0
    assert one(spark, G.mean_abs_diff(vec(1), vec(3, 2))) == float("inf")


def test_window_arguments():
    assert V.parse_window("2026-01-01", "2026-01-31", "h") == ("2026-01-01", "2026-01-31", "h")
    for bad in (("2026-1-1", "2026-01-02"), ("2026-02-30", "2026-03-01"), ("2026-03-02", "2026-03-01")):
        with pytest.raises(ValueError):
            V.parse_window(*bad)
    with pytest.raises(ValueError):
        V.parse_window("2025-01-01", "2026-06-01", max_days=366)
