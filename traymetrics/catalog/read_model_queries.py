"""Read models and facts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traymetrics.catalog.bindings import Tables
from traymetrics.catalog.impact_queries import FOODS_SQL, PERIOD_SQL, TOTALS_SQL, foods, scored
from traymetrics.catalog.registry import query, r4
from traymetrics.catalog.service_queries import A12_SQL, A14_SQL, A1_SQL, A4_SQL, A5_SQL, benchmark, pixel_caps, pixel_sum, summaries
from traymetrics.functions import numbers as N
from traymetrics.functions.text import readable_item_name
from traymetrics.operators import facts as A
from traymetrics.operators import impact as I
from traymetrics.operators import joins as J
from traymetrics.operators import picking as P
from traymetrics.operators import services as S
from traymetrics.plans import read_models as Q

START, END, TODAY = "1995-01-01", "2001-12-31", "1998-04-01"


def store(t: Tables) -> Q.Store:
    return Q.Store(
        t.captures(), t.services(), t.measurements(), t.menu_items(), t.attempts(), t.calibrations(), t.portions(), t.attendance(), t.waste_factors(), t.nutrition_factors(), t.visibility(), t.views()
    )


@query("q01_impact_dashboard_totals", """
SELECT count(*) AS captures, count(*) FILTER (analyzed) AS analyzed_captures, count(*) FILTER (NOT analyzed) AS excluded_captures, count(*) FILTER (calibrated) AS calibrated_captures,
 (SELECT CAST(sum(pixels) AS BIGINT) FROM scored) AS pixels, (SELECT round(sum(impact_points), 2) FROM scored) AS impact_points FROM caps""", visible=True)
def q01(t):
    df = Q.impact_dashboard(store(t), START, END)["totals"]
    return df.select("captures", "analyzed_captures", "excluded_captures", "calibrated_captures", "pixels", F.round("impact_points", 2).alias("impact_points"))


@query("q01_impact_dashboard_targets", FOODS_SQL + """
SELECT row_number() OVER (ORDER BY pixels_per_portion DESC NULLS LAST, display_name, item_id, group_key) AS rank, group_key, pixels, portions_served, portions_source, round(pixels_per_portion, 4) AS pixels_per_portion FROM foods WHERE item_id IS NOT NULL""", visible=True)
def q01_targets(t):
    df = Q.impact_dashboard(store(t), START, END)["targets"]
    return r4(df.select("rank", "group_key", "pixels", "portions_served", "portions_source", "pixels_per_portion"), "pixels_per_portion")


@query("q02_impact_daily", TOTALS_SQL.format(key="service_date", caps="caps", rows="scored") + """
SELECT d::DATE AS date, CASE WHEN analyzed_captures > 0 THEN pixels END AS pixels, CASE WHEN analyzed_captures > 0 THEN round(co2_points, 4) END AS co2_points, coalesce(analyzed_captures, 0) AS analyzed_captures
FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) g(d) LEFT JOIN tot ON tot.service_date = d::DATE""", visible=True)
def q02(t):
    return r4(Q.impact_daily(store(t), START, END, max_days=None).select("date", "pixels", "co2_points", "analyzed_captures"), "co2_points")


@query("q03_impact_totals", PERIOD_SQL + TOTALS_SQL.format(key="period", caps="caps_p", rows="rows_p") + """
SELECT period, pixels, round(impact_points, 4) AS impact_points, captures, analyzed_captures, sample_captures FROM tot""", visible=True)
def q03(t):
    df = Q.impact_totals(store(t), TODAY)
    return r4(df.select("period", "pixels", "impact_points", "captures", "analyzed_captures", "sample_captures"), "impact_points")


@query("q04_meal_detail", A4_SQL + A5_SQL + """
SELECT s.service_id, coalesce(p.capture_count, 0) AS capture_count, coalesce(p.counted_count, 0) AS counted_count, coalesce(p.pixels_wasted, 0) AS pixels_wasted, coalesce(sv.measured_dishes, 0) AS measured_dishes
FROM svc s LEFT JOIN ps p USING (service_id) LEFT JOIN sv USING (service_id)""", visible=True)
def q04(t):
    return Q.meal_detail(store(t), START, END).select("service_id", "capture_count", "counted_count", "pixels_wasted", "measured_dishes")


@query("q05_daily", A14_SQL + """
SELECT d::DATE AS service_date, px AS pixels_wasted, coalesce(captured, 0) AS captured_dishes, coalesce(counted, 0) AS counted_dishes, coalesce(plates_counted, 0) AS plates_counted
FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) g(d) LEFT JOIN dd ON dd.service_date = d::DATE LEFT JOIN dp ON dp.service_date = d::DATE""", visible=True)
def q05(t):
    return Q.daily(store(t), START, END).drop("percent_sum", "plates_without_percent")


@query("q06_cards", A14_SQL + """
, p AS (SELECT * FROM (VALUES ('today', DATE '1998-04-01'), ('week', DATE '1998-03-30'), ('month', DATE '1998-04-01')) v(period, d0)),
w AS (SELECT period, d0, DATE '1998-04-01' AS d1, d0 - CAST(DATE '1998-04-01' - d0 + 1 AS INTEGER) AS p0, d0 - 1 AS p1 FROM p)
SELECT period, CAST(coalesce((SELECT sum(px) FROM dd WHERE service_date BETWEEN d0 AND d1), 0) AS BIGINT) AS pixels_wasted, CAST((SELECT sum(px) FROM dd WHERE service_date BETWEEN p0 AND p1) AS BIGINT) AS previous_pixels_wasted,
 (SELECT floor(sum(percent_sum) / sum(plates_counted) * 10 + 0.5) / 10 FROM dp WHERE service_date BETWEEN d0 AND d1) AS average_percent FROM w""", visible=True)
def q06(t):
    return Q.cards(store(t), TODAY).select("period", "pixels_wasted", "previous_pixels_wasted", "average_percent")


@query("q07_plates", A12_SQL + """
SELECT p.event_id, p.service_id, round(pct, 4) AS plate_waste_percent, count(m.measurement_id) AS foods, round(sum(CASE WHEN m.baseline_area_px > 0 THEN floor(least(100, 100 * m.remaining_area_px / nullif(m.baseline_area_px, 0)) * 10 + 0.5) / 10 END), 4) AS percent_sum
FROM pl p LEFT JOIN cm m ON m.event_id = p.event_id GROUP BY p.event_id, p.service_id, pct""", visible=True)
def q07(t):
    df = Q.plates(store(t), START, END)
    pct = F.aggregate(F.filter(F.transform("foods", lambda f: f["percent_of_serving"]), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    has = F.exists("foods", lambda f: f["percent_of_serving"].isNotNull())
    out = df.select("event_id", "service_id", "plate_waste_percent", F.coalesce(F.size("foods"), F.lit(0)).cast("long").alias("foods"), F.when(has, pct).alias("percent_sum"))
    return r4(out, "plate_waste_percent", "percent_sum")


@query("q08_service_summary", """
SELECT service_id, count(*) AS captured_dishes, count(*) FILTER (state = 'succeeded') AS analyzed_dishes FROM cap GROUP BY service_id""")
def q08(t):
    return Q.service_summary(store(t)).select("service_id", "captured_dishes", "analyzed_dishes")


@query("q09_capture_gallery", """
, g AS (SELECT event_id, sum(pixels) AS px FROM scored GROUP BY 1)
SELECT c.event_id, c.captured_at, c.state, (SELECT count(*) FROM caps) AS total, CASE WHEN c.state = 'succeeded' AND k.count_status IN ('complete', 'empty') AND c.analyzed THEN CAST(coalesce(px, 0) AS BIGINT) END AS pixels_wasted,
 CASE WHEN c.state = 'succeeded' AND k.count_status IN ('complete', 'empty') AND NOT c.analyzed THEN 'not_counted' END AS not_counted_reason,
 coalesce(CASE WHEN c.state = 'succeeded' AND k.attempt_id IS NOT NULL THEN k.overlay_object_id IS NOT NULL END, l.overlay_object_id IS NOT NULL) AS has_overlay
FROM caps c LEFT JOIN counted k ON k.event_id = c.event_id LEFT JOIN latest l ON l.event_id = c.event_id LEFT JOIN g ON g.event_id = c.event_id ORDER BY c.captured_at DESC, c.event_id DESC LIMIT 100""", visible=True)
def q09(t):
    return Q.capture_gallery(store(t), START, END, 100).select("event_id", "captured_at", "state", "total", "pixels_wasted", "not_counted_reason", "has_overlay")


@query("q10_portion_benchmark", A5_SQL + "SELECT service_id, count(*) AS items, count(*) FILTER (reason IS NULL) AS ranked, round(max(CASE WHEN reason IS NULL THEN px / portions_served END), 4) AS best FROM br GROUP BY service_id")
def q10(t):
    r = F.col("pixels_per_portion")
    df = Q.portion_benchmark(store(t)).groupBy("service_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("unavailable_reason").isNull()).alias("ranked"), F.max(r).alias("best"))
    return r4(df, "best")


FACT_SQL = FOODS_SQL + """
, ft AS (
 SELECT 'targets' AS list, row_number() OVER (ORDER BY pixels_per_portion DESC, display_name, group_key) AS rank, display_name AS food, floor(pixels_per_portion * 10 + 0.5) / 10 AS value FROM foods WHERE item_id IS NOT NULL AND pixels_per_portion IS NOT NULL
 UNION ALL SELECT 'most_wasted', row_number() OVER (ORDER BY pixels DESC, display_name, group_key), display_name, pixels FROM foods WHERE item_id IS NOT NULL
 UNION ALL SELECT 'highest_impact', row_number() OVER (ORDER BY impact_points DESC, display_name, group_key), display_name, floor(impact_points * 100 + 0.5) / 100 FROM foods WHERE item_id IS NOT NULL AND impact_points IS NOT NULL
 UNION ALL SELECT 'top_co2', row_number() OVER (ORDER BY kg_co2e DESC, display_name, group_key), display_name, NULL FROM foods WHERE item_id IS NOT NULL AND kg_co2e IS NOT NULL),
fc AS (SELECT * FROM ft WHERE rank <= CASE WHEN list IN ('targets', 'most_wasted') THEN 5 ELSE 3 END)
"""


@query("w10_top_facts", FACT_SQL + "SELECT list, rank, food, round(value, 4) AS value FROM fc")
def w10(t):
    df = A.top_facts(foods(t)).withColumn("value", F.when(F.col("list") != "top_co2", F.col("value")))
    return r4(df.drop("metric"), "value")


@query("f12_metric_strings", FACT_SQL + """
SELECT list, rank, food || CASE list WHEN 'most_wasted' THEN ': ' || format('{:,}', CAST(value AS BIGINT)) || ' pixels wasted in total' WHEN 'highest_impact' THEN ': ' || format('{:,}', CAST(floor(value + 0.5) AS BIGINT)) || ' relative impact points' END AS metric
FROM fc WHERE list IN ('most_wasted', 'highest_impact')""")
def f12(t):
    return A.top_facts(foods(t)).filter("list in ('most_wasted', 'highest_impact')").select("list", "rank", "metric")


@query("q11_recommendation_allowed", """
SELECT 1 AS rank, CAST(count(*) FILTER (analyzed) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' plates analyzed' AS metric FROM caps
UNION ALL SELECT 2, 'Total: ' || format('{:,}', CAST(sum(pixels) AS BIGINT)) || ' pixels wasted' FROM scored UNION ALL SELECT 3, 'Total: ' || format('{:,}', CAST(floor(sum(impact_points) + 0.5) AS BIGINT)) || ' relative impact points' FROM scored""", visible=True)
def q11(t):
    df = Q.recommendation(store(t), START, END)["allowed"]
    return df.filter("list = 'totals' and rank <= 3").select(F.col("rank").cast("int").alias("rank"), "metric")


@query("q11_recommendation_fallback")
def q11_text(t):
    """Rule-based text; its wording is tested on hand-made facts."""
    df = Q.recommendation(store(t), START, END)["fallback"]
    return df.select("text", F.to_json("bullets").alias("bullets"))


@query("q12_saved_recommendations", """
WITH i AS (SELECT conv_id, turn, 'hall-' || CAST(conv_id % 5 AS VARCHAR) AS hall_id, role, text, TIMESTAMP '1995-12-31 00:00:00' + to_hours(turn * 12) AS made FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS insight_id, hall_id, text, 2 AS bullets, CASE WHEN turn % 3 = 0 THEN 'gemini' ELSE 'fallback' END AS source, made AS generated_at FROM i
WHERE role = 'user' AND turn % 5 <> 4 AND NOT (hall_id = 'hall-4' AND made < TIMESTAMP '1996-01-01')""", domain=False)
def q12(t):
    n = F.col("turn")
    body = F.to_json(F.struct("text", F.array(F.struct(F.lit("a").alias("text"), F.lit("m").alias("metric")), F.struct(F.lit("b").alias("text"), F.lit("m").alias("metric"))).alias("bullets")))
    df = t.read("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("insight_id"),
        F.concat(F.lit("hall-"), (F.col("conv_id") % 5).cast("string")).alias("hall_id"),
        F.when(F.col("role") == "user", "impact-recommendation").otherwise("service").alias("kind"),
        F.when(n % 5 == 4, F.lit("{broken")).otherwise(body).alias("recommendation"),
        F.when(n % 3 == 0, "gemini").otherwise("fallback_rules").alias("source"),
        (F.lit("1995-12-31 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=(n * 12).cast("int"))).alias("generated_at"),
    )
    views = t.views().withColumn("cleared_at", F.col("cleared_at").cast("timestamp_ntz"))
    return Q.saved_recommendations(df, views)


@query("q13_admin_captures", """
SELECT c.event_id, c.captured_at, c.state, coalesce(v.hidden, FALSE) AS hidden, (SELECT count(*) FROM cap WHERE NOT (hall_id = 'hall-4' AND captured_at < TIMESTAMP '1996-01-01')) AS total, TRUE AS truncated
FROM cap c LEFT JOIN visibility v USING (event_id) WHERE NOT (hall_id = 'hall-4' AND captured_at < TIMESTAMP '1996-01-01') ORDER BY captured_at DESC, event_id DESC LIMIT 200""")
def q13(t):
    return Q.admin_captures(store(t), START, END, 200)


@query("q14_services_and_observations", """
SELECT s.hall_id, s.service_date, count(DISTINCT s.service_id) AS services, count(c.event_id) AS captures, count(*) FILTER (c.state IN ('failed', 'needs_review')) AS retryable FROM svc s LEFT JOIN cap c USING (service_id) GROUP BY s.hall_id, s.service_date""")
def q14(t):
    from traymetrics.operators import eligibility as E

    caps = t.captures()
    retry = E.retryable_captures(caps, t.visibility()).groupBy("service_id").agg(F.count(F.lit(1)).alias("_r"))
    n = caps.groupBy("service_id").agg(F.count(F.lit(1)).alias("_c"))
    df = t.services().join(n, "service_id", "left").join(retry, "service_id", "left")
    return df.groupBy("hall_id", "service_date").agg(
        F.count(F.lit(1)).alias("services"), F.coalesce(F.sum("_c"), F.lit(0)).alias("captures"), F.coalesce(F.sum("_r"), F.lit(0)).alias("retryable")
    )


@query("q15_capture_detail", """
SELECT c.event_id, c.state, CASE WHEN c.state = 'succeeded' THEN k.attempt_id END AS counted_attempt_id, l.status AS latest_status, coalesce(a.n, 0) AS attempts, CASE WHEN c.state = 'succeeded' AND k.attempt_id IS NOT NULL THEN coalesce(m.n, 0) ELSE 0 END AS measurements
FROM cap c LEFT JOIN counted k USING (event_id) LEFT JOIN latest l ON l.event_id = c.event_id LEFT JOIN (SELECT event_id, count(*) AS n FROM attempt GROUP BY 1) a ON a.event_id = c.event_id
LEFT JOIN (SELECT attempt_id, count(*) AS n FROM meas GROUP BY 1) m ON m.attempt_id = k.attempt_id""")
def q15(t):
    return Q.capture_detail(store(t))


@query("q15_nested_capture_detail", """
, a AS (SELECT event_id, string_agg(concat_ws(' ', attempt_id, status, menu_version, coalesce(count_status, '-'), coalesce(CAST(CAST(capture_pixels_wasted AS BIGINT) AS VARCHAR), '-'), coalesce(calibration_id, '-'), coalesce(overlay_object_id, '-')), ';' ORDER BY created_at, attempt_id) AS txt FROM attempt GROUP BY 1),
m AS (SELECT attempt_id, string_agg(concat_ws(' ', measurement_id, coalesce(item_id, '-'), CAST(remaining_area_px AS BIGINT), coalesce(CAST(CAST(baseline_area_px AS BIGINT) AS VARCHAR), '-'), method), ';' ORDER BY measurement_id, item_id NULLS FIRST, remaining_area_px) AS txt FROM meas GROUP BY 1)
SELECT c.event_id, c.service_id, c.state, c.captured_at, CASE WHEN c.state = 'succeeded' THEN k.attempt_id END AS counted_attempt_id, coalesce(a.txt, '') AS attempts, CASE WHEN c.state = 'succeeded' THEN coalesce(m.txt, '') ELSE '' END AS measurements
FROM cap c LEFT JOIN counted k USING (event_id) LEFT JOIN a ON a.event_id = c.event_id LEFT JOIN m ON m.attempt_id = k.attempt_id""")
def q15_nested(t):
    told = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    lines = lambda rows, fn: F.array_join(F.transform(rows, lambda r: F.concat_ws(" ", *fn(r))), ";").alias(rows)
    attempts = lines("attempts", lambda r: [told(r[c]) for c in ("attempt_id", "status", "menu_version", "count_status", "capture_pixels_wasted", "calibration_id", "overlay_object_id")])
    rows = lines("measurements", lambda r: [told(r["measurement_id"]), told(r["item_id"]), told(r["remaining_area_px"].cast("long")), told(r["baseline_area_px"].cast("long")), r["method"]])
    return Q.nested_capture_detail(store(t)).select("event_id", "service_id", "state", "captured_at", "counted_attempt_id", attempts, rows)


@query("q16_measurement_settings", """
SELECT 'hall-' || CAST(c_custkey AS VARCHAR) AS hall_id, s.cal AS active_calibration_id, s.cal IS NULL AS is_default FROM customer LEFT JOIN (SELECT s_suppkey AS k, 'cal-' || CAST(s_suppkey AS VARCHAR) AS cal FROM supplier) s ON s.k = c_custkey""", domain=False)
def q16(t):
    halls = t.read("customer").select(F.concat(F.lit("hall-"), F.col("c_custkey").cast("string")).alias("hall_id"))
    s = F.col("s_suppkey").cast("string")
    settings = t.read("supplier").select(F.concat(F.lit("hall-"), s).alias("hall_id"), F.concat(F.lit("cal-"), s).alias("active_calibration_id"), F.lit("2000-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    df = Q.measurement_settings(halls, settings)
    return df.select("hall_id", "active_calibration_id", (F.year("updated_at") == 1970).alias("is_default"))


@query("q16_calibration_list", "SELECT calibration_id, hall_id, reference_pixels FROM cal")
def q16b(t):
    return Q.calibration_list(t.calibrations(), ["score", "calibration_id"]).select("calibration_id", "hall_id", "reference_pixels")


@query("w17_delta_percent", """
, d AS (SELECT hall_id, service_date, count(*) FILTER (state = 'succeeded') AS n FROM cap GROUP BY 1, 2)
SELECT a.hall_id, a.service_date, round(CASE WHEN b.n > 0 THEN (a.n - b.n) * 100.0::DOUBLE / b.n END, 4) AS delta FROM d a LEFT JOIN d b ON b.hall_id = a.hall_id AND b.service_date = a.service_date - 10""")
def w17(t):
    svc = t.services().select("service_id", "service_date")
    d = t.captures().join(svc, "service_id").groupBy("hall_id", "service_date").agg(F.count_if(F.col("state") == "succeeded").alias("n"))
    before = d.select("hall_id", F.date_add("service_date", 10).alias("service_date"), F.col("n").alias("p"))
    return r4(d.join(before, ["hall_id", "service_date"], "left").select("hall_id", "service_date", N.delta_percent("n", "p").alias("delta")), "delta")


@query("w18_choose_recommendation", """
WITH s AS (SELECT 'hall-' || CAST(user_id AS VARCHAR) AS hall, day(ts) AS w, event_id % 2 AS v, ts, event_id FROM events WHERE event_type = 'click'),
f AS (SELECT 'hall-' || CAST(c_custkey AS VARCHAR) AS hall, c_custkey % 30 + 1 AS w, c_custkey % 2 AS v, c_nationkey % 2 = 0 AS has_data FROM customer),
x AS (SELECT f.*, (SELECT max(ts) FROM s WHERE s.hall = f.hall AND s.w = f.w AND s.v = f.v) AS et, (SELECT max(ts) FROM s WHERE s.hall = f.hall) AS lt FROM f)
SELECT hall AS hall_id, CASE WHEN et IS NOT NULL OR (has_data AND lt IS NOT NULL) THEN 'model' ELSE 'fallback' END AS source, et IS NULL AND has_data AND lt IS NOT NULL AS stale,
 CASE WHEN et IS NOT NULL THEN et WHEN has_data THEN lt END AS generated_at FROM x""", domain=False)
def w18(t):
    day = F.dayofmonth("ts").cast("long")
    saved = t.read("events").select(
        F.concat(F.lit("hall-"), F.col("user_id").cast("string")).alias("hall_id"), day.alias("window_start"), day.alias("window_end"), (F.col("event_id") % 2).alias("input_version"),
        F.when(F.col("event_type") == "click", "model").otherwise("fallback").alias("source"), F.col("event_type").alias("text"), F.col("ts").alias("generated_at"),
    )
    c = F.col("c_custkey")
    day2 = (c % 30 + 1).cast("long")
    fallback = t.read("customer").select(
        F.concat(F.lit("hall-"), c.cast("string")).alias("hall_id"), day2.alias("window_start"), day2.alias("window_end"), (c % 2).alias("input_version"), (F.col("c_nationkey") % 2 == 0).alias("has_data"), F.lit("rules").alias("text")
    )
    return P.choose_recommendation(saved, fallback).select("hall_id", "source", "stale", "generated_at")


@query("j14_capture_images", """
, a AS (SELECT c.event_id, k.attempt_id, k.overlay_object_id FROM cap c LEFT JOIN counted k USING (event_id)),
r AS (SELECT event_id, 'photo' AS kind, 'img-' || CAST(event_id AS VARCHAR) AS object_id, NULL AS item_id FROM cap UNION ALL SELECT event_id, 'overlay', overlay_object_id, NULL FROM a
 UNION ALL SELECT a.event_id, 'mask', 'mask-' || measurement_id, item_id FROM a JOIN meas USING (attempt_id) WHERE validated
 UNION ALL SELECT a.event_id, 'mask', 'reg-' || measurement_id, item_id FROM a JOIN meas m USING (attempt_id) WHERE attempt_id NOT IN (SELECT attempt_id FROM meas WHERE validated))
SELECT event_id, kind, count(*) AS n, count(item_id) AS named FROM r WHERE object_id IS NOT NULL AND event_id % 6 <> 0 GROUP BY 1, 2""")
def j14(t):
    m = t.measurements()
    mask = F.col("mask_count")
    own = m.withColumn("mask_count", F.when(mask["validated"], F.struct(F.concat(F.lit("mask-"), "measurement_id").alias("mask_object_id"))))
    regions = m.select("attempt_id", "item_id", F.concat(F.lit("reg-"), "measurement_id").alias("mask_object_id"))
    k = F.col("event_id")
    ids = m.select(k, F.explode(F.array(F.concat(F.lit("mask-"), "measurement_id"), F.concat(F.lit("reg-"), "measurement_id"))).alias("object_id"))
    ids = ids.unionByName(t.captures().select(k, F.col("image_object_id").alias("object_id"))).unionByName(t.attempts().select(k, F.col("overlay_object_id").alias("object_id")))
    images = ids.filter(F.col("object_id").isNotNull()).distinct().select("object_id", F.col("object_id").alias("object_key"), F.when(k % 6 != 0, "finalized").otherwise("uploaded").alias("state"))
    df = J.capture_images(t.captures(), t.attempts(), own, regions, images)
    return df.groupBy("event_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("item_id").alias("named"))


# F-30, F-31, F-21: texts and stamps over service summaries

TOPA1 = A1_SQL + """
, it AS (SELECT service_id, item_id, sum(remaining_area_px) AS px, sum(baseline_area_px) AS bs FROM mr WHERE mr IS NULL GROUP BY 1, 2),
tp AS (SELECT service_id, arg_min(item_id, (-px, item_id)) AS top_id, max(px) AS px FROM it GROUP BY 1),
nm AS (SELECT item_id, min(display_name) AS nm FROM menu GROUP BY 1),
tx AS (SELECT a1.*, s.meal_label, tp.top_id, coalesce(nm.nm, substr(top_id, 6)) AS top_name, CASE WHEN remaining_area_px > 0 THEN floor(100 * tp.px / remaining_area_px * 10 + 0.5) / 10 END AS share, att.count AS attendance
 FROM a1 JOIN svc s USING (service_id) LEFT JOIN tp USING (service_id) LEFT JOIN nm ON nm.item_id = top_id LEFT JOIN attendance att USING (service_id))
"""


def with_top(t):
    items = S.service_items(t.captures(), t.measurements(), t.menu_items())
    return summaries(t).join(A.top_item(items, "remaining_area_px", ["display_name", "share_percent", "waste_percent"]), "service_id", "left")


@query("f30_service_text", TOPA1 + """
, p AS (SELECT *, succeeded_capture_count || CASE WHEN succeeded_capture_count = 1 THEN ' plate' ELSE ' plates' END AS plates FROM tx),
q AS (SELECT *, CASE WHEN succeeded_capture_count < 10 THEN 'Only ' || plates || ' checked so far, and amounts are an AI estimate from photos, not proof of why food was left.' ELSE 'Based on ' || plates || '. Amounts are an AI estimate from photos, not proof of why food was left.' END AS cv FROM p)
SELECT service_id, CASE WHEN succeeded_capture_count > 0 AND top_name IS NOT NULL AND share IS NOT NULL THEN top_name || ' made up ' || CAST(floor(share + 0.5) AS BIGINT) || '% of the food left on ' || meal_label || ' plates. Try a smaller scoop or batch of ' || top_name || ' and see if that drops. ' || cv
 WHEN succeeded_capture_count > 0 AND overall_waste_percent IS NOT NULL THEN 'About ' || CAST(floor(overall_waste_percent + 0.5) AS BIGINT) || '% of each ' || meal_label || ' serving came back on the plate. ' || cv || ' Check again once more plates are scanned.'
 ELSE 'Not enough ' || meal_label || ' plates checked to make a suggestion yet. Scan more plates and make sure this meal has a menu.' END AS text FROM q""")
def f30(t):
    top = F.col("top")
    text = A.service_text(F.col("meal_label"), F.col("succeeded_capture_count"), top["display_name"], top["share_percent"], F.col("overall_waste_percent"))
    return with_top(t).select("service_id", text.alias("text"))


PXTOP = A4_SQL + """
, it AS (SELECT p.service_id, m.item_id, sum(m.remaining_area_px) AS px FROM pr p JOIN meas m ON m.attempt_id = p.attempt_id WHERE reason IS NULL AND m.method = 'mask_pixel_count' AND m.item_id IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT service_id, arg_min(item_id, (-px, item_id)) AS top_id, max(px) AS tpx FROM it GROUP BY 1),
z AS (SELECT s.service_id, s.meal_label, coalesce(counted_count, 0) AS n, coalesce(capture_count - counted_count, 0) AS x, coalesce(pixels_wasted, 0) AS px, top_id, tpx, coalesce(unclassified_pixels, 0) AS u, a.count AS att,
 CASE WHEN pixels_wasted > 0 THEN floor(100 * tpx / pixels_wasted * 10 + 0.5) / 10 END AS share FROM svc s LEFT JOIN psum USING (service_id) LEFT JOIN tp USING (service_id) LEFT JOIN attendance a USING (service_id))
"""


def pixel_top(t):
    items = S.pixel_items(pixel_caps(t), t.measurements())
    return pixel_sum(t).join(A.top_item(items, "pixels_wasted", ["share_percent"]), "service_id", "left")


@query("f30_pixel_text", PXTOP + """
, c AS (SELECT *, CASE WHEN n < 10 THEN 'This is based on only ' || n || ' counted plate(s)' || CASE WHEN x > 0 THEN ', with ' || x || ' left out' ELSE '' END || '. Coverage is limited.' ELSE 'Based on ' || n || ' counted plates.' END AS cv FROM z)
SELECT service_id, CASE WHEN top_id IS NOT NULL AND share IS NOT NULL THEN top_id || ' made up ' || regexp_replace(CAST(share AS VARCHAR), '\\.0$', '') || '% of ' || meal_label || '''s wasted pixels (' || format('{:,}', CAST(tpx AS BIGINT)) || ' of ' || format('{:,}', px) || '). ' || cv || ' Consider reviewing the serving scoop or batch size for ' || top_id || '; this is an observed pattern, not proof of the cause.'
 ELSE 'No food pixels were attributed to a menu item for ' || meal_label || ' yet. ' || cv END AS text FROM c""")
def f30_pixel(t):
    top = F.col("top")
    text = A.pixel_text(F.col("meal_label"), F.col("counted_count"), F.col("excluded_count"), top["item_id"], top["share_percent"], top["pixels_wasted"], F.col("pixels_wasted"))
    return pixel_top(t).select("service_id", text.alias("text"))


@query("f30_portion_text", A5_SQL + """
, rk AS (SELECT service_id, arg_min(struct_pack(i := item_id, r := px / portions_served, p := px, s := portions_served, src := portions_source), (-px / portions_served, item_id)) FILTER (reason IS NULL) AS b, count(*) FILTER (reason IS NOT NULL) AS missing, count(*) FILTER (coalesce(portions_served, 0) = 0) AS un FROM br GROUP BY 1),
nt AS (SELECT rk.*, coalesce(measured_dishes, 0) || ' of ' || (SELECT count(*) FROM cap c WHERE c.service_id = rk.service_id) || ' captured dishes have validated mask counts. Observed pixels are divided by full-meal portions served; incomplete capture coverage can understate waste. This does not prove dislike or another cause.' AS note FROM rk LEFT JOIN sv USING (service_id))
SELECT service_id, CASE WHEN b IS NULL THEN 'No suggestion yet. ' || CASE WHEN un > 0 THEN 'Enter how many portions of each food were served on the Portions served page.' ELSE 'More plate scans are needed first.' END
 ELSE b.i || ' has the highest available benchmark: ' || regexp_replace(CAST(floor(b.r * 100 + 0.5) / 100 AS VARCHAR), '\\.0$', '') || ' pixels/portion (' || CAST(b.p AS BIGINT) || ' observed pixels ÷ ' || b.s || ' portions served' || CASE WHEN b.src = 'demo' THEN ', demo count' ELSE '' END || '). Test a smaller scoop or batch and compare another service with similar capture coverage; this does not prove dislike. ' || note || CASE WHEN missing > 0 THEN ' ' || missing || ' menu item(s) lack a benchmark and are not ranked.' ELSE '' END END AS text FROM nt""")
def f30_portion(t):
    bench, counts = benchmark(t)
    rate = F.col("pixels_per_portion")
    best = bench.groupBy("service_id").agg(
        F.min_by(F.struct("item_id", rate, "pixels_wasted", "portions_served", "portions_source"), F.when(rate.isNotNull(), F.struct((-rate).alias("r"), "item_id"))).alias("b"),
        F.count_if(rate.isNull()).alias("missing"), F.count_if(F.coalesce("portions_served", F.lit(0)) == 0).alias("un"),
    )
    b = F.col("b")
    note = A.coverage_note(F.col("measured_dishes"), F.col("captured_dishes"))
    text = A.portion_text(b["item_id"], b["pixels_per_portion"], b["pixels_wasted"], b["portions_served"], b["portions_source"], note, F.col("missing"), F.col("un") > 0)
    return best.join(counts, "service_id").select("service_id", text.alias("text"))


@query("f21_service_version", TOPA1 + """
SELECT service_id, 'agg-' || hall_id || '-' || service_id || '-' || strftime(service_date, '%Y-%m-%d') || '-m' || eligible_measurement_count || '-x' || excluded_measurement_count || '-r' || CAST(remaining_area_px AS BIGINT) || '-b' || CAST(baseline_area_px AS BIGINT) || '-t' || coalesce(top_id, 'none') || '-a' || coalesce(attendance, 0) AS data_version FROM tx""")
def f21(t):
    return with_top(t).select("service_id", A.aggregate_version(F.col("top.item_id")).alias("data_version"))


@query("f21_pixel_version", PXTOP + """
SELECT service_id, 'px-' || service_id || '-c' || n || '-x' || x || '-p' || px || '-u' || CAST(u AS BIGINT) || '-t' || coalesce(top_id, 'none') || ':' || CAST(coalesce(tpx, 0) AS BIGINT) || '-a' || coalesce(att, 0) AS data_version FROM z""")
def f21_pixel(t):
    return pixel_top(t).select("service_id", A.pixel_version(F.col("top.item_id"), F.col("top.pixels_wasted")).alias("data_version"))


@query("f31_insight_metrics", TOPA1 + """
SELECT service_id, meal_label AS meal, CAST(succeeded_capture_count AS BIGINT) AS analyzed, CAST(remaining_area_px AS BIGINT) AS area, overall_waste_percent AS pct, top_id, share FROM tx""")
def f31(t):
    js = A.service_metrics(F.col("top.display_name"))
    g = lambda k: F.get_json_object("m", f"$.{k}")
    return with_top(t).select("service_id", js.alias("m")).select(
        "service_id", g("mealLabel").alias("meal"), g("analyzedCaptures").cast("long").alias("analyzed"), g("observedRemainingAreaPx").cast("long").alias("area"),
        g("overallWastePercent").cast("double").alias("pct"), g("topItemId").alias("top_id"), g("topItemShareOfMealWastePercent").cast("double").alias("share"),
    )


@query("f32_numbered_menu", """
, n AS (SELECT menu_id, row_number() OVER (PARTITION BY menu_id ORDER BY display_name, item_id) || '. ' || display_name || CASE WHEN category <> '' THEN ' — ' || category ELSE '' END AS l, row_number() OVER (PARTITION BY menu_id ORDER BY display_name, item_id) AS i FROM menu)
SELECT menu_id, string_agg(l, chr(10) ORDER BY i) AS menu_text FROM n GROUP BY menu_id""")
def f32(t):
    return A.numbered_menu(t.menu_items().withColumnRenamed("category", "description"), ["display_name", "item_id"])
