"""Eligibility, attempts, joins, service and plate summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from traymetrics.catalog.impact_queries import END, START, TODAY, scored
from traymetrics.catalog.registry import query, r4
from traymetrics.functions.geometry import geometry_json, geometry_key
from traymetrics.functions.text import baseline_id, item_id, menu_id, readable_item_name, revision_id, service_id, slug
from traymetrics.operators import eligibility as E
from traymetrics.operators import joins as J
from traymetrics.operators import picking as P
from traymetrics.operators import facts as F21
from traymetrics.operators import services as S

MR = """CASE WHEN item_id IS NULL THEN 'unknown_item' WHEN baseline_area_px IS NULL THEN 'missing_baseline' WHEN baseline_area_px <= 0 THEN 'invalid_baseline'
 WHEN flag_above OR raw_waste_fraction > 1 THEN 'above_baseline' END"""
SR = """CASE WHEN item_id IS NULL THEN 'unknown_item' WHEN baseline_area_px IS NULL OR baseline_area_px <= 0 THEN 'missing_baseline'
 WHEN coalesce(raw_waste_fraction, remaining_area_px / nullif(baseline_area_px, 0)) > 1 THEN 'above_baseline' END"""
CR = "CASE WHEN state <> 'succeeded' THEN 'capture_not_succeeded' WHEN space <> 'topdown-normalized-v1' THEN 'incompatible_geometry' END"


def counted_rows(t):
    return J.counted_measurements(t.measurements(), P.counted_attempts(t.attempts()))


@query("v01_measurement_reason", f"SELECT {MR} AS reason, count(*) AS n, CAST(sum(remaining_area_px) AS BIGINT) AS px FROM meas GROUP BY 1")
def v01(t):
    df = t.measurements().withColumn("reason", E.measurement_reason())
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("remaining_area_px").cast("long").alias("px"))


@query("v02_capture_reason", f"SELECT event_id, {CR} AS reason FROM cap")
def v02(t):
    return t.captures().select("event_id", E.capture_reason().alias("reason"))


@query("v03_valid_mask_count", """
SELECT service_id, count(*) FILTER (valid) AS valid, count(*) AS n FROM (
 SELECT c.service_id, coalesce(m.method = 'mask_pixel_count' AND m.validated AND m.remaining_area_px <= c.side * c.side AND c.space = 'topdown-normalized-v1' AND c.side = 1024
  AND m.mask_menu_id = c.menu_id AND m.mask_menu_version = s.menu_version AND NOT m.blank_version AND NOT c.blurred AND NOT m.ambiguous, FALSE) AS valid
 FROM meas m JOIN cap c ON m.event_id = c.event_id JOIN svc s ON s.service_id = c.service_id) GROUP BY service_id""")
def v03(t):
    svc = t.services().select("service_id", "menu_id", "menu_version")
    caps = t.captures().select("event_id", "service_id", "geometry", F.col("quality_flags").alias("capture_flags")).join(svc, "service_id")
    df = t.measurements().join(caps, "event_id").withColumn("valid", E.valid_mask_count())
    return df.groupBy("service_id").agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("n"))


@query("v04_summary_reason", f"SELECT {SR} AS reason, count(*) AS n FROM meas GROUP BY 1")
def v04(t):
    return t.measurements().withColumn("reason", E.summary_reason()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("v20_visible_captures", """
SELECT c.hall_id, count(*) AS captures, min(event_id) AS first_event FROM cap c JOIN hallview v ON v.hall_id = c.hall_id
WHERE event_id NOT IN (SELECT event_id FROM visibility WHERE hidden) AND (cleared_at IS NULL OR captured_at >= cleared_at) GROUP BY c.hall_id""")
def v20(t):
    df = E.visible_captures(t.captures(), t.visibility(), t.views())
    return df.groupBy("hall_id").agg(F.count(F.lit(1)).alias("captures"), F.min("event_id").alias("first_event"))


@query("v21_retryable", """
SELECT c.event_id, state, coalesce(hidden, FALSE) AS hidden FROM cap c LEFT JOIN visibility v USING (event_id) WHERE state IN ('failed', 'needs_review')""")
def v21(t):
    return E.retryable_captures(t.captures(), t.visibility()).select("event_id", "state", "hidden")


@query("v22_find_orphans", """
SELECT event_id AS object_id FROM events WHERE event_type IN ('click', 'view', 'error') AND (value < 1 OR ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 DAY)""", domain=False)
def v22(t):
    kind = F.col("event_type")
    images = t.read("events").select(
        F.col("event_id").alias("object_id"),
        F.when(kind == "click", "pending_upload").when(kind == "view", "uploaded").when(kind == "error", "failed").otherwise("finalized").alias("state"),
        F.when(F.col("value") >= 1, F.col("ts")).alias("requested_at"),
    )
    return E.find_orphans(images, F.lit("2024-01-20 00:00:00").cast("timestamp"), 2 * 86400).select("object_id")


@query("w01_latest_by_key", """
SELECT l_orderkey AS event_id, l_linenumber AS line, max(l_shipdate) AS l_shipdate, CAST(arg_max(l_partkey, (l_shipdate, l_extendedprice)) AS BIGINT) AS l_partkey
FROM lineitem GROUP BY l_orderkey, l_linenumber""", domain=False)
def w01(t):
    log = t.read("lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"), "l_shipdate", "l_extendedprice", "l_partkey"
    )
    return P.latest_by_key(log, ["event_id", "line"], ["l_shipdate", "l_extendedprice"]).drop("l_extendedprice")


@query("w02_counted_attempts", "SELECT event_id, attempt_id, created_at, menu_version FROM counted")
def w02(t):
    return P.counted_attempts(t.attempts()).select("event_id", "attempt_id", "created_at", "menu_version")


@query("w02_latest_attempts", "SELECT event_id, attempt_id, status FROM latest")
def w02b(t):
    return P.latest_attempts(t.attempts()).select("event_id", "attempt_id", "status")


@query("w04_mode_with_ties", """
SELECT service_id, arg_min(g, (-n, g)) AS agreed FROM (
 SELECT service_id, side || 'x' || side || ' ' || space AS g, count(*) AS n FROM cap GROUP BY 1, 2) GROUP BY service_id""")
def w04(t):
    df = t.captures().select("service_id", geometry_key().alias("g"))
    return P.mode_with_ties(df, ["service_id"], "g", "agreed")


@query("w05_top_reason", f"""
SELECT service_id, arg_min(reason, (-n, prio)) AS top_reason FROM (
 SELECT service_id, reason, count(*) AS n, min(list_position(['above_baseline', 'unknown_item', 'missing_baseline'], reason)) AS prio
 FROM (SELECT c.service_id, {MR.replace('item_id', 'm.item_id')} AS reason FROM meas m JOIN cap c USING (event_id)) WHERE reason IN ('above_baseline', 'unknown_item', 'missing_baseline') GROUP BY ALL) GROUP BY service_id
UNION ALL SELECT service_id, NULL FROM (SELECT c.service_id, {MR.replace('item_id', 'm.item_id')} AS reason FROM meas m JOIN cap c USING (event_id)) GROUP BY service_id
 HAVING count(*) FILTER (reason IN ('above_baseline', 'unknown_item', 'missing_baseline')) = 0""")
def w05(t):
    df = t.measurements().join(t.captures().select("event_id", "service_id"), "event_id").withColumn("reason", E.measurement_reason())
    return P.top_reason(df, ["service_id"], "reason", ["above_baseline", "unknown_item", "missing_baseline"])


@query("w11_newest_page", """
SELECT event_id, captured_at, (SELECT count(*) FROM cap) AS total FROM cap ORDER BY captured_at DESC, event_id DESC LIMIT 50""")
def w11(t):
    return P.newest_page(t.captures().select("event_id", "captured_at"), 50)


@query("w12_share_of_total", """
SELECT service_id, item_id, CAST(sum(remaining_area_px) AS BIGINT) AS px, round(100 * sum(remaining_area_px) / sum(sum(remaining_area_px)) OVER (PARTITION BY service_id), 4) AS share_percent
FROM meas JOIN cap USING (event_id) GROUP BY service_id, item_id""")
def w12(t):
    df = t.measurements().join(t.captures().select("event_id", "service_id"), "event_id").groupBy("service_id", "item_id").agg(
        F.sum("remaining_area_px").cast("long").alias("px")
    )
    return r4(P.share_of_total(df, ["service_id"], "px"), "share_percent")


@query("w16_first_per_id", """
SELECT measurement_id, attempt_id, item_id, CAST(remaining_area_px AS BIGINT) AS px FROM (
 SELECT *, row_number() OVER (PARTITION BY measurement_id ORDER BY attempt_id, item_id NULLS FIRST, remaining_area_px, baseline_area_px NULLS FIRST, raw_waste_fraction NULLS FIRST) AS rn FROM meas) WHERE rn = 1""")
def w16(t):
    m = t.measurements().select("measurement_id", "attempt_id", "item_id", "remaining_area_px", "baseline_area_px", "raw_waste_fraction")
    df = P.first_per_id(m, "measurement_id", ["attempt_id", "item_id", "remaining_area_px", "baseline_area_px", "raw_waste_fraction"])
    return df.select("measurement_id", "attempt_id", "item_id", F.col("remaining_area_px").cast("long").alias("px"))


@query("w19_newest_calibrations", "SELECT hall_id, calibration_id, status FROM cal ORDER BY calibration_id DESC")
def w19(t):
    return P.newest_first(t.calibrations(), ["calibration_id"]).select("hall_id", "calibration_id", "status")


@query("j01_with_attempts", """
SELECT c.event_id, CASE WHEN state = 'succeeded' THEN k.attempt_id END AS counted_attempt_id, l.attempt_id AS latest_attempt_id, l.status AS latest_status
FROM cap c LEFT JOIN counted k USING (event_id) LEFT JOIN latest l USING (event_id)""")
def j01(t):
    return J.with_attempts(t.captures(), t.attempts()).select("event_id", "counted_attempt_id", "latest_attempt_id", "latest_status")


@query("j02_counted_measurements", "SELECT event_id, count(*) AS n, CAST(sum(remaining_area_px) AS BIGINT) AS px FROM meas WHERE attempt_id IN (SELECT attempt_id FROM counted) GROUP BY event_id")
def j02(t):
    return counted_rows(t).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("remaining_area_px").cast("long").alias("px"))


@query("j03_item_names", """
, ids AS (SELECT DISTINCT mask_menu_id AS menu_id, item_id FROM meas WHERE item_id IS NOT NULL),
anyrow AS (SELECT item_id, arg_min(display_name, menu_id) AS nm FROM menu GROUP BY item_id),
old AS (SELECT 'item_' || CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS nm FROM part WHERE p_partkey % 26 = 0)
SELECT i.menu_id, i.item_id, coalesce(m.display_name, a.nm, o.nm, substr(i.item_id, 6)) AS display_name
FROM ids i LEFT JOIN menu m USING (menu_id, item_id) LEFT JOIN anyrow a ON a.item_id = i.item_id LEFT JOIN old o ON o.item_id = i.item_id""")
def j03(t):
    ids = t.measurements().filter(F.col("item_id").isNotNull()).select(F.col("mask_count.menu_id").alias("menu_id"), "item_id").distinct()
    part = t.read("part").filter(F.col("p_partkey") % 26 == 0)
    revisions = part.select(
        F.concat(F.lit("item_"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_brand").alias("display_name"), F.lit(1).alias("menu_version")
    )
    return J.resolve_item_names(ids, t.menu_items(), revisions).select("menu_id", "item_id", "display_name")


@query("j05_join_portions", """
SELECT service_id, count(*) AS n, count(portions_served) AS known, CAST(sum(portions_served) AS BIGINT) AS served
FROM (SELECT service_id, mask_menu_version AS menu_version, item_id FROM meas JOIN cap USING (event_id)) LEFT JOIN portion1 USING (service_id, menu_version, item_id) GROUP BY service_id""")
def j05(t):
    m = t.measurements().select("event_id", F.col("mask_count.menu_version").alias("menu_version"), "item_id")
    df = J.join_portions(m.join(t.captures().select("event_id", "service_id"), "event_id"), t.portions())
    return df.groupBy("service_id").agg(F.count(F.lit(1)).alias("n"), F.count("portions_served").alias("known"), F.sum("portions_served").alias("served"))


@query("j06_frozen_version", "SELECT event_id, menu_version FROM capv")
def j06(t):
    return J.with_frozen_version(t.captures(), t.services(), P.counted_attempts(t.attempts())).select("event_id", "menu_version")


@query("j07_physical_context", "SELECT event_id, counted_id AS attempt_id, physical_method, CASE WHEN physical_method IS NULL THEN ctx_reason END AS physical_context_reason FROM capv WHERE counted_id IS NOT NULL")
def j07(t):
    return J.physical_context(P.counted_attempts(t.attempts()), t.captures(), t.calibrations())


@query("j08_recompute_area", """
SELECT m.event_id, count(*) AS n, count(k.cm2_per_px) AS with_area, round(sum(floor(m.remaining_area_px * k.cm2_per_px * 10000 + 0.5) / 10000), 4) AS area_cm2
FROM meas m LEFT JOIN cal k ON k.calibration_id = m.phys_cal AND k.status = 'succeeded' GROUP BY m.event_id""")
def j08(t):
    df = J.recompute_area(t.measurements(), t.calibrations())
    area = F.col("physical.area_cm2")
    return r4(df.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count(area).alias("with_area"), F.sum(area).alias("area_cm2")), "area_cm2")


@query("j13_observations", """
SELECT c.event_id, count(m.measurement_id) AS n, coalesce(string_agg(m.measurement_id || ':' || coalesce(m.item_id, '-'), ',' ORDER BY m.measurement_id, m.item_id NULLS FIRST, m.remaining_area_px), '') AS foods
FROM cap c LEFT JOIN meas m ON m.event_id = c.event_id GROUP BY c.event_id""")
def j13(t):
    df = J.observations(t.captures().select("event_id"), t.measurements())
    text = F.array_join(F.transform("measurements", lambda m: F.concat(m["measurement_id"], F.lit(":"), F.coalesce(m["item_id"], F.lit("-")))), ",")
    return df.select("event_id", F.size("measurements").cast("long").alias("n"), text.alias("foods"))


@query("j15_region_ids", """
SELECT m.attempt_id, m.item_id, count(*) AS n, max(coalesce(r.ids, '')) AS region_ids FROM meas m LEFT JOIN (
 SELECT attempt_id, item_id, string_agg(DISTINCT measurement_id, ',' ORDER BY measurement_id) AS ids FROM meas WHERE validated GROUP BY attempt_id, item_id) r
 ON r.attempt_id = m.attempt_id AND r.item_id IS NOT DISTINCT FROM m.item_id GROUP BY m.attempt_id, m.item_id""")
def j15(t):
    m = t.measurements().select("attempt_id", "item_id", "measurement_id", "mask_count.validated")
    regions = m.filter("validated").select("attempt_id", "item_id", F.col("measurement_id").alias("region_id"))
    df = J.region_ids(m, regions)
    return df.groupBy("attempt_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join("region_ids", ",")).alias("region_ids"))


@query("j16_allowed_classifications", """
SELECT m.item_id IS NULL OR n.item_id IS NOT NULL AS allowed, count(*) AS n FROM meas m LEFT JOIN menu n ON n.menu_id = m.mask_menu_id AND n.item_id = m.item_id GROUP BY 1""")
def j16(t):
    rows = t.measurements().select(F.col("mask_count.menu_id").alias("menu_id"), "item_id", "measurement_id")
    ok, bad = J.allowed_classifications(rows, t.menu_items())
    both = ok.withColumn("allowed", F.lit(True)).unionByName(bad.withColumn("allowed", F.lit(False)))
    return both.groupBy("allowed").agg(F.count(F.lit(1)).alias("n"))


@query("j19_nest_attempts", """
SELECT a.attempt_id, count_status, CAST(capture_pixels_wasted AS BIGINT) AS px, coalesce(r.n, 0) AS regions, overlay_object_id
FROM attempt a LEFT JOIN (SELECT attempt_id, count(*) AS n FROM meas GROUP BY attempt_id) r USING (attempt_id)""")
def j19(t):
    a = t.attempts()
    regions = t.measurements().select("attempt_id", F.col("measurement_id").alias("region_id"), "item_id", F.col("mask_count.pixels_wasted").alias("mask_pixels"))
    df = J.nest_attempts(a.select("attempt_id", "event_id", "status"), a, regions, a)
    return df.select(
        "attempt_id",
        F.col("segmentation.count_status").alias("count_status"),
        F.col("segmentation.capture_pixels_wasted").alias("px"),
        F.coalesce(F.size("regions"), F.lit(0)).cast("long").alias("regions"),
        "overlay_object_id",
    )


@query("j20_active_calibration", """
SELECT c.c_custkey AS customer, k.calibration_id AS usable_calibration_id FROM customer c
LEFT JOIN cal k ON k.calibration_id = 'cal-' || CAST(c_custkey % 97 AS VARCHAR) AND k.hall_id = 'hall-' || CAST(c_custkey % 5 AS VARCHAR) AND k.status = 'succeeded'""")
def j20(t):
    c = F.col("c_custkey")
    settings = t.read("customer").select(
        c.alias("customer"),
        F.concat(F.lit("hall-"), (c % 5).cast("string")).alias("hall_id"),
        F.concat(F.lit("cal-"), (c % 97).cast("string")).alias("active_calibration_id"),
    )
    return J.active_calibration(settings, t.calibrations()).select("customer", "usable_calibration_id")


A1_SQL = f"""
, ce AS (SELECT *, {CR} AS cr FROM cap),
pc AS (SELECT service_id, count(*) AS capture_count, count(*) FILTER (cr IS NULL) AS succeeded_capture_count, count(*) FILTER (cr = 'incompatible_geometry') AS x_incompatible_geometry FROM ce GROUP BY service_id),
mr AS (SELECT c.service_id, m.item_id, m.remaining_area_px, m.baseline_area_px, {MR.replace('item_id', 'm.item_id')} AS mr FROM meas m JOIN ce c USING (event_id) WHERE cr IS NULL),
pr AS (SELECT service_id, count(*) FILTER (mr IS NULL) AS eligible_measurement_count, count(*) FILTER (mr IS NOT NULL) AS excluded_measurement_count, count(*) FILTER (mr = 'above_baseline') AS x_above_baseline,
 count(*) FILTER (mr = 'unknown_item') AS x_unknown_item, coalesce(sum(remaining_area_px) FILTER (mr IS NULL), 0) AS rem, coalesce(sum(baseline_area_px) FILTER (mr IS NULL), 0) AS base FROM mr GROUP BY service_id),
a1 AS (SELECT s.service_id, s.hall_id, s.service_date, capture_count, succeeded_capture_count, x_incompatible_geometry, coalesce(eligible_measurement_count, 0) AS eligible_measurement_count,
 coalesce(excluded_measurement_count, 0) AS excluded_measurement_count, coalesce(x_above_baseline, 0) AS x_above_baseline, coalesce(x_unknown_item, 0) AS x_unknown_item,
 coalesce(rem, 0)::DOUBLE AS remaining_area_px, coalesce(base, 0)::DOUBLE AS baseline_area_px, CASE WHEN base > 0 THEN floor(100 * rem / base * 10 + 0.5) / 10 END AS overall_waste_percent,
 CASE WHEN a.count > 0 THEN coalesce(rem, 0) / a.count END AS area_per_attendee
 FROM svc s LEFT JOIN pc USING (service_id) LEFT JOIN pr USING (service_id) LEFT JOIN attendance a USING (service_id))
"""


def summaries(t):
    return S.summarize_service(t.captures(), t.measurements(), t.services(), t.attendance())


@query("a01_summarize_service", A1_SQL + """
SELECT service_id, capture_count, succeeded_capture_count, x_incompatible_geometry, eligible_measurement_count, excluded_measurement_count, x_above_baseline, x_unknown_item,
 remaining_area_px, baseline_area_px, overall_waste_percent, round(area_per_attendee, 4) AS area_per_attendee FROM a1""")
def a01(t):
    cols = ["service_id", "capture_count", "succeeded_capture_count", "x_incompatible_geometry", "eligible_measurement_count", "excluded_measurement_count",
            "x_above_baseline", "x_unknown_item", "remaining_area_px", "baseline_area_px", "overall_waste_percent", "area_per_attendee"]
    return r4(summaries(t).select(*cols), "area_per_attendee")


@query("a01_service_items", A1_SQL + """
SELECT service_id, item_id, count(*) AS eligible_count, sum(remaining_area_px)::DOUBLE AS remaining_area_px, floor(100 * sum(remaining_area_px) / sum(baseline_area_px) * 10 + 0.5) / 10 AS waste_percent,
 CASE WHEN sum(sum(remaining_area_px)) OVER (PARTITION BY service_id) > 0 THEN floor(100 * sum(remaining_area_px) / sum(sum(remaining_area_px)) OVER (PARTITION BY service_id) * 10 + 0.5) / 10 END AS share_percent
FROM mr WHERE mr IS NULL GROUP BY service_id, item_id""")
def a01_items(t):
    df = S.service_items(t.captures(), t.measurements(), t.menu_items())
    return df.select("service_id", "item_id", "eligible_count", "remaining_area_px", "waste_percent", "share_percent")


@query("a02_waste_trend", A1_SQL + "SELECT hall_id, service_id, service_date, overall_waste_percent, remaining_area_px, round(area_per_attendee, 4) AS area_per_attendee FROM a1 ORDER BY service_date, service_id")
def a02(t):
    return r4(S.waste_trend(summaries(t)).drop("meal_label", "eligible_measurement_count"), "area_per_attendee")


@query("a03_state_summary", f"""
, pc AS (SELECT service_id, count(*) AS captured_dishes, count(*) FILTER (state = 'succeeded') AS analyzed_dishes, count(*) FILTER (state = 'failed') AS failed_captures,
 count(*) FILTER (state = 'needs_review') AS needs_review_captures, count(*) FILTER (state IN ('pending', 'processing')) AS pending_captures FROM cap GROUP BY service_id),
sr AS (SELECT c.service_id, m.remaining_area_px, m.baseline_area_px, {SR.replace('item_id', 'm.item_id')} AS r FROM meas m JOIN cap c USING (event_id) WHERE c.state = 'succeeded' AND m.attempt_id IN (SELECT attempt_id FROM counted)),
pr AS (SELECT service_id, count(*) FILTER (r IS NULL) AS eligible_measurements, count(*) FILTER (r = 'unknown_item') AS unknown_item_measurements, count(*) FILTER (r = 'missing_baseline') AS missing_baseline_measurements,
 count(*) FILTER (r = 'above_baseline') AS above_baseline_measurements, sum(remaining_area_px) FILTER (r IS NULL) AS rem, sum(baseline_area_px) FILTER (r IS NULL) AS base, sum(remaining_area_px) FILTER (r = 'unknown_item') AS unk FROM sr GROUP BY service_id)
SELECT service_id, captured_dishes, analyzed_dishes, failed_captures, needs_review_captures, pending_captures, coalesce(eligible_measurements, 0) AS eligible_measurements, coalesce(unknown_item_measurements, 0) AS unknown_item_measurements,
 coalesce(missing_baseline_measurements, 0) AS missing_baseline_measurements, coalesce(above_baseline_measurements, 0) AS above_baseline_measurements, coalesce(rem, 0)::DOUBLE AS remaining_area_px, coalesce(unk, 0)::DOUBLE AS unknown_area_px,
 round(CASE WHEN base > 0 THEN 100 * rem / base END, 4) AS overall_waste_percent, round(CASE WHEN a.count > 0 THEN coalesce(rem, 0) / a.count END, 4) AS area_per_attendee
FROM svc LEFT JOIN pc USING (service_id) LEFT JOIN pr USING (service_id) LEFT JOIN attendance a USING (service_id)""")
def a03(t):
    df = S.state_summary(t.captures(), t.measurements(), t.services(), t.attempts(), t.attendance())
    return r4(df.drop("hall_id", "attendance", "baseline_area_px", "invalid_value_measurements"), "overall_waste_percent", "area_per_attendee")


A4_SQL = """
, pcap AS (
 SELECT c.event_id, c.service_id, c.state, side || 'x' || side || ' ' || space AS g, CASE WHEN c.state = 'succeeded' THEN k.attempt_id END AS attempt_id,
  CASE WHEN c.state = 'succeeded' THEN k.count_status END AS cs, CASE WHEN c.state = 'succeeded' THEN k.capture_pixels_wasted END AS px, l.status AS ls, l.count_status AS lcs
 FROM cap c LEFT JOIN counted k USING (event_id) LEFT JOIN latest l ON l.event_id = c.event_id),
ag AS (SELECT service_id, arg_min(g, (-n, g)) AS agreed FROM (SELECT service_id, g, count(*) AS n FROM pcap WHERE cs IN ('complete', 'empty') GROUP BY 1, 2) GROUP BY 1),
pr AS (
 SELECT p.*, agreed, CASE WHEN attempt_id IS NULL AND (state = 'failed' OR ls = 'failed') THEN 'analysis_failed'
  WHEN attempt_id IS NULL AND (state = 'needs_review' OR ls = 'needs_review') AND lcs = 'partial' THEN 'partial_segmentation'
  WHEN attempt_id IS NULL AND (state = 'needs_review' OR ls = 'needs_review') THEN 'needs_review' WHEN attempt_id IS NULL THEN 'not_analyzed'
  WHEN cs IS NULL THEN 'legacy_estimate' WHEN cs = 'partial' THEN 'partial_segmentation' WHEN cs = 'unavailable' OR px IS NULL THEN 'count_unavailable'
  WHEN g IS DISTINCT FROM agreed THEN 'incompatible_geometry' END AS reason FROM pcap p LEFT JOIN ag USING (service_id)),
ps AS (
 SELECT service_id, max(agreed) AS agreed_geometry, count(*) AS capture_count, count(*) FILTER (reason IS NULL) AS counted_count, count(*) FILTER (reason IS NULL AND cs = 'empty') AS empty_plates,
  count(*) FILTER (reason = 'not_analyzed') AS x_not_analyzed, count(*) FILTER (reason = 'analysis_failed') AS x_analysis_failed, count(*) FILTER (reason = 'needs_review') AS x_needs_review,
  count(*) FILTER (reason = 'partial_segmentation') AS x_partial_segmentation, count(*) FILTER (reason = 'count_unavailable') AS x_count_unavailable, count(*) FILTER (reason = 'legacy_estimate') AS x_legacy_estimate,
  count(*) FILTER (reason = 'incompatible_geometry') AS x_incompatible_geometry, CAST(coalesce(sum(px) FILTER (reason IS NULL), 0) AS BIGINT) AS pixels_wasted FROM pr GROUP BY service_id),
un AS (SELECT p.service_id, sum(m.remaining_area_px) AS unclassified_pixels FROM pr p JOIN meas m ON m.attempt_id = p.attempt_id WHERE reason IS NULL AND m.method = 'mask_pixel_count' AND m.item_id IS NULL GROUP BY 1),
psum AS (SELECT s.service_id, s.service_date, s.hall_id, ps.* EXCLUDE (service_id), coalesce(unclassified_pixels, 0)::DOUBLE AS unclassified_pixels, CASE WHEN a.count > 0 AND counted_count > 0 THEN pixels_wasted / a.count END AS pixels_per_attendee
 FROM svc s JOIN ps USING (service_id) LEFT JOIN un USING (service_id) LEFT JOIN attendance a USING (service_id))
"""


def pixel_caps(t):
    return S.pixel_captures(t.captures(), t.attempts())


def pixel_sum(t):
    return S.pixel_summary(t.services(), pixel_caps(t), t.measurements(), t.attendance())


@query("a04_pixel_summary", A4_SQL + """
SELECT service_id, agreed_geometry, capture_count, counted_count, empty_plates, x_not_analyzed, x_analysis_failed, x_needs_review, x_partial_segmentation, x_count_unavailable, x_legacy_estimate, x_incompatible_geometry,
 pixels_wasted, unclassified_pixels, round(pixels_per_attendee, 4) AS pixels_per_attendee FROM psum""")
def a04(t):
    df = pixel_sum(t).drop("hall_id", "service_date", "meal_label", "excluded_count", "attendance")
    return r4(df.withColumn("unclassified_pixels", F.col("unclassified_pixels").cast("double")), "pixels_per_attendee")


@query("a04_pixel_items", A4_SQL + """
, it AS (SELECT p.service_id, m.item_id, sum(m.remaining_area_px) AS px, count(DISTINCT m.event_id) AS captures FROM pr p JOIN meas m ON m.attempt_id = p.attempt_id WHERE reason IS NULL AND m.method = 'mask_pixel_count' AND m.item_id IS NOT NULL GROUP BY 1, 2)
SELECT service_id, item_id, px::DOUBLE AS pixels_wasted, captures, round(CASE WHEN ps.pixels_wasted > 0 THEN 100 * px / ps.pixels_wasted END, 4) AS share_percent FROM it JOIN ps USING (service_id)""")
def a04_items(t):
    return r4(S.pixel_items(pixel_caps(t), t.measurements()), "share_percent")


A5_SQL = """
, rv AS (
 SELECT m.*, c.service_id, c.state, c.side, coalesce(m.method = 'mask_pixel_count' AND m.validated AND m.remaining_area_px <= c.side * c.side AND c.space = 'topdown-normalized-v1' AND c.side = 1024
  AND m.mask_menu_id = c.menu_id AND m.mask_menu_version = s.menu_version AND NOT m.blank_version AND NOT c.blurred AND NOT m.ambiguous, FALSE) AS valid
 FROM measd m JOIN cap c ON c.event_id = m.event_id JOIN svc s ON s.service_id = c.service_id),
ev AS (SELECT event_id, any_value(service_id) AS service_id, count(*) AS n, count(*) FILTER (valid) AS nv, any_value(side) AS side,
 any_value(state) = 'succeeded' AND count(DISTINCT attempt_id) = 1 AND coalesce(sum(remaining_area_px) FILTER (valid), 0) <= any_value(side) * any_value(side) AS usable FROM rv GROUP BY event_id),
sv AS (SELECT service_id, count(*) FILTER (usable AND nv > 0) AS measured_dishes, sum(CASE WHEN usable THEN n - nv ELSE n END) AS dropped, count(DISTINCT side) FILTER (usable AND nv > 0) > 1 AS mixed FROM ev GROUP BY 1),
good AS (SELECT r.service_id, r.event_id, r.item_id, r.remaining_area_px, n.item_id IS NOT NULL AS listed FROM rv r JOIN ev USING (event_id) LEFT JOIN menu n ON n.menu_id = r.mask_menu_id AND n.item_id = r.item_id WHERE r.valid AND usable),
bk AS (SELECT service_id, item_id, sum(remaining_area_px) AS px, count(DISTINCT event_id) AS events FROM good WHERE listed GROUP BY 1, 2),
b AS (SELECT s.service_id, n.item_id, p.portions_served, p.portions_source, CASE WHEN NOT coalesce(mixed, FALSE) THEN bk.px END AS px, coalesce(mixed, FALSE) AS mixed, coalesce(bk.events, 0) AS measured_captures
 FROM svc s JOIN menu n USING (menu_id) LEFT JOIN portion1 p ON p.service_id = s.service_id AND p.menu_version = s.menu_version AND p.item_id = n.item_id
 LEFT JOIN bk ON bk.service_id = s.service_id AND bk.item_id = n.item_id LEFT JOIN sv ON sv.service_id = s.service_id),
br AS (SELECT *, CASE WHEN mixed THEN 'geometries_differ' WHEN px IS NULL THEN 'no_mask_counts' WHEN portions_served IS NULL THEN 'no_portions' WHEN portions_served = 0 AND px > 0 THEN 'waste_with_zero_portions' WHEN portions_served = 0 THEN 'zero_portions' END AS reason FROM b)
"""


def benchmark(t):
    return S.portion_benchmark(t.services(), t.menu_items(), t.captures(), counted_rows(t), t.portions())


@query("a05_portion_benchmark", A5_SQL + """
SELECT service_id, item_id, portions_served, portions_source, CAST(px AS BIGINT) AS pixels_wasted, round(CASE WHEN reason IS NULL THEN px / portions_served END, 4) AS pixels_per_portion, measured_captures, reason AS unavailable_reason FROM br""")
def a05(t):
    return r4(benchmark(t)[0].drop("display_name"), "pixels_per_portion")


@query("a05_benchmark_counts", A5_SQL + """
SELECT s.service_id, (SELECT count(*) FROM cap c WHERE c.service_id = s.service_id) AS captured_dishes, coalesce(measured_dishes, 0) AS measured_dishes,
 CAST(coalesce(dropped, 0) + coalesce((SELECT count(*) FROM good g WHERE g.service_id = s.service_id AND NOT listed), 0) AS BIGINT) AS excluded_measurements FROM svc s LEFT JOIN sv USING (service_id)""")
def a05_counts(t):
    return benchmark(t)[1]


@query("f21_portion_version", A5_SQL + """
, words(reason, said) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in F21.BENCHMARK_REASONS.items()) + """),
js AS (SELECT service_id, '{"itemId":"' || b.item_id || '","displayName":"' || n.display_name || '","portionsServed":' || coalesce(CAST(CAST(portions_served AS BIGINT) AS VARCHAR), 'null') || ',"portionsSource":' || coalesce('"' || portions_source || '"', 'null')
 || ',"pixelsWasted":' || coalesce(CAST(CAST(px AS BIGINT) AS VARCHAR), 'null') || ',"pixelsWastedPerPortion":' || coalesce(regexp_replace(CAST(CASE WHEN b.reason IS NULL THEN CAST(px AS DOUBLE) / portions_served END AS VARCHAR), '[.]0$', ''), 'null')
 || ',"measuredCaptures":' || measured_captures || ',"unavailableReason":' || coalesce('"' || said || '"', 'null') || '}' AS j, b.item_id
 FROM br b JOIN svc USING (service_id) JOIN menu n ON n.menu_id = svc.menu_id AND n.item_id = b.item_id LEFT JOIN words USING (reason)),
ls AS (SELECT service_id, string_agg(j, ',' ORDER BY item_id) AS j FROM js GROUP BY 1)
SELECT s.service_id, '["portions-v1","' || s.hall_id || '","' || s.service_id || '","' || strftime(s.service_date, '%Y-%m-%d') || '",' || s.menu_version || ',' || (SELECT count(*) FROM cap c WHERE c.service_id = s.service_id) || ',' || coalesce(measured_dishes, 0) || ','
 || CAST(coalesce(dropped, 0) + coalesce((SELECT count(*) FROM good g WHERE g.service_id = s.service_id AND NOT listed), 0) AS BIGINT) || ',[' || coalesce(j, '') || ']]' AS data_version FROM svc s LEFT JOIN sv USING (service_id) LEFT JOIN ls USING (service_id)""")
def f21_portions(t):
    return F21.portion_version(t.services(), *benchmark(t))


A12_SQL = """
, cm AS (SELECT * FROM meas WHERE attempt_id IN (SELECT attempt_id FROM counted)),
pl AS (SELECT c.event_id, c.service_id, c.hall_id, c.service_date, CASE WHEN c.state <> 'succeeded' OR c.space <> 'topdown-normalized-v1' THEN NULL WHEN m.n IS NULL THEN 0 ELSE 100 * m.r / nullif(m.b, 0) END AS pct
 FROM cap c LEFT JOIN (SELECT event_id, count(*) AS n, sum(least(remaining_area_px, baseline_area_px)) FILTER (item_id IS NOT NULL AND baseline_area_px > 0) AS r, sum(baseline_area_px) FILTER (item_id IS NOT NULL AND baseline_area_px > 0) AS b FROM cm GROUP BY event_id) m USING (event_id))
"""


def plates(t):
    return S.plate_waste_percent(t.captures(), counted_rows(t))


@query("a12_plate_waste_percent", A12_SQL + "SELECT event_id, round(pct, 4) AS plate_waste_percent FROM pl")
def a12(t):
    return r4(plates(t).select("event_id", "plate_waste_percent"), "plate_waste_percent")


@query("a13_average_plate_waste", A12_SQL + """
SELECT hall_id, floor(avg(pct) * 10 + 0.5) / 10 AS average_percent, count(pct) AS plates_counted, count(*) FILTER (pct IS NULL) AS plates_without_percent FROM pl GROUP BY hall_id""")
def a13(t):
    return S.average_plate_waste(plates(t), ["hall_id"])


A14_SQL = A4_SQL + A12_SQL + """
, dd AS (SELECT service_date, CAST(sum(CASE WHEN counted_count > 0 THEN pixels_wasted END) AS BIGINT) AS px, CAST(sum(capture_count) AS BIGINT) AS captured, CAST(sum(counted_count) AS BIGINT) AS counted FROM psum GROUP BY 1),
dp AS (SELECT service_date, count(pct) AS plates_counted, sum(pct) AS percent_sum, count(*) FILTER (pct IS NULL) AS plates_without FROM pl GROUP BY 1)
"""


def daily(t):
    return S.daily_pixels(pixel_sum(t), plates(t), t.services(), START, END)


@query("a14_daily_pixels", A14_SQL + """
SELECT d::DATE AS service_date, px AS pixels_wasted, coalesce(captured, 0) AS captured_dishes, coalesce(counted, 0) AS counted_dishes, coalesce(plates_counted, 0) AS plates_counted, round(percent_sum, 4) AS percent_sum, coalesce(plates_without, 0) AS plates_without_percent
FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) g(d) LEFT JOIN dd ON dd.service_date = d::DATE LEFT JOIN dp ON dp.service_date = d::DATE""")
def a14(t):
    return r4(daily(t), "percent_sum")


@query("a14_plate_percents", A12_SQL + """
SELECT service_date, event_id, round(pct, 4) AS plate_waste_percent FROM pl WHERE service_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""")
def a14_percents(t):
    return r4(S.plate_percents(plates(t), t.services(), START, END), "plate_waste_percent")


@query("a15_period_cards", A14_SQL + """
, p AS (SELECT * FROM (VALUES ('today', DATE '1998-04-01'), ('week', DATE '1998-03-30'), ('month', DATE '1998-04-01')) v(period, d0)),
w AS (SELECT period, d0, DATE '1998-04-01' AS d1, d0 - CAST(DATE '1998-04-01' - d0 + 1 AS INTEGER) AS p0, d0 - 1 AS p1 FROM p)
SELECT period, d0 AS start, CAST(coalesce((SELECT sum(px) FROM dd WHERE service_date BETWEEN d0 AND d1), 0) AS BIGINT) AS pixels_wasted, CAST((SELECT sum(px) FROM dd WHERE service_date BETWEEN p0 AND p1) AS BIGINT) AS previous_pixels_wasted,
 (SELECT floor(sum(percent_sum) / sum(plates_counted) * 10 + 0.5) / 10 FROM dp WHERE service_date BETWEEN d0 AND d1) AS average_percent,
 CAST(coalesce((SELECT sum(plates_counted) FROM dp WHERE service_date BETWEEN d0 AND d1), 0) AS BIGINT) AS plates_counted, CAST(coalesce((SELECT sum(plates_without) FROM dp WHERE service_date BETWEEN d0 AND d1), 0) AS BIGINT) AS plates_without_percent FROM w""")
def a15(t):
    return S.period_cards(daily(t), TODAY)


@query("a23_menu_days", "SELECT DISTINCT hall_id, service_date FROM cap")
def a23(t):
    return S.menu_days(t.services())


@query("a24_sample_status", """
SELECT v.hall_id, count(*) FILTER (source = 'demo') AS sample_captures, CASE WHEN any_value(cleared_at) IS NOT NULL THEN 'cleared' WHEN count(*) FILTER (source = 'demo') > 0 THEN 'sample' ELSE 'default' END AS mode
FROM hallview v LEFT JOIN cap c USING (hall_id) GROUP BY v.hall_id""")
def a24(t):
    return S.sample_status(t.captures(), t.views())


@query("a27_insight_window", "SELECT service_id, min(captured_at) AS window_start, max(captured_at) AS window_end FROM cap GROUP BY service_id")
def a27(t):
    return S.insight_window(t.captures(), ["service_id"])


@query("a26_photo_food_totals", """
, bx AS (SELECT event_id, item_id, count(*) AS n FROM meas WHERE validated GROUP BY ALL),
f AS (SELECT event_id, item_id, sum(pixels) AS px, sum(impact_points) AS ip, sum(co2_points) AS cp FROM scored GROUP BY ALL)
SELECT f.event_id, CAST(sum(px) AS BIGINT) AS pixels, CAST(sum(coalesce(n, 0)) AS BIGINT) AS boxes, floor(sum(ip) * 10 + 0.5) / 10 AS impact_points, floor(sum(cp) * 10 + 0.5) / 10 AS co2_points
FROM f LEFT JOIN bx ON bx.event_id = f.event_id AND bx.item_id IS NOT DISTINCT FROM f.item_id GROUP BY f.event_id""")
def a26(t):
    regions = t.measurements().filter("mask_count.validated").select("event_id", "item_id")
    return S.photo_point_totals(S.photo_food_totals(scored(t)[0], regions)).drop("water_points", "nutrition_points")


@query("a22_strict_summary", """
, base AS (SELECT DISTINCT service_id, 'item_' || CAST(l_partkey AS VARCHAR) AS item_id FROM line WHERE l_partkey % 5 <> 0),
pe AS (SELECT service_id, arg_min(side, (-n, side)) AS gs FROM (SELECT service_id, side, count(*) AS n FROM cap GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT c.event_id, c.service_id, c.service_date, c.state, c.event_id % 10 = 0 AS empty_plate, c.side, p.gs, m.measurement_id, m.remaining_area_px, m.baseline_area_px,
  coalesce(m.measurement_id IS NOT NULL AND b.item_id IS NOT NULL AND m.baseline_area_px = 60000 AND m.remaining_area_px <= m.baseline_area_px AND c.side = p.gs AND NOT m.flag_above AND NOT m.ambiguous, FALSE) AS good
 FROM cap c JOIN pe p USING (service_id) LEFT JOIN meas m ON m.event_id = c.event_id LEFT JOIN base b ON b.service_id = c.service_id AND b.item_id = m.item_id),
pl AS (SELECT event_id, any_value(service_id) AS service_id, any_value(service_date) AS service_date, any_value(state) AS state, any_value(empty_plate) AS ep, any_value(gs) AS gs, count(measurement_id) AS n, count(*) FILTER (good) AS ng,
  coalesce(sum(remaining_area_px) FILTER (good), 0) AS r, coalesce(sum(baseline_area_px) FILTER (good), 0) AS b, coalesce(max(remaining_area_px) FILTER (good), 0) AS mx FROM g GROUP BY event_id),
pp AS (SELECT *, state = 'succeeded' AND (NOT ep OR mx = 0) AS counted, CASE WHEN state = 'succeeded' AND n = ng AND (NOT ep OR mx = 0) AND (ep OR ng > 0) THEN CASE WHEN ep THEN 0 ELSE 100 * r / nullif(b, 0) END END AS pct FROM pl),
aa AS (SELECT svc.service_date, CASE WHEN bool_and(coalesce(a.count > 0, FALSE)) THEN sum(a.count) END AS att FROM svc LEFT JOIN attendance a USING (service_id) GROUP BY svc.service_date)
SELECT p.service_date, count(*) AS captured_dishes, count(pct) AS averaged_plates, count(*) FILTER (pct = 0) AS clean_plates, count(*) FILTER (pct IS NULL) AS excluded_plates,
 CAST(sum(CASE WHEN counted THEN n - ng ELSE n END) AS BIGINT) AS excluded_measurements, min(gs) = max(gs) AS one_geometry,
 CASE WHEN min(gs) = max(gs) THEN sum(CASE WHEN counted THEN r ELSE 0 END)::DOUBLE END AS remaining_area_px, round(CASE WHEN min(gs) = max(gs) THEN avg(pct) END, 4) AS average_plate_percent,
 CAST(any_value(att) AS BIGINT) AS attendance, round(CASE WHEN min(gs) = max(gs) THEN sum(CASE WHEN counted THEN r ELSE 0 END) / any_value(att) END, 4) AS area_per_attendee
FROM pp p JOIN aa USING (service_date) GROUP BY p.service_date""")
def a22(t):
    caps = t.captures().withColumn("geometry_id", F.col("geometry.width_px"))
    agreed = P.mode_with_ties(caps, ["service_id"], "geometry_id", "service_geometry_id")
    caps = caps.join(agreed, "service_id").join(t.services().select("service_id", "service_date"), "service_id").withColumn("empty_plate", F.col("event_id") % 10 == 0)
    part = F.concat(F.lit("item_"), F.col("l_partkey").cast("string"))
    items = t.lines().filter(F.col("l_partkey") % 5 != 0).select("service_id", part.alias("item_id")).distinct().select(
        "service_id", "item_id", F.concat(F.lit("base-"), "item_id").alias("baseline_id"), F.lit(60000.0).alias("baseline_area_px")
    )
    rows = t.measurements().withColumn("baseline_id", F.concat(F.lit("base-"), "item_id"))
    df = S.strict_summary(caps, rows, items, t.attendance(), ["service_date"])
    return r4(df.drop("baseline_area_px", "waste_percent"), "average_plate_percent", "area_per_attendee")


@query("f03_slug", """
SELECT doc_id, trim(regexp_replace(lower(strip_accents(substr(text, 1, 400000))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents""", domain=False)
def f03(t):
    return t.read("documents").select("doc_id", slug("text").alias("slug"))


@query("f04_readable_name", """
SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_brand || ' ' || p_name, '[-\\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part""", domain=False)
def f04(t):
    return t.read("part").select("p_partkey", readable_item_name(F.concat(F.lit("item_hall_x_"), F.col("p_brand"), F.lit("-"), F.col("p_name"))).alias("name"))


@query("f05_id_builders", """
SELECT event_id, service_id, menu_id, 'item_' || hall_id || '_' || strftime(service_date, '%Y-%m-%d') || '_' || meal_label || '_' || state AS item_id,
 'base_' || hall_id || '_' || strftime(service_date, '%Y-%m-%d') || '_' || meal_label || '_' || state || '_v2' AS baseline_id, 'item_' || hall_id || '_' || strftime(service_date, '%Y-%m-%d') || '_' || meal_label || '_' || state || '@v2' AS revision_id
FROM (SELECT * REPLACE (replace(state, '_', '-') AS state) FROM cap)""")
def f05(t):
    df = t.captures().join(t.services().select("service_id", "service_date", "meal_label"), "service_id")
    item = item_id("hall_id", "service_date", "meal_label", "state")
    return df.select(
        "event_id",
        service_id("hall_id", "service_date", "meal_label").alias("service_id"),
        menu_id("hall_id", "service_date", "meal_label").alias("menu_id"),
        item.alias("item_id"),
        baseline_id(item, F.lit(2)).alias("baseline_id"),
        revision_id(item, F.lit(2)).alias("revision_id"),
    )


@query("f28_geometry_keys", """
SELECT event_id, side || 'x' || side || ' ' || space AS count_key, '["' || space || '",' || side || ',' || side || ',null,null]' AS json_key FROM cap""")
def f28(t):
    return t.captures().select("event_id", geometry_key().alias("count_key"), geometry_json().alias("json_key"))
