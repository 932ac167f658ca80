"""Validation rules, model answers and change detection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traymetrics.catalog.registry import query
from traymetrics.operators import answers as A
from traymetrics.operators import changes as C
from traymetrics.operators import validation as V
from traymetrics.operators import joins as J
from traymetrics.operators import picking as P
from traymetrics.session import materialize, scratch_path


def counted_by_reason(df):
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


MENU_DOC_SQL = r"""
WITH d AS (SELECT doc_id, 'hall-' || CAST(doc_id % 5 AS VARCHAR) AS hall_id, DATE '1995-01-01' + CAST(doc_id // 90 AS INTEGER) AS service_date,
  CASE doc_id % 3 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' ELSE 'dinner' END AS meal_label, CASE WHEN doc_id % 31 = 0 THEN '  ' WHEN doc_id % 37 = 0 THEN '!!' ELSE source || '  ' || lang END AS name,
  trim(regexp_replace(text, '\s+', ' ', 'g')) AS description FROM documents),
e AS (SELECT *, trim(regexp_replace(name, '\s+', ' ', 'g')) AS nm FROM d),
f AS (SELECT *, trim(regexp_replace(lower(strip_accents(nm)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM e)
"""


@query("v05_check_menu_items", MENU_DOC_SQL + """
SELECT doc_id, CASE WHEN nm = '' THEN 'name_empty' WHEN slug = '' THEN 'name_without_letters' WHEN count(*) OVER (PARTITION BY hall_id, service_date, meal_label, slug) > 1 THEN 'duplicate_item' END AS reason FROM f""", domain=False)
def v05(t):
    return V.check_menu_items(menu_docs(t)).select("doc_id", "reason")


@query("v05_menu_limits", MENU_DOC_SQL + """
SELECT doc_id, CASE WHEN nm = '' THEN 'name_empty' WHEN length(nm) > 7 THEN 'name_too_long' WHEN length(description) > 2000 THEN 'description_too_long' WHEN slug = '' THEN 'name_without_letters'
 WHEN count(*) OVER (PARTITION BY hall_id, service_date, meal_label, slug) > 1 THEN 'duplicate_item' WHEN count(*) OVER (PARTITION BY hall_id, service_date, meal_label) > 5 THEN 'too_many_items' END AS reason FROM f""", domain=False)
def v05_limits(t):
    return V.check_menu_items(menu_docs(t), max_name=7, max_description=2000, max_items=5).select("doc_id", "reason")


def menu_docs(t):
    d = F.col("doc_id")
    return t.read("documents").select(
        "doc_id",
        F.concat(F.lit("hall-"), (d % 5).cast("string")).alias("hall_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.floor(d / 90).cast("int")).alias("service_date"),
        F.when(d % 3 == 0, "breakfast").when(d % 3 == 1, "lunch").otherwise("dinner").alias("meal_label"),
        F.when(d % 31 == 0, "  ").when(d % 37 == 0, "!!").otherwise(F.concat("source", F.lit("  "), "lang")).alias("name"),
        F.lit("").alias("category"),
        F.col("text").alias("description"),
    )


@query("v06_check_service_key", """
WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '-bad' ELSE lower(c_mktsegment) END AS hall_id, '1998-02-' || lpad(CAST(c_custkey % 33 AS VARCHAR), 2, '0') AS d,
 CASE c_custkey % 4 WHEN 0 THEN ' Breakfast ' WHEN 1 THEN 'LUNCH' WHEN 2 THEN 'dinner' ELSE 'snack' END AS meal, 'NATION_' || CAST(c_custkey % 30 AS VARCHAR) AS tz FROM customer)
SELECT c_custkey, CASE WHEN NOT regexp_matches(hall_id, '^[a-z0-9][a-z0-9-]*$') THEN 'invalid_hall_id' WHEN try_cast(d AS DATE) IS NULL THEN 'invalid_date'
 WHEN lower(trim(meal)) NOT IN ('breakfast', 'lunch', 'dinner') THEN 'invalid_meal' WHEN tz NOT IN (SELECT n_name FROM nation) THEN 'invalid_timezone' END AS reason FROM k""", domain=False)
def v06(t):
    c = F.col("c_custkey")
    df = t.read("customer").select(
        "c_custkey",
        F.when(c % 7 == 0, "-bad").otherwise(F.lower("c_mktsegment")).alias("hall_id"),
        F.concat(F.lit("1998-02-"), F.lpad((c % 33).cast("string"), 2, "0")).alias("service_date"),
        F.when(c % 4 == 0, " Breakfast ").when(c % 4 == 1, "LUNCH").when(c % 4 == 2, "dinner").otherwise("snack").alias("meal_label"),
        F.concat(F.lit("NATION_"), (c % 30).cast("string")).alias("hall_timezone"),
    )
    return V.check_service_key(df, t.read("nation").select(F.col("n_name").alias("zone"))).select("c_custkey", "reason")


def references(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    shape = F.when(s % 5 == 0, "round").when(s % 5 == 1, "tray").when(s % 5 == 2, "other").when(s % 5 == 3, F.lit(None)).otherwise("oval")
    return t.read("part").select(
        F.concat(F.lit("base-"), k.cast("string")).alias("baseline_id"),
        (s % 4).cast("long").alias("baseline_version"),
        F.concat(F.lit("item_"), (k % 500).cast("string")).alias("item_id"),
        (F.col("p_retailprice") * 1000.0).alias("expected_area_px"),
        F.struct(
            F.lit(1024).cast("long").alias("width_px"),
            F.when(s % 9 == 0, 512).otherwise(1024).cast("long").alias("height_px"),
            F.lit("topdown-normalized-v1").alias("coordinate_space"),
            shape.alias("plate_shape"),
            F.when(s % 6 != 0, s * 30.0).alias("plate_diameter_px"),
        ).alias("geometry"),
        F.when(s % 3 == 0, "reference_photo").when(s % 3 == 1, "manual_area").otherwise("guess").alias("source"),
        F.when(s % 2 == 0, F.col("p_name")).alias("reference_image_object_id"),
    )


REF_SQL = """
WITH r AS (SELECT 'base-' || CAST(p_partkey AS VARCHAR) AS baseline_id, p_size % 4 AS v, 'item_' || CAST(p_partkey % 500 AS VARCHAR) AS item_id, p_retailprice * 1000.0::DOUBLE AS area, CASE WHEN p_size % 9 = 0 THEN 512 ELSE 1024 END AS h,
 CASE p_size % 5 WHEN 0 THEN 'round' WHEN 1 THEN 'tray' WHEN 2 THEN 'other' WHEN 3 THEN NULL ELSE 'oval' END AS shape, CASE WHEN p_size % 6 <> 0 THEN p_size * 30.0::DOUBLE END AS dia,
 CASE p_size % 3 WHEN 0 THEN 'reference_photo' WHEN 1 THEN 'manual_area' ELSE 'guess' END AS source, p_size % 2 = 0 AS has_photo FROM part)
"""


@query("v07_check_reference_portion", REF_SQL + """
SELECT baseline_id, CASE WHEN v < 1 THEN 'invalid_version' WHEN shape = 'oval' OR dia > 1024 THEN 'invalid_geometry' WHEN area > 1024 * h THEN 'area_exceeds_image' WHEN source = 'guess' THEN 'invalid_source'
 WHEN source = 'reference_photo' AND NOT has_photo THEN 'missing_photo' END AS reason FROM r""", domain=False)
def v07(t):
    return V.check_reference_portion(references(t)).select("baseline_id", "reason")


@query("w03_latest_baseline", REF_SQL + """
SELECT item_id, arg_max(baseline_id, (v, baseline_id)) AS baseline_id, max(v) AS baseline_version, max(v) + 1 AS next_version FROM r GROUP BY item_id""", domain=False)
def w03(t):
    refs = references(t)
    latest = P.latest_baseline(refs).select("item_id", "baseline_id", "baseline_version")
    return latest.join(P.next_baseline_version(refs, refs), "item_id")


@query("j11_geometry_compatibility", REF_SQL + """
, o AS (SELECT o_orderkey AS event_id, 'item_' || CAST(o_custkey % 500 AS VARCHAR) AS item_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 512 ELSE 1024 END AS side, CASE WHEN o_orderkey % 17 = 0 THEN 'raw-camera-v1' ELSE 'topdown-normalized-v1' END AS space,
 CASE o_custkey % 3 WHEN 0 THEN 'round' WHEN 1 THEN NULL ELSE 'tray' END AS shape, o_custkey % 100 * 8.0::DOUBLE + 100 AS dia FROM orders)
SELECT event_id, baseline_id, concat_ws(',', CASE WHEN space <> 'topdown-normalized-v1' THEN 'observation_space' END, CASE WHEN space <> 'topdown-normalized-v1' THEN 'different_space' END, CASE WHEN side <> 1024 OR side <> h THEN 'different_size' END,
 CASE WHEN o.shape <> r.shape THEN 'different_shape' END, CASE WHEN abs(o.dia - r.dia) / greatest(o.dia, r.dia) > 0.05 AND r.dia IS NOT NULL THEN 'different_diameter' END) AS reasons FROM o JOIN r USING (item_id)""", domain=False)
def j11(t):
    c = F.col("o_custkey")
    side = F.when(F.col("o_orderpriority") == "1-URGENT", 512).otherwise(1024).cast("long")
    obs = t.read("orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("item_"), (c % 500).cast("string")).alias("item_id"),
        F.struct(
            side.alias("width_px"),
            side.alias("height_px"),
            F.when(F.col("o_orderkey") % 17 == 0, "raw-camera-v1").otherwise("topdown-normalized-v1").alias("coordinate_space"),
            F.when(c % 3 == 0, "round").when(c % 3 == 2, "tray").alias("plate_shape"),
            (c % 100 * 8.0 + 100).alias("plate_diameter_px"),
        ).alias("geometry"),
    )
    return J.geometry_compatibility(obs, references(t), form=lambda codes: F.array_join(codes, ",")).select("event_id", "baseline_id", "reasons")


@query("j12_best_baseline", REF_SQL + """
, best AS (SELECT item_id, arg_max(baseline_id, (v, baseline_id)) AS baseline_id, max(v) AS baseline_version FROM r WHERE h = 1024 GROUP BY item_id)
SELECT o_orderkey AS event_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN baseline_id END AS baseline_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN baseline_version END AS baseline_version
FROM orders LEFT JOIN best ON item_id = 'item_' || CAST(o_custkey % 700 AS VARCHAR)""", domain=False)
def j12(t):
    side = F.when(F.col("o_orderpriority") == "1-URGENT", 512).otherwise(1024).cast("long")
    obs = t.read("orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.concat(F.lit("item_"), (F.col("o_custkey") % 700).cast("string")).alias("item_id"),
        F.struct(side.alias("width_px"), side.alias("height_px"), F.lit("topdown-normalized-v1").alias("coordinate_space")).alias("geometry"),
    )
    return J.best_baseline(obs, references(t)).select("event_id", "baseline_id", "baseline_version")


@query("v08_check_measurement", """
SELECT CASE WHEN l_linenumber <> 5 AND l_extendedprice <> floor(l_extendedprice) THEN 'mask_count_not_integer' WHEN l_extendedprice / 60000.0::DOUBLE > 1 AND l_linenumber % 2 = 1 THEN 'above_baseline_unflagged'
 WHEN l_linenumber = 5 AND l_tax = 0 THEN 'no_percent_no_reason' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""", domain=False)
def v08(t):
    p, ln = F.col("l_extendedprice"), F.col("l_linenumber")
    df = t.read("lineitem").select(
        p.alias("remaining_area_px"),
        F.lit(60000.0).alias("baseline_area_px"),
        (p / 60000.0).alias("raw_waste_fraction"),
        F.when(ln % 2 == 0, F.array(F.lit("above_baseline"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
        F.when(ln == 5, "area_estimate").otherwise("mask_pixel_count").alias("method"),
        F.when(F.col("l_tax") > 0, F.lit(10.0)).alias("display_waste_percent"),
        F.lit(None).cast("string").alias("unavailable_reason"),
    )
    return counted_by_reason(V.check_measurement(df))


@query("v09_check_count_status", """
, s AS (SELECT attempt_id, sum(remaining_area_px) AS px FROM meas WHERE item_id IS NOT NULL GROUP BY 1)
SELECT a.attempt_id, CASE WHEN count_status IS NULL THEN 'invalid_status' WHEN capture_pixels_wasted > 262144 THEN 'total_outside_image'
 WHEN count_status IN ('complete', 'partial') AND capture_pixels_wasted <> coalesce(s.px, 0) THEN 'total_differs_from_measurements' END AS reason FROM attempt a LEFT JOIN s USING (attempt_id)""")
def v09(t):
    side = F.lit(512).cast("long")
    counts = t.attempts().select("attempt_id", "count_status", "capture_pixels_wasted", side.alias("width_px"), side.alias("height_px"))
    return V.check_count_status(counts, t.measurements().filter(F.col("item_id").isNotNull())).select("attempt_id", "reason")


@query("v10_check_physical_snapshot", """
, m AS (SELECT DISTINCT attempt_id FROM meas JOIN attempt a USING (attempt_id) WHERE phys_cal IS NOT NULL AND phys_cal IS DISTINCT FROM a.calibration_id)
SELECT a.attempt_id, CASE WHEN a.calibration_id IS NOT NULL AND k.calibration_id IS NULL THEN 'calibration_not_succeeded' WHEN physical_method IS NOT NULL AND a.calibration_id IS NULL THEN 'method_without_calibration'
 WHEN m.attempt_id IS NOT NULL THEN 'measurement_calibration_differs' END AS reason FROM attempt a LEFT JOIN cal k ON k.calibration_id = a.calibration_id AND k.status = 'succeeded' LEFT JOIN m ON m.attempt_id = a.attempt_id""")
def v10(t):
    return V.check_physical_snapshot(t.attempts(), t.measurements(), t.calibrations()).select("attempt_id", "reason")


@query("v11_check_calibration", """
, n AS (SELECT calibration_id, status, CASE WHEN reference_pixels % 5 = 0 THEN 2000000 WHEN reference_pixels % 7 = 0 THEN 0 ELSE reference_pixels END AS px, known_area_cm2, side, cm2_per_px, reference_pixels % 11 = 0 AS odd, reference_pixels % 3 = 0 AS old FROM cal)
SELECT calibration_id, CASE WHEN px > side * side THEN 'reference_pixels_outside_image' WHEN status = 'succeeded' AND px = 0 THEN 'reference_pixels_zero' WHEN status = 'succeeded' AND odd THEN 'k_differs' WHEN old THEN 'already_finished' END AS reason FROM n""")
def v11(t):
    n = F.col("reference_pixels")
    cal = t.calibrations()
    new = cal.withColumn("cm2_per_px", F.when(n % 11 == 0, F.col("cm2_per_px") * 1.01).otherwise(F.col("cm2_per_px"))).withColumn(
        "flags", F.array(F.lit("reference_low_confidence"))
    )
    new = new.withColumn("reference_pixels", F.when(n % 5 == 0, 2000000).when(n % 7 == 0, 0).otherwise(n))
    return V.check_calibration(new, cal.filter(n % 3 == 0)).select("calibration_id", "reason")


@query("v12_factor_quality", """
, r AS (SELECT factor_key FROM wf WHERE tbl IN ('east-quad', 'halal-bros') GROUP BY factor_key HAVING count(DISTINCT tbl) > 1),
x AS (SELECT 'key_in_two_restaurant_tables' AS issue, factor_key, NULL AS "table" FROM r
 UNION ALL SELECT 'nutrition_without_waste_row', factor_key, NULL FROM nutri WHERE factor_key NOT IN (SELECT factor_key FROM wf WHERE tbl <> 'common-500')
 UNION ALL SELECT 'largest_factor', factor_key, tbl FROM wf WHERE kg_co2e_per_kg > 10)
SELECT issue, factor_key, "table" FROM x""")
def v12(t):
    wrong = F.when(F.col("kg_co2e_per_kg") > 10, F.when(F.col("largest_factor") == "carbon", "water").otherwise("carbon")).otherwise(F.col("largest_factor"))
    return V.factor_quality(t.waste_factors().withColumn("largest_factor", wrong), t.nutrition_factors())


@query("v13_check_capture_submission", """
SELECT event_id, CASE WHEN source NOT IN ('camera') THEN 'invalid_source' WHEN space <> 'topdown-normalized-v1' THEN 'invalid_geometry' WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN 'invalid_scan' END AS reason FROM cap""")
def v13(t):
    k = F.col("event_id")
    text = lambda v: F.lit(v).cast("string")
    scan = F.when(
        k % 4 == 0,
        F.struct(
            text("tray-cam").alias("device_id"),
            text("laptop_received").alias("timestamp_basis"),
            text(None).alias("original_image_object_id"),
            text(None).alias("source_name"),
            F.when(k % 8 == 0, F.upper(F.sha2(k.cast("string"), 256))).otherwise(F.sha2(k.cast("string"), 256)).alias("original_sha256"),
        ),
    )
    # upper-case digests always hold a letter here, so they break the lower-case rule
    return V.check_capture_submission(t.captures().withColumn("scan", scan)).select("event_id", "reason")


@query("v14_check_attendance", """
SELECT service_id, CASE WHEN count = 0 AND day(service_date) = 21 AND meal_label = 'lunch' THEN 'invalid_count' WHEN meal_label = 'dinner' THEN 'invalid_source' END AS reason FROM attendance JOIN svc USING (service_id, hall_id, service_date)""")
def v14(t):
    a = t.attendance().join(t.services().select("service_id", "meal_label"), "service_id")
    meal = F.col("meal_label")
    df = a.select(
        "service_id", "hall_id", "service_date",
        F.when((F.col("count") == 0) & (meal == "lunch"), -1).otherwise(F.col("count")).alias("count"),
        F.when(meal == "dinner", "guess").otherwise("simulated").alias("source"),
        F.lit(300).alias("configured_min"), F.lit(1200).alias("configured_max"), F.lit("attendance-gen-v1").alias("generator_version"),
    )
    return V.check_attendance(df).select("service_id", "reason")


@query("v14_check_insight", """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'missing_metrics' WHEN trim(regexp_replace(text, '[^ -~]', '', 'g')) = '' THEN 'missing_text' WHEN role = 'user' AND turn % 4 = 2 THEN 'invalid_source' END AS reason FROM conversations""", domain=False)
def v14b(t):
    key = F.concat_ws("-", "conv_id", "turn")
    df = t.read("conversations").select(
        "conv_id", "turn", key.alias("insight_id"), F.lit("hall-1").alias("hall_id"), F.lit("1998-01-01").alias("window_start"), F.lit("1998-01-07").alias("window_end"),
        F.when(F.col("role") != "system", F.create_map(F.lit("n"), F.lit("1"))).alias("metrics"),
        F.lit("v1").alias("data_version"), F.regexp_replace("text", "[^ -~]", "").alias("recommendation"), F.lit("1998-01-08").alias("generated_at"),
        F.when((F.col("role") == "user") & (F.col("turn") % 4 == 2), "other").otherwise("fallback_rules").alias("source"),
    )
    return V.check_insight(df).select("conv_id", "turn", "reason")


@query("v14_check_menu_bundle", """
, n AS (SELECT menu_id, count(*) AS n FROM menu GROUP BY 1)
SELECT s.service_id, CASE WHEN menu_version = 2 AND meal_label = 'lunch' THEN 'invalid_service' WHEN n IS NULL THEN 'no_items' WHEN meal_label = 'dinner' THEN 'item_of_other_menu' END AS reason FROM svc s LEFT JOIN n USING (menu_id)""")
def v14c(t):
    s = t.services()
    items = t.menu_items().join(s.select("menu_id", "service_id", "meal_label"), "menu_id")
    items = items.withColumn("menu_id", F.when(F.col("meal_label") == "dinner", F.lit("menu_other")).otherwise(F.col("menu_id")))
    s = s.withColumn("menu_version", F.when((F.col("menu_version") == 2) & (F.col("meal_label") == "lunch"), 0).otherwise(F.col("menu_version")))
    return V.check_menu_bundle(s, items).select("service_id", "reason")


GUARD_TEXT = """trim(regexp_replace(text, '\\s+', ' ', 'g'))"""


@query("v18_guard_texts", rf"""
WITH c AS (SELECT conv_id, turn, {GUARD_TEXT} || CASE WHEN turn % 5 = 1 THEN ' estimated 3 kg' WHEN turn % 5 = 2 THEN ' 3 kg' WHEN turn % 7 = 3 THEN ' 5 points' WHEN turn % 7 = 4 THEN ' 5 relative impact points' ELSE '' END AS t, turn % 2 = 0 AS est FROM conversations)
SELECT conv_id, turn, length(t) > 0 AND length(t) <= CASE WHEN est THEN 500 ELSE 400 END AND NOT regexp_matches(t, '(?i)\b(dislike[sd]?|don''?t like|do not like|doesn''?t like|unpopular|not popular|hate[sd]?|tastes? (bad|bland|poor)|because (students|diners|people|guests|they))\b')
 AND NOT regexp_matches(t, '(?i)\$|\b(dollars?|usd)\b') AND NOT regexp_matches(t, '[*#`]|—') AND NOT regexp_matches(regexp_replace(t, '(?i)relative impact points', '', 'g'), '(?i)\bpoints\b')
 AND NOT (regexp_matches(t, '(?i)\b(kg|kgs|kilograms?|grams?|lbs?|liters?|litres?|gallons?|co2e)\b') AND NOT (est AND regexp_matches(t, '(?i)\bestimat'))) AS ok FROM c""", domain=False)
def v18(t):
    n = F.col("turn")
    extra = F.when(n % 5 == 1, " estimated 3 kg").when(n % 5 == 2, " 3 kg").when(n % 7 == 3, " 5 points").when(n % 7 == 4, " 5 relative impact points").otherwise("")
    text = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), extra)
    est = n % 2 == 0
    df = t.read("conversations").select("conv_id", "turn", text.alias("t"), est.alias("est"))
    limit = F.when(F.col("est"), F.lit(500)).otherwise(F.lit(400))
    return df.select("conv_id", "turn", V.text_allowed("t", limit, F.col("est")).alias("ok"))


@query("v18_guard_recommendation", r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, length(t) BETWEEN 1 AND 240 AND turn % 3 <> 2 AND turn % 5 <> 4 AND NOT regexp_matches(t, '[*#`]|—') AND NOT regexp_matches(t, '\$') AND NOT regexp_matches(t, '(?i)\bpoints\b') AND contains(lower(t), 'the') AS ok FROM c""", domain=False)
def v18b(t):
    n = F.col("turn")
    bullet = lambda m: F.struct(F.col("text"), m.alias("metric"))
    good = F.when(n % 5 == 4, "Total: 6 pixels wasted").otherwise("Total: 5 pixels wasted")
    bullets = F.when(n % 3 == 2, F.array(bullet(good))).otherwise(F.array(bullet(good), bullet(F.lit("the: 7 pixels wasted in total"))))
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct("text", bullets.alias("bullets"))), F.lit("\n```"))
    df = t.read("conversations").select(
        "conv_id", "turn", raw.alias("raw"),
        F.array(F.lit("Total: 5 pixels wasted"), F.lit("the: 7 pixels wasted in total")).alias("allowed_metrics"),
        F.array(F.lit("the")).alias("foods"), F.lit(False).alias("has_estimates"),
    )
    return V.guard_recommendation(df).select("conv_id", "turn", "ok")


# model answers: one JSON text per order, built from its line items


def area_answers(t):
    """Answers with every kind of fault, by order key."""
    k = F.col("event_id")
    item = F.struct(
        F.when(F.col("l_linenumber") == 7, "item_x").otherwise(F.concat(F.lit("item_"), F.col("l_partkey").cast("string"))).alias("itemId"),
        F.when((F.col("l_quantity") == 50), F.lit(-1.0)).otherwise(F.floor("l_extendedprice").cast("double")).alias("remainingAreaPx"),
        (F.col("l_discount") * 10 + F.when(F.col("l_tax") == 0.08, 1).otherwise(0)).alias("confidence"),
        F.col("l_linenumber").alias("n"),
    )
    per = t.lines().groupBy("event_id", "service_id", "hall_id", "service_date", "meal_label").agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.to_json(F.struct((k % 50 == 0).alias("plateEmpty"), F.lit(False).alias("ambiguous"), F.col("items"), F.array().cast("array<struct<label:string,remainingAreaPx:double>>").alias("unknown")))
    raw = F.when(k % 23 == 0, "{oops").when(k % 29 == 0, "[1]").when(k % 31 == 0, F.lit('{"ambiguous": false}')).otherwise(body)
    from traymetrics.functions.text import menu_id

    geometry = F.struct(F.lit(600).alias("width_px"), F.lit(600).alias("height_px"), F.lit(None).cast("double").alias("plate_diameter_px"))
    return per.select(k.alias("answer_id"), menu_id("hall_id", "service_date", "meal_label").alias("menu_id"), raw.alias("raw"), geometry.alias("geometry"))


@query("v15_check_area_answers", """
, it AS (SELECT event_id, menu_id, CASE WHEN l_linenumber = 7 THEN 'item_x' ELSE 'item_' || CAST(l_partkey AS VARCHAR) END AS item_id, CASE WHEN l_quantity = 50 THEN -1 ELSE floor(l_extendedprice) END AS px,
 l_discount * 10 + CASE WHEN l_tax = 0.08 THEN 1 ELSE 0 END AS conf, l_linenumber AS ln FROM line),
o AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY event_id, item_id ORDER BY item_id, px, conf, ln) AS dup FROM it WINDOW w AS (PARTITION BY event_id ORDER BY item_id, px, conf, ln)),
rs AS (SELECT o.event_id, o.pos, o.px, CASE WHEN m.item_id IS NULL THEN 'unknown_item_id_in_response' WHEN dup > 1 THEN 'duplicate_item_assignment' WHEN px < 0 THEN 'invalid_remaining_area' WHEN conf > 1 THEN 'invalid_confidence' END AS r
 FROM o LEFT JOIN menu m ON m.menu_id = o.menu_id AND m.item_id = o.item_id),
a AS (SELECT event_id, arg_min(r, pos) FILTER (r IS NOT NULL) AS r, sum(px) AS total FROM rs GROUP BY event_id),
z AS (SELECT event_id AS answer_id, CASE WHEN event_id % 23 = 0 THEN 'response_not_json' WHEN event_id % 29 = 0 THEN 'response_not_object' WHEN event_id % 31 = 0 THEN 'missing_or_invalid_field:plateEmpty' WHEN r IS NOT NULL THEN r
 WHEN total > 360000 THEN 'total_area_exceeds_plate' WHEN event_id % 50 = 0 AND total > 0 THEN 'empty_plate_with_nonzero_area' END AS reason FROM a)
SELECT answer_id, reason, CASE WHEN reason LIKE 'response%' OR reason LIKE 'missing%' THEN 'failed' WHEN reason IS NOT NULL THEN 'needs_review' END AS severity FROM z""")
def v15(t):
    return A.check_area_answers(area_answers(t), t.menu_items()).select("answer_id", "severity", "reason")


def box_answers(t):
    k = F.col("l_orderkey")
    piece = F.struct(
        F.when((F.col("l_linenumber") == 7) & (k % 3 == 0), 999).otherwise(F.col("l_linenumber") - 1).alias("menu_id"),
        F.col("l_shipdate").cast("string").alias("ingredient"),
        F.array(F.col("l_quantity"), F.col("l_quantity"), F.col("l_quantity") + 100.0, F.col("l_quantity") + F.col("l_linenumber") * 10.0).alias("box_2d"),
        (F.col("l_returnflag") != "A").alias("on_target_dish"),
    )
    per = t.read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    dish = F.when(k % 4 == 0, F.lit(None)).otherwise(
        F.struct(F.when(k % 4 == 1, "plate").when(k % 4 == 2, "bowl").otherwise("tray").alias("dish_type"), F.array(F.lit(1.0), F.lit(1.0), F.lit(900.0), F.lit(900.0)).alias("box_2d"), (k % 5 != 0).alias("fully_visible"))
    )
    raw = F.when(k % 37 == 0, "nope").when(k % 41 == 0, "7").when(k % 43 == 0, F.lit('{"pieces": 3}')).when(k % 6 == 0, F.to_json("pieces")).otherwise(F.to_json(F.struct(dish.alias("target_dish"), "pieces")))
    menu = t.read("region").select((F.col("r_regionkey") + 1).cast("long").alias("number"), F.concat(F.lit("item_"), F.col("r_name")).alias("item_id")).withColumn("menu_id", F.lit("m"))
    return per.select(k.alias("answer_id"), F.lit("m").alias("menu_id"), raw.alias("raw")), menu


BOX_SQL = """
WITH ans AS (SELECT l_orderkey AS k, max(CASE WHEN l_linenumber = 7 AND (l_orderkey % 3 = 0 OR l_linenumber - 1 > 5) THEN 1 ELSE 0 END) = 1 AS bad, count(*) AS n FROM lineitem GROUP BY 1),
st AS (SELECT k, n, CASE WHEN k % 37 = 0 THEN 'invalid_json' WHEN k % 41 = 0 THEN 'not_an_object' WHEN k % 43 = 0 THEN 'pieces_not_an_array' WHEN bad THEN 'menu_id_out_of_range' END AS reject FROM ans)
"""


@query("v16_box_answer_rejects", BOX_SQL + "SELECT k AS answer_id, reject AS reason FROM st WHERE reject IS NOT NULL", domain=False)
def v16(t):
    return A.parse_box_answers(*box_answers(t))[2]


@query("v16_box_answer_pieces", BOX_SQL + """
SELECT l_orderkey AS answer_id, CASE WHEN l_linenumber > 1 THEN 'item_' || r_name END AS item_id, count(*) AS pieces, count(*) FILTER (l_returnflag <> 'A') AS on_target, sum(l_quantity) AS y0
FROM lineitem JOIN st ON k = l_orderkey AND reject IS NULL LEFT JOIN region ON r_regionkey = l_linenumber - 2 GROUP BY 1, 2""", domain=False)
def v16b(t):
    pieces = A.parse_box_answers(*box_answers(t))[0]
    return pieces.groupBy("answer_id", "item_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_if("on_target").alias("on_target"), F.sum(F.get("box", F.lit(0))).alias("y0")
    )


@query("v16_box_answer_dishes", BOX_SQL + """
SELECT k AS answer_id, CASE WHEN k % 6 = 0 THEN 'legacy_array' WHEN k % 4 = 0 THEN 'not_found' WHEN k % 4 = 3 THEN 'bad_dish_type' END AS reason, CASE WHEN k % 6 <> 0 THEN CASE k % 4 WHEN 1 THEN 'plate' WHEN 2 THEN 'bowl' WHEN 3 THEN 'tray' END END AS dish_type FROM st WHERE reject IS NULL""", domain=False)
def v16c(t):
    return A.parse_box_answers(*box_answers(t))[1].select("answer_id", "reason", "dish_type")


def leftover_answers(t):
    k = F.col("event_id")
    count = F.when(k % 6 == 0, F.lit("-1")).when(k % 6 == 1, F.lit("2.5")).otherwise((k % 9).cast("string"))
    raw = (
        F.when(k % 19 == 0, F.lit("{"))
        .when(k % 17 == 0, F.lit('{"item": []}'))
        .when(k % 4 == 0, F.concat(F.lit('{"items": [{"label": "'), "event_type", F.lit('", "countable": true, "count": '), count, F.lit("}]}")))
        .when(k % 4 == 1, F.concat(F.lit('{"items": [{"label": "'), "event_type", F.lit('", "countable": false, "percentRemaining": '), F.col("value").cast("string"), F.lit("}]}")))
        .when(k % 4 == 2, F.concat(F.lit('{"items": [{"label": "'), "event_type", F.lit('", "countable": true, "count": 1}, {"label": "'), "event_type", F.lit('", "countable": true, "count": 1}]}')))
        .otherwise(F.concat(F.lit('{"items": [{"label": "'), "event_type", F.lit('"}]}')))
    )
    return t.read("events").select(k.alias("answer_id"), raw.alias("raw"), F.array(F.lit("click"), F.lit("view"), F.lit("error")).alias("labels"))


@query("v17_check_leftover_answers", """
SELECT event_id AS answer_id, CASE WHEN event_id % 19 = 0 THEN 'invalid_json' WHEN event_id % 17 = 0 THEN 'missing_items' WHEN event_type NOT IN ('click', 'view', 'error') THEN 'label_not_allowed'
 WHEN event_id % 4 = 0 AND event_id % 6 IN (0, 1) THEN 'invalid_count' WHEN event_id % 4 = 1 AND value > 100 THEN 'invalid_percent' WHEN event_id % 4 = 2 THEN 'duplicate_label' WHEN event_id % 4 = 3 THEN 'missing_countable' END AS reason FROM events""", domain=False)
def v17(t):
    return A.check_leftover_answers(leftover_answers(t)).select("answer_id", "reason")


@query("v17_leftover_items", """
SELECT event_id AS answer_id, event_type AS label, event_id % 4 = 0 AS countable, CASE WHEN event_id % 4 = 0 THEN event_id % 9 END AS count, CASE WHEN event_id % 4 = 1 THEN value END AS percent_remaining FROM events
WHERE event_id % 19 <> 0 AND event_id % 17 <> 0 AND event_type IN ('click', 'view', 'error') AND ((event_id % 4 = 0 AND event_id % 6 NOT IN (0, 1)) OR (event_id % 4 = 1 AND value <= 100))""", domain=False)
def v17b(t):
    return A.leftover_items(A.check_leftover_answers(leftover_answers(t))).drop("confidence")


# change detection


def menu_versions(t):
    s = t.services().select("service_id", "menu_id", "hall_id", "service_date", "meal_label", "hall_timezone", "menu_version")
    stored = t.menu_items().withColumn("description", F.lit(None).cast("string")).join(s, "menu_id")
    day, meal = F.dayofmonth("service_date"), F.col("meal_label")
    incoming = stored.drop("menu_version").filter(~((day == 11) & (F.col("item_id").endswith("3")))).withColumn(
        "hall_timezone", F.when((day == 21) & (meal == "lunch"), F.lit("UTC")).otherwise(F.col("hall_timezone"))
    )
    return stored.filter(meal != "breakfast"), incoming.filter(day != 31)


@query("s01_plan_menu_revision", """
, m AS (SELECT s.service_id, s.meal_label, s.menu_version, day(service_date) AS d, count(*) AS n, count(*) FILTER (NOT (day(service_date) = 11 AND item_id LIKE '%3')) AS k FROM svc s JOIN menu USING (menu_id) GROUP BY ALL),
p AS (SELECT service_id, menu_version, CASE WHEN d = 31 OR k = 0 THEN CASE WHEN meal_label <> 'breakfast' THEN 'absent' END WHEN meal_label = 'breakfast' THEN 'create' WHEN d = 21 AND meal_label = 'lunch' THEN 'mismatch' WHEN k = n THEN 'unchanged' ELSE 'revise' END AS action FROM m)
SELECT service_id, action, CASE action WHEN 'create' THEN 1 WHEN 'revise' THEN menu_version + 1 WHEN 'unchanged' THEN menu_version END AS menu_version FROM p WHERE action IS NOT NULL""")
def s01(t):
    return C.plan_menu_revision(*menu_versions(t))


@query("s02_archive_items", """
SELECT item_id || '@v' || CAST(menu_version AS VARCHAR) || '' AS revision_item_id, menu_id, menu_version FROM menu JOIN svc USING (menu_id) WHERE meal_label = 'lunch' AND item_id NOT LIKE '%7'""")
def s02(t):
    items = t.menu_items()
    plan = t.services().select("menu_id", F.col("menu_version").alias("stored_version"), (F.col("menu_version") + F.when(F.col("meal_label") == "lunch", 1).otherwise(0)).alias("new_version"))
    done = items.filter(F.col("item_id").endswith("7")).select(F.explode(F.array(*[F.concat("item_id", F.lit(f"@v{v}")) for v in (1, 2)])).alias("revision_item_id")).distinct()
    return C.archive_items(items, done, plan).select("revision_item_id", "menu_id", "menu_version")


@query("s03_set_scores", """
, d AS (SELECT DISTINCT event_id, l_partkey % 10 AS f FROM line WHERE l_returnflag <> 'A'), t AS (SELECT DISTINCT event_id, l_partkey % 10 AS f FROM line WHERE l_linestatus = 'O'),
j AS (SELECT coalesce(d.event_id, t.event_id) AS event_id, d.f AS a, t.f AS b FROM d FULL JOIN t ON d.event_id = t.event_id AND d.f = t.f)
SELECT event_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS correct, count(*) FILTER (a IS NULL) AS missed, count(*) FILTER (b IS NULL) AS wrong FROM j GROUP BY 1""")
def s03(t):
    food = (F.col("l_partkey") % 10).cast("string")
    sets = t.read("lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.collect_set(F.when(F.col("l_returnflag") != "A", food)).alias("d"), F.collect_set(F.when(F.col("l_linestatus") == "O", food)).alias("t")
    )
    cols = {k: v.cast("long") for k, v in C.set_scores("d", "t").items()}
    return sets.select("event_id", *[v.alias(k) for k, v in cols.items()]).filter("correct + missed + wrong > 0")


@query("s04_union_factors", """
SELECT factor_key, tbl AS "table" FROM wf WHERE tbl <> 'common-500' OR factor_key NOT IN (SELECT factor_key FROM wf WHERE tbl <> 'common-500')""")
def s04(t):
    f = t.waste_factors()
    return C.union_factors(f.filter("table != 'common-500'"), f.filter("table = 'common-500'")).select("factor_key", "table")


@query("s05_portions_source", """
SELECT service_id, CASE WHEN bool_or(source = 'demo') THEN 'demo' WHEN bool_or(source = 'csv') THEN 'csv' ELSE 'manual' END AS source FROM portion GROUP BY service_id""")
def s05(t):
    from traymetrics.operators.impact import portions_source

    return t.portions().groupBy("service_id").agg(portions_source("source").alias("source"))


@query("s06_missing_insights", """
SELECT DISTINCT c.hall_id, 'v' || CAST(year(service_date) * 12 + month(service_date) - 23904 AS VARCHAR) AS data_version FROM cap c WHERE NOT EXISTS (
 SELECT 1 FROM customer WHERE c_custkey % 2 = 0 AND 'hall-' || CAST(c_custkey % 5 AS VARCHAR) = c.hall_id AND c_custkey % 997 = year(service_date) * 12 + month(service_date) - 23904)""")
def s06(t):
    version = F.concat(F.lit("v"), (F.year("service_date") * 12 + F.month("service_date") - 23904).cast("string"))
    current = t.services().select("hall_id", version.alias("data_version")).distinct()
    c = F.col("c_custkey")
    stored = t.read("customer").select(
        F.concat(F.lit("hall-"), (c % 5).cast("string")).alias("hall_id"),
        F.concat(F.lit("v"), (c % 997).cast("string")).alias("data_version"),
        F.when(c % 2 == 0, "gemini").otherwise("fallback_rules").alias("source"),
    )
    return C.missing_insights(current, stored)


@query("s07_unclaimed", "SELECT event_id AS capture_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", domain=False)
def s07(t):
    frames = t.read("events").select(F.col("event_id").alias("capture_id"))
    return C.unclaimed(frames, t.read("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("capture_id")))


@query("s08_food_database", """
SELECT w.factor_key, tbl AS "table", nutrient_days_per_kg FROM wf w LEFT JOIN nutri n ON n.factor_key = w.factor_key AND tbl = 'east-quad' WHERE tbl = 'east-quad' OR (tbl = 'halal-bros' AND w.factor_key NOT IN ('red-gear', 'hot-rod'))""")
def s08(t):
    f = t.waste_factors()
    df = C.food_database(f.filter("table = 'east-quad'"), t.nutrition_factors(), f.filter("table = 'halal-bros'"), ["red-gear", "hot-rod"])
    return df.select("factor_key", "table", "nutrient_days_per_kg")


@query("snk04_record_analysis", """
, bad AS (SELECT DISTINCT attempt_id FROM meas WHERE raw_waste_fraction > 1 AND NOT flag_above)
SELECT a.attempt_id, count(m.attempt_id) AS measurements FROM attempt a LEFT JOIN meas m USING (attempt_id) WHERE a.attempt_id NOT IN (SELECT attempt_id FROM bad) AND a.status <> 'needs_review' GROUP BY 1""")
def snk04(t):
    rows = V.check_measurement(
        t.measurements().withColumn("display_waste_percent", F.lit(1.0)).withColumn("unavailable_reason", F.lit(None).cast("string"))
    ).withColumn("reason", F.when(F.col("reason") == "above_baseline_unflagged", F.col("reason")))
    attempts = t.attempts()
    stored = attempts.filter("status = 'needs_review'").select("attempt_id")
    ok, kept, _ = C.record_analysis(attempts.withColumn("reason", F.lit(None).cast("string")), rows, stored)
    n = kept.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("measurements"))
    return ok.select("attempt_id").join(n, "attempt_id", "left").withColumn("measurements", F.coalesce("measurements", F.lit(0)))


@query("snk04_append_analysis", """
, bad AS (SELECT DISTINCT attempt_id FROM meas WHERE raw_waste_fraction > 1 AND NOT flag_above)
SELECT a.attempt_id, a.status, count(m.attempt_id) AS measurements, count(m.attempt_id) FILTER (m.item_id IS NOT NULL) AS regions, CAST(sum(m.remaining_area_px) AS BIGINT) AS pixels
FROM attempt a LEFT JOIN meas m USING (attempt_id) WHERE a.attempt_id NOT IN (SELECT attempt_id FROM bad) GROUP BY 1, 2""")
def snk04_append(t):
    """Two batches, the second repeats the first: everything of an attempt is stored once or not at all."""
    rows = V.check_measurement(
        t.measurements().withColumn("display_waste_percent", F.lit(1.0)).withColumn("unavailable_reason", F.lit(None).cast("string"))
    ).withColumn("reason", F.when(F.col("reason") == "above_baseline_unflagged", F.col("reason")))
    # both batches and every table of them read these, so they are frozen once
    rows = materialize(rows.select("attempt_id", "measurement_id", "item_id", "remaining_area_px", "reason"))
    attempts = materialize(t.attempts().select("attempt_id", "event_id", "status").withColumn("reason", F.lit(None).cast("string")))
    regions = rows.filter("item_id IS NOT NULL").select("attempt_id", "item_id")
    counts = rows.groupBy("attempt_id").agg(F.sum("remaining_area_px").cast("long").alias("capture_pixels_wasted"))
    root = scratch_path(t.spark, "analysis")
    for batch in (attempts.filter("event_id % 3 = 0"), attempts):
        C.append_analysis(root, batch, rows, regions, counts)
    stored = C.read_analysis(t.spark, root)
    n = stored["food_measurement"].groupBy("attempt_id").agg(F.count(F.lit(1)).alias("measurements"))
    r = stored["segmentation_region"].groupBy("attempt_id").agg(F.count(F.lit(1)).alias("regions"))
    out = stored["analysis_attempt"].join(n, "attempt_id", "left").join(r, "attempt_id", "left").join(stored["capture_count"], "attempt_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("attempt_id", "status", zero("measurements"), zero("regions"), F.col("capture_pixels_wasted").alias("pixels"))


@query("snk05_delete_marked", """
SELECT c.event_id, count(m.measurement_id) AS measurements FROM cap c LEFT JOIN meas m USING (event_id) WHERE c.source <> 'demo' GROUP BY 1""")
def snk05(t):
    caps = t.captures()
    markers = caps.filter("source = 'demo'").select(F.lit("capture_event").alias("table_name"), F.col("event_id").cast("string").alias("row_key"))
    m = t.measurements().select("event_id", "measurement_id")
    left = C.delete_marked({"capture_event": caps.select("event_id"), "food_measurement": m}, {"capture_event": "event_id", "food_measurement": "measurement_id"}, markers, {"food_measurement": ("capture_event", "event_id")})
    n = left["food_measurement"].groupBy("event_id").agg(F.count(F.lit(1)).alias("measurements"))
    return left["capture_event"].join(n, "event_id", "left").withColumn("measurements", F.coalesce("measurements", F.lit(0)))
