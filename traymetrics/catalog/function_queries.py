"""Scalar functions and run scoring over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traymetrics.catalog.registry import query, r4
from traymetrics.functions import dates as D
from traymetrics.functions import hashing as H
from traymetrics.functions import impact as M
from traymetrics.functions import numbers as N
from traymetrics.functions import roles as O
from traymetrics.functions import text as X
from traymetrics.operators import joins as J
from traymetrics.operators import scoring as S


@query("f06_local_date", """
, l AS (SELECT event_id, (captured_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Detroit' AS t FROM cap) SELECT event_id, t::DATE AS day, strftime(t, '%H:%M') AS hhmm FROM l""")
def f06(t):
    tz = F.lit("America/Detroit")
    return t.captures().select("event_id", D.local_date("captured_at", tz).alias("day"), D.local_hhmm("captured_at", tz).alias("hhmm"))


@query("f07_zoned_to_utc", """
WITH w AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(o_orderkey % 1440) AS w FROM orders),
a AS (SELECT *, w + (w - (w AT TIME ZONE 'UTC') AT TIME ZONE 'America/Detroit') AS g FROM w)
SELECT o_orderkey, g + (w - (g AT TIME ZONE 'UTC') AT TIME ZONE 'America/Detroit') AS at FROM a""", domain=False)
def f07(t):
    hhmm = F.date_format(F.timestamp_seconds(F.col("o_orderkey") % 1440 * 60), "HH:mm")
    return t.read("orders").select("o_orderkey", D.zoned_to_utc(F.to_date("o_orderdate"), hhmm, F.lit("America/Detroit")).cast("timestamp_ntz").alias("at"))


@query("f08_calendar", """
SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate AS DATE) - CAST(date_trunc('month', o_orderdate) AS DATE) + 1 AS days FROM orders""", domain=False)
def f08(t):
    d = F.to_date("o_orderdate")
    days = F.size(D.each_day(D.month_start(d), d)).cast("long")
    return t.read("orders").select("o_orderkey", D.week_start(d).alias("week_start"), D.month_start(d).cast("date").alias("month_start"), days.alias("days"))


@query("f09_js_round", "SELECT p_partkey, floor(p_retailprice * 0.37 * 100 + 0.5) / 100 AS r2, floor(p_retailprice * 0.37 + 0.5) AS r0 FROM (SELECT p_partkey, p_retailprice::DOUBLE AS p_retailprice FROM part)".replace("0.37", "0.37::DOUBLE"), domain=False)
def f09(t):
    x = F.col("p_retailprice") * 0.37
    return t.read("part").select("p_partkey", N.js_round(x, 2).alias("r2"), N.js_round(x, 0).alias("r0"))


@query("f10_significant", """
WITH v AS (SELECT event_id, value * power(10, event_id % 7 - 3) AS x FROM events WHERE value > 0), e AS (SELECT *, CAST(floor(log10(x)) AS INTEGER) - 1 AS p FROM v)
SELECT event_id, round(CASE WHEN p >= 0 THEN floor(x / power(10, p) + 0.5) * power(10, p) ELSE floor(x * power(10, -p) + 0.5) / power(10, -p) END, 4) AS s2 FROM e""", domain=False)
def f10(t):
    x = F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 7 - 3).cast("double"))
    return r4(t.read("events").filter("value > 0").select("event_id", N.significant(x, 2).alias("s2")), "s2")


@query("f11_physical_label", """
SELECT p_partkey, format('{:,}', CAST(floor(g + 0.5) AS BIGINT)) || ' g' AS grams, CASE WHEN g / 1000 * 3 >= 0.1 THEN ' kg CO2e' ELSE ' g CO2e' END AS unit FROM (SELECT p_partkey, p_size * 7.5::DOUBLE AS g FROM part)""", domain=False)
def f11(t):
    g = F.col("p_size") * 7.5
    label = M.format_physical_label(g, g / 1000 * 3, g * 0.2)
    parts = F.split(label, " · ")
    return t.read("part").select("p_partkey", F.get(parts, F.lit(0)).alias("grams"), F.regexp_extract(F.get(parts, F.lit(1)), "( k?g CO2e)$", 1).alias("unit"))


@query("f13_display_formats", """
SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) || '%' AS pct, format('{:,}', CAST(floor(value * 20 + 0.5) AS BIGINT)) AS whole,
 CASE WHEN value * 100000 >= 1000000 THEN regexp_replace(printf('%.1f', floor(value * 100000 / 1000000 * 10 + 0.5) / 10), '\\.0$', '') || 'M' WHEN value * 100000 >= 10000 THEN regexp_replace(printf('%.1f', floor(value * 100000 / 1000 * 10 + 0.5) / 10), '\\.0$', '') || 'k' ELSE format('{:,}', CAST(floor(value * 100000 + 0.5) AS BIGINT)) END AS compact FROM events""", domain=False)
def f13(t):
    v = F.col("value")
    return t.read("events").select("event_id", N.format_percent(v).alias("pct"), N.whole(v * 20).alias("whole"), N.format_compact(v * 100000).alias("compact"))


@query("f14_nice_ceil", """
WITH v AS (SELECT event_id, value AS x, power(10, floor(log10(value))) AS b FROM events WHERE value > 0)
SELECT event_id, round(CASE WHEN x <= b THEN b WHEN x <= 2 * b THEN 2 * b WHEN x <= 2.5 * b THEN 2.5 * b WHEN x <= 5 * b THEN 5 * b ELSE 10 * b END, 4) AS top FROM v""", domain=False)
def f14(t):
    return r4(t.read("events").filter("value > 0").select("event_id", N.nice_ceil("value").alias("top")), "top")


@query("f15_sanitize_text", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}`]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""", domain=False)
def f15(t):
    return t.read("documents").select("doc_id", F.md5(X.sanitize_text("text", 1_000_000_000)).alias("digest"))


@query("f15_plain_text", r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s*[—–]\s*', ', ', 'g'), ',?\s+([.,;:!?])', '\1', 'g'), '\s{2,}', ' ', 'g')) AS t FROM conversations""", domain=False)
def f15b(t):
    return t.read("conversations").select("conv_id", "turn", X.plain_text("text").alias("t"))


@query("f16_cap_text", r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t = '' THEN NULL WHEN length(t) > 600 THEN left(t, 597) || '...' ELSE t END AS t FROM c""", domain=False)
def f16(t):
    return t.read("conversations").select("conv_id", "turn", X.cap_text("text").alias("t"))


FNV = "list_reduce(list_transform(string_split({s}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda h, ch: xor(h, ch) * 16777619 % 4294967296, CAST(2166136261 AS BIGINT))"


@query("f17_fnv1a32", f"SELECT p_partkey, {FNV.format(s='p_name')} AS h FROM part", domain=False)
def f17(t):
    return t.read("part").select("p_partkey", H.fnv1a32("p_name").alias("h"))


@query("f18_attendance_count", f"""
, k AS (SELECT service_id, {FNV.format(s="('attendance-gen-v1|' || hall_id || '|' || service_id || '|' || strftime(service_date, '%Y-%m-%d'))")} AS seed FROM svc),
a AS (SELECT service_id, (seed + 1831565813) % 4294967296 AS t FROM k),
b AS (SELECT service_id, CAST(CAST(xor(t, t >> 15) AS HUGEINT) * (t | 1) % 4294967296 AS BIGINT) AS r FROM a),
c AS (SELECT service_id, xor(r, (r + CAST(CAST(xor(r, r >> 7) AS HUGEINT) * (r | 61) % 4294967296 AS BIGINT)) % 4294967296) AS r FROM b)
SELECT service_id, 300 + CAST(floor(xor(r, r >> 14) / 4294967296.0::DOUBLE * 901) AS BIGINT) AS count FROM c""")
def f18(t):
    return t.services().select("service_id", H.attendance_count("hall_id", "service_id", "service_date").alias("count"))


@query("f19_demo_random", f"""
WITH k AS (SELECT p_partkey, {FNV.format(s="('v1|' || p_name || '|' || CAST(p_partkey AS VARCHAR))")} AS h FROM part), a AS (SELECT p_partkey, xor(h, (h << 13) % 4294967296) AS h FROM k), b AS (SELECT p_partkey, xor(h, h >> 17) AS h FROM a)
SELECT p_partkey, CAST(xor(h, (h << 5) % 4294967296) AS BIGINT) AS draw FROM b""", domain=False)
def f19(t):
    key = F.concat_ws("|", F.lit("v1"), "p_name", F.col("p_partkey").cast("string"))
    return t.read("part").select("p_partkey", (H.demo_random(key) * 4294967296.0).cast("long").alias("draw"))


@query("f20_recipe_rows", """
WITH r AS (SELECT p_partkey, p_name AS a, p_size / 10.0::DOUBLE AS ka, p_brand AS b FROM part)
SELECT ingredient, count(*) AS recipes, round(sum(kg), 4) AS kg FROM (SELECT a AS ingredient, ka AS kg FROM r UNION ALL SELECT b, 0.25::DOUBLE FROM r) GROUP BY 1""", domain=False)
def f20(t):
    recipe = F.concat("p_name", F.lit(" "), (F.col("p_size") / 10.0).cast("string"), F.lit("; "), "p_brand", F.lit(" 0.25"))
    df = t.read("part").select(F.inline(M.recipe_rows(recipe)))
    return r4(df.groupBy("ingredient").agg(F.count(F.lit(1)).alias("recipes"), F.sum("kg").alias("kg")), "kg")


@query("f20_split_allergens", "SELECT p_partkey, lower(p_type) || '|' || p_name AS allergens FROM part", domain=False)
def f20b(t):
    return t.read("part").select("p_partkey", F.array_join(X.split_allergens(F.concat(F.lower("p_type"), F.lit("; "), "p_name", F.lit("; "))), "|").alias("allergens"))


@query("f29_portion_role", """
WITH r AS (SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'dessert' WHEN p_type = 'SMALL' THEN 'soup' WHEN p_size = 7 THEN 'pizza' WHEN p_size = 8 THEN 'entree' ELSE 'side' END AS role FROM part)
SELECT p_partkey, role, CASE role WHEN 'pizza' THEN 200 WHEN 'entree' THEN 80 WHEN 'dessert' THEN 50 ELSE 60 END AS low, CASE role WHEN 'pizza' THEN 400 WHEN 'entree' THEN 200 ELSE 150 END AS high FROM r""", domain=False)
def f29(t):
    key = F.when(F.col("p_size") == 7, "cheese-pizza").when(F.col("p_size") == 8, "ancho-flank-steak").otherwise("rice")
    station = F.when(F.col("p_type") == "PROMO", "MBakery").when(F.col("p_type") == "SMALL", "Soup").otherwise("Grill")
    df = t.read("part").select("p_partkey", O.portion_role(key, station).alias("role"))
    low, high = O.portion_range("role")
    return df.select("p_partkey", "role", low.alias("low"), high.alias("high"))


@query("f33_factor_dollars", """
SELECT factor_key, tbl AS "table", round(floor(0.19::DOUBLE * kg_co2e_per_kg * 100 + 0.5) / 100, 4) AS carbon_usd, round(floor(1.5::DOUBLE * water_m3_per_kg * 100 + 0.5) / 100, 4) AS water_usd, round(impact_usd_per_kg, 4) AS impact_usd FROM wf""")
def f33(t):
    df = t.waste_factors().select("factor_key", "table", *[c.alias(n) for n, c in M.factor_dollars("kg_co2e_per_kg", "water_m3_per_kg").items()])
    return r4(df, "carbon_usd", "water_usd", "impact_usd")


NAMES = {"red widget": "Widget", "hot rod": "Rod"}  # a sample of a label map


@query("f34_canonical_food", """
WITH e AS (SELECT p_partkey, unnest([p_name, p_brand]) AS n FROM part) SELECT p_partkey, count(*) AS n, string_agg(CASE n WHEN 'red widget' THEN 'Widget' WHEN 'hot rod' THEN 'Rod' ELSE n END, '|' ORDER BY CASE n WHEN 'red widget' THEN 'Widget' WHEN 'hot rod' THEN 'Rod' ELSE n END) AS foods FROM e GROUP BY 1""", domain=False)
def f34(t):
    cell = F.concat("p_name", F.lit(" (left) & unkown food & "), "p_brand")
    foods = F.array_sort(X.truth_foods(cell, NAMES))
    return t.read("part").select("p_partkey", F.size(foods).cast("long").alias("n"), F.array_join(foods, "|").alias("foods"))


# runs against labelled photos: one run per (order, return flag), a photo per order


def runs(t):
    line = t.read("lineitem")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), "l_returnflag")
    food = F.when(F.col("l_linenumber") != 7, F.concat(F.lit("food"), (F.col("l_partkey") % 10).cast("string")))
    per = line.groupBy(key.alias("run_key"), F.col("l_orderkey").cast("string").alias("photo"), "l_returnflag").agg(
        F.sum(F.floor("l_extendedprice")).alias("capture_pixels"), F.sum(F.when(F.col("l_linenumber") == 7, F.floor("l_extendedprice")).otherwise(0)).alias("_u")
    )
    k = F.col("photo").cast("long")
    per = per.select(
        "run_key", "photo", F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("run"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"),
        (k % 11 != 0).alias("counted"), (100.0 * F.col("_u") / F.col("capture_pixels")).alias("unknown_pct"), "capture_pixels",
    )
    items = line.groupBy(key.alias("run_key"), food.alias("food")).agg(F.sum(F.floor("l_extendedprice")).alias("pixels")).join(per.select("run_key", "capture_pixels"), "run_key")
    truth = line.filter("l_linestatus = 'O'").select(F.col("l_orderkey").cast("string").alias("photo"), F.concat(F.lit("food"), (F.col("l_partkey") % 10).cast("string")).alias("food")).distinct()
    return per, items, truth


RUN_SQL = """
WITH rn AS (SELECT l_orderkey AS k, l_returnflag AS f, sum(floor(l_extendedprice)) AS cp, sum(CASE WHEN l_linenumber = 7 THEN floor(l_extendedprice) ELSE 0 END) AS u FROM lineitem GROUP BY 1, 2),
it AS (SELECT l_orderkey AS k, l_returnflag AS f, 'food' || CAST(l_partkey % 10 AS VARCHAR) AS food, sum(floor(l_extendedprice)) AS px FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2, 3),
det AS (SELECT k, f, food FROM it JOIN rn USING (k, f) WHERE px >= 0.01 * cp), tr AS (SELECT DISTINCT l_orderkey AS k, 'food' || CAST(l_partkey % 10 AS VARCHAR) AS food FROM lineitem WHERE l_linestatus = 'O'),
d AS (SELECT det.* FROM det WHERE k % 11 <> 0), t AS (SELECT rn.k, rn.f, food FROM rn JOIN tr USING (k) WHERE k % 11 <> 0),
j AS (SELECT coalesce(d.k, t.k) AS k, coalesce(d.f, t.f) AS f, d.food AS a, t.food AS b FROM d FULL JOIN t ON d.k = t.k AND d.f = t.f AND d.food = t.food)
"""


@query("a20_score_detections", RUN_SQL + """
, s AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS correct, count(*) FILTER (a IS NULL) AS missed, count(*) FILTER (b IS NULL) AS wrong FROM j)
SELECT (SELECT count(*) FROM rn WHERE k % 11 <> 0) AS scored, correct, missed, wrong, (SELECT count(*) FROM rn WHERE k % 11 = 0) AS failed, round(correct / (correct + missed), 4) AS recall, round(correct / (correct + wrong), 4) AS precision FROM s""", domain=False)
def a20(t):
    per, items, truth = runs(t)
    return r4(S.score_detections(per, items, truth), "recall", "precision")


@query("a19_experiment_summary", RUN_SQL + """
, sc AS (SELECT 's' || CAST(k % 3 AS VARCHAR) AS source, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS correct, count(*) FILTER (a IS NULL) AS missed, count(*) FILTER (b IS NULL) AS wrong FROM j GROUP BY 1),
b AS (SELECT 's' || CAST(k % 3 AS VARCHAR) AS source, count(*) FILTER (k % 11 = 0) AS failed_runs, count(*) FILTER (k % 11 <> 0) AS scored_runs, avg(CASE WHEN k % 11 <> 0 THEN 100 * u / cp END) AS unk FROM rn GROUP BY 1),
pr AS (SELECT k FROM rn WHERE f IN ('A', 'N') AND k % 11 <> 0 GROUP BY k HAVING count(*) = 2),
df AS (SELECT DISTINCT k FROM (SELECT k, food FROM d WHERE f IN ('A', 'N') GROUP BY k, food HAVING count(*) = 1) WHERE k IN (SELECT k FROM pr)),
p AS (SELECT 's' || CAST(k % 3 AS VARCHAR) AS source, count(*) AS run_pairs, count(*) FILTER (k IN (SELECT k FROM df)) AS run_pairs_different FROM pr GROUP BY 1)
SELECT source, scored_runs, failed_runs, correct, missed, wrong, round(unk, 4) AS avg_unknown_pct, run_pairs, run_pairs_different, round(run_pairs_different / run_pairs, 4) AS run_disagreement_rate FROM b JOIN sc USING (source) JOIN p USING (source)""", domain=False)
def a19(t):
    per, items, truth = runs(t)
    return r4(S.experiment_summary(per, items, truth), "avg_unknown_pct", "run_disagreement_rate")


@query("j18_detections_vs_truth", RUN_SQL + """
, a AS (SELECT DISTINCT k, food FROM it), x AS (SELECT coalesce(a.k, tr.k) AS k, a.food AS a, tr.food AS b FROM a FULL JOIN tr ON a.k = tr.k AND a.food = tr.food)
SELECT CAST(k AS VARCHAR) AS photo, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS correct, count(*) FILTER (a IS NULL) AS missed, count(*) FILTER (b IS NULL) AS wrong FROM x GROUP BY 1""", domain=False)
def j18(t):
    per, items, truth = runs(t)
    d = items.join(per.select("run_key", "photo"), "run_key").select("photo", "food")
    return J.detections_vs_truth(d, truth)
