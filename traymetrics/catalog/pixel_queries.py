"""Masks, boxes and images over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from traymetrics.catalog.registry import query, r4
from traymetrics.functions import geometry as G
from traymetrics.operators import images as M
from traymetrics.operators import joins as J
from traymetrics.operators import masks as K
from traymetrics.operators import validation as V


def runs(t, flag=None):
    x0 = F.col("l_quantity").cast("int")
    line = t.read("lineitem") if flag is None else t.read("lineitem").filter(F.col("l_returnflag") == flag)
    n = F.col("l_linenumber")
    return line.select(
        F.col("l_orderkey").alias("event_id"),
        n.alias("region_id"),
        F.when(n != 7, F.concat(F.lit("f"), (n % 4).cast("string"))).alias("item_id"),
        (F.col("l_suppkey") % 8).cast("int").alias("y"),
        x0.alias("x0"),
        (x0 + F.col("l_partkey") % 50 + 1).cast("int").alias("x1"),
    )


RUN_SQL = """
WITH RECURSIVE runs AS (SELECT l_orderkey AS event_id, l_linenumber AS region_id, CASE WHEN l_linenumber <> 7 THEN 'f' || CAST(l_linenumber % 4 AS VARCHAR) END AS item_id, l_suppkey % 8 AS y,
 CAST(l_quantity AS INTEGER) AS x0, CAST(l_quantity AS INTEGER) + l_partkey % 50 + 1 AS x1, l_returnflag AS flag FROM lineitem),
px AS (SELECT DISTINCT event_id, region_id, item_id, y, unnest(range(x0, x1)) AS x FROM runs),
sz AS (SELECT event_id, region_id, any_value(coalesce(item_id, '~')) AS it, count(*) AS n, min((y, x)) AS fp FROM px GROUP BY 1, 2),
win AS (SELECT p.event_id, p.y, p.x, arg_min(it, (n, it = '~', it, fp, p.region_id)) AS it, count(*) AS k FROM px p JOIN sz USING (event_id, region_id) GROUP BY 1, 2, 3),
bucket AS (SELECT event_id, CASE WHEN it <> '~' THEN it END AS item_id, count(*) AS pixels, count(*) FILTER (k > 1) AS ov FROM win GROUP BY 1, 2)
"""


@query("g01_assign_pixels", RUN_SQL + "SELECT event_id, item_id, pixels FROM bucket", domain=False)
def g01(t):
    return K.assign_pixels(runs(t))[0]


@query("g01_pixel_totals", RUN_SQL + "SELECT event_id, CAST(sum(pixels) AS BIGINT) AS union_pixels, CAST(sum(ov) AS BIGINT) AS overlap_pixels, CAST(coalesce(sum(pixels) FILTER (item_id IS NULL), 0) AS BIGINT) AS unclassified_pixels FROM bucket GROUP BY 1", domain=False)
def g01_totals(t):
    return K.assign_pixels(runs(t))[1]


def boxes(t, per_event=16):
    """Boxes on 0-1000 from four embedding components, sixteen to an event."""
    e = lambda i: F.element_at("embedding", i + 1).cast("double")
    ymin, xmin = F.abs(e(0)) * 2000, F.abs(e(1)) * 2000
    return t.read("embeddings").select(
        F.floor(F.col("vec_id") / per_event).alias("event_id"),
        F.col("vec_id").alias("box_id"),
        (F.col("vec_id") % 2 + 1).cast("int").alias("pass"),
        (F.col("vec_id") % per_event).cast("int").alias("idx"),
        F.when(F.col("label") != 0, F.concat(F.lit("f"), F.col("label").cast("string"))).alias("item_id"),
        (F.col("vec_id") % 5 != 0).alias("on_target"),
        F.array(ymin, xmin, ymin + e(2) * 1000 + 200, xmin + e(3) * 1000 + 200).alias("raw_box"),
    )


BOX_SQL = """
WITH RECURSIVE b0 AS (SELECT vec_id // 16 AS event_id, vec_id AS box_id, vec_id % 2 + 1 AS pass, vec_id % 16 AS idx, CASE WHEN label <> 0 THEN 'f' || CAST(label AS VARCHAR) END AS item_id, vec_id % 5 <> 0 AS on_target,
 abs(CAST(embedding[1] AS DOUBLE)) * 2000 AS ymin, abs(CAST(embedding[2] AS DOUBLE)) * 2000 AS xmin, CAST(embedding[3] AS DOUBLE) * 1000 + 200 AS h, CAST(embedding[4] AS DOUBLE) * 1000 + 200 AS w FROM embeddings),
b1 AS (SELECT *, ymin + h AS ymax, xmin + w AS xmax FROM b0),
b2 AS (SELECT *, xmin * 640 / 1000.0::DOUBLE AS x0, ymin * 480 / 1000.0::DOUBLE AS y0, xmax * 640 / 1000.0::DOUBLE AS x1, ymax * 480 / 1000.0::DOUBLE AS y1,
 CASE WHEN least(ymin, xmin, ymax, xmax) < 0 OR greatest(ymin, xmin, ymax, xmax) > 1000 THEN 'box_out_of_range' WHEN NOT (xmax > xmin AND ymax > ymin) THEN 'box_reversed_or_empty'
  WHEN xmax * 640 / 1000.0::DOUBLE - xmin * 640 / 1000.0::DOUBLE < 1 OR ymax * 480 / 1000.0::DOUBLE - ymin * 480 / 1000.0::DOUBLE < 1 THEN 'box_under_one_pixel' END AS reason FROM b1),
ok AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM b2 WHERE reason IS NULL)
"""
IOU = """(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"""


def pixel_boxes(t):
    return boxes(t).withColumn("b", G.box_to_pixels("raw_box", F.lit(640), F.lit(480)))


@query("f23_box_to_pixels", BOX_SQL + """
SELECT box_id, reason, round(CASE WHEN reason IS NULL THEN x0 END, 4) AS x0, round(CASE WHEN reason IS NULL THEN y0 END, 4) AS y0, round(CASE WHEN reason IS NULL THEN x1 END, 4) AS x1, round(CASE WHEN reason IS NULL THEN y1 END, 4) AS y1 FROM b2""", domain=False)
def f23(t):
    return r4(pixel_boxes(t).select("box_id", "b.*"), "x0", "y0", "x1", "y1")


@query("j17_overlapping_boxes", BOX_SQL + f"""
, p AS (SELECT a.event_id, a.box_id AS a_id, b.box_id AS b_id, a.area + b.area AS s, {IOU.format(a='a', b='b')} AS inter FROM ok a JOIN ok b ON a.event_id = b.event_id AND a.box_id < b.box_id)
SELECT event_id, a_id, b_id, round(inter / (s - inter), 4) AS iou FROM p WHERE inter / (s - inter) > 0.3""", domain=False)
def j17(t):
    ok = pixel_boxes(t).filter("b.reason is null").select("event_id", "box_id", "b.x0", "b.y0", "b.x1", "b.y1")
    return r4(J.overlapping_boxes(ok, 0.3), "iou")


@query("f24_box_iou", BOX_SQL + f"""
SELECT a.box_id, round({IOU.format(a='a', b='b')} / (a.area + b.area - {IOU.format(a='a', b='b')}), 4) AS iou FROM ok a JOIN ok b ON b.box_id = a.box_id + 1""", domain=False)
def f24(t):
    ok = pixel_boxes(t).filter("b.reason is null")
    nxt = ok.select((F.col("box_id") - 1).alias("box_id"), F.col("b").alias("n"))
    return r4(ok.join(nxt, "box_id").select("box_id", G.box_iou("b", "n").alias("iou")), "iou")


@query("g02_merge_boxes", BOX_SQL + f"""
, o AS (SELECT event_id, pass, idx, struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, area := area, idx := idx) AS b, row_number() OVER (PARTITION BY event_id ORDER BY area, x0, y0, x1, y1, item_id IS NULL, coalesce(item_id, ''), pass, idx) AS i FROM ok),
rec(event_id, i, kept) AS (SELECT DISTINCT event_id, 0::BIGINT, [] :: STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, area DOUBLE, idx BIGINT)[] FROM o
 UNION ALL SELECT r.event_id, r.i + 1, CASE WHEN len(list_filter(r.kept, lambda k: {IOU.format(a='k', b='o.b')} > 0.5 * (k.area + o.b.area - {IOU.format(a='k', b='o.b')}))) > 0 THEN r.kept ELSE list_append(r.kept, o.b) END FROM rec r JOIN o ON o.event_id = r.event_id AND o.i = r.i + 1)
SELECT event_id, unnest(kept).idx AS idx FROM (SELECT event_id, arg_max(kept, i) AS kept FROM rec GROUP BY event_id)""", domain=False)
def g02(t):
    ok = pixel_boxes(t).filter("b.reason is null").select("event_id", "pass", "idx", "item_id", F.struct("b.x0", "b.y0", "b.x1", "b.y1").alias("box"))
    return K.merge_boxes(ok).select("event_id", F.col("idx").cast("long").alias("idx"))


@query("g03_split_target", BOX_SQL + """
, s AS (SELECT event_id, min(pass) = max(pass) AS single FROM b2 GROUP BY 1)
SELECT event_id, count(*) FILTER (on_target AND (reason IS NULL OR single)) AS counted_boxes, count(*) FILTER (NOT on_target AND reason IS NULL) AS excluded_boxes, bool_or(NOT on_target AND reason IS NULL) AS neighbor_food_excluded FROM b2 JOIN s USING (event_id) GROUP BY 1""", domain=False)
def g03(t):
    return K.split_target(pixel_boxes(t).withColumn("box_ok", F.col("b.reason").isNull()))[2]


REGION_SQL = """
, reg AS (SELECT o_orderkey AS event_id, unnest(range(0, 8)) AS y, 10 + o_custkey % 20 AS r0, 60 + o_custkey % 20 AS r1 FROM orders WHERE o_orderstatus <> 'P')
"""


def regions(t):
    c = F.col("o_custkey")
    return t.read("orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("event_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), (10 + c % 20).cast("int").alias("x0"), (60 + c % 20).cast("int").alias("x1")
    )


@query("g04_clip_runs", RUN_SQL + REGION_SQL + """
SELECT p.event_id, p.region_id, count(*) FILTER (r.y IS NOT NULL) AS kept_pixels, count(*) FILTER (r.y IS NULL) AS removed_pixels FROM px p LEFT JOIN reg r ON r.event_id = p.event_id AND r.y = p.y AND p.x >= r0 AND p.x < r1 GROUP BY 1, 2""", domain=False)
def g04(t):
    return K.clip_runs(runs(t), regions(t))[1]


@query("g07_count_status", """
WITH n AS (SELECT l_orderkey AS event_id, count(*) FILTER (l_linenumber < 3) AS counted, count(*) FILTER (l_linenumber IN (3, 4)) AS failed, count(*) FILTER (l_linenumber = 5) AS outside, bool_or(l_tax = 0.08) AS ambiguous FROM lineitem GROUP BY 1)
SELECT event_id, CASE WHEN counted = 0 AND failed = 0 THEN 'empty' WHEN counted = 0 THEN 'unavailable' WHEN failed > 0 THEN 'partial' ELSE 'complete' END AS count_status,
 CASE WHEN counted = 0 AND failed = 0 AND outside > 0 THEN 'needs_review' WHEN counted = 0 AND failed = 0 THEN 'succeeded' WHEN counted = 0 THEN 'failed' WHEN failed > 0 OR ambiguous THEN 'needs_review' ELSE 'succeeded' END AS status FROM n""", domain=False)
def g07(t):
    n = F.col("l_linenumber")
    outcome = F.when(n < 3, "counted").when(n < 5, "failed").when(n == 5, "outside").otherwise("other_dish")
    df = t.read("lineitem").select(F.col("l_orderkey").alias("event_id"), outcome.alias("outcome"), (F.col("l_tax") == 0.08).alias("ambiguous"))
    return K.count_status(df).select("event_id", "count_status", "status")


@query("g08_build_measurements", RUN_SQL + """
, base AS (SELECT 'f' || CAST(r_regionkey * 2 AS VARCHAR) AS item_id, 20.0::DOUBLE + r_regionkey * 10 AS area FROM region)
SELECT event_id, b.item_id, pixels, round(pixels / area, 4) AS raw_waste_fraction, round(100 * least(pixels / area, 1), 4) AS display_waste_percent,
 CASE WHEN area IS NOT NULL THEN NULL WHEN b.item_id IS NULL THEN 'unclassified_food' ELSE 'no_baseline_auxiliary_only' END AS unavailable_reason, coalesce(pixels / area > 1, FALSE) AS above, floor(pixels * 0.0123::DOUBLE * 10000 + 0.5) / 10000 AS area_cm2
FROM bucket b LEFT JOIN base USING (item_id)""", domain=False)
def g08(t):
    buckets, totals = K.assign_pixels(runs(t))
    r = F.col("r_regionkey")
    base = t.read("region").select(F.concat(F.lit("f"), (r * 2).cast("string")).alias("item_id"), F.lit("b").alias("baseline_id"), (F.lit(20.0) + r * 10).alias("expected_area_px"))
    cals = t.read("orders").select(F.col("o_orderkey").alias("event_id"), F.lit("cal").alias("calibration_id"), F.lit(0.0123).alias("cm2_per_px"))
    df = K.build_measurements(buckets, base, cals).withColumn("above", F.array_contains("quality_flags", "above_baseline"))
    return r4(df.select("event_id", "item_id", "pixels", "raw_waste_fraction", "display_waste_percent", "unavailable_reason", "above", "area_cm2"), "raw_waste_fraction", "display_waste_percent")


@query("g11_localization_stats", BOX_SQL + f"""
, an AS (SELECT box_id // 2 AS event_id, pass, box_id // 2 % 5 + pass AS n FROM b2),
d AS (SELECT box_id // 2 AS event_id, pass, least(greatest(xmin, 0), 1000) * 0.64::DOUBLE AS x0, least(greatest(ymin, 0), 1000) * 0.48::DOUBLE AS y0, least(greatest(xmax, 0), 1000) * 0.64::DOUBLE AS x1, least(greatest(ymax, 0), 1000) * 0.48::DOUBLE AS y1 FROM b2),
dd AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM d WHERE x1 - x0 >= 1 AND y1 - y0 >= 1)
SELECT event_id, max(CASE WHEN pass = 1 AND n % 3 <> 1 THEN n END) AS pass1_boxes, max(CASE WHEN pass = 2 AND n % 3 <> 1 THEN n END) AS pass2_boxes, count(*) FILTER (n % 3 = 1) AS failed_passes,
 event_id IN (SELECT event_id FROM dd) AS dish_found,
 (SELECT round(floor({IOU.format(a='a', b='b')} / (a.area + b.area - {IOU.format(a='a', b='b')}) * 1000 + 0.5) / 1000, 4) FROM dd a JOIN dd b ON a.event_id = b.event_id AND a.pass = 1 AND b.pass = 2 WHERE a.event_id = an.event_id) AS pass_agreement_iou FROM an GROUP BY event_id""", domain=False)
def g11(t):
    b = boxes(t).withColumn("event_id", F.floor(F.col("box_id") / 2))  # a photo's two passes, one dish each
    n = F.col("event_id") % 5 + F.col("pass")
    answers = b.select("event_id", "pass", F.when(n % 3 != 1, n).alias("boxes"))
    dishes = b.select("event_id", "pass", F.col("raw_box").alias("box"), F.lit(640).alias("width_px"), F.lit(480).alias("height_px"))
    return K.localization_stats(answers, dishes).withColumn("dish_found", F.coalesce("dish_found", F.lit(False)))


@query("a21_mask_agreement", RUN_SQL + """
, a AS (SELECT DISTINCT event_id, y, unnest(range(x0, x1)) AS x FROM runs WHERE flag IN ('A', 'R')), n AS (SELECT DISTINCT event_id, y, unnest(range(x0, x1)) AS x FROM runs WHERE flag = 'N'),
j AS (SELECT coalesce(a.event_id, n.event_id) AS event_id, a.event_id IS NOT NULL AS p, n.event_id IS NOT NULL AS q FROM a FULL JOIN n ON a.event_id = n.event_id AND a.y = n.y AND a.x = n.x)
SELECT event_id, count(*) FILTER (p AND q) AS tp, count(*) FILTER (p AND NOT q) AS fp, count(*) FILTER (q AND NOT p) AS fn, round(count(*) FILTER (p AND q) / count(*), 4) AS iou,
 round(2 * count(*) FILTER (p AND q) / (count(*) FILTER (p) + count(*) FILTER (q)), 4) AS dice, round(abs(count(*) FILTER (p) - count(*) FILTER (q)) / nullif(count(*) FILTER (q), 0), 4) AS relative_error FROM j GROUP BY 1""", domain=False)
def a21(t):
    return r4(K.mask_agreement(runs(t, "A").unionByName(runs(t, "R")), runs(t, "N")).drop("absolute_error"), "iou", "dice", "relative_error")


@query("a21_agreement_means", RUN_SQL + """
, a AS (SELECT DISTINCT event_id, y, unnest(range(x0, x1)) AS x FROM runs WHERE flag IN ('A', 'R')), n AS (SELECT DISTINCT event_id, y, unnest(range(x0, x1)) AS x FROM runs WHERE flag = 'N'),
j AS (SELECT coalesce(a.event_id, n.event_id) AS event_id, a.event_id IS NOT NULL AS p, n.event_id IS NOT NULL AS q FROM a FULL JOIN n ON a.event_id = n.event_id AND a.y = n.y AND a.x = n.x),
m AS (SELECT count(*) FILTER (p AND q) / count(*) AS iou, abs(count(*) FILTER (p) - count(*) FILTER (q)) AS err FROM j GROUP BY event_id)
SELECT count(*) AS images, round(avg(iou), 4) AS mean_iou, round(avg(err), 4) AS mean_absolute_error FROM m""", domain=False)
def a21_means(t):
    df = K.agreement_means(K.mask_agreement(runs(t, "A").unionByName(runs(t, "R")), runs(t, "N")))
    return r4(df.select("images", "mean_iou", "mean_absolute_error"), "mean_iou", "mean_absolute_error")


@query("a28_label_mask_eval", RUN_SQL + """
, r AS (SELECT DISTINCT event_id, coalesce(item_id, '-') AS label, y, unnest(range(x0, x1)) AS x FROM runs), q AS (SELECT DISTINCT event_id, coalesce(item_id, '-') AS label, y, unnest(range(x0, x1)) AS x FROM runs WHERE flag = 'N'),
pc AS (SELECT event_id, coalesce(item_id, '-') AS label, count(DISTINCT region_id) AS pieces FROM runs GROUP BY 1, 2),
s AS (SELECT event_id, label, count(*) AS pixels FROM r GROUP BY 1, 2), z AS (SELECT event_id, label, count(*) AS ref FROM q GROUP BY 1, 2)
SELECT event_id, label, pieces, pixels, round(100 * pixels / 1024.0::DOUBLE, 4) AS frame_percent, round(CASE WHEN ref IS NOT NULL THEN 1 END, 4) AS recall, round(ref / pixels, 4) AS iou FROM s JOIN pc USING (event_id, label) LEFT JOIN z USING (event_id, label)""", domain=False)
def a28(t):
    label = F.coalesce("item_id", F.lit("-")).alias("label")
    r = runs(t).select("event_id", "region_id", label, "y", "x0", "x1")
    q = runs(t, "N").select("event_id", label, "y", "x0", "x1")
    return r4(K.label_mask_eval(r, q, F.lit(1024.0)), "frame_percent", "recall", "iou")


def images(t, binary):
    """8 x 8 grey images from the 64 embedding components."""
    v = F.transform("embedding", lambda x: F.when(x > 0, 255).otherwise(0)) if binary else F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 500 % 256).cast("int"))
    data = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return t.read("embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"), "embedding")


@query("g09_photo_metrics", """
WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 500 % 256) AS v FROM embeddings, range(64) r(i)),
l AS (SELECT c.vec_id, w.v + e.v + n.v + s.v - 4 * c.v AS lap FROM p c JOIN p w ON w.vec_id = c.vec_id AND w.y = c.y AND w.x = c.x - 1 JOIN p e ON e.vec_id = c.vec_id AND e.y = c.y AND e.x = c.x + 1
 JOIN p n ON n.vec_id = c.vec_id AND n.y = c.y - 1 AND n.x = c.x JOIN p s ON s.vec_id = c.vec_id AND s.y = c.y + 1 AND s.x = c.x)
SELECT vec_id AS id, round((SELECT avg(v) FROM p WHERE p.vec_id = l.vec_id), 4) AS brightness, round(avg(lap * lap) - avg(lap) * avg(lap), 4) AS sharpness FROM l GROUP BY vec_id""", domain=False)
def g09(t):
    return r4(M.photo_metrics(images(t, False)).select("id", "brightness", "sharpness"), "brightness", "sharpness")


@query("v24_photo_quality_verdict", """
WITH p AS (SELECT vec_id, avg(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 500 % 256)) AS b FROM embeddings, range(64) r(i) GROUP BY 1)
SELECT vec_id AS id, concat_ws(',', CASE WHEN vec_id % 7 = 0 THEN 'not_jpeg' END, CASE WHEN vec_id % 9 = 0 THEN 'wrong_size' END, CASE WHEN b < 50 THEN 'too_dark' END) AS problems FROM p""", domain=False)
def v24(t):
    m = M.photo_metrics(images(t, False)).withColumn("format", F.when(F.col("id") % 7 == 0, "png").otherwise("jpeg")).withColumn(
        "width_px", F.when(F.col("id") % 9 == 0, 9).otherwise(F.col("width_px"))
    )
    return V.photo_quality_verdict(m, 8, 8, min_brightness=50.0, min_sharpness=0.0).select("id", F.array_join("problems", ",").alias("problems"))


MASK_SQL = """
WITH p AS (SELECT vec_id AS id, i // 8 AS y, i % 8 AS x, embedding[i + 1] > 0 AS v FROM embeddings, range(64) r(i)), n AS (SELECT id, count(*) FILTER (v) AS n FROM p GROUP BY 1),
good AS (SELECT id FROM n WHERE id % 11 <> 0 AND id % 13 <> 0)
"""


def masks(t):
    on = F.size(F.filter("embedding", lambda x: x > 0))
    df = images(t, True).withColumn("want_width", F.when(F.col("id") % 11 == 0, 9).otherwise(8)).withColumn("want_height", F.lit(8))
    return M.mask_runs(df.withColumn("declared_pixels", on + F.when(F.col("id") % 13 == 0, 1).otherwise(0)))


@query("g10_mask_runs", MASK_SQL + """
, g AS (SELECT id, y, x, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS k FROM p WHERE v AND id IN (SELECT id FROM good))
SELECT id, y, min(x) AS x0, max(x) + 1 AS x1 FROM g GROUP BY id, y, k""", domain=False)
def g10(t):
    return masks(t)[0]


@query("g10_mask_rejects", MASK_SQL + "SELECT id, CASE WHEN id % 11 = 0 THEN 'mask_dimension_mismatch' ELSE 'mask_count_mismatch' END AS reason FROM n WHERE id NOT IN (SELECT id FROM good)", domain=False)
def g10b(t):
    return masks(t)[1]


@query("f26_mean_abs_diff", """
WITH d AS (SELECT a.vec_id, i, abs(CAST(a.embedding[i + 1] AS DOUBLE) - CAST(b.embedding[i + 1] AS DOUBLE)) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1, range(64) r(i))
SELECT vec_id, round(avg(v), 4) AS mad FROM d GROUP BY vec_id""", domain=False)
def f26(t):
    e = t.read("embeddings")
    prev = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    return r4(e.join(prev, "vec_id").select("vec_id", G.mean_abs_diff("embedding", "before").alias("mad")), "mad")


@query("f22_waste_parts", """
SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_percent, count(*) FILTER (b > 0 AND p / nullif(b, 0) > 1) AS above, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (b = 0) AS invalid, round(sum(CASE WHEN b > 0 THEN 100 * least(p / nullif(b, 0), 1) END), 4) AS pct
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 10 = 1 THEN 0.0::DOUBLE ELSE 40000.0::DOUBLE END AS b FROM lineitem) GROUP BY 1, 2""", domain=False)
def f22(t):
    s = F.col("l_suppkey") % 10
    df = t.read("lineitem").withColumn("b", F.when(s == 0, F.lit(None).cast("double")).when(s == 1, F.lit(0.0)).otherwise(F.lit(40000.0)))
    df = df.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in G.waste_parts("l_extendedprice", "b").items()])
    has = lambda f: F.count_if(F.array_contains("quality_flags", f))
    out = df.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("raw_waste_fraction").alias("with_percent"), has("above_baseline").alias("above"),
        F.count_if(F.col("unavailable_reason") == "missing_baseline").alias("missing"), F.count_if(F.col("unavailable_reason") == "invalid_baseline").alias("invalid"),
        F.sum("display_waste_percent").alias("pct"),
    )
    return r4(out, "pct")


@query("f25_camera_math", """
, f AS (SELECT *, floor(sqrt(1920.0::DOUBLE * 1920 + 1080.0::DOUBLE * 1080) / 2 / tan(radians(39)) * greatest(side / 1920.0::DOUBLE, side / 1080.0::DOUBLE) * 1000 + 0.5) / 1000 AS fx FROM cal)
SELECT calibration_id, round(known_area_cm2 / reference_pixels * 1000, 4) AS k1000, round(fx, 4) AS fx, round(fx * sqrt(known_area_cm2 / reference_pixels), 4) AS height_cm,
 concat_ws(',', CASE WHEN reference_pixels % 2 = 0 THEN 'reference_touches_edge' END, CASE WHEN reference_pixels / 60000.0::DOUBLE < 0.35 OR reference_pixels > 0.6 * side * side THEN 'reference_low_confidence' END) AS flags FROM f""")
def f25(t):
    n = F.col("reference_pixels")
    c = t.calibrations().withColumn("k", G.calibration_k("known_area_cm2", "reference_pixels")).withColumn("fx", G.focal_px("width_px", "height_px"))
    flags = G.calibration_flags("reference_pixels", F.lit(60000.0), n % 2 == 0, F.lit(True), F.lit(False), F.lit(0.9), F.col("width_px") * F.col("height_px"))
    df = c.select("calibration_id", (F.col("k") * 1000).alias("k1000"), "fx", G.camera_height("k", "fx", "fx").alias("height_cm"), F.array_join(flags, ",").alias("flags"))
    return r4(df, "k1000", "fx", "height_cm")


@query("f27_plausible_area", """
SELECT p_partkey, round(least(1024.0::DOUBLE * 768, coalesce(pi() * (d / 2) * (d / 2), 1e18)), 4) AS area FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size * 25.0::DOUBLE END AS d FROM part)""", domain=False)
def f27(t):
    g = F.struct(F.lit(1024).alias("width_px"), F.lit(768).alias("height_px"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 25.0).alias("plate_diameter_px"))
    return r4(t.read("part").select("p_partkey", G.max_plausible_area(g).alias("area")), "area")
