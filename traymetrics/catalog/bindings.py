"""Views that read the driver's tables as plate-waste tables (see SURVEY 7.3).

Every view covers its whole source table. Ids stay numeric where the source key is numeric, so a
join on ``event_id`` keeps the partitioning of the join below it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traymetrics.functions.text import menu_id, service_id, slug


def view(fn):
    """Build a view once per ``Tables``."""

    @functools.wraps(fn)
    def cached(self):
        if fn.__name__ not in self._views:
            self._views[fn.__name__] = fn(self)
        return self._views[fn.__name__]

    return cached


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # captures and services come from orders

    @view
    def _orders(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        day = F.to_date("o_orderdate")
        df = self.read("orders").select(
            k.alias("event_id"),
            self._hall(c % 5).alias("hall_id"),
            self._meal(k % 3).alias("meal_label"),
            F.date_sub(day, (F.dayofmonth(day) - 1) % 10).alias("service_date"),
            (F.col("o_orderdate") + F.make_dt_interval(secs=k % 86400)).alias("captured_at"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 512).otherwise(1024).cast("long").alias("side"),
            F.when(k % 17 == 0, "raw-camera-v1").otherwise("topdown-normalized-v1").alias("space"),
            F.when(c % 3 == 0, "demo").otherwise("camera").alias("source"),
            F.when(c % 11 == 0, F.array(F.lit("blurred"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
            F.when(F.col("o_orderstatus") != "P", "succeeded")
            .when(F.col("o_orderpriority") == "1-URGENT", "pending")
            .when(F.col("o_orderpriority") == "2-HIGH", "processing")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "failed")
            .otherwise("needs_review")
            .alias("state"),
        )
        return df.withColumn("service_id", service_id("hall_id", "service_date", "meal_label"))

    @staticmethod
    def _hall(number: Column) -> Column:
        return F.concat(F.lit("hall-"), number.cast("string"))

    @staticmethod
    def _meal(number: Column) -> Column:
        return F.when(number == 0, "breakfast").when(number == 1, "lunch").otherwise("dinner")

    @staticmethod
    def _geometry(side: Column, space: Column) -> Column:
        return F.struct(
            side.alias("width_px"),
            side.alias("height_px"),
            space.alias("coordinate_space"),
            F.lit(None).cast("string").alias("plate_shape"),
            F.lit(None).cast("double").alias("plate_diameter_px"),
        )

    @view
    def captures(self) -> DataFrame:
        return self._orders().select(
            "event_id",
            "hall_id",
            "service_id",
            "captured_at",
            F.concat(F.lit("img-"), F.col("event_id").cast("string")).alias("image_object_id"),
            self._geometry(F.col("side"), F.col("space")).alias("geometry"),
            "source",
            "quality_flags",
            "state",
        )

    @view
    def services(self) -> DataFrame:
        df = self._orders().select("service_id", "hall_id", "service_date", "meal_label").distinct()
        return df.select(
            "service_id",
            "hall_id",
            F.lit("America/Detroit").alias("hall_timezone"),
            "service_date",
            "meal_label",
            menu_id("hall_id", "service_date", "meal_label").alias("menu_id"),
            (F.dayofmonth("service_date") % 2 + 1).cast("long").alias("menu_version"),
        )

    # attempts, measurements, menus and portions come from line items

    @view
    def attempts(self) -> DataFrame:
        k, flag = F.col("event_id"), F.col("flag")
        per = self.read("lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("flag")).agg(
            F.max("l_shipdate").alias("created_at"), F.sum(F.floor("l_extendedprice")).alias("_px")
        ).repartition("event_id")  # attempts are picked and joined by event; the texts below are made where they lie
        good = flag != "A"
        status = F.when(good, "succeeded").when(k % 2 == 0, "failed").otherwise("needs_review")
        count = (
            F.when(~good, F.when(k % 4 == 1, "partial"))
            .when(k % 10 == 0, "empty")
            .when(k % 10 == 1, "partial")
            .when(k % 10 == 2, "unavailable")
            .when(k % 10 == 3, F.lit(None).cast("string"))
            .otherwise("complete")
        )
        return per.select(
            F.concat(k.cast("string"), F.lit("-"), flag).alias("attempt_id"),
            "event_id",
            "created_at",
            status.alias("status"),
            (k % 2 + 1).cast("long").alias("menu_version"),
            count.alias("count_status"),
            F.when(count.isin("complete", "partial"), F.col("_px")).when(count == "empty", F.lit(0)).cast("long").alias("capture_pixels_wasted"),
            F.when(k % 13 == 0, F.array(F.lit("neighbor_food_excluded"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
            F.when(k % 3 != 0, F.concat(F.lit("cal-"), (k % 97).cast("string"))).alias("calibration_id"),
            F.when(k % 3 == 1, F.lit("area-calibrated-v1")).alias("physical_method"),
            F.when(k % 4 != 0, F.concat(F.lit("ovl-"), k.cast("string"), F.lit("-"), flag)).alias("overlay_object_id"),
        )

    @view
    def lines(self) -> DataFrame:
        """Line items with the service of their order."""
        o = self._orders().select("event_id", "service_id", "hall_id", "service_date", "meal_label")
        line = self.read("lineitem").withColumnRenamed("l_orderkey", "event_id")
        return line.join(o, "event_id")

    @view
    def _served(self) -> DataFrame:
        """Line items with the service of their order as numbers of its hall and meal, which are shorter to shuffle than its id."""
        k = F.col("event_id")
        day = F.to_date("o_orderdate")
        o = self.read("orders").select(
            F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 5).cast("tinyint").alias("hall"), F.date_sub(day, (F.dayofmonth(day) - 1) % 10).alias("service_date")
        )
        line = self.read("lineitem").select(F.col("l_orderkey").alias("event_id"), "l_partkey", "l_quantity", "l_linestatus")
        # only breakfast and lunch are told apart by the number; every other remainder is dinner
        return line.join(o, "event_id").withColumn("meal", F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(2).cast("tinyint"))

    @view
    def measurements(self) -> DataFrame:
        k, ln, sup = F.col("event_id"), F.col("l_linenumber"), F.col("l_suppkey")
        px = F.floor("l_extendedprice").cast("long")
        base = F.when(sup % 10 == 0, F.lit(None).cast("double")).when(sup % 23 == 1, F.lit(0.0)).otherwise(F.lit(60000.0))
        ratio = F.try_divide(px, base)
        frac = F.when(sup % 7 != 0, ratio)
        flags = F.array_compact(
            F.array(
                F.when((ratio > 1) & (ln % 2 == 0), F.lit("above_baseline")),
                F.when(F.col("l_quantity") == 13, F.lit("ambiguous_items")),
            )
        )
        key, number = k.cast("string"), ln.cast("string")
        mask = F.struct(
            px.alias("pixels_wasted"),
            F.concat(F.lit("mask-"), key, F.lit("-"), number).alias("mask_object_id"),
            self._geometry(F.lit(1024).cast("long"), F.lit("topdown-normalized-v1")).alias("geometry"),
            menu_id("hall_id", "service_date", "meal_label").alias("menu_id"),
            (k % 2 + 1).cast("long").alias("menu_version"),
            F.when(F.col("l_quantity") == 7, F.lit(" ")).otherwise(F.lit("cls-1")).alias("classification_version"),
            F.lit("seg-1").alias("segmentation_version"),
            F.lit("smallest-first-v1").alias("processing_version"),
            F.lit("exclusive").alias("assignment"),
            (ln != 6).alias("validated"),
        )
        physical = F.when(
            k % 3 == 1,
            F.struct(
                F.concat(F.lit("cal-"), (k % 97).cast("string")).alias("calibration_id"),
                F.lit("area-calibrated-v1").alias("method"),
                (px * 0.0025).alias("area_cm2"),
            ),
        )
        return self.lines().select(
            F.concat(key, F.lit("-"), number).alias("measurement_id"),
            "event_id",
            F.concat(key, F.lit("-"), F.col("l_returnflag")).alias("attempt_id"),
            F.when(ln != 7, F.concat(F.lit("item_"), F.col("l_partkey").cast("string"))).alias("item_id"),
            px.cast("double").alias("remaining_area_px"),
            base.alias("baseline_area_px"),
            frac.alias("raw_waste_fraction"),
            F.when(ln == 5, F.lit("area_estimate")).otherwise(F.lit("mask_pixel_count")).alias("method"),
            flags.alias("quality_flags"),
            mask.alias("mask_count"),
            physical.alias("physical"),
        )

    @view
    def menu_items(self) -> DataFrame:
        """Foods of each service's menu: the parts of its orders, but for every 13th part."""
        served = self._served().filter(F.col("l_partkey") % 13 != 0).select("hall", "service_date", "meal", F.col("l_partkey").alias("p_partkey")).distinct()
        part = self.read("part").select("p_partkey", "p_name", "p_type")
        return served.join(part, "p_partkey").select(
            menu_id(self._hall(F.col("hall")), "service_date", self._meal(F.col("meal"))).alias("menu_id"),
            F.concat(F.lit("item_"), F.col("p_partkey").cast("string")).alias("item_id"),
            F.col("p_name").alias("display_name"),
            F.lower("p_type").alias("category"),
        )

    @view
    def portions(self) -> DataFrame:
        p = F.col("l_partkey")
        split = F.when(p % 29 == 0, F.col("l_linestatus")).otherwise(F.lit("-"))
        per = (
            self._served()
            .filter(p % 7 != 0)
            .groupBy("hall", "service_date", "meal", (F.col("event_id") % 2 + 1).cast("tinyint").alias("menu_version"), "l_partkey", split.alias("_s"))
            .agg(F.floor(F.sum("l_quantity")).cast("long").alias("_q"))
            .withColumns({"hall_id": self._hall(F.col("hall")), "meal_label": self._meal(F.col("meal")), "menu_version": F.col("menu_version").cast("long")})
        )
        return per.select(
            service_id("hall_id", "service_date", "meal_label").alias("service_id"),
            "hall_id",
            "service_date",
            "menu_version",
            F.concat(F.lit("item_"), p.cast("string")).alias("item_id"),
            F.when(p % 11 == 0, F.lit(0)).otherwise(F.col("_q")).cast("long").alias("count"),
            F.when(p % 3 == 0, "demo").when(p % 3 == 1, "csv").otherwise("manual").alias("source"),
        )

    @view
    def attendance(self) -> DataFrame:
        d = F.dayofmonth("service_date")
        return self.services().filter(d.isin(1, 21)).select(
            "service_id", "hall_id", "service_date", F.when(d == 21, 0).otherwise(100 + F.year("service_date") % 50).cast("long").alias("count")
        )

    # factors come from parts, calibrations from suppliers, halls from regions

    @view
    def waste_factors(self) -> DataFrame:
        table = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "east-quad").when(F.col("p_type") == "LARGE", "halal-bros").otherwise("common-500")
        per = (
            self.read("part")
            .filter(~F.col("p_name").startswith("old") & (F.col("p_size") % 4 == 0))
            .groupBy(slug("p_name").alias("factor_key"), F.col("p_name").alias("food"), table.alias("table"))
            .agg((F.max("p_size") / 25.0).alias("weight_g_per_cm2"), (F.min("p_retailprice") / 100.0).alias("kg_co2e_per_kg"), (F.max("p_retailprice") / 1000.0).alias("water_m3_per_kg"))
        )
        usd = F.lit(0.19) * F.col("kg_co2e_per_kg") + F.lit(1.5) * F.col("water_m3_per_kg")
        return per.withColumn("impact_usd_per_kg", F.floor(usd * 100 + 0.5) / 100.0).withColumn(
            "largest_factor", F.when(F.lit(0.19) * F.col("kg_co2e_per_kg") >= F.lit(1.5) * F.col("water_m3_per_kg"), "carbon").otherwise("water")
        )

    @view
    def nutrition_factors(self) -> DataFrame:
        return (
            self.read("part")
            .filter(F.col("p_name").startswith("s") | F.col("p_name").startswith("r"))
            .groupBy(slug("p_name").alias("factor_key"))
            .agg((F.max("p_size") / 40.0).alias("nutrient_days_per_kg"), F.min("p_retailprice").alias("kcal_per_kg"))
        )

    @view
    def calibrations(self) -> DataFrame:
        s = F.col("s_suppkey")
        area, px = (50 + s % 40).cast("double"), (20000 + s * 13 % 7919).cast("long")
        side = F.when(s % 5 == 0, 512).otherwise(1024).cast("long")
        return self.read("supplier").select(
            F.concat(F.lit("cal-"), s.cast("string")).alias("calibration_id"),
            F.concat(F.lit("hall-"), (s % 5).cast("string")).alias("hall_id"),
            side.alias("width_px"),
            side.alias("height_px"),
            area.alias("known_area_cm2"),
            px.alias("reference_pixels"),
            (area / px).alias("cm2_per_px"),
            F.when(s % 6 == 0, "failed").otherwise("succeeded").alias("status"),
            F.col("s_acctbal").alias("score"),
        )

    @view
    def visibility(self) -> DataFrame:
        return self._orders().filter(F.col("event_id") % 19 == 0).select("event_id", (F.col("event_id") % 38 == 0).alias("hidden"))

    @view
    def views(self) -> DataFrame:
        r = F.col("r_regionkey")
        return self.read("region").select(
            F.concat(F.lit("hall-"), r.cast("string")).alias("hall_id"),
            F.when(r == 4, F.lit("1996-01-01 00:00:00").cast("timestamp")).alias("cleared_at"),
        )


# The same views for the SQL oracle.
DOMAIN_SQL = """
WITH ord AS (
 SELECT o_orderkey AS event_id, 'hall-' || CAST(o_custkey % 5 AS VARCHAR) AS hall_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' ELSE 'dinner' END AS meal_label,
  CAST(o_orderdate AS DATE) - CAST((day(o_orderdate) - 1) % 10 AS INTEGER) AS service_date,
  o_orderdate + to_seconds(o_orderkey % 86400) AS captured_at,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 512 ELSE 1024 END AS side,
  CASE WHEN o_orderkey % 17 = 0 THEN 'raw-camera-v1' ELSE 'topdown-normalized-v1' END AS space,
  CASE WHEN o_custkey % 3 = 0 THEN 'demo' ELSE 'camera' END AS source,
  o_custkey % 11 = 0 AS blurred,
  CASE WHEN o_orderstatus <> 'P' THEN 'succeeded' WHEN o_orderpriority = '1-URGENT' THEN 'pending'
   WHEN o_orderpriority = '2-HIGH' THEN 'processing' WHEN o_orderpriority = '3-MEDIUM' THEN 'failed' ELSE 'needs_review' END AS state
 FROM orders),
cap AS (
 SELECT *, 'svc_' || hall_id || '_' || strftime(service_date, '%Y-%m-%d') || '_' || meal_label AS service_id,
  'menu_' || hall_id || '_' || strftime(service_date, '%Y-%m-%d') || '_' || meal_label AS menu_id FROM ord),
svc AS (
 SELECT DISTINCT service_id, hall_id, service_date, meal_label, menu_id,
  day(service_date) % 2 + 1 AS menu_version FROM cap),
att AS (
 SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_returnflag AS attempt_id, l_orderkey AS event_id, max(l_shipdate) AS created_at,
  CASE WHEN l_returnflag <> 'A' THEN 'succeeded' WHEN l_orderkey % 2 = 0 THEN 'failed' ELSE 'needs_review' END AS status,
  l_orderkey % 2 + 1 AS menu_version,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_orderkey % 4 = 1 THEN 'partial' END
   WHEN l_orderkey % 10 = 0 THEN 'empty' WHEN l_orderkey % 10 = 1 THEN 'partial' WHEN l_orderkey % 10 = 2 THEN 'unavailable'
   WHEN l_orderkey % 10 = 3 THEN NULL ELSE 'complete' END AS count_status,
  sum(floor(l_extendedprice)) AS raw_px,
  l_orderkey % 13 = 0 AS neighbor,
  CASE WHEN l_orderkey % 3 <> 0 THEN 'cal-' || CAST(l_orderkey % 97 AS VARCHAR) END AS calibration_id,
  CASE WHEN l_orderkey % 3 = 1 THEN 'area-calibrated-v1' END AS physical_method,
  CASE WHEN l_orderkey % 4 <> 0 THEN 'ovl-' || CAST(l_orderkey AS VARCHAR) || '-' || l_returnflag END AS overlay_object_id
 FROM lineitem GROUP BY l_orderkey, l_returnflag),
attempt AS (
 SELECT *, CASE WHEN count_status IN ('complete', 'partial') THEN raw_px WHEN count_status = 'empty' THEN 0 END AS capture_pixels_wasted FROM att),
counted AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, attempt_id DESC) AS rn FROM attempt WHERE status = 'succeeded') WHERE rn = 1),
latest AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, attempt_id DESC) AS rn FROM attempt) WHERE rn = 1),
line AS (
 SELECT l.*, c.event_id, c.service_id, c.hall_id, c.service_date, c.meal_label, c.menu_id FROM lineitem l JOIN cap c ON l.l_orderkey = c.event_id),
meas0 AS (
 SELECT CAST(event_id AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS measurement_id, event_id,
  CAST(event_id AS VARCHAR) || '-' || l_returnflag AS attempt_id,
  CASE WHEN l_linenumber <> 7 THEN 'item_' || CAST(l_partkey AS VARCHAR) END AS item_id,
  floor(l_extendedprice) AS remaining_area_px,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 23 = 1 THEN 0.0::DOUBLE ELSE 60000.0::DOUBLE END AS baseline_area_px,
  CASE WHEN l_linenumber = 5 THEN 'area_estimate' ELSE 'mask_pixel_count' END AS method,
  l_suppkey % 7 <> 0 AS has_fraction, l_linenumber % 2 = 0 AS even_line, l_quantity = 13 AS ambiguous,
  l_quantity = 7 AS blank_version, l_linenumber <> 6 AS validated, menu_id AS mask_menu_id, event_id % 2 + 1 AS mask_menu_version,
  CASE WHEN event_id % 3 = 1 THEN 'cal-' || CAST(event_id % 97 AS VARCHAR) END AS phys_cal,
  CASE WHEN event_id % 3 = 1 THEN floor(l_extendedprice) * 0.0025::DOUBLE END AS area_cm2
 FROM line),
meas AS (
 SELECT *, CASE WHEN baseline_area_px > 0 AND has_fraction THEN remaining_area_px / baseline_area_px END AS raw_waste_fraction,
  coalesce(baseline_area_px > 0 AND remaining_area_px / nullif(baseline_area_px, 0) > 1 AND even_line, FALSE) AS flag_above FROM meas0),
menu AS (
 SELECT DISTINCT l.menu_id, 'item_' || CAST(p_partkey AS VARCHAR) AS item_id, p_name AS display_name, lower(p_type) AS category
 FROM line l JOIN part ON l.l_partkey = p_partkey WHERE l_partkey % 13 <> 0),
portion AS (
 SELECT service_id, hall_id, service_date, event_id % 2 + 1 AS menu_version, 'item_' || CAST(l_partkey AS VARCHAR) AS item_id,
  CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE CAST(floor(sum(l_quantity)) AS BIGINT) END AS count,
  CASE l_partkey % 3 WHEN 0 THEN 'demo' WHEN 1 THEN 'csv' ELSE 'manual' END AS source
 FROM line WHERE l_partkey % 7 <> 0
 GROUP BY service_id, hall_id, service_date, event_id % 2 + 1, l_partkey, CASE WHEN l_partkey % 29 = 0 THEN l_linestatus ELSE '-' END),
portion1 AS (
 SELECT service_id, menu_version, item_id, CASE WHEN count(*) = 1 THEN max(count) END AS portions_served,
  CASE WHEN count(*) = 1 THEN max(source) END AS portions_source FROM portion GROUP BY ALL),
attendance AS (
 SELECT service_id, hall_id, service_date, CASE WHEN day(service_date) = 21 THEN 0 ELSE 100 + year(service_date) % 50 END AS count
 FROM svc WHERE day(service_date) IN (1, 21)),
wf0 AS (
 SELECT replace(lower(p_name), ' ', '-') AS factor_key, p_name AS food,
  CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'east-quad' WHEN p_type = 'LARGE' THEN 'halal-bros' ELSE 'common-500' END AS tbl,
  max(p_size) / 25.0::DOUBLE AS weight_g_per_cm2, min(p_retailprice) / 100.0::DOUBLE AS kg_co2e_per_kg, max(p_retailprice) / 1000.0::DOUBLE AS water_m3_per_kg
 FROM part WHERE p_name NOT LIKE 'old%' AND p_size % 4 = 0 GROUP BY ALL),
wf AS (
 SELECT *, floor((0.19::DOUBLE * kg_co2e_per_kg + 1.5::DOUBLE * water_m3_per_kg) * 100 + 0.5) / 100 AS impact_usd_per_kg,
  CASE WHEN 0.19::DOUBLE * kg_co2e_per_kg >= 1.5::DOUBLE * water_m3_per_kg THEN 'carbon' ELSE 'water' END AS largest_factor FROM wf0),
factor AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY factor_key ORDER BY CASE tbl WHEN 'east-quad' THEN 0 WHEN 'halal-bros' THEN 1 ELSE 2 END) AS rn FROM wf) WHERE rn = 1),
nutri AS (
 SELECT replace(lower(p_name), ' ', '-') AS factor_key, max(p_size) / 40.0::DOUBLE AS nutrient_days_per_kg, min(p_retailprice) AS kcal_per_kg
 FROM part WHERE p_name LIKE 's%' OR p_name LIKE 'r%' GROUP BY ALL),
cal AS (
 SELECT 'cal-' || CAST(s_suppkey AS VARCHAR) AS calibration_id, 'hall-' || CAST(s_suppkey % 5 AS VARCHAR) AS hall_id,
  CASE WHEN s_suppkey % 5 = 0 THEN 512 ELSE 1024 END AS side, CAST(50 + s_suppkey % 40 AS DOUBLE) AS known_area_cm2,
  20000 + s_suppkey * 13 % 7919 AS reference_pixels, (50 + s_suppkey % 40) / CAST(20000 + s_suppkey * 13 % 7919 AS DOUBLE) AS cm2_per_px,
  CASE WHEN s_suppkey % 6 = 0 THEN 'failed' ELSE 'succeeded' END AS status, s_acctbal AS score FROM supplier),
visibility AS (SELECT event_id, event_id % 38 = 0 AS hidden FROM cap WHERE event_id % 19 = 0),
hallview AS (
 SELECT 'hall-' || CAST(r_regionkey AS VARCHAR) AS hall_id, CASE WHEN r_regionkey = 4 THEN TIMESTAMP '1996-01-01' END AS cleared_at FROM region),
measd AS (
 SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY measurement_id ORDER BY attempt_id, item_id NULLS FIRST, remaining_area_px, baseline_area_px NULLS FIRST, raw_waste_fraction NULLS FIRST) AS rn
  FROM meas m WHERE attempt_id IN (SELECT attempt_id FROM counted)) WHERE rn = 1),
capv AS (
 SELECT c.*, s.menu_version AS cur_version, coalesce(k.menu_version, s.menu_version) AS menu_version, k.attempt_id AS counted_id, k.physical_method, k.calibration_id,
  CASE WHEN k.physical_method IS NOT NULL THEN NULL WHEN cal.side <> c.side THEN 'incompatible_geometry' ELSE 'no_calibration' END AS ctx_reason
 FROM cap c JOIN svc s USING (service_id) LEFT JOIN counted k ON k.event_id = c.event_id LEFT JOIN cal ON cal.calibration_id = k.calibration_id),
rowv AS (
 SELECT c.event_id, c.state, c.side, m.measurement_id, m.attempt_id, m.item_id, n.display_name, m.remaining_area_px AS px, m.area_cm2,
  coalesce(m.method = 'mask_pixel_count' AND m.validated AND m.remaining_area_px <= c.side * c.side AND c.space = 'topdown-normalized-v1' AND c.side = 1024
   AND m.mask_menu_id = c.menu_id AND m.mask_menu_version = c.menu_version AND NOT m.blank_version AND NOT c.blurred AND NOT m.ambiguous, FALSE)
   AND (m.item_id IS NULL OR n.display_name IS NOT NULL) AS valid
 FROM capv c JOIN measd m ON m.event_id = c.event_id LEFT JOIN menu n ON n.menu_id = m.mask_menu_id AND n.item_id = m.item_id WHERE c.state = 'succeeded'),
status AS (
 SELECT c.*, coalesce(r.n, 0) AS n_rows, coalesce(r.nv, 0) AS n_valid,
  c.state = 'succeeded' AND coalesce(r.na, 1) <= 1 AND coalesce(r.total, 0) <= c.side * c.side AND NOT (coalesce(r.n, 0) > 0 AND coalesce(r.nv, 0) = 0) AS analyzed,
  c.counted_id IS NOT NULL AND c.physical_method IS NULL AS uncal, coalesce(r.any_phys, FALSE) AS any_phys
 FROM capv c LEFT JOIN (SELECT event_id, count(*) AS n, count(*) FILTER (valid) AS nv, count(DISTINCT attempt_id) AS na, sum(px) FILTER (valid) AS total,
  bool_or(valid AND area_cm2 IS NOT NULL) AS any_phys FROM rowv GROUP BY event_id) r USING (event_id)),
caps AS (
 SELECT *, analyzed AND NOT uncal AND (physical_method IS NOT NULL OR any_phys) AS calibrated, source = 'demo' AS sample,
  CASE WHEN analyzed THEN n_rows - n_valid ELSE n_rows END AS excluded_rows FROM status),
sel AS (
 SELECT c.event_id, c.hall_id, c.service_id, c.service_date, c.meal_label, c.captured_at, c.menu_version, r.measurement_id, r.item_id,
  CASE WHEN r.item_id IS NULL THEN 'Food not on the menu' ELSE r.display_name END AS display_name, r.px AS pixels,
  CASE WHEN NOT c.uncal THEN r.area_cm2 END AS area_cm2, CASE WHEN c.uncal THEN c.ctx_reason END AS capture_reason
 FROM rowv r JOIN caps c USING (event_id) WHERE r.valid AND c.analyzed),
scored AS (
 SELECT s.*, f.factor_key, f.tbl AS factor_table, (pixels / 1000.0::DOUBLE * weight_g_per_cm2) * kg_co2e_per_kg AS co2_points,
  (pixels / 1000.0::DOUBLE * weight_g_per_cm2) * water_m3_per_kg AS water_points,
  0.19::DOUBLE * ((pixels / 1000.0::DOUBLE * weight_g_per_cm2) * kg_co2e_per_kg) + 1.5::DOUBLE * ((pixels / 1000.0::DOUBLE * weight_g_per_cm2) * water_m3_per_kg) AS impact_points,
  (pixels / 1000.0::DOUBLE * weight_g_per_cm2) * nutrient_days_per_kg AS nutrition_points,
  CASE WHEN s.item_id IS NULL THEN 'unknown_item' WHEN f.factor_key IS NULL THEN 'no_factor' END AS unavailable_reason,
  area_cm2 * weight_g_per_cm2 AS grams, area_cm2 * weight_g_per_cm2 / 1000.0::DOUBLE * kg_co2e_per_kg AS kg_co2e, area_cm2 * weight_g_per_cm2 * water_m3_per_kg AS water_litres,
  CASE WHEN s.item_id IS NULL THEN 'unknown_item' WHEN area_cm2 IS NULL THEN coalesce(capture_reason, 'no_calibration') WHEN f.factor_key IS NULL THEN 'no_factor' END AS physical_reason
 FROM sel s LEFT JOIN factor f ON s.item_id IS NOT NULL AND f.factor_key = replace(lower(s.display_name), ' ', '-')
 LEFT JOIN nutri n ON s.item_id IS NOT NULL AND n.factor_key = f.factor_key)
"""
