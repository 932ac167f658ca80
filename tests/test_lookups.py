"""Lookup joins with hot keys against plain left joins."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from traymetrics.catalog.bindings import Tables
from traymetrics.operators import joins, lookups, picking


def rows_of(df):
    return Counter(map(tuple, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def no_small_side(spark):
    """Neither side is small enough for the optimizer to broadcast it by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def facts(spark):
    """A third of the rows is pizza, a third has no name, the rest is spread over 500 dishes."""
    dish = F.when(F.col("id") % 3 == 0, "pizza").when(F.col("id") % 3 == 1, F.concat(F.lit("dish "), (F.col("id") % 500).cast("string")))
    return spark.range(0, 9000, 1, 8).select(F.col("id").alias("n"), (F.col("id") % 2).alias("menu"), dish.alias("item"))


def lookup(spark):
    names = spark.range(400).select(F.concat(F.lit("dish "), F.col("id").cast("string")).alias("item"), F.col("id").alias("value"))
    return names.union(spark.createDataFrame([("pizza", -1), (None, -2), ("unused", -3)], "item string, value long"))


@pytest.mark.parametrize("limit", [1000, 402, 0])
def test_lookup_join_is_a_left_join(spark, no_small_side, limit):
    df, side = facts(spark), lookup(spark)
    out = lookups.lookup_join(df, side, ["item"], lookup_rows=limit, heavy_parts=50)
    assert out.columns == ["item", "n", "menu", "value"]
    assert rows_of(out) == rows_of(df.join(side, ["item"], "left"))
    both = side.withColumn("menu", F.lit(0).cast("long"))
    got = lookups.lookup_join(df, both, ["menu", "item"], lookup_rows=limit, heavy_parts=5)
    assert rows_of(got) == rows_of(df.join(both, ["menu", "item"], "left"))


@pytest.mark.parametrize("rows, names", [(0, 5), (5, 0), (0, 0)])
def test_lookup_join_of_empty_tables(spark, rows, names):
    df, side = facts(spark).limit(rows), lookup(spark).limit(names)
    assert rows_of(lookups.lookup_join(df, side, ["item"], lookup_rows=-1)) == rows_of(df.join(side, ["item"], "left"))


def test_a_hot_dish_is_not_one_task(spark, no_small_side):
    df, side = facts(spark), lookup(spark)
    most = lambda out: out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most(df.join(side, ["item"], "left")) >= 3000
    assert most(lookups.lookup_join(df, side, ["item"], lookup_rows=0)) < 2000
    assert most(lookups.lookup_join(df, side, ["item"])) < 2000


def test_names_and_factors_with_a_large_lookup(spark, monkeypatch):
    ids = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "b"), ("x", "a"), ("x", "old-item"), (None, "a"), ("m", None), ("m", "my-new_item")], "menu_id string, item_id string")
    items = spark.createDataFrame([("m", "a", "Apple"), ("k", "a", "Any apple"), ("m", "b", "Beet")], "menu_id string, item_id string, display_name string")
    old = spark.createDataFrame([("old-item", "Older", 1), ("old-item", "Old", 2)], "item_id string, display_name string, menu_version int")
    waste = spark.createDataFrame([("apple", "common-500", 1.0), ("apple", "east-quad", 2.0), ("beet", "common-500", 3.0)], "factor_key string, table string, weight_g_per_cm2 double").selectExpr("*", "1D AS kg_co2e_per_kg", "2D AS water_m3_per_kg", "3D AS impact_usd_per_kg")
    nutrition = spark.createDataFrame([("apple", 0.5)], "factor_key string, nutrient_days_per_kg double")

    def both():
        named = joins.resolve_item_names(ids, items, old)
        return named, joins.join_factors(named, waste, nutrition)

    small = [(df.columns, rows_of(df)) for df in both()]
    monkeypatch.setattr(lookups.lookup_join, "__defaults__", (0, 3))
    assert [(df.columns, rows_of(df)) for df in both()] == small
    names = {(r["menu_id"], r["item_id"]): r["display_name"] for r in both()[0].collect()}
    assert names["m", "a"] == "Apple" and names[None, "a"] == names["x", "a"] == "Any apple" and names["x", "old-item"] == "Old"
    apple = both()[1].filter("display_name = 'Apple'").first()
    assert (apple["factor_key"], apple["factor_table"], apple["weight_g_per_cm2"], apple["nutrient_days_per_kg"]) == ("apple", "east-quad", 2.0, 0.5)
    assert both()[1].filter("display_name = 'Old'").first()["factor_key"] is None


def dealt_by(df):
    """The columns that the plan's shuffles deal rows by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]


def test_counted_measurements_stay_by_event(spark, no_small_side):
    """Rows that lie by event are not dealt again by attempt; other attempts, other events and null ids are left out."""
    rows = [("m1", 1, "1-R"), ("m2", 1, "1-A"), ("m2", 1, "1-R"), ("m3", 2, "2-N"), ("m4", 3, "3-N"), ("m5", None, None), ("m6", 2, None)]
    measurements = spark.createDataFrame(rows, "measurement_id string, event_id long, attempt_id string")
    counted = spark.createDataFrame([("1-R", 1), ("2-N", 2), (None, None)], "attempt_id string, event_id long")
    out = joins.counted_measurements(measurements.repartition("event_id"), counted)
    assert out.columns == measurements.columns
    assert rows_of(out) == rows_of(measurements.join(counted.select("attempt_id"), "attempt_id", "left_semi").select(measurements.columns))
    assert set(dealt_by(out)) == {"event_id"}


def test_attempts_lie_by_event(spark, no_small_side):
    """Picks of an event's attempts need no shuffle of their own."""
    attempts = Tables(spark, "/root/testdata/sf0.001").attempts()
    assert dealt_by(picking.counted_attempts(attempts)) == dealt_by(attempts)


@pytest.mark.parametrize("rows, hint", [(3, True), (2, False)])
def test_small_is_counted(spark, no_small_side, rows, hint):
    side = spark.createDataFrame([("pizza", 1), ("dish 1", 2), (None, 3)], "item string, value long")
    plan = facts(spark).join(lookups.small(side, rows), ["item"])._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == hint


def test_geometry_pairs_are_dealt_over_tasks(spark):
    """Pairs of a common item are made by many tasks, each pair once, with every code that a pair can have."""
    g = "struct<width_px: long, height_px: long, coordinate_space: string, plate_shape: string, plate_diameter_px: double>"
    top, raw = "topdown-normalized-v1", "raw-camera-v1"
    same = (1024, 1024, top, "round", 500.0)
    odd = (0, 512, raw, "tray", None)
    obs = [(k, "hot", same if k % 2 else odd) for k in range(300)] + [(None, "hot", None), (300, "rare", same), (301, None, same), (302, "none", same)]
    refs = [("hot", f"b{k}", (1024, 1024, top, None if k % 3 else "round", 500.0 + 20 * k)) for k in range(20)] + [("hot", "b-odd", odd), ("rare", "b20", same), (None, "b21", same), ("rare", None, None)]
    obs, refs = spark.createDataFrame(obs, f"event_id long, item_id string, geometry {g}"), spark.createDataFrame(refs, f"item_id string, baseline_id string, geometry {g}")
    out = joins.geometry_compatibility(obs, refs, pairs=100)
    assert out.columns == ["item_id", "event_id", "geometry", "baseline_id", "reasons", "compatible"]
    assert out.rdd.getNumPartitions() >= 60
    assert max(out.groupBy(F.spark_partition_id()).count().collect(), key=lambda r: r["count"])["count"] < 1500  # of 6,323
    got = {(r.event_id, r.baseline_id): (r.reasons, r.compatible) for r in out.collect()}
    assert out.count() == len(got) == 301 * 21 + 2
    assert got[1, "b0"] == ([], True) and got[1, "b1"] == ([], True) and got[1, "b2"] == (["different_diameter"], False)
    assert got[0, "b0"] == (["observation_dimensions", "observation_space", "different_space", "different_size", "different_shape"], False)
    assert got[0, "b-odd"] == (["observation_dimensions", "reference_dimensions", "observation_space"], False)
    assert got[300, "b20"] == ([], True) and got[300, None][0] == ["reference_dimensions", "different_space", "different_size"]


def test_references_of_one_geometry_are_compared_once(spark):
    """An observation meets a list of ids, not each reference; ids that are null or come twice and lists cut short give the same pairs."""
    g = "struct<width_px: long, height_px: long, coordinate_space: string, plate_shape: string, plate_diameter_px: double>"
    top = "topdown-normalized-v1"
    obs = [(k, "hot", (1024, 1024, top, "round", 500.0 + k % 2)) for k in range(30)] + [(1, "hot", (1024, 1024, top, "round", 501.0)), (90, None, None), (91, "hot", None)]
    refs = [("hot", f"b{k}", (1024, 1024, top, "tray" if k % 2 else "round", 500.0)) for k in range(40)] + [("hot", "b0", (1024, 1024, top, "round", 500.0)), ("hot", None, (1024, 1024, top, "round", 500.0)), ("hot", "none", None)]
    obs, refs = spark.createDataFrame(obs, f"event_id long, item_id string, geometry {g}"), spark.createDataFrame(refs, f"item_id string, baseline_id string, geometry {g}")
    out = joins.geometry_compatibility(obs, refs, form=lambda codes: F.array_join(codes, ","))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")  # pairs are the ids of a list that was met
    pairs = lambda df: sorted(((r.event_id, r.baseline_id, r.reasons, r.compatible) for r in df.collect()), key=str)
    got = pairs(out)
    assert len(got) == 32 * 43 and got.count((1, "b0", "", True)) == 4 and got.count((2, None, "", True)) == 1 and got.count((3, "b1", "different_shape", False)) == 1
    assert (91, "b0", "observation_dimensions,observation_space,different_space,different_size", False) in got
    assert (0, "none", "reference_dimensions,different_space,different_size", False) in got
    assert pairs(joins.geometry_compatibility(obs, refs, pairs=50, list_rows=3, form=lambda codes: F.array_join(codes, ","))) == got
