"""Registered queries beside their SQL at sf0.001; TRAYMETRICS_ALL=1 runs every one of them."""

import os

import pytest
from compare import check, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "q01_most_wasted a01_summarize_service a04_pixel_summary a05_portion_benchmark a09_food_rows a12_plate_waste_percent a15_period_cards a22_strict_summary a19_experiment_summary "
    "f03_slug f10_significant f17_fnv1a32 f18_attendance_count f19_demo_random f30_portion_text g01_pixel_totals g02_merge_boxes g04_clip_runs g09_photo_metrics g10_mask_runs "
    "j03_item_names j09_asof_join j14_capture_images j17_overlapping_boxes s01_plan_menu_revision src01_read_menu_csv src06_judge_frames t02_group_dishes t04_session_stream t08_sliding_pixels "
    "v05_check_menu_items v15_check_area_answers v16_box_answer_pieces v17_check_leftover_answers v18_guard_recommendation w05_top_reason w18_choose_recommendation q09_capture_gallery snk03_replace_snapshot"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TRAYMETRICS_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    error, _ = check(con, entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name])
    assert error is None, error


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["src09_keyed_reads"](spark, FOLDER)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(o_orderdate), IsNotNull(o_custkey), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan
