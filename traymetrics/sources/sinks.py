"""Sinks: waste CSV, upsert log, snapshot replacement, gated appends, marked deletes (SNK-1 to SNK-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.functions.numbers import js_round
from traymetrics.operators.changes import delete_marked, record_analysis, replace_snapshot, upsert

__all__ = ["delete_marked", "export_waste_csv", "record_analysis", "replace_snapshot", "upsert", "waste_rows"]


def waste_rows(summary: DataFrame, items: DataFrame, names: DataFrame, attendance: DataFrame) -> DataFrame:
    """SNK-1 rows: date, meal, item, pixels, share (one decimal), plates, attendance."""
    named = names.groupBy("item_id").agg(F.min("display_name").alias("_n"))
    att = attendance.select("service_id", F.col("count").alias("_a"))
    return (
        items.join(named, "item_id", "left")
        .join(summary.select("service_id", "service_date", "meal_label", "counted_count"), "service_id")
        .join(att, "service_id", "left")
        .select(
            F.col("service_date").alias("date"),
            F.col("meal_label").alias("meal"),
            F.coalesce("_n", "item_id").alias("item"),
            F.col("pixels_wasted").cast("long").alias("pixels_wasted_ai_mask_count"),
            F.format_string("%.1f", js_round(F.coalesce("share_percent", F.lit(0.0)), 1)).alias("share_of_meal_wasted_pixels_percent"),
            F.col("counted_count").alias("plates_scanned"),
            F.col("_a").alias("meal_swipes_simulated"),
        )
    )


def export_waste_csv(rows: DataFrame, path: str) -> None:
    """SNK-1: CSV with a header; cells are quoted only where they need it."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
