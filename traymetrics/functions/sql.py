"""The shared scalar rules as temporary SQL functions, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from traymetrics.functions.impact import CARBON_WEIGHT, PIXELS_PER_POINT_UNIT, WATER_WEIGHT
from traymetrics.functions.text import ACCENTED, BASE


def register_sql_functions(spark: SparkSession) -> None:
    """js_round (F-9), slug (F-3), fnv1a32 (F-17) and impact_points (F-1)."""
    bodies = [
        "js_round(x DOUBLE, d INT) RETURNS DOUBLE RETURN CAST(floor(x * power(10, d) + 0.5D) AS DOUBLE) / power(10, d)",
        f"slug(s STRING) RETURNS STRING RETURN trim(BOTH '-' FROM regexp_replace(lower(translate(s, '{ACCENTED}', '{BASE}')), '[^a-z0-9]+', '-'))",
        "fnv1a32(s STRING) RETURNS BIGINT RETURN aggregate(filter(split(s, ''), c -> c <> ''), 2166136261L, (h, c) -> ((h ^ ascii(c)) * 16777619L) & 4294967295L)",
        f"impact_points(pixels DOUBLE, weight DOUBLE, c DOUBLE, w DOUBLE) RETURNS DOUBLE RETURN pixels / {PIXELS_PER_POINT_UNIT}D * weight * ({CARBON_WEIGHT}D * c + {WATER_WEIGHT}D * w)",
    ]
    for body in bodies:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
