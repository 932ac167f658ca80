"""Registered queries, grouped by the inventory sections they cover."""

from traymetrics.catalog import check_queries, frame_queries, function_queries, impact_queries, pixel_queries, read_model_queries, service_queries, source_queries  # noqa: F401
from traymetrics.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
