"""Plate-waste analytics as PySpark DataFrame operators."""
