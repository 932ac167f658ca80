"""F-29: the portion role of a food and the demo range of portions per role."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traymetrics.functions.numbers import as_col

# fixed values
PIZZA_KEYS = ["cheese-pizza", "pepperoni-pizza", "chicken-broccoli-alfredo-pizza"]
ENTREE_KEYS = ["baked-boneless-ham", "ancho-flank-steak", "vegetable-cannelloni", "michigan-farmers-4-bean-stew"]
PORTION_RANGES = {"pizza": (200, 400), "entree": (80, 200), "side": (60, 150), "soup": (60, 150), "dessert": (50, 150)}


def portion_role(factor_key, station) -> Column:
    k, s = as_col(factor_key), as_col(station)
    return (
        F.when(s == "MBakery", F.lit("dessert"))
        .when(s == "Soup", F.lit("soup"))
        .when(k.isin(PIZZA_KEYS), F.lit("pizza"))
        .when(k.isin(ENTREE_KEYS), F.lit("entree"))
        .otherwise(F.lit("side"))
    )


def portion_range(role) -> tuple[Column, Column]:
    r = as_col(role)
    low = F.coalesce(*[F.when(r == name, F.lit(lo)) for name, (lo, _) in PORTION_RANGES.items()])
    high = F.coalesce(*[F.when(r == name, F.lit(hi)) for name, (_, hi) in PORTION_RANGES.items()])
    return low, high
