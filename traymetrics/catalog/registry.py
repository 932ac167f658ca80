"""Named queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traymetrics.catalog.bindings import DOMAIN_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def even_rounding(sql: str) -> str:
    """Spell ``round(x, 4)`` as the floor form of ``r4``, so both engines treat halves alike."""
    out, i = "", 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            return out + sql[i:]
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6 : k - 1]
        if inner.rstrip().endswith(", 4"):
            body = even_rounding(inner.rstrip()[:-3])
            out += sql[i:j] + f"floor(CAST({body} AS DOUBLE) * 10000 + 0.500001) / 10000"
        else:
            out += sql[i:j] + "round(" + even_rounding(inner) + ")"
        i = k


def visible_views() -> str:
    """The shared views with hidden and cleared captures taken out of ``cap`` (not out of menus)."""
    sql = DOMAIN_SQL.replace("cap AS (", "cap0 AS (", 1).replace("FROM cap),\natt AS", "FROM cap0),\n" + VISIBLE_CAP + ",\natt AS", 1)
    return sql.replace("JOIN cap c ON l.l_orderkey", "JOIN cap0 c ON l.l_orderkey", 1)


VISIBLE_CAP = "cap AS (SELECT * FROM cap0 WHERE event_id % 38 <> 0 AND NOT (hall_id = 'hall-4' AND captured_at < TIMESTAMP '1996-01-01'))"


def query(name: str, sql: str | None = None, domain: bool = True, visible: bool = False):
    """Register ``fn(tables)``; ``sql`` follows the shared views unless ``domain`` is off."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            text = even_rounding(sql.strip())
            if domain:
                text = (visible_views() if visible else DOMAIN_SQL) + (text if text.startswith(",") else "\n" + text)
            ORACLE[name] = text
        return fn

    return register


def r4(df: DataFrame, *cols: str) -> DataFrame:
    """Four digits, half up with a little slack (summation order differs between engines)."""
    return df.withColumns({c: F.floor(F.col(c) * 10000.0 + 0.500001).cast("double") / 10000.0 for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})
