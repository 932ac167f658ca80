"""One row per key by a stated order, as aggregates (map-side combine, no per-key sort in one task)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traymetrics.operators.ordering import global_rank


def _pick(df: DataFrame, keys: list[str], order: list[str | Column], latest: bool, where: Column | None = None) -> DataFrame:
    """The first or last row per key: min or max of one struct that starts with the order columns.

    Column types must be orderable (no maps). Ties on the order fall to the remaining columns. An order
    column given by its name travels once.
    """
    rest = [c for c in df.columns if c not in keys and c not in [o for o in order if isinstance(o, str)]]
    src = df if where is None else df.filter(where)
    row = F.struct(*[F.col(o) if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)
    best = (F.max if latest else F.min)(row).alias("_r")
    return src.groupBy(*keys).agg(best).select(*[c if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def latest_by_key(log: DataFrame, pk: list[str], seq: list[str]) -> DataFrame:
    """W-1: latest-wins view of an append log."""
    return _pick(log, pk, seq, latest=True)


def counted_attempts(attempts: DataFrame) -> DataFrame:
    """W-2: the latest succeeded attempt per event."""
    return _pick(attempts, ["event_id"], ["created_at", "attempt_id"], True, F.col("status") == "succeeded")


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """W-2: the latest attempt of any status (ties by id, for a total order)."""
    return _pick(attempts, ["event_id"], ["created_at", "attempt_id"], True)


def latest_baseline(refs: DataFrame) -> DataFrame:
    """W-3: highest baseline version per item."""
    return _pick(refs, ["item_id"], ["baseline_version", "baseline_id"], True)


def next_baseline_version(items: DataFrame, refs: DataFrame) -> DataFrame:
    """W-3: max + 1, or 1 for an item without a baseline."""
    top = refs.groupBy("item_id").agg(F.max("baseline_version").alias("_v"))
    return items.select("item_id").distinct().join(top, "item_id", "left").select(
        "item_id", (F.coalesce(F.col("_v"), F.lit(0)) + 1).cast("long").alias("next_version")
    )


def mode_with_ties(df: DataFrame, by: list[str], value: str, name: str = "mode") -> DataFrame:
    """W-4: most common value, ties by the value ascending."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value))).alias(name))


def top_reason_of(counts: dict[str, Column]) -> Column:
    """W-5 on ready counts: the most common reason, ties by the order given."""
    best = F.greatest(*[c for c in counts.values()]) if len(counts) > 1 else next(iter(counts.values()))
    return F.coalesce(*[F.when((n > 0) & (n == best), F.lit(reason)) for reason, n in counts.items()])


def top_reason(df: DataFrame, by: list[str], reason: str, priority: list[str], name: str = "top_reason") -> DataFrame:
    """W-5: most common listed reason per group; null when none occurs."""
    counts = [F.count_if(F.col(reason) == r).alias(f"_n{i}") for i, r in enumerate(priority)]
    picked = top_reason_of({r: F.col(f"_n{i}") for i, r in enumerate(priority)})
    return df.groupBy(*by).agg(*counts).select(*by, picked.alias(name))


def first_by_priority(df: DataFrame, key: str, prio: Column) -> DataFrame:
    """W-6: keep the row with the lowest priority number per key."""
    return _pick(df, [key], [prio], latest=False)


def first_per_id(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """W-16: the first row of a repeated id, in a stated total order."""
    return _pick(df, [id_col], order, latest=False)


def rank_targets(rows: DataFrame) -> DataFrame:
    """W-7: named foods by pixels per portion, missing rates last, then name and id."""
    named = rows.filter(F.col("item_id").isNotNull())
    return global_rank(named, F.col("pixels_per_portion").desc_nulls_last(), F.col("display_name"), F.col("item_id"), F.col("group_key"))


def rank_most_wasted(rows: DataFrame) -> DataFrame:
    """W-8: every row by pixels, then name and id."""
    return global_rank(rows, F.col("pixels").desc(), F.col("display_name"), F.coalesce("item_id", F.lit("")), F.col("group_key"))


def rank_foods(rows: DataFrame, metric: str, k: int | None = 8) -> DataFrame:
    """W-9: foods by a chosen metric; rows without it follow, in name order; first k shown."""
    order = [F.col(metric).isNull(), F.col(metric).desc_nulls_last(), F.col("display_name"), F.coalesce("item_id", F.lit("")), F.col("group_key")]
    if k is None:
        return global_rank(rows, *order)
    top = rows.orderBy(*order).limit(k)  # numbered over those k rows only
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def newest_page(df: DataFrame, limit: int, ts: str = "captured_at", key: str = "event_id") -> DataFrame:
    """W-11: the newest rows (a distributed top-k) with the full total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    page = df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)
    return page.crossJoin(F.broadcast(total))


def share_of_total(df: DataFrame, by: list[str], value: str, name: str = "share_percent") -> DataFrame:
    """W-12: percent of the group total; null when the total is zero."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_t"))
    return df.join(totals, by).withColumn(name, F.lit(100.0) * F.col(value) / F.nullif(F.col("_t"), F.lit(0))).drop("_t")


def newest_first(df: DataFrame, cols: list[str]) -> DataFrame:
    """W-19."""
    return df.orderBy(*[F.col(c).desc() for c in cols])


def choose_recommendation(saved: DataFrame, fallback: DataFrame) -> DataFrame:
    """W-18: newest saved model text for the same window and version, else the newest saved model
    text marked stale (only when there is data), else the rule text.

    ``fallback`` has one row per (hall_id, window_start, window_end, input_version) with has_data;
    ``saved`` has hall_id, window_start, window_end, input_version, source, text, generated_at.
    """
    model = saved.filter(F.col("source") == "model")
    payload = F.struct("text", "generated_at", "window_start", "window_end")
    newest = F.struct("generated_at", "text")
    exact = model.groupBy("hall_id", "window_start", "window_end", "input_version").agg(F.max_by(payload, newest).alias("_exact"))
    last = model.groupBy("hall_id").agg(F.max_by(payload, newest).alias("_last"))
    df = fallback.join(exact, ["hall_id", "window_start", "window_end", "input_version"], "left").join(last, "hall_id", "left")
    use_exact = F.col("_exact").isNotNull()
    use_last = ~use_exact & F.col("has_data") & F.col("_last").isNotNull()
    return df.select(
        "hall_id",
        "window_start",
        "window_end",
        "input_version",
        F.when(use_exact, F.col("_exact.text")).when(use_last, F.col("_last.text")).otherwise(F.col("text")).alias("text"),
        F.when(use_exact | use_last, F.lit("model")).otherwise(F.lit("fallback")).alias("source"),
        use_last.alias("stale"),
        F.when(use_exact, F.col("_exact.generated_at")).when(use_last, F.col("_last.generated_at")).alias("generated_at"),
    )
