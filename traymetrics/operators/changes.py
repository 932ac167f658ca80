"""Change detection, set differences and idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traymetrics.session import materialize

# fixed values: factor rows the second restaurant table repeats under other names are passed by the caller


def _fingerprint():
    return F.to_json(F.struct("item_id", "display_name", "category", "description"), {"ignoreNullFields": "false"})


def plan_menu_revision(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """S-1: per service: create, unchanged, revise (version + 1) or mismatch.

    Both sides have one row per menu item with service_id, menu_id, hall_id, service_date,
    meal_label, hall_timezone, item_id, display_name, category, description; ``stored`` also has
    menu_version. Item lists are compared as sets of fingerprints by an anti-style full join with
    counts, so no menu is collected.
    """
    key = ["menu_id", "hall_id", "service_date", "meal_label", "hall_timezone"]
    head = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    s = stored.withColumn("_fp", _fingerprint()).groupBy("service_id", "_fp").agg(F.count(F.lit(1)).alias("_sn"), F.max(head).alias("_sh"), F.max("menu_version").alias("_v"))
    i = incoming.withColumn("_fp", _fingerprint()).groupBy("service_id", "_fp").agg(F.count(F.lit(1)).alias("_in"), F.max(head).alias("_ih"))
    both = s.join(i, ["service_id", "_fp"], "full")
    per = both.groupBy("service_id").agg(
        F.sum("_sn").alias("_sn"),
        F.sum("_in").alias("_in"),
        F.count_if(F.col("_in").isNotNull() & F.col("_sn").isNull()).alias("_new"),
        F.max("_sh").alias("_sh"),
        F.max("_ih").alias("_ih"),
        F.max("_v").alias("_v"),
    )
    action = (
        F.when(F.col("_in").isNull(), F.lit("absent"))
        .when(F.col("_sn").isNull(), F.lit("create"))
        .when(F.col("_sh") != F.col("_ih"), F.lit("mismatch"))
        .when((F.col("_sn") == F.col("_in")) & (F.col("_new") == 0), F.lit("unchanged"))
        .otherwise(F.lit("revise"))
    )
    return per.withColumn("action", action).select(
        "service_id",
        "action",
        F.when(action == "create", F.lit(1)).when(action == "revise", F.col("_v") + 1).when(action == "unchanged", F.col("_v")).cast("long").alias("menu_version"),
    )


def archive_items(items: DataFrame, revisions: DataFrame, plan: DataFrame) -> DataFrame:
    """S-2: revision rows to append for menus that move to a newer version.

    ``plan`` has menu_id, stored_version, new_version; ids already archived are skipped, and a plan
    that would move backwards is rejected (see ``rejected_versions``).
    """
    moving = plan.filter(F.col("new_version") > F.col("stored_version")).select("menu_id", "stored_version")
    out = items.join(moving, "menu_id").select(
        F.concat("item_id", F.lit("@v"), F.col("stored_version").cast("string")).alias("revision_item_id"),
        "item_id",
        "menu_id",
        F.col("stored_version").alias("menu_version"),
        "display_name",
        "category",
    )
    return out.join(revisions.select("revision_item_id"), "revision_item_id", "left_anti")


def rejected_versions(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("new_version") < F.col("stored_version"))


def set_scores(detected: str, truth: str) -> dict:
    """S-3: correct, missed and wrong counts of two distinct-name arrays."""
    d, t = F.array_distinct(detected), F.array_distinct(truth)
    return {
        "correct": F.size(F.array_intersect(d, t)),
        "missed": F.size(F.array_except(t, d)),
        "wrong": F.size(F.array_except(d, t)),
    }


def union_factors(restaurant: DataFrame, common: DataFrame) -> DataFrame:
    """S-4: restaurant rows plus common rows whose key is not there yet."""
    return restaurant.unionByName(common.join(restaurant.select("factor_key").distinct(), "factor_key", "left_anti").select(*restaurant.columns))


def missing_insights(current: DataFrame, stored: DataFrame) -> DataFrame:
    """S-6: current facts (hall_id, data_version) with no stored model text of the same version."""
    return current.join(stored.filter(F.col("source") == "gemini").select("hall_id", "data_version").distinct(), ["hall_id", "data_version"], "left_anti")


def unclaimed(frames: DataFrame, claims: DataFrame) -> DataFrame:
    """S-7: frames no earlier run has ingested."""
    return frames.join(claims.select("capture_id"), "capture_id", "left_anti")


def food_database(dinner: DataFrame, nutrition: DataFrame, halal: DataFrame, drop_keys: list[str] | None = None) -> DataFrame:
    """S-8: dinner rows with their nutrition, plus the second restaurant's rows minus named duplicates."""
    n = nutrition.select("factor_key", "nutrient_days_per_kg", "kcal_per_kg")
    extra = halal if not drop_keys else halal.filter(~F.col("factor_key").isin(drop_keys))
    return dinner.join(n, "factor_key", "left").unionByName(extra, allowMissingColumns=True)


# sinks


def upsert(path: str, rows: DataFrame, seq: str = "seq") -> None:
    """SNK-2: append to the log; readers take the latest row per key (W-1)."""
    if seq not in rows.columns:
        raise ValueError(f"rows need a {seq} column")
    rows.write.mode("append").parquet(path)


def replace_snapshot(path: str, rows: DataFrame, partitions: list[str]) -> None:
    """SNK-3: replace only the partitions present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def record_analysis(attempts: DataFrame, measurements: DataFrame, stored_attempts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK-4 gate: (attempts to append, their measurements, rejects with a reason).

    An attempt is appended with all of its measurements or not at all; rows carry ``reason`` from
    the checks V-8 to V-10, and an attempt id that is already stored is rejected.
    """
    known = stored_attempts.select("attempt_id").distinct().withColumn("_known", F.lit(True))
    bad_rows = measurements.filter(F.col("reason").isNotNull()).groupBy("attempt_id").agg(F.min("reason").alias("_row_reason"))
    judged = attempts.join(known, "attempt_id", "left").join(bad_rows, "attempt_id", "left").withColumn(
        "_why", F.coalesce(F.when(F.col("_known"), F.lit("already_recorded")), F.col("reason"), F.col("_row_reason"))
    )
    ok = judged.filter(F.col("_why").isNull()).select(*attempts.columns)
    rows = measurements.join(ok.select("attempt_id"), "attempt_id", "left_semi")
    return ok, rows, judged.filter(F.col("_why").isNotNull()).select("attempt_id", F.col("_why").alias("reason"))


ANALYSIS_TABLES = ("food_measurement", "segmentation_region", "capture_count", "analysis_attempt")


COMMITS, APPEND = "_commits", "_append"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed_appends(spark: SparkSession, root: str) -> DataFrame:
    """The ids of the appends that were finished."""
    if not _exists(spark, f"{root}/{COMMITS}"):
        return spark.createDataFrame([], f"{APPEND} string")
    return spark.read.schema(f"at timestamp, {APPEND} string").parquet(f"{root}/{COMMITS}").select(APPEND)


def read_analysis(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SNK-4: the tables under ``root`` that hold something, without the rows of appends that broke off."""
    commits, out = committed_appends(spark, root), {}
    for name in ANALYSIS_TABLES:
        if _exists(spark, f"{root}/{name}"):
            rows = spark.read.parquet(f"{root}/{name}")
            out[name] = rows.withColumn(APPEND, F.col(APPEND).cast("string")).join(commits, APPEND, "left_semi").drop(APPEND)
    return out


def append_name(attempts: DataFrame) -> str:
    """A name that a set of attempts always gets, in whatever order or files it comes."""
    ids = attempts.select("attempt_id").distinct().select(F.xxhash64("attempt_id").cast("decimal(38,0)").alias("h"), F.xxhash64("attempt_id", F.lit(1)).alias("g"))
    n, total, mixed = ids.agg(F.count(F.lit(1)), F.sum("h"), F.bit_xor("g")).first()
    return f"a{n}-{total or 0}-{mixed or 0}"


def append_analysis(root: str, attempts: DataFrame, measurements: DataFrame, regions: DataFrame, counts: DataFrame, name: str | None = None) -> DataFrame:
    """SNK-4: append what the gate lets through to the tables under ``root``; returns the rejects.

    ``attempts`` and ``measurements`` carry ``reason`` (null when fine); regions and counts belong to
    attempts. Every table gets a folder of the append's ``name`` (that of its attempts, if none is
    given), and a commit record is written when all are there. ``read_analysis`` reads appends with a
    record only, so one that breaks off leaves nothing to be seen; repeated, it overwrites its folders.
    An append whose record exists changes nothing. One writer at a time.
    """
    spark = attempts.sparkSession
    name = name or append_name(attempts)
    stored = read_analysis(spark, root).get("analysis_attempt", attempts.select("attempt_id").limit(0))
    ok, rows, rejects = record_analysis(attempts, measurements, stored.select("attempt_id"))
    ok, rejects = materialize(ok), materialize(rejects)
    if not committed_appends(spark, root).filter(F.col(APPEND) == name).isEmpty():
        return rejects
    visible = ok.select("attempt_id")
    children = (rows.drop("reason"), regions.join(visible, "attempt_id", "left_semi"), counts.join(visible, "attempt_id", "left_semi"))
    for table, df in zip(ANALYSIS_TABLES, (*children, ok.drop("reason"))):
        df.write.mode("overwrite").parquet(f"{root}/{table}/{APPEND}={name}")
    spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMMITS}/{APPEND}={name}")
    return rejects


def delete_marked(tables: dict[str, DataFrame], keys: dict[str, str], markers: DataFrame, dependents: dict[str, tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """SNK-5: drop only rows listed in the markers (table_name, row_key), and rows that depend on them.

    ``dependents`` maps a table to (parent table, foreign key column).
    """
    out = {}
    for name, df in tables.items():
        gone = markers.filter(F.col("table_name") == name).select(F.col("row_key").alias("_k"))
        out[name] = df.join(gone, F.col(keys[name]).cast("string") == F.col("_k"), "left_anti")
    for name, (parent, column) in (dependents or {}).items():
        gone = markers.filter(F.col("table_name") == parent).select(F.col("row_key").alias("_k"))
        out[name] = out[name].join(gone, F.col(column).cast("string") == F.col("_k"), "left_anti")
    return out
