"""Detection scores of analysis runs against labelled photos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SHARE = 0.01  # fixed value: foods below this share of the plate's pixels are ignored


def detected_foods(items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Distinct named foods of each counted run with at least the minimal share of its pixels.

    ``items`` has run_key, capture_pixels, food (null when unknown), pixels.
    """
    keep = F.col("food").isNotNull() & (F.col("capture_pixels") > 0) & (F.col("pixels") >= min_share * F.col("capture_pixels"))
    return items.filter(keep).select("run_key", "food").distinct()


def score_runs(
    runs: DataFrame,
    items: DataFrame,
    truth: DataFrame,
    any_of: Sequence[str] = (),
    family: Sequence[str] = (),
    not_scored: Sequence[str] = (),
    no_wrong: Sequence[str] = (),
) -> DataFrame:
    """Per counted and scored run: correct, missed, wrong.

    ``runs`` has run_key, photo, counted; ``truth`` has photo, food. For photos in ``any_of`` any food
    of the family is one correct answer; photos in ``no_wrong`` never count wrong foods; those in
    ``not_scored`` are left out.
    """
    scored = runs.filter(F.col("counted") & ~F.col("photo").isin(list(not_scored))).select("run_key", "photo")
    d = detected_foods(items).join(scored, "run_key").withColumn("_d", F.lit(1))
    t = scored.join(truth.select("photo", "food").distinct(), "photo").withColumn("_t", F.lit(1))
    both = d.select("run_key", "food", "_d").join(t.select("run_key", "food", "_t"), ["run_key", "food"], "full")
    fam = F.col("food").isin(list(family))
    n = both.groupBy("run_key").agg(
        F.count_if(F.col("_d").isNotNull() & F.col("_t").isNotNull()).alias("_c"),
        F.count_if(F.col("_d").isNull()).alias("_m"),
        F.count_if(F.col("_t").isNull()).alias("_w"),
        F.coalesce(F.bool_or(fam & F.col("_d").isNotNull()), F.lit(False)).alias("_hit"),
        F.count_if(~fam & F.col("_d").isNotNull()).alias("_other"),
    )
    df = scored.join(n, "run_key", "left").na.fill(0, ["_c", "_m", "_w", "_other"]).withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    loose, lenient = F.col("photo").isin(list(any_of)), F.col("photo").isin(list(no_wrong))
    hit = F.col("_hit").cast("long")
    return df.select(
        "run_key",
        "photo",
        F.when(loose, hit).otherwise(F.col("_c")).alias("correct"),
        F.when(loose, 1 - hit).otherwise(F.col("_m")).alias("missed"),
        F.when(loose, F.col("_other")).when(lenient, F.lit(0)).otherwise(F.col("_w")).alias("wrong"),
    )


def score_detections(runs: DataFrame, items: DataFrame, truth: DataFrame, **rules) -> DataFrame:
    """A-20: totals with recall and precision (null without a denominator), one row."""
    s = score_runs(runs, items, truth, **rules).agg(
        F.count(F.lit(1)).alias("scored"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("correct", "missed", "wrong")]
    )
    failed = runs.agg(F.count_if(~F.col("counted")).alias("failed"))
    c = F.col("correct")
    return (
        s.crossJoin(F.broadcast(failed))  # one row each
        .withColumn("recall", F.try_divide(c, c + F.col("missed")))
        .withColumn("precision", F.try_divide(c, c + F.col("wrong")))
    )


def experiment_summary(runs: DataFrame, items: DataFrame, truth: DataFrame, **rules) -> DataFrame:
    """A-19: per source: scores, mean unknown percent, failed runs, and how often run 1 and run 2 differ.

    ``runs`` also has source, run (1, 2, ...) and unknown_pct.
    """
    per = score_runs(runs, items, truth, **rules).join(runs.select("run_key", "source"), "run_key").groupBy("source").agg(
        F.count(F.lit(1)).alias("scored_runs"), F.sum("correct").alias("correct"), F.sum("missed").alias("missed"), F.sum("wrong").alias("wrong")
    )
    counted = runs.filter("counted")
    base = runs.groupBy("source").agg(F.count_if(~F.col("counted")).alias("failed_runs"), F.avg(F.when(F.col("counted"), F.col("unknown_pct"))).alias("avg_unknown_pct"))
    keyed = counted.filter(F.col("run").isin(1, 2)).select("run_key", "photo", "source", "run")
    foods = detected_foods(items).join(keyed, "run_key").select("photo", "source", "run", "food").distinct()
    have = keyed.groupBy("photo", "source").agg((F.count_distinct("run") == 2).alias("_both")).filter("_both")
    odd = foods.groupBy("photo", "source", "food").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("photo", "source").distinct().withColumn("_diff", F.lit(1))
    pairs = have.join(odd, ["photo", "source"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("run_pairs"), F.count("_diff").alias("run_pairs_different"))
    df = base.join(per, "source", "left").join(pairs, "source", "left")
    df = df.na.fill(0, ["scored_runs", "correct", "missed", "wrong", "run_pairs", "run_pairs_different"])
    return df.withColumn("run_disagreement_rate", F.try_divide(F.col("run_pairs_different"), F.col("run_pairs")))
