"""Checks of model answers that arrive as JSON text (one row per answer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traymetrics.functions.geometry import max_plausible_area
from traymetrics.functions.numbers import finite_nonneg, is_finite
from traymetrics.session import materialize

# fixed values
DISH_TYPES = ["plate", "bowl", "other"]
AREA_SEVERITY_FAILED = [
    "response_not_json",
    "response_not_object",
    "missing_or_invalid_field:plateEmpty",
    "missing_or_invalid_field:ambiguous",
    "missing_or_invalid_field:items",
    "missing_or_invalid_field:unknown",
    "item_not_object",
    "item_missing_id",
    "unknown_not_object",
    "unknown_missing_label",
]


def kind(v: Column) -> Column:
    """Type word of a variant value (OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DOUBLE, DECIMAL, VOID)."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def is_number(v: Column) -> Column:
    return F.coalesce(kind(v).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string, variant>").isNotNull()


def outer_kind(raw) -> Column:
    """OBJECT or ARRAY by the first character of valid JSON text (no walk through the document)."""
    first = F.substring(F.ltrim(F.regexp_replace(raw, r"^\s+", "")), 1, 1)
    return F.when(first == "{", F.lit("OBJECT")).when(first == "[", F.lit("ARRAY")).otherwise(F.lit("SCALAR"))


def field(v: Column, name: str, as_type: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", as_type)


def items_of(v: Column, name: str) -> Column:
    """A JSON list as an array of variants; null when the field is not a list."""
    return field(v, name, "array<variant>")


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))


def check_area_answers(answers: DataFrame, menu: DataFrame) -> DataFrame:
    """V-15: (answer rows) + severity and reason of the first broken rule; null when accepted.

    ``answers`` has answer_id (unique), menu_id, raw, geometry; ``menu`` has menu_id, item_id. Every
    listed item is one row with typed columns; duplicates are numbered in a window over (answer, item).
    """
    v = F.col("_v")
    boolean = lambda name: F.coalesce(kind(field(v, name, "variant")) == "BOOLEAN", F.lit(False))
    parsed = answers.withColumn("_v", F.try_parse_json("raw")).withColumns({"_items": items_of(v, "items"), "_unknown": items_of(v, "unknown")})
    shape = (
        F.when(v.isNull(), F.lit("response_not_json"))
        .when(outer_kind("raw") != "OBJECT", F.lit("response_not_object"))
        .when(~boolean("plateEmpty"), F.lit("missing_or_invalid_field:plateEmpty"))
        .when(~boolean("ambiguous"), F.lit("missing_or_invalid_field:ambiguous"))
        .when(F.col("_items").isNull(), F.lit("missing_or_invalid_field:items"))
        .when(F.col("_unknown").isNull(), F.lit("missing_or_invalid_field:unknown"))
    )
    shaped = parsed.select(*answers.columns, shape.alias("_shape"), F.coalesce(field(v, "plateEmpty", "boolean"), F.lit(False)).alias("_empty"), "_items", "_unknown")
    usable = shaped.filter(F.col("_shape").isNull())

    e = F.col("_e")
    area, conf, base = (field(e, n, "variant") for n in ("remainingAreaPx", "confidence", "estimatedUneatenAreaPx"))
    number = lambda x, n: F.when(is_number(x), field(e, n, "double"))
    items = usable.select("answer_id", "menu_id", F.posexplode("_items").alias("_pos", "_e")).select(
        "answer_id",
        "menu_id",
        "_pos",
        is_object(e).alias("_object"),
        field(e, "itemId", "string").alias("item_id"),
        F.coalesce(kind(field(e, "itemId", "variant")) == "STRING", F.lit(False)).alias("_text"),
        number(area, "remainingAreaPx").alias("_area"),
        field(e, "remainingAreaPx", "double").alias("_claimed"),
        number(conf, "confidence").alias("_conf"),
        F.coalesce(kind(base) != "VOID", F.lit(False)).alias("_has_base"),
        number(base, "estimatedUneatenAreaPx").alias("_base"),
    )
    known = menu.select("menu_id", "item_id").distinct().withColumn("_known", F.lit(True))
    again = F.row_number().over(Window.partitionBy("answer_id", "item_id").orderBy("_pos")) > 1
    good = lambda ok: F.coalesce(ok, F.lit(False))
    item_reason = (
        F.when(~F.col("_object"), F.lit("item_not_object"))
        .when(~F.col("_text") | (F.col("item_id") == ""), F.lit("item_missing_id"))
        .when(F.col("_known").isNull(), F.lit("unknown_item_id_in_response"))
        .when(F.col("_again"), F.lit("duplicate_item_assignment"))
        .when(~good(finite_nonneg("_area")), F.lit("invalid_remaining_area"))
        .when(~good(is_finite("_conf") & F.col("_conf").between(0, 1)), F.lit("invalid_confidence"))
        .when(F.col("_has_base") & ~good(finite_nonneg("_base") & (F.col("_base") > 0)), F.lit("invalid_estimated_baseline"))
    )
    items = items.withColumn("_again", again).join(known, ["menu_id", "item_id"], "left").select("answer_id", F.lit(0).alias("_part"), "_pos", item_reason.alias("_why"), "_claimed")

    label = field(e, "label", "variant")
    unknown_reason = (
        F.when(~is_object(e), F.lit("unknown_not_object"))
        .when(~good((kind(label) == "STRING") & (F.trim(field(e, "label", "string")) != "")), F.lit("unknown_missing_label"))
        .when(~good(is_number(area) & finite_nonneg(field(e, "remainingAreaPx", "double"))), F.lit("invalid_unknown_area"))
    )
    unknown = usable.select("answer_id", F.posexplode("_unknown").alias("_pos", "_e")).select(
        "answer_id", F.lit(1).alias("_part"), "_pos", unknown_reason.alias("_why"), field(e, "remainingAreaPx", "double").alias("_claimed")
    )
    first = F.min(F.when(F.col("_why").isNotNull(), F.struct("_part", "_pos", "_why")))
    judged = items.unionByName(unknown).groupBy("answer_id").agg(first["_why"].alias("_why"), F.sum("_claimed").alias("_total"))
    claimed = F.coalesce("_total", F.lit(0.0))
    reason = F.coalesce(
        "_shape",
        "_why",
        F.when(claimed > max_plausible_area("geometry"), F.lit("total_area_exceeds_plate")),
        F.when(F.col("_empty") & (claimed > 0), F.lit("empty_plate_with_nonzero_area")),
    )
    out = shaped.drop("_items", "_unknown").join(judged, "answer_id", "left").withColumn("reason", reason)
    return out.withColumn("severity", F.when(F.col("reason").isNotNull(), F.when(F.col("reason").isin(AREA_SEVERITY_FAILED), F.lit("failed")).otherwise(F.lit("needs_review")))).select(
        *answers.columns, "severity", "reason"
    )


def parse_box_answers(answers: DataFrame, menu: DataFrame, max_pieces: int | None = None, label_chars: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V-16: (pieces, dishes, rejects) of localization answers.

    ``answers`` has answer_id, menu_id, raw; ``menu`` has menu_id, number (1..N), item_id. An answer
    with any out-of-range menu number is rejected as a whole, and so is one of more than
    ``max_pieces`` pieces; labels are cut at ``label_chars``. Both limits are off unless given.
    """
    v = F.col("_v")
    df = answers.withColumn("_v", F.try_parse_json("raw")).withColumn("_kind", outer_kind("raw"))
    df = df.withColumn("_pieces", F.when(F.col("_kind") == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(F.col("_kind") == "OBJECT", items_of(v, "pieces")))
    shape = (
        F.when(v.isNull(), F.lit("invalid_json"))
        .when(~F.col("_kind").isin("ARRAY", "OBJECT"), F.lit("not_an_object"))
        .when(F.col("_pieces").isNull(), F.lit("pieces_not_an_array"))
        .when(F.size("_pieces") > F.lit(max_pieces), F.lit("too_many_regions"))
    )
    df = df.withColumn("_shape", shape)
    pieces = df.filter(F.col("_shape").isNull()).select("answer_id", "menu_id", F.posexplode("_pieces").alias("idx", "_e"))
    e = F.col("_e")
    number = field(e, "menu_id", "double")
    label = F.trim(F.regexp_replace(F.coalesce(field(e, "ingredient", "string"), F.lit("")), r"[\x00-\x1f]", " "))
    label = label if label_chars is None else F.substring(label, 1, label_chars)
    pieces = pieces.select(
        "answer_id",
        "menu_id",
        "idx",
        F.when(is_number(field(e, "menu_id", "variant")) & (number == F.floor(number)) & (number >= 0), number.cast("long")).alias("number"),
        F.when(label == "", F.lit("food")).otherwise(label).alias("visual_label"),
        field(e, "box_2d", "array<double>").alias("box"),
        (~F.coalesce((kind(field(e, "on_target_dish", "variant")) == "BOOLEAN") & ~field(e, "on_target_dish", "boolean"), F.lit(False))).alias("on_target"),
    )
    pieces = materialize(pieces.join(menu.select("menu_id", "number", "item_id"), ["menu_id", "number"], "left"))  # parsed once, read twice
    bad = F.col("number").isNull() | ((F.col("number") > 0) & F.col("item_id").isNull())
    out_of_range = pieces.filter(bad).select("answer_id").distinct()
    dish = field(v, "target_dish", "variant")
    usable = df.filter(F.col("_shape").isNull()).join(out_of_range, "answer_id", "left_anti")
    dishes = usable.select(
        "answer_id",
        F.when(F.col("_kind") == "ARRAY", F.lit("legacy_array"))
        .when(F.coalesce(kind(dish) == "VOID", F.lit(True)), F.lit("not_found"))
        .when(kind(dish) != "OBJECT", F.lit("bad_target_dish"))
        .when(~F.coalesce(field(dish, "dish_type", "string").isin(DISH_TYPES), F.lit(False)), F.lit("bad_dish_type"))
        .alias("reason"),
        field(dish, "dish_type", "string").alias("dish_type"),
        field(dish, "box_2d", "array<double>").alias("box"),
        (~F.coalesce((kind(field(dish, "fully_visible", "variant")) == "BOOLEAN") & ~field(dish, "fully_visible", "boolean"), F.lit(False))).alias("fully_visible"),
    )
    rejects = df.filter(F.col("_shape").isNotNull()).select("answer_id", F.col("_shape").alias("reason")).unionByName(
        out_of_range.withColumn("reason", F.lit("menu_id_out_of_range"))
    )
    return pieces.join(out_of_range, "answer_id", "left_anti"), dishes, rejects


def check_leftover_answers(answers: DataFrame) -> DataFrame:
    """V-17: + reason. ``answers`` has answer_id, raw and the answer's own ``labels``.

    Each label at most once; a countable food has a whole count and no percent, another has a
    percent from 0 to 100 and no count.
    """
    v = F.col("_v")
    df = answers.withColumn("_v", F.try_parse_json("raw")).withColumn("_items", items_of(v, "items"))
    names = F.transform("_items", lambda e: field(e, "label", "string"))

    def reason(e: Column, i: Column) -> Column:
        label = field(e, "label", "string")
        countable = F.when(kind(field(e, "countable", "variant")) == "BOOLEAN", field(e, "countable", "boolean"))
        count, pct = field(e, "count", "double"), field(e, "percentRemaining", "double")
        has = lambda n: field(e, n, "variant").isNotNull()
        return (
            F.when(~F.coalesce((kind(field(e, "label", "variant")) == "STRING") & F.array_contains("labels", label), F.lit(False)), F.lit("label_not_allowed"))
            .when(F.array_position(names, label) < i + 1, F.lit("duplicate_label"))
            .when(countable & ~(is_number(field(e, "count", "variant")) & finite_nonneg(count) & (count == F.floor(count))), F.lit("invalid_count"))
            .when(countable & has("percentRemaining"), F.lit("percent_on_countable"))
            .when(~countable & ~(is_number(field(e, "percentRemaining", "variant")) & finite_nonneg(pct) & (pct <= 100)), F.lit("invalid_percent"))
            .when(~countable & has("count"), F.lit("count_on_uncountable"))
            .when(countable.isNull(), F.lit("missing_countable"))
        )

    out = F.when(v.isNull(), F.lit("invalid_json")).when(F.col("_items").isNull(), F.lit("missing_items")).otherwise(_first(F.transform("_items", reason)))
    return df.withColumn("reason", out).drop("_v", "_items")


def leftover_items(checked: DataFrame) -> DataFrame:
    """V-17: the items of accepted answers, one row each."""
    e = F.col("_e")
    return (
        checked.filter(F.col("reason").isNull())
        .select("answer_id", F.explode(items_of(F.try_parse_json("raw"), "items")).alias("_e"))
        .select(
            "answer_id",
            field(e, "label", "string").alias("label"),
            field(e, "countable", "boolean").alias("countable"),
            field(e, "count", "double").cast("long").alias("count"),
            field(e, "percentRemaining", "double").alias("percent_remaining"),
            F.coalesce(field(e, "confidence", "double"), F.lit(0.0)).alias("confidence"),
        )
    )
