"""Names, slugs, ids and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traymetrics.functions.numbers import as_col

# fixed values: accented letters and their base letters
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
BASE = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
COMBINING_MARKS = r"[̀-ͯ]"


def slug(s) -> Column:
    """F-3: accents stripped, lower case, runs of other characters to one hyphen, hyphens trimmed."""
    base = F.lower(F.regexp_replace(F.translate(as_col(s), ACCENTED, BASE), COMBINING_MARKS, ""))
    return F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_and(s) -> Column:
    """S-8: the second slug form, which spells out '&'."""
    return slug(F.regexp_replace(as_col(s), "&", " and "))


def readable_item_name(item_id) -> Column:
    """F-4: last '_' part, split on hyphens and spaces, first letters upper case."""
    c = as_col(item_id)
    words = F.filter(F.split(F.element_at(F.split(c, "_"), -1), r"[-\s]+"), lambda w: w != "")
    titled = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    return F.when(F.size(words) == 0, c).otherwise(F.array_join(titled, " "))


def _day(d) -> Column:
    return F.date_format(as_col(d), "yyyy-MM-dd")


def service_id(hall, date, meal) -> Column:
    """F-5."""
    return F.concat_ws("_", F.lit("svc"), as_col(hall), _day(date), as_col(meal))


def menu_id(hall, date, meal) -> Column:
    return F.concat_ws("_", F.lit("menu"), as_col(hall), _day(date), as_col(meal))


def item_id(hall, date, meal, name) -> Column:
    return F.concat_ws("_", F.lit("item"), as_col(hall), _day(date), as_col(meal), slug(name))


def baseline_id(item, version) -> Column:
    return F.concat(F.lit("base_"), F.regexp_replace(as_col(item), "^item_", ""), F.lit("_v"), as_col(version).cast("string"))


def revision_id(item, version) -> Column:
    return F.concat(as_col(item), F.lit("@v"), as_col(version).cast("string"))


def collapse(s) -> Column:
    """Trim and collapse runs of white space."""
    return F.trim(F.regexp_replace(as_col(s), r"\s+", " "))


def plain_text(s) -> Column:
    """F-15: long dashes to commas, pictographs out, no space before punctuation, spaces collapsed."""
    t = F.regexp_replace(as_col(s), r"\s*[—–]\s*", ", ")
    t = F.regexp_replace(t, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{231A}-\x{23FF}\x{25AA}-\x{25FE}\x{3030}\x{303D}\x{3297}\x{3299}]", "")
    t = F.regexp_replace(t, r",?\s+([.,;:!?])", "$1")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def sanitize_text(s, max_len: int | None = None) -> Column:
    """F-15: control characters and backticks to spaces, collapsed, cut at ``max_len`` if one is given."""
    t = F.regexp_replace(as_col(s), r"[\x00-\x1f\x7f-\x9f`]", " ")
    return collapse(t) if max_len is None else F.substring(collapse(t), 1, max_len)


def cap_text(s, limit: int = 600) -> Column:
    """F-16: collapsed text, cut with dots at the limit (the cut is the function); empty text raises no error here but is null."""
    t = collapse(s)
    return F.when(F.length(t) == 0, F.lit(None).cast("string")).when(
        F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))
    ).otherwise(t)


def split_allergens(s) -> Column:
    """F-20: '; ' list to array, blanks dropped."""
    return F.filter(F.transform(F.split(as_col(s), ";"), lambda v: F.trim(v)), lambda v: v != "")


def canonical_food(raw, name_map: dict[str, str] | None = None) -> Column:
    """F-34: text before '(' trimmed, then mapped by its lower-case form."""
    name = F.trim(F.element_at(F.split(as_col(raw), r"\("), 1))
    if not name_map:
        return name
    pairs = F.create_map(*[F.lit(v) for kv in name_map.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(name)), name)


def truth_foods(cells, name_map: dict[str, str] | None = None) -> Column:
    """F-34: one labelled cell ('ham & pizza (1 slice)') to canonical food names, unknowns dropped."""
    parts = F.transform(F.split(as_col(cells), "&"), lambda p: F.trim(p))
    parts = F.filter(parts, lambda p: (p != "") & ~p.rlike(r"(?i)^(un(k)?own|unkown)"))
    return F.array_distinct(F.transform(parts, lambda p: canonical_food(p, name_map)))


def json_string(c) -> Column:
    """A string as JSON text with its quotes; null is null."""
    text = F.to_json(F.struct(F.col(c).alias("v") if isinstance(c, str) else c.alias("v")))
    return F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6)).otherwise(F.lit("null"))
