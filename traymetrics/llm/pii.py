"""Operator 7, personal data by candidate gradient boosting; DataFrame functions only.

Generators of high recall propose spans, which may overlap: the four base patterns, with or without
a passed check (parts up to 255, Luhn digit, number of digits), and looser spellings of each kind.
Spans of a base pattern that pass are always reported. The others are scored by boosted trees over
format and context, read from the spelling a span stands for (``x [at] y [dot] com`` as ``x@y.com``).
The trees learn from all of the corpus; base spans that pass are positive. A spelled-out span is sound
if its plain spelling passes the check: it is scored by trees that tell base spans from look-alikes
without the format of the kind (``met at noon``, ``3.5``, runs of digits). All others are scored by trees
for which failing base spans are negative too, and which don't see the check itself. Documents fall
into two folds by a hash of doc_id and text, and each span is scored by the trees of the other fold.
Thresholds are the lowest scores at which a lower confidence bound of the precision reaches what is
asked; spans that aren't sound must also be likelier than not. A kind without enough evidence adds
nothing. An added span inside a base span that is reported is left out.

Positions come from splitting at a pattern: the pieces between matches and the matches alternate.
Patterns are written so that Java's engine needs linear time and a flat stack on any text; dots and
separators that can't belong to a span are overwritten first, one character for one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traymetrics.llm.boosting import Boosted, Cell, fit
from traymetrics.llm.common import land, null_as_empty, query, table

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98  # asked of added spans that fail the check, on held-out documents
SOUND_PRECISION = 0.9  # asked of added spans whose plain spelling passes the check
ERRORS = 1.0  # standard errors between the measured precision and its lower bound
CONTEXT = 24  # characters looked at on either side

_LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Generator:
    """Spans of one pattern. ``gate`` must hold for any match; ``bare`` overwrites what can't be part of one.

    Look-alikes are only learned from, never reported.
    """

    kind: str
    base: bool
    gate: str
    pattern: str
    bare: tuple[str, str] | None = None
    lookalike: bool = False


GENERATORS = (
    Generator("email", True, "@", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]+", (r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "%")),
    Generator("ip", True, r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    Generator("card", True, r"(?:[0-9][ -]?){11}[0-9]", r"[0-9][0-9 -]+", (r"(?<![0-9])[ -]|[ -](?![0-9])", "_")),
    Generator("phone", True, r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    Generator("email", False, r"[\[(](?:at|AT)[\])]", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{{1,63}} ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{{2,24}}"),
    Generator("ip", False, r":[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    Generator("card", False, r"[0-9]{4}\.[0-9]{4}", r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{4}(?![0-9.])"),
    Generator("phone", False, r"[0-9]{3}[-. ][0-9]{4}", r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"),
    Generator("email", False, "@| at ", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}(?:@| at )[A-Za-z0-9-]{{1,63}}(?![A-Za-z0-9.-])", lookalike=True),
    Generator("ip", False, r"[0-9]\.[0-9]", r"(?<![0-9.])[0-9]++\.[0-9]++(?:\.[0-9]++)?+(?![0-9.])", lookalike=True),
    Generator("card", False, "[0-9]{8}", "(?<![0-9])(?:[0-9]{20,}+|[0-9]{8,11}+)(?![0-9])", lookalike=True),
    Generator("phone", False, "[0-9]{7}", "(?<![0-9+])[0-9]{7,15}+(?![0-9])", lookalike=True),
)


def _found(g: Generator) -> Column:
    """Per match: length of the piece before it, the match, and what stands on its sides."""
    text = F.regexp_replace("_text", *g.bare) if g.bare else F.col("_text")
    match = F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0))
    pieces = F.split(text, g.pattern, -1)
    side = F.transform(
        F.sequence(F.lit(0), F.size("_m") - 1),
        lambda i: F.struct(
            i.alias("i"),
            F.length(F.get("_p", i)).alias("gap"),
            F.length(F.get("_m", i)).alias("len"),
            F.get("_m", i).alias("match"),
            F.lower(F.right(F.get("_p", i), F.lit(CONTEXT))).alias("before"),
            F.left(F.get("_p", i + 1), F.lit(1)).alias("after"),
        ),
    )
    return F.col("_text").rlike(g.gate), match, pieces, side


def _candidates(docs: DataFrame) -> DataFrame:
    """One row per document with a list of matches for each generator; the text stays behind."""
    out = docs
    for k, g in enumerate(GENERATORS):
        gate, match, pieces, side = _found(g)
        # a document without the gate is not split
        out = out.withColumn("_hit", gate).withColumn("_m", F.when(F.col("_hit"), match)).withColumn("_p", F.when(F.size("_m") > 0, pieces))
        out = out.withColumn(f"_g{k}", F.when(F.size("_m") > 0, side)).drop("_hit", "_m", "_p")
    return out.drop("_text")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a short string of digits ends in its Luhn digit."""
    value = lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _passes(kind: Column, match: Column) -> Column:
    """The check of a base span."""
    digits = _digits(match)
    n = F.length(digits)
    parts = F.transform(F.split(match, r"\.", -1), lambda p: F.ltrim(p, F.lit("0")))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    card = F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).otherwise(n.between(9, 15))


def _bin(value: Column, *edges: int) -> Column:
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


def _plain(kind: Column, match: Column) -> Column:
    """The spelling a span stands for: ``x [at] y [dot] com`` as ``x@y.com``, dots of a card as dashes."""
    email = F.regexp_replace(F.regexp_replace(match, r" ?(?:[\[(](?:at|AT)[\])]| at ) ?", "@"), r" ?[\[(](?:dot|DOT)[\])] ?", ".")
    return F.when(kind == "email", email).when(kind == "card", F.replace(match, F.lit("."), F.lit("-"))).otherwise(match)


def _sound(kind: Column, match: Column) -> Column:
    """Whether a spelled-out span, in its plain spelling, passes the check of its kind; eight groups are an address."""
    return F.when((kind == "ip") & match.contains(":"), True).otherwise(_passes(kind, match))


_CODES = [f"_c{i}" for i in range(10)]
_WORDS = {"email": "mail|contact|write", "ip": r"\bip\b|host|addr|server", "card": "card|visa|master|credit|pay", "phone": "tel|phone|call|fax|mobil"}


def _features() -> list[Column]:
    """Small codes of format and context; ``match`` is the plain spelling."""
    n, match = F.length(_digits(F.col("match"))), F.col("match")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    told = F.lit(False)
    for kind, about in _WORDS.items():
        told = told | ((F.col("kind") == kind) & F.col("before").rlike(about))
    prefix = F.when(F.col("kind") == "phone", _bin(F.length(F.regexp_extract(match, r"^\+?([0-9]+)", 1)), 2, 3, 4)).otherwise(_bin(F.substring(_digits(match), 1, 1).try_cast("int"), 3, 4, 5, 6, 7))
    prefix = F.when(F.col("kind").isin("card", "phone"), prefix)
    return [
        number,
        _bin(n, 7, 9, 10, 12, 13, 15, 16, 17, 20),
        _bin(F.length(match) - n, 1, 2, 3, 4, 6, 10),
        F.coalesce(prefix, F.lit(0)),
        match.contains(" ").cast("int") + 2 * match.contains("-").cast("int"),
        match.rlike("[0-9]{4}[ -.]?[0-9]{4}[ -.]?[0-9]{4}[ -.]?[0-9]{4}").cast("int"),
        told.cast("int"),
        F.col("before").rlike(r"(^|[\s:=(])$").cast("int"),
        F.coalesce(F.col("after").rlike(r"^($|[\s.,;)])").cast("int"), F.lit(1)),
        # separators as full as they should be: three or more, for an email a dot in its domain
        F.when(F.col("kind") == "email", match.rlike(r"@.*\.").cast("int") * 3).otherwise(_bin(F.length(F.regexp_replace(match, r"[^.: -]", "")), 1, 2, 3)),
    ]


def precision_bound(yes: float, no: float) -> float:
    """Lower end of the score interval of a share, ``ERRORS`` standard errors wide; 0 without cases."""
    n, z = yes + no, ERRORS
    if not n:
        return 0.0
    share = yes / n
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _lowest(rows: list[tuple[float, float, float]], asked: float) -> float | None:
    """The lowest score from which on the bound of the precision holds; rows are (score, positive, negative)."""
    rows, found, yes, no = sorted(rows, reverse=True), None, 0.0, 0.0
    for k, (score, y, n) in enumerate(rows):
        yes, no = yes + y, no + n
        last = k + 1 == len(rows) or rows[k + 1][0] < score
        if last and precision_bound(yes, no) >= asked:
            found = score
    return found


def _model(spans: DataFrame) -> tuple[dict[tuple[bool, int], Boosted], dict[tuple[str, bool], float]]:
    """Trees by (sound, fold), fitted on the other fold, and thresholds by (kind, sound)."""
    count = lambda c: F.sum(c.cast("long"))
    taught = spans.filter("base OR lookalike").groupBy("kind", "fold", *_CODES)
    counted = taught.agg(count(F.col("passes")).alias("yes"), count(F.col("base") & ~F.col("passes")).alias("failed"), count(F.col("lookalike")).alias("alike")).collect()
    counted.sort(key=lambda r: (r["kind"], *[r[c] for c in _CODES]))  # bounded by the product of the code ranges
    codes = lambda r: tuple(r[c] for c in _CODES)
    models, limits = {}, {}
    for sound in (True, False):
        cells = [(r["kind"], r["fold"], Cell(codes(r), r["yes"], r["alike"] + (0 if sound else r["failed"]))) for r in counted]
        for fold in (0, 1):
            models[sound, fold] = fit([c for _, f, c in cells if f != fold and c.positive + c.negative])
        held = defaultdict(list)
        for kind, fold, c in cells:
            held[kind].append((models[sound, fold].logit(c.codes), c.positive, c.negative))
        for kind, rows in held.items():
            limit = _lowest(rows, SOUND_PRECISION if sound else PRECISION)
            if limit is not None:
                limits[kind, sound] = limit if sound else max(limit, 0.0)
    return models, limits


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (kind, start, end, base), sorted by start and kind.

    Positions count code points, the end is exclusive. A null text is empty. Rows that repeat a
    doc_id are separate. Spans of different generators may overlap; equal ones count once.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("doc_id"), null_as_empty(text).alias("_text"))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(2)).cast("int"))
    rows = land(_candidates(rows), "candidates")
    parts = []
    for k, g in enumerate(GENERATORS):
        each = rows.select("_row", F.col("_fold").alias("fold"), F.explode(f"_g{k}").alias("m"), F.lit(g.kind).alias("kind"), F.lit(g.base).alias("base"), F.lit(g.lookalike).alias("lookalike"), F.lit(k).alias("g"))
        parts.append(each.select("_row", "fold", "kind", "base", "lookalike", "g", "m.*"))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    before = Window.partitionBy("_row", "g").orderBy("i")
    start = F.sum("gap").over(before) + F.sum("len").over(before) - F.col("len")
    spans = spans.withColumn("start", start.cast("long")).withColumn("end", (F.col("start") + F.col("len")).cast("long"))
    spans = spans.withColumn("passes", F.col("base") & _passes(F.col("kind"), F.col("match")))
    # base card matches of another length are no candidates
    spans = spans.filter("passes OR lookalike OR kind <> 'card' OR length(regexp_replace(match, '[^0-9]', '')) BETWEEN 12 AND 19")
    spans = spans.withColumn("match", _plain(F.col("kind"), F.col("match")))
    spans = spans.withColumn("sound", ~F.col("base") & ~F.col("lookalike") & _sound(F.col("kind"), F.col("match")))
    spans = spans.select("_row", "kind", "base", "lookalike", "passes", "sound", "start", "end", "fold", *[f.alias(c) for f, c in zip(_features(), _CODES)])
    spans = land(spans, "spans")

    models, limits = _model(spans)
    limit = F.lit(None).cast("double")
    for (kind, sound), value in limits.items():
        limit = F.when((F.col("kind") == kind) & (F.col("sound") == sound), F.lit(value)).otherwise(limit)
    codes = [F.col(c) for c in _CODES]
    score = F.lit(None).cast("double")
    for (sound, fold), model in models.items():
        score = F.when((F.col("sound") == sound) & (F.col("fold") == fold), model.column(codes)).otherwise(score)
    added = F.coalesce(~F.col("lookalike") & (score >= limit), F.lit(False))
    chosen = spans.filter(F.col("passes") | added).groupBy("_row", "start", "end", "kind").agg(F.max("passes").alias("base"))
    # the end of the base spans that start no later
    reach = Window.partitionBy("_row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = chosen.withColumn("_reach", F.max(F.when(F.col("base"), F.col("end"))).over(reach)).filter("base OR _reach IS NULL OR _reach < `end`").drop("_reach")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    lists = chosen.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", number.alias("n"), "end", "kind", "base"))).alias("spans"))
    out = rows.select("_row", "doc_id").join(lists, "_row", "left")
    spans_out = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:long,n:long,end:long,kind:string,base:boolean>>")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return out.select("doc_id", spans_out.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op7_pii")
def op7_pii(spark, folder):
    found = find_pii(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
