"""Q-1 to Q-16: the read models, each one lazy plan over the stored tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traymetrics.functions.dates import as_date
from traymetrics.functions.hashing import attendance_count
from traymetrics.functions.numbers import js_round
from traymetrics.functions.text import readable_item_name
from traymetrics.operators import eligibility as E
from traymetrics.operators import facts as A
from traymetrics.operators import impact as I
from traymetrics.operators import joins as J
from traymetrics.operators import picking as P
from traymetrics.operators import services as S
from traymetrics.operators import validation as V
from traymetrics.session import materialize


@dataclass
class Store:
    """The stored tables a read model needs."""

    captures: DataFrame
    services: DataFrame
    measurements: DataFrame
    items: DataFrame
    attempts: DataFrame
    calibrations: DataFrame
    portions: DataFrame
    attendance: DataFrame
    waste: DataFrame
    nutrition: DataFrame
    visibility: DataFrame
    views: DataFrame

    def in_window(self, start: str, end: str, hall: str | None = None, hidden: bool = False) -> "Store":
        """Services of a window and the captures a dashboard may show; filters reach the scans."""
        V.parse_window(start, end, hall)
        keep = F.col("service_date").between(as_date(start), as_date(end))
        svc = self.services.filter(keep if hall is None else keep & (F.col("hall_id") == hall))
        caps = self.captures if hall is None else self.captures.filter(F.col("hall_id") == hall)
        visible = E.visible_captures(caps, self.visibility.filter("false") if hidden else self.visibility, self.views)
        return Store(**{**self.__dict__, "services": svc, "captures": visible.join(svc.select("service_id"), "service_id", "left_semi")})

    def scored(self) -> tuple[DataFrame, DataFrame]:
        selected, caps = I.select_impact(self.captures, self.services, self.measurements, self.items, self.attempts, self.calibrations)
        return I.score(selected, self.waste, self.nutrition), caps

    def counted_rows(self) -> DataFrame:
        return J.counted_measurements(self.measurements, P.counted_attempts(self.attempts))


class Dashboard:
    """Q-1: totals, targets, most_wasted and coverage; each is computed when it is asked for.

    What several of them read, the scored rows and the food rows, is frozen by the first that does.
    """

    def __init__(self, window: Store):
        self._window = window

    @cached_property
    def _rows(self) -> tuple[DataFrame, DataFrame]:
        scored, caps = self._window.scored()
        return materialize(scored), materialize(caps)

    @cached_property
    def _foods(self) -> DataFrame:
        return materialize(I.food_rows(self._rows[0], self._window.portions))

    @cached_property
    def totals(self) -> DataFrame:
        return I.totals_by(*self._rows, [])

    @cached_property
    def targets(self) -> DataFrame:
        return P.rank_targets(self._foods)

    @cached_property
    def most_wasted(self) -> DataFrame:
        return P.rank_most_wasted(self._foods)

    @cached_property
    def coverage(self) -> DataFrame:
        return I.coverage(self._foods).crossJoin(I.neighbor_captures(self._window.captures, self._window.attempts))  # one row each

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)


def impact_dashboard(store: Store, start: str, end: str, hall: str | None = None) -> Dashboard:
    """Q-1 of a window."""
    return Dashboard(store.in_window(start, end, hall))


def impact_daily(store: Store, start: str, end: str, hall: str | None = None, max_days: int | None = V.MAX_WINDOW_DAYS) -> DataFrame:
    """Q-2."""
    V.parse_window(start, end, hall, max_days)
    return I.daily_impact(*store.in_window(start, end, hall).scored(), start, end)


def impact_totals(store: Store, today: str, hall: str | None = None) -> DataFrame:
    """Q-3: one read of the widest period."""
    import datetime

    d = datetime.date.fromisoformat(today)
    start = min(d - datetime.timedelta(days=d.weekday()), d.replace(day=1)).isoformat()
    return I.headline_totals(*store.in_window(start, today, hall).scored(), today)


def with_attendance(services: DataFrame, attendance: DataFrame, low: int = 300, high: int = 1200, seed: str | None = None) -> DataFrame:
    """Stored attendance, else the simulated count of the service (F-18)."""
    s = None if seed is None else F.lit(seed)
    made = attendance_count("hall_id", "service_id", "service_date", low, high, s)
    return services.select("service_id", "hall_id", "service_date").join(attendance.select("service_id", F.col("count").alias("_c")), "service_id", "left").select(
        "service_id", "hall_id", "service_date", F.coalesce("_c", made).alias("count")
    )


def meal_detail(store: Store, start: str, end: str, hall: str | None = None) -> DataFrame:
    """Q-4: per meal: pixel summary, attendance, benchmark coverage and the rule-based tip.

    The tip comes from per-portion rates when the meal has one, else from its pixels.
    """
    w = store.in_window(start, end, hall)
    att = with_attendance(w.services, w.attendance)
    caps = S.pixel_captures(w.captures, w.attempts)
    summary = S.pixel_summary(w.services, caps, w.measurements, att)
    names = w.items.groupBy("item_id").agg(F.min("display_name").alias("_n"))
    top_px = A.top_item(S.pixel_items(caps, w.measurements), "pixels_wasted", ["share_percent"]).withColumn("_i", F.col("top.item_id"))
    top_px = top_px.join(names, F.col("_i") == names["item_id"], "left").select("service_id", F.col("top").alias("_px"), F.coalesce("_n", "_i").alias("_px_name"))
    bench, counts = S.portion_benchmark(w.services, w.items, w.captures, w.counted_rows(), w.portions)
    rate = F.col("pixels_per_portion")
    best = bench.groupBy("service_id").agg(
        F.min_by(F.struct("display_name", rate, "pixels_wasted", "portions_served", "portions_source"), F.when(rate.isNotNull(), F.struct((-rate).alias("r"), "item_id"))).alias("_b"),
        F.count_if(rate.isNull()).alias("_missing"),
        F.count_if(F.coalesce("portions_served", F.lit(0)) == 0).alias("_unserved"),
    )
    df = summary.join(top_px, "service_id", "left").join(best, "service_id", "left").join(counts, "service_id", "left")
    b, px = F.col("_b"), F.col("_px")
    note = A.coverage_note(F.col("measured_dishes"), F.col("captured_dishes"))
    portion = A.portion_text(b["display_name"], b["pixels_per_portion"], b["pixels_wasted"], b["portions_served"], b["portions_source"], note, F.col("_missing"), F.col("_unserved") > 0)
    pixel = A.pixel_text(F.col("meal_label"), F.col("counted_count"), F.col("excluded_count"), F.col("_px_name"), px["share_percent"], px["pixels_wasted"], F.col("pixels_wasted"))
    return df.select(
        "service_id", "hall_id", "service_date", "meal_label", "capture_count", "counted_count", "pixels_wasted", "attendance", "pixels_per_attendee", "measured_dishes",
        F.when(b.isNotNull(), portion).otherwise(pixel).alias("tip"),
    )


def daily(store: Store, start: str, end: str, hall: str | None = None) -> DataFrame:
    """Q-5."""
    w = store.in_window(start, end, hall)
    summary = S.pixel_summary(w.services, S.pixel_captures(w.captures, w.attempts), w.measurements)
    return S.daily_pixels(summary, S.plate_waste_percent(w.captures, w.counted_rows()), w.services, start, end)


def cards(store: Store, today: str, hall: str | None = None) -> DataFrame:
    """Q-6: the previous windows never start before 31 days ahead of the month."""
    import datetime

    start = datetime.date.fromisoformat(today).replace(day=1) - datetime.timedelta(days=31)
    return S.period_cards(daily(store, start.isoformat(), today, hall), today)


def plates(store: Store, start: str, end: str, hall: str | None = None) -> DataFrame:
    """Q-7: each plate with its percent and its foods (one plate's foods are nested in its row)."""
    w = store.in_window(start, end, hall)
    names = w.items.select("menu_id", "item_id", "display_name")
    rows = w.counted_rows()
    own = w.captures.select("event_id", "service_id").join(w.services.select("service_id", "menu_id"), "service_id")
    full = F.when(F.col("baseline_area_px") > 0, F.col("baseline_area_px"))
    percent = js_round(F.least(F.lit(100.0), F.try_divide(100.0 * F.col("remaining_area_px"), full)), 1)
    food = F.struct(
        "measurement_id", "item_id",
        F.when(F.col("item_id").isNull(), F.lit("Unknown food")).otherwise(F.coalesce("display_name", readable_item_name("item_id"))).alias("name"),
        F.col("remaining_area_px").alias("leftover_px"), full.alias("full_serving_px"),
        F.when(full.isNotNull(), percent).alias("percent_of_serving"), F.col("quality_flags").alias("flags"),
    )
    foods = rows.join(own, "event_id").join(names, ["menu_id", "item_id"], "left").groupBy("event_id").agg(F.array_sort(F.collect_list(food)).alias("foods"))
    return S.plate_waste_percent(w.captures, rows).join(foods, "event_id", "left").select(
        "event_id", "service_id", "captured_at", "source", "state", "image_object_id", "plate_waste_percent", "foods"
    )


def service_summary(store: Store) -> DataFrame:
    """Q-8."""
    return S.state_summary(store.captures, store.measurements, store.services, store.attempts, store.attendance)


def capture_gallery(store: Store, start: str, end: str, limit: int, hall: str | None = None, hidden: bool = False) -> DataFrame:
    """Q-9: newest plates with the pixels the totals count, or why they are not counted."""
    w = store.in_window(start, end, hall, hidden)
    page = P.newest_page(w.captures.select("event_id", "captured_at", "service_id", "source", "state", "hall_id"), limit)
    scored, caps = w.scored()
    px = scored.groupBy("event_id").agg(F.sum("pixels").alias("_px"), F.sum("grams").alias("grams"))
    seg = P.counted_attempts(w.attempts).select(
        "event_id", F.col("count_status").isin("complete", "empty").alias("_seg"), (F.col("overlay_object_id").isNotNull()).alias("_ov"), "calibration_id", "physical_method"
    )
    last = P.latest_attempts(w.attempts).select("event_id", F.col("overlay_object_id").isNotNull().alias("_lov"))
    df = page.join(caps.select("event_id", "analyzed"), "event_id", "left").join(px, "event_id", "left").join(seg, "event_id", "left").join(last, "event_id", "left")
    done = F.col("state") == "succeeded"
    shown = done & F.coalesce("_seg", F.lit(False))
    return df.select(
        "event_id", "captured_at", "service_id", "source", "state", "total",
        F.when(shown & F.col("analyzed"), F.coalesce("_px", F.lit(0))).alias("pixels_wasted"),
        F.when(shown & ~F.col("analyzed"), F.lit("not_counted")).alias("not_counted_reason"),
        F.when(shown, F.col("grams")).alias("grams"),
        F.coalesce(F.when(done, F.col("_ov")), F.col("_lov"), F.lit(False)).alias("has_overlay"),
        F.when(done, F.col("calibration_id")).alias("calibration_id"),
        F.when(done, F.col("physical_method")).alias("physical_method"),
    )


def portion_benchmark(store: Store) -> DataFrame:
    """Q-10."""
    return S.portion_benchmark(store.services, store.items, store.captures, store.counted_rows(), store.portions)[0]


def recommendation(store: Store, start: str, end: str, hall: str | None = None) -> dict[str, DataFrame]:
    """Q-11: facts, allowed metrics, trend and the rule-based text of a window."""
    w = store.in_window(start, end, hall)
    scored, caps = w.scored()
    scored, caps = materialize(scored), materialize(caps)
    foods = materialize(I.food_rows(scored, w.portions))
    totals = I.totals_by(scored, caps, [])
    facts = materialize(A.top_facts(foods))  # at most sixteen rows
    return {
        "facts": facts,
        "allowed": A.allowed_metrics(totals, facts),
        "trend": I.trend_halves(scored, caps, start, end),
        "fallback": A.impact_text(totals, facts, I.coverage(foods)),
    }


def saved_recommendations(insights: DataFrame, views: DataFrame) -> DataFrame:
    """Q-12: readable saved recommendations made after the hall's cutoff."""
    body = F.from_json("recommendation", V.RECOMMENDATION_SCHEMA)
    cut = views.select("hall_id", F.col("cleared_at").alias("_cut"))
    return (
        insights.filter(F.col("kind") == "impact-recommendation")
        .join(cut, "hall_id", "left")
        .filter(F.col("_cut").isNull() | (F.col("generated_at") >= F.col("_cut")))
        .withColumn("_b", body)
        .filter(F.col("_b.text").isNotNull())
        .select(
            "insight_id", "hall_id", F.col("_b.text").alias("text"), F.size("_b.bullets").alias("bullets"),
            F.when(F.col("source") == "gemini", F.lit("gemini")).otherwise(F.lit("fallback")).alias("source"), "generated_at",
        )
    )


def admin_captures(store: Store, start: str, end: str, limit: int, hall: str | None = None) -> DataFrame:
    """Q-13: newest plates, hidden ones included and marked, with the total and whether it was cut."""
    w = store.in_window(start, end, hall, hidden=True)
    page = P.newest_page(w.captures.select("event_id", "captured_at", "state"), limit)
    marks = store.visibility.filter("hidden").select("event_id", F.lit(True).alias("_h"))
    return page.join(marks, "event_id", "left").select(
        "event_id", "captured_at", "state", F.coalesce("_h", F.lit(False)).alias("hidden"), "total", (F.col("total") > limit).alias("truncated")
    )


def capture_detail(store: Store) -> DataFrame:
    """Q-15: every event with its attempts, counted attempt and counted measurements."""
    base = J.with_attempts(store.captures, store.attempts)
    n = store.attempts.groupBy("event_id").agg(F.count(F.lit(1)).alias("attempts"))
    m = store.counted_rows().groupBy("event_id").agg(F.count(F.lit(1)).alias("_m"))
    return base.join(n, "event_id", "left").join(m, "event_id", "left").select(
        "event_id", "state", "counted_attempt_id", "latest_status", F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(F.col("counted_attempt_id").isNotNull(), F.coalesce("_m", F.lit(0))).otherwise(F.lit(0)).alias("measurements"),
    )


def nested_capture_detail(store: Store) -> DataFrame:
    """Q-15: every event with all its attempts (oldest first), the counted one's id and its measurements (by id).

    Attempts and measurements are whole rows, in the order of their columns where ids repeat; an event
    that has not succeeded counts nothing.
    """
    base = J.with_attempts(store.captures, store.attempts).drop("latest_attempt_id", "latest_status")

    def nested(df: DataFrame, name: str, *first: str) -> DataFrame:
        row = F.struct(*first, *[c for c in df.columns if c not in ("event_id", *first)])
        return df.groupBy("event_id").agg(F.array_sort(F.collect_list(row)).alias(name))

    attempts = nested(store.attempts, "attempts", "created_at", "attempt_id")
    rows = nested(store.counted_rows(), "measurements", "measurement_id")
    none = {name: F.array().cast(df.schema[name].dataType) for df, name in ((attempts, "attempts"), (rows, "measurements"))}
    out = base.join(attempts, "event_id", "left").join(rows, "event_id", "left")
    counts = F.col("counted_attempt_id").isNotNull()
    return out.withColumns(
        {
            "attempts": F.coalesce("attempts", none["attempts"]),
            "measurements": F.coalesce(F.when(counts, F.col("measurements")), none["measurements"]),
        }
    )


def calibration_list(calibrations: DataFrame, newest: list[str]) -> DataFrame:
    """Q-16."""
    return P.newest_first(calibrations, newest)


def measurement_settings(halls: DataFrame, settings: DataFrame) -> DataFrame:
    """Q-16: each hall's settings, with the default where none are stored."""
    return halls.select("hall_id").join(settings.select("hall_id", "active_calibration_id", "updated_at"), "hall_id", "left").withColumn(
        "updated_at", F.coalesce("updated_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    )


