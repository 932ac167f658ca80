"""Frame sequences in batch: differences, dish groups, runs of days, focus checks, provider status.

Order-dependent steps use range chunks (``ordering``), so a camera with a third of all frames is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traymetrics.functions.geometry import mean_abs_diff
from traymetrics.operators.joins import asof_join
from traymetrics.operators.ordering import Last, Total, drop_chunks, ordered_chunks, previous_value, running_sum, scan
from traymetrics.session import materialize

# fixed values
PREFILTER_MAD = 4.0
CLOSE_GRACE_MS = 3000
OPERATOR_CODES = ["GEMINI_BILLING"]


def frame_difference(frames: DataFrame) -> DataFrame:
    """W-14: mean absolute difference of each frame's fingerprint to the camera's previous frame."""
    c = ordered_chunks(frames, F.col("camera_id"), F.col("captured_at"), F.col("capture_id"))
    c = previous_value(c, ["camera_id"], F.col("fingerprint"), "_prev")
    return drop_chunks(c.withColumn("mad", mean_abs_diff("fingerprint", "_prev")).drop("_prev"))


def middle_member(members: DataFrame, keys: list[str], order: list[str], id_col: str, name: str = "representative") -> DataFrame:
    """W-15: the member at index floor((n - 1) / 2) of each group."""
    c = ordered_chunks(members, *[F.col(k) for k in keys], *[F.col(o) for o in order])
    c = running_sum(c, keys, F.lit(1), "_i")
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return c.join(sizes, keys).filter(F.col("_i") == F.floor((F.col("_n") - 1) / 2) + 1).select(*keys, F.col(id_col).alias(name))


def manual_frames_only(frames: DataFrame) -> DataFrame:
    """T-3: without dedupe every manual frame is its own dish; interval frames are skipped."""
    return frames.filter(F.col("trigger") != "interval").withColumn("group_id", F.col("capture_id"))


FRAME = "camera_id string, capture_id string, captured_at timestamp, service_id string, mad double, plate_visible boolean, same_dish string"
CARRIED = "plate boolean, last_plate string, dish struct<id: string, service: string>, plate_at timestamp, closed long, members long"
DISH_STATE = f"camera_id string, captured_at timestamp, capture_id string, service_id string, {CARRIED}"


def dish_roles(frames: DataFrame, grace_ms: int, prefilter_mad: float, carried: DataFrame | None = None) -> DataFrame:
    """The scans of T-2 over frames in camera order: group, role, closing and place of every frame.

    ``carried`` (DISH_STATE) says where each camera stood after its last earlier frame. It joins the
    scans as a row before the camera's frames that hands over values and has no role; everything a
    frame needs from the past is in that one row, however long a group has been open. Frames from a
    camera's first missing verdict on are left out.
    """
    cam, grp = ["camera_id"], ["camera_id", "group_id"]
    if carried is not None:
        state = F.struct(*[F.col(f.split()[0]) for f in CARRIED.replace("<id: string, service: string>", "").split(", ")])
        before = carried.select("camera_id", "capture_id", "captured_at", "service_id", state.alias("_carried"))
        frames = frames.unionByName(before, allowMissingColumns=True)
    is_carried = F.lit(False) if carried is None else F.col("_carried").isNotNull()
    handed = lambda field, value: value if carried is None else F.when(is_carried, F.col(f"_carried.{field}")).otherwise(value)
    c = ordered_chunks(frames, F.col("camera_id"), F.col("captured_at"), F.col("capture_id"))
    c = previous_value(c, cam, F.col("service_id"), "_prev_service")
    unchanged = F.coalesce((F.col("mad") < prefilter_mad) & (F.col("_prev_service") == F.col("service_id")), F.lit(False))
    c = c.withColumn("_follows", unchanged)
    missing = (~F.col("_follows") & F.col("plate_visible").isNull() & ~is_carried).cast("int")
    c = scan(c, cam, Total("_missing", missing), Last("_plate", handed("plate", F.when(~F.col("_follows"), F.col("plate_visible"))), inclusive=True))
    c = c.filter("_missing = 0")
    c = scan(c, cam, Last("_last_plate", handed("last_plate", F.when(F.col("_plate"), F.col("service_id")))))
    new_dish = (F.col("same_dish") == "different") | F.col("_last_plate").isNull() | (F.col("_last_plate") != F.col("service_id"))
    c = c.withColumn("_opens", ~F.col("_follows") & F.col("_plate") & F.coalesce(new_dish, F.lit(False)) & ~is_carried)
    opener = handed("dish", F.when(F.col("_opens"), F.struct(F.col("capture_id").alias("id"), F.col("service_id").alias("service"))))
    c = materialize(scan(c, cam, Last("_group", opener, inclusive=True), Last("_before", opener)).withColumn("group_id", F.col("_group.id")))
    c = scan(c, grp, Last("_plate_at", handed("plate_at", F.when(F.col("_plate"), F.col("captured_at"))), inclusive=True))
    gap = F.col("captured_at").cast("double") - F.col("_plate_at").cast("double") >= grace_ms / 1000.0
    changed = F.col("service_id") != F.col("_group.service")
    reason = F.when(F.col("group_id").isNotNull() & ~is_carried, F.when(changed, F.lit("service_change")).when(~F.col("_plate") & gap, F.lit("gap")))
    c = c.withColumn("_closes", reason)
    c = scan(c, grp, Total("_closed", handed("closed", F.col("_closes").isNotNull().cast("long"))))
    member = F.coalesce(F.col("_plate") & F.col("group_id").isNotNull(), F.lit(False))
    role = F.when(is_carried, F.lit("carried")).when(~member, F.lit("no_plate")).when(F.col("_opens"), F.lit("opened")).when(F.col("_closed") > 0, F.lit("late")).otherwise(F.lit("joined"))
    c = c.withColumn("role", role).withColumn("_unsure", member & ~is_carried & ~F.col("_follows") & ~F.col("_opens") & F.coalesce(F.col("same_dish") == "unsure", F.lit(False)))
    return materialize(scan(c, grp, Total("_i", handed("members", F.col("role").isin("opened", "joined").cast("long")))))


def dish_state(roles: DataFrame) -> DataFrame:
    """DISH_STATE of every camera after its last frame in ``roles``."""
    last_plate = F.coalesce(F.when(F.col("role") == "carried", F.col("_carried.last_plate")).when(F.col("_plate"), F.col("service_id")), F.col("_last_plate"))
    state = F.struct("captured_at", "capture_id", "service_id", F.col("_plate").alias("plate"), last_plate.alias("last_plate"), F.col("_group").alias("dish"), F.col("_plate_at").alias("plate_at"), F.col("_closed").alias("closed"), F.col("_i").alias("members"))
    return roles.groupBy("camera_id").agg(F.max_by(state, F.struct("captured_at", "capture_id")).alias("s")).select("camera_id", "s.*")


def next_closes(roles: DataFrame) -> DataFrame:
    """(camera_id, group_id, service_id, _next, captured_at, capture_id): the group that each opener ends, and why, if nothing ended it before."""
    changed = F.when(F.col("_before.service") != F.col("service_id"), F.lit("service_change")).otherwise(F.lit("different"))
    ends = roles.filter(F.col("_opens") & F.col("_before").isNotNull())
    return ends.select("camera_id", F.col("_before.id").alias("group_id"), F.col("_before.service").alias("service_id"), changed.alias("_next"), "captured_at", "capture_id")


def group_dishes(frames: DataFrame, grace_ms: int = CLOSE_GRACE_MS, prefilter_mad: float = PREFILTER_MAD) -> tuple[DataFrame, DataFrame]:
    """T-2 batch twin: (frames with their group and role, one row per dish group).

    ``frames`` has camera_id, capture_id, captured_at, service_id, mad (difference to the previous
    frame, null if none), plate_visible and same_dish (same, different, unsure). A frame whose mad is
    below the limit follows the previous frame of its service; any other frame needs a verdict, and
    frames from the first missing verdict on are held back. A group closes on a different dish, on a
    no-plate frame at least ``grace_ms`` after its last plate, or on a service change; a frame that
    joins a closed group is late and never reopens it.
    """
    grp = ["camera_id", "group_id"]
    out = drop_chunks(dish_roles(frames, grace_ms, prefilter_mad))
    on_time = F.col("role").isin("opened", "joined")

    when = F.struct("captured_at", "capture_id")
    groups = out.filter(F.col("group_id").isNotNull()).groupBy(*grp).agg(
        F.max("_group.service").alias("service_id"),
        F.count_if(on_time).alias("members"),
        F.count_if(F.col("role") == "late").alias("late_members"),
        F.count_if("_unsure").alias("unsure_merges"),
        F.min_by("_closes", F.when(F.col("_closes").isNotNull(), when)).alias("_closed_by"),
    )
    followed = next_closes(out).select("camera_id", "group_id", "_next")
    middle = out.filter(on_time).select(*grp, "capture_id", "_i").join(groups.select(*grp, "members"), grp)
    middle = middle.filter(F.col("_i") == F.floor((F.col("members") - 1) / 2) + 1).select(*grp, F.col("capture_id").alias("representative"))
    groups = (
        groups.join(followed, grp, "left")
        .join(middle, grp, "left")
        .select(*grp, "service_id", "members", "late_members", "unsure_merges", F.coalesce("_closed_by", "_next").alias("closed_by"), "representative")
    )
    return out.select("camera_id", "capture_id", "captured_at", "service_id", F.when(F.col("role") != "no_plate", F.col("group_id")).alias("group_id"), "role"), groups


def gap_sessions(frames: DataFrame, gap_seconds: float) -> DataFrame:
    """T-4 batch twin: sessions of frames no further apart than the gap, per camera."""
    c = ordered_chunks(frames, F.col("camera_id"), F.col("captured_at"), F.col("capture_id"))
    c = previous_value(c, ["camera_id"], F.col("captured_at"), "_prev")
    far = F.col("captured_at").cast("double") - F.col("_prev").cast("double") >= gap_seconds
    c = running_sum(c, ["camera_id"], F.when(F.col("_prev").isNull() | far, 1).otherwise(0), "session")
    return c.groupBy("camera_id", "session").agg(
        F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"), F.count(F.lit(1)).alias("frames")
    )


def runs_of_data(daily: DataFrame, key: list[str], date: str, value: str) -> DataFrame:
    """W-13: runs of consecutive dates with a value; a missing or null day ends a run.

    Consecutive dates minus their position are constant inside a run, so one running count is enough.
    """
    have = daily.filter(F.col(value).isNotNull())
    c = ordered_chunks(have, *[F.col(k) for k in key], F.col(date))
    c = c.withColumn("_all", F.lit(1))
    c = running_sum(c, [*key, "_all"], F.lit(1), "_i")
    return drop_chunks(c).withColumn("_anchor", F.date_sub(F.col(date), F.col("_i").cast("int"))).groupBy(*key, "_anchor").agg(
        F.min(date).alias("run_start"), F.max(date).alias("run_end"), F.count(F.lit(1)).alias("days"), F.sum(value).alias("total")
    ).drop("_anchor")


def focus_warnings(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """V-23: dish frames whose focus is unlocked, or locked at another position than the newest calibration frame.

    ``frames`` has row_id, camera_id, captured_at, focus_lock, focus_absolute, simulated;
    ``calibrations`` has camera_id, captured_at, capture_id, focus_lock, focus_absolute.
    """
    cal = calibrations.filter(F.col("focus_lock").isNotNull()).select(
        "camera_id", "captured_at", "capture_id", F.col("focus_lock").alias("cal_lock"), F.col("focus_absolute").alias("cal_absolute")
    )
    hit = asof_join(frames.select("row_id", "camera_id", "captured_at"), cal, ["camera_id"], "captured_at", "capture_id", ["cal_lock", "cal_absolute"])
    df = frames.withColumn("row_id", F.col("row_id").cast("string")).join(hit.select("row_id", "cal_lock", "cal_absolute"), "row_id", "left")
    warning = F.when(F.col("focus_lock") != "locked", F.lit("not_locked")).when(
        (F.col("cal_lock") == "locked") & ~F.col("cal_absolute").eqNullSafe(F.col("focus_absolute")), F.lit("differs_from_calibration")
    )
    return df.filter(~F.col("simulated") & F.col("focus_lock").isNotNull()).withColumn("warning", warning).filter(F.col("warning").isNotNull())


def provider_status(attempts: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """T-9 batch: per provider, whether operator failures followed the latest success.

    ``attempts`` has provider, at, status, error_code. ``since`` is when the current code began.
    """
    ok = F.col("status") == "succeeded"
    last_ok = attempts.groupBy("provider").agg(F.max(F.when(ok, F.col("at"))).alias("_ok_at"))
    bad = (
        attempts.filter(~ok & F.col("error_code").isin(codes or OPERATOR_CODES))
        .join(last_ok, "provider")
        .filter(F.col("_ok_at").isNull() | (F.col("at") > F.col("_ok_at")))
    )
    now = bad.groupBy("provider").agg(F.max_by("error_code", F.struct("at", "error_code")).alias("code"), F.count(F.lit(1)).alias("failures"))
    other = bad.join(now.select("provider", "code"), "provider").filter(F.col("error_code") != F.col("code")).groupBy("provider").agg(F.max("at").alias("_other"))
    since = (
        bad.join(now.select("provider", "code"), "provider")
        .join(other, "provider", "left")
        .filter((F.col("error_code") == F.col("code")) & (F.col("_other").isNull() | (F.col("at") > F.col("_other"))))
        .groupBy("provider")
        .agg(F.min("at").alias("since"))
    )
    return last_ok.select("provider").join(now, "provider", "left").join(since, "provider", "left").select(
        "provider", F.col("code").isNull().alias("ok"), "code", "since", F.coalesce("failures", F.lit(0)).alias("failures")
    )
