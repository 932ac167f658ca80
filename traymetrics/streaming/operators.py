"""T-1 to T-10 as streaming transformations (input and output are streaming DataFrames)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from traymetrics.operators.frames import CLOSE_GRACE_MS, DISH_STATE, FRAME, PREFILTER_MAD, dish_roles, dish_state, next_closes
from traymetrics.operators.joins import asof_join
from traymetrics.session import materialize
from traymetrics.streaming.runner import Step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame_sessions(frames: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """T-4: gap sessions per camera, emitted when the watermark passes them."""
    return (
        frames.withWatermark("captured_at", watermark)
        .groupBy("camera_id", F.session_window("captured_at", gap))
        .agg(F.count(F.lit(1)).alias("frames"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))
        .select("camera_id", "first_at", "last_at", "frames")
    )


def dedupe_events(events: DataFrame, watermark: str, ts: str = "captured_at", key: str = "event_id") -> DataFrame:
    """T-5: the same event id never makes a second observation."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def latest_state(changes: DataFrame) -> DataFrame:
    """T-6: last state per event (update mode)."""
    return changes.groupBy("event_id").agg(F.max_by("state", F.struct("changed_at", "change_id")).alias("state"), F.max("changed_at").alias("changed_at"))


def stream_daily_pixels(rows: DataFrame, watermark: str = "1 day") -> DataFrame:
    """T-7: running totals per day (update mode); late rows inside the watermark correct their day."""
    return (
        rows.withWatermark("captured_at", watermark)
        .groupBy(F.window("captured_at", "1 day"))
        .agg(F.sum("pixels").alias("pixels"), F.count(F.lit(1)).alias("plates"))
        .select(F.to_date("window.start").alias("date"), "pixels", "plates")
    )


def stream_sliding_pixels(rows: DataFrame, size: str = "7 days", slide: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """T-8: totals of sliding windows (update mode)."""
    return (
        rows.withWatermark("captured_at", watermark)
        .groupBy(F.window("captured_at", size, slide))
        .agg(F.sum("pixels").alias("pixels"), F.count(F.lit(1)).alias("plates"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "pixels", "plates")
    )


def stream_provider_outcomes(attempts: DataFrame, codes: list[str]) -> DataFrame:
    """T-9: per provider, the latest success and the latest operator failure (update mode)."""
    ok = F.col("status") == "succeeded"
    bad = ~ok & F.col("error_code").isin(codes)
    df = attempts.groupBy("provider").agg(
        F.max(F.when(ok, F.col("at"))).alias("last_success"), F.max(F.when(bad, F.col("at"))).alias("last_failure"), F.max_by("error_code", F.when(bad, F.struct("at", "error_code"))).alias("_code")
    )
    down = F.col("last_failure").isNotNull() & (F.col("last_success").isNull() | (F.col("last_failure") > F.col("last_success")))
    return df.select("provider", F.coalesce(~down, F.lit(True)).alias("ok"), F.when(down, F.col("_code")).alias("code"), "last_success", "last_failure")


def closed_groups(log: DataFrame) -> DataFrame:
    """T-2: the closed groups of a landed dish log; frames that joined after the close count as late.

    A group ends at the first of its closings. Its representative is the member in the middle; its
    members are read here and never rewritten by a batch.
    """
    keys = ["camera_id", "group_id"]
    on_time = F.col("role").isin("opened", "joined")
    groups = log.filter(on_time | (F.col("role") == "late")).groupBy(*keys).agg(F.count_if(on_time).alias("members"), F.count_if(~on_time).alias("late_members"), F.count_if("unsure").alias("unsure_merges"))
    when = F.struct("captured_at", "capture_id")
    closed = log.filter("role = 'closed'").groupBy(*keys).agg(F.max("service_id").alias("service_id"), F.min_by("closed_by", when).alias("closed_by"))
    groups = groups.join(closed, keys)
    place = F.floor((F.col("members") - 1) / 2) + 1
    middle = log.filter(on_time).select(*keys, F.col("capture_id").alias("representative"), "place").join(groups.select(*keys, place.alias("place")), [*keys, "place"])
    return groups.join(middle.drop("place"), keys).select(*keys, "service_id", "members", "late_members", "unsure_merges", "closed_by", "representative")


DISH_LOG = "camera_id string, capture_id string, captured_at timestamp, service_id string, group_id string, role string, place long, unsure boolean, closed_by string"
DISH_TABLES = {"rows": DISH_LOG, "state": DISH_STATE, "waiting": FRAME, "seen": "camera_id string, seen timestamp"}


def dish_step(delay_ms: int, grace_ms: int = CLOSE_GRACE_MS, prefilter_mad: float = PREFILTER_MAD, idle_ms: int | None = None) -> Step:
    """T-2, for each batch of a frame stream: rows of DISH_LOG, and what is carried to the next batch.

    Frames may come out of order by ``delay_ms``: a camera's frames are settled, in order of time, once
    it has sent one that much later (all of them where the step is told to flush). A frame without its
    verdict holds back its camera's later ones until it is sent again with one. A frame older than what
    is settled is logged as too_late and changes nothing. With ``idle_ms`` an open group also closes
    when its camera has been silent that long, by the newest frame of all cameras.

    The work of a batch is that of the batch twin over its frames, with ordered chunks, so a camera with
    a third of all frames is spread; from the past there is a row a camera and the frames that wait.
    """

    def step(batch: DataFrame, carried: dict[str, DataFrame], flush: bool) -> dict[str, DataFrame]:
        columns = [f.split()[0] for f in FRAME.split(", ")]
        rest = [c for c in columns if c not in ("camera_id", "capture_id")]
        seen = carried["seen"].union(batch.groupBy("camera_id").agg(F.max("captured_at"))).groupBy("camera_id").agg(F.max("seen").alias("seen"))
        # a frame sent twice is one; the delivery that knows more counts
        knows = F.struct(F.col("plate_visible").isNotNull(), F.col("same_dish").isNotNull(), F.col("mad").isNotNull())
        pool = carried["waiting"].unionByName(batch.select(*columns)).groupBy("camera_id", "capture_id").agg(F.max_by(F.struct(*rest), knows).alias("r")).select("camera_id", "capture_id", "r.*")
        place = F.struct("captured_at", "capture_id")
        done = carried["state"].select("camera_id", place.alias("_done"))
        ready = F.lit(True) if flush else F.col("captured_at").cast("double") <= F.col("seen").cast("double") - delay_ms / 1000.0
        pool = materialize(pool.join(done, "camera_id", "left").join(seen, "camera_id", "left").select(*columns, F.coalesce(place <= F.col("_done"), F.lit(False)).alias("_late"), ready.alias("_ready")))
        roles = dish_roles(pool.filter("_ready AND NOT _late").select(*columns), grace_ms, prefilter_mad, carried["state"])
        state = dish_state(roles)
        settled = state.select("camera_id", place.alias("_done"))
        waiting = pool.filter("NOT _late").join(settled, "camera_id", "left").filter(F.col("_done").isNull() | (place > F.col("_done"))).select(*columns)
        log = ["camera_id", "capture_id", "captured_at", "service_id"]
        no = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
        closing = lambda df, why: df.select(*log, "group_id", F.lit("closed").alias("role"), no("place", "long"), no("unsure", "boolean"), why.alias("closed_by"))
        on_time = F.col("role").isin("opened", "joined")
        out = roles.filter("role <> 'carried'").select(*log, F.when(F.col("role") != "no_plate", F.col("group_id")).alias("group_id"), "role", F.when(on_time, F.col("_i")).alias("place"), F.col("_unsure").alias("unsure"), no("closed_by"))
        out = out.union(closing(roles.filter("_closes IS NOT NULL AND _closed = 1").withColumn("service_id", F.col("_group.service")), F.col("_closes")))
        out = out.union(closing(next_closes(roles), F.col("_next")))
        out = out.union(pool.filter("_late").select(*log, no("group_id"), F.lit("too_late").alias("role"), no("place", "long"), no("unsure", "boolean"), no("closed_by")))
        if idle_ms is not None:
            state = materialize(state)
            now = seen.agg(F.max("seen").alias("_now"))  # one row
            silent = F.col("dish").isNotNull() & (F.col("closed") == 0) & (F.col("captured_at").cast("double") <= F.col("_now").cast("double") - idle_ms / 1000.0)
            state = state.crossJoin(F.broadcast(now)).withColumn("_idle", F.coalesce(silent, F.lit(False)))
            out = out.union(closing(state.filter("_idle").withColumn("group_id", F.col("dish.id")).withColumn("service_id", F.col("dish.service")), F.lit("idle")))
            state = state.withColumn("closed", F.when(F.col("_idle"), 1).otherwise(F.col("closed")).cast("long")).drop("_idle", "_now")
        return {"rows": out, "state": state, "waiting": waiting, "seen": seen}

    return step


class Succeeded(StatefulProcessor):
    """T-5 per event id: whether it had succeeded before this batch. No rows are held."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        ok = False
        for part in rows:
            ok = ok or bool(part["ok"].any())
            yield part
        if ok:
            self.done.update((True,))

    def close(self) -> None:
        pass


def unfinished_deliveries(deliveries: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """T-5: deliveries (event_id, at, row_id, ok) of events that have not succeeded in an earlier batch.

    Keyed state looks up only the ids of the batch; with ``keep_ms`` an id is forgotten after that time.
    """
    mode = "ProcessingTime" if keep_ms is not None else "None"
    return deliveries.groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=Succeeded(keep_ms), outputStructType=deliveries.schema, outputMode="Append", timeMode=mode
    )


def ingest_attempts(batch: DataFrame) -> DataFrame:
    """T-5, for each batch of ``unfinished_deliveries``: the attempts to add (event_id, at, row_id, ok).

    A delivery after the event's first success is a replay and adds nothing; a failed event that comes
    again adds an attempt. The first success is combined before the shuffle, so an event that is
    delivered over and over stays one row.
    """
    first_ok = batch.filter("ok").groupBy("event_id").agg(F.min(F.struct("at", "row_id")).alias("_ok"))
    fresh = batch.join(first_ok, "event_id", "left")
    return fresh.filter(F.col("_ok").isNull() | (F.struct("at", "row_id") <= F.col("_ok"))).select("event_id", "at", "row_id", "ok")


FOCUS_ROWS = "camera_id string, chunk long, kind string, capture_id string, captured_at timestamp, cal_id string, seq long"


BUCKETS = 1024  # of cameras: keys of T-10 in a stretch, at most


class FocusChunk(StatefulProcessor):
    """T-10 per bucket of cameras and stretch of time: their calibrations and frames.

    A calibration that comes late corrects the frames after it that the stretch already has. State is read
    and written by the pack (what one call brings), not row by row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cals = handle.getMapState("cals", "pack long", "camera array<string>, at array<long>, id array<string>")
        self.frames = handle.getMapState("frames", "pack long", "camera array<string>, at array<long>, id array<string>, cal array<string>")
        self.info = handle.getValueState("info", "last_frame long, seq long, packs long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        _, chunk = key
        last, seq, packs = self.info.get() if self.info.exists() else (-(1 << 62), 0, 0)
        known: dict[str, list] = {}
        for camera, *cal in {c for _, pack in self.cals.iterator() for c in zip(*pack)} if packs else ():
            known.setdefault(camera, []).append(tuple(cal))
        for cals in known.values():
            cals.sort()

        def newest(camera: str, at: int) -> str | None:
            cals = known.get(camera, ())
            return cals[k - 1][1] if (k := bisect_right(cals, (at, chr(0x10FFFF)))) else None

        for part in rows:
            out = []
            times = pd.to_datetime(part["captured_at"]).astype("datetime64[us]").astype("int64").tolist()
            both = list(zip(part["kind"].tolist(), part["camera_id"].tolist(), times, part["capture_id"].tolist()))
            cals = [row[1:] for row in both if row[0] == "calibration"]
            if cals:
                self.cals.updateValue((packs,), tuple(map(list, zip(*cals))))
                since: dict[str, int] = {}
                for camera, at, i in cals:
                    since[camera] = min(at, since.get(camera, at))
                    known.setdefault(camera, []).append((at, i))
                for camera in since:
                    known[camera] = sorted(set(known[camera]))
                if min(since.values()) <= last:
                    out += self._corrected(since, newest)
                out += [("head", camera, known[camera][-1][0], known[camera][-1][1], known[camera][-1][1]) for camera in since]
            frames = [("frame", camera, at, i, newest(camera, at)) for kind, camera, at, i in both if kind != "calibration"]
            if frames:
                self.frames.updateValue((packs,), tuple(map(list, list(zip(*frames))[1:])))
                out += frames
                last = max(last, max(f[2] for f in frames))
            packs += 1
            kinds, cameras, ats, ids, cal_ids = zip(*out)
            made = {"camera_id": cameras, "chunk": chunk, "kind": kinds, "capture_id": ids, "captured_at": pd.to_datetime(list(ats), unit="us"), "cal_id": cal_ids, "seq": range(seq, seq + len(out))}
            seq += len(out)
            yield pd.DataFrame(made)
        self.info.update((last, seq, packs))

    def _corrected(self, since: dict[str, int], newest: Callable[[str, int], str | None]) -> list[tuple]:
        """Rows of the cameras' frames from ``since`` on whose calibration is another one now; a frame sent again counts as sent last."""
        packs = sorted((n, [list(c) for c in pack]) for (n,), pack in self.frames.iterator())
        sent_last = {(camera, i): (n, k) for n, (cameras, _, ids, _) in packs for k, (camera, i) in enumerate(zip(cameras, ids)) if camera in since}
        out = []
        for n, (cameras, ats, ids, cal_ids) in packs:
            before = len(out)
            for k, (camera, at, i) in enumerate(zip(cameras, ats, ids)):
                if camera in since and at >= since[camera] and sent_last[camera, i] == (n, k) and newest(camera, at) != cal_ids[k]:
                    cal_ids[k] = newest(camera, at)
                    out.append(("frame", camera, at, i, cal_ids[k]))
            if len(out) > before:
                self.frames.updateValue((n,), (cameras, ats, ids, cal_ids))
        return out

    def close(self) -> None:
        pass


def focus_rows(frames: DataFrame, calibrations: DataFrame, chunk_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """T-10: FOCUS_ROWS of a frame stream and a calibration stream (camera_id, capture_id, captured_at).

    State is keyed by bucket of cameras and stretch of ``chunk_seconds``, so many quiet cameras are few keys,
    a busy camera spreads over its stretches and a late calibration touches one of them. A frame row tells
    the newest calibration of its stretch at or before it, and comes again when that changes; a head row
    tells the newest calibration of the whole stretch. Needs the RocksDB state store.
    """
    chunk = F.floor(F.col("captured_at").cast("double") / chunk_seconds).cast("long")
    both = frames.withColumn("kind", F.lit("frame")).unionByName(calibrations.withColumn("kind", F.lit("calibration"))).withColumn("chunk", chunk)
    both = both.withColumn("bucket", F.pmod(F.xxhash64("camera_id"), F.lit(buckets)))
    return both.groupBy("bucket", "chunk").transformWithStateInPandas(statefulProcessor=FocusChunk(), outputStructType=StructType.fromDDL(FOCUS_ROWS), outputMode="Append", timeMode="None")


def focus_join(log: DataFrame) -> DataFrame:
    """T-10: the newest calibration at or before every frame (null without one), of a landed log of ``focus_rows``.

    Frames before the first calibration of their stretch take that of the latest stretch before it (J-9).
    """
    newest = lambda kind, *keys: log.filter(F.col("kind") == kind).groupBy(*keys).agg(F.max_by(F.struct("capture_id", "captured_at", "cal_id"), F.struct("_batch", "seq")).alias("r"))
    frames = newest("frame", "camera_id", "chunk", "capture_id").select("camera_id", "chunk", F.col("r.capture_id").alias("capture_id"), "r.captured_at", "r.cal_id")
    heads = newest("head", "camera_id", "chunk").select("camera_id", "r.captured_at", F.col("r.capture_id").alias("capture_id"), "r.cal_id")
    open_ = frames.filter("cal_id IS NULL").select("camera_id", "captured_at", F.col("capture_id").alias("row_id"))
    hit = asof_join(open_, heads, ["camera_id"], "captured_at", "capture_id", ["cal_id"]).select("camera_id", F.col("row_id").alias("capture_id"), "captured_at", "cal_id")
    return frames.filter("cal_id IS NOT NULL").select("camera_id", "capture_id", "captured_at", "cal_id").unionByName(hit)
