"""Dish groups and ordered scans against a plain loop."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from traymetrics.operators import frames as R
from traymetrics.operators import ordering as O
from traymetrics.streaming import operators as S
from traymetrics.streaming.runner import land, land_carrying

FRAMES = "camera_id string, capture_id string, captured_at timestamp, service_id string, mad double, plate_visible boolean, same_dish string"
T0 = datetime.datetime(2026, 10, 3, 12)


def frames(rows):
    return [(c, f"{c}-{i:04d}", T0 + datetime.timedelta(seconds=s), svc, mad, plate, same) for i, (c, s, svc, mad, plate, same) in enumerate(rows)]


def plain_groups(rows, grace=3.0):
    """One camera at a time, by the stated rules."""
    out, state = {}, {}
    for cam, cid, at, svc, mad, plate, same in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        s = state.setdefault(cam, dict(open=None, last=None, prev=None, stop=False))
        if s["stop"]:
            continue
        follows = s["prev"] is not None and mad is not None and mad < 4 and s["prev"][0] == svc
        if not follows and plate is None:
            s["stop"] = True
            continue

        def close(why):
            if s["open"]:
                s["open"]["closed_by"] = why
                s["last"], s["open"] = s["open"], None

        if s["open"] and s["open"]["svc"] != svc:
            close("service_change")
        target = s["open"] or (s["last"] if s["last"] and s["last"]["svc"] == svc else None)
        if follows:
            target = s["prev"][1]
        elif not plate:
            target = None
        elif target is None or same == "different":
            close("different")
            g = dict(id=cid, svc=svc, members=[cid], at=at, late=0, unsure=0, closed_by=None)
            out[(cam, cid)] = s["open"] = g
            s["prev"] = (svc, g)
            continue
        elif same == "unsure":
            target["unsure"] += 1
        if target is None:
            if s["open"] and (at - s["open"]["at"]).total_seconds() >= grace:
                close("gap")
        elif target is s["open"]:
            target["members"].append(cid)
            target["at"] = at
        else:
            target["late"] += 1
        s["prev"] = (svc, target)
    return {k: (len(g["members"]), g["late"], g["unsure"], g["closed_by"], g["members"][(len(g["members"]) - 1) // 2]) for k, g in out.items()}


def batch(spark, rows):
    _, groups = R.group_dishes(spark.createDataFrame(rows, FRAMES))
    return {(g.camera_id, g.group_id): (g.members, g.late_members, g.unsure_merges, g.closed_by, g.representative) for g in groups.collect()}


def test_two_dishes_with_a_gap(spark):
    v = [(0, True), (1, False), (2, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False)]
    rows = frames([("c", s, "s", 9.0, p, "same") for s, p in v] + [("c", 9, "s", 9.0, True, "different")])
    assert batch(spark, rows) == {("c", "c-0000"): (2, 0, 0, "gap", "c-0000"), ("c", "c-0009"): (1, 0, 0, None, "c-0009")}


def test_middle_frame_represents(spark):
    rows = frames([("c", s, "s", 9.0, True, "same") for s in range(4)])
    assert batch(spark, rows) == {("c", "c-0000"): (4, 0, 0, None, "c-0001")}


def random_frames(seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for _ in range(150):
        t += rng.choice([0.5, 1, 2, 4])
        plate = None if rng.random() < 0.004 else rng.random() < 0.6
        rows.append((rng.choice("ab"), t, "s2" if 90 < t < 160 else "s1", rng.choice([None, 2.0, 9.0, 9.0]), plate, rng.choice(["same", "same", "different", "unsure"])))
    return frames(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_loop(spark, seed):
    rows = random_frames(seed)
    assert batch(spark, rows) == plain_groups(rows)


def stream_in_turn(spark, folder, schema, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def groups_of(log):
    return {(r.camera_id, r.group_id): (r.members, r.late_members, r.unsure_merges, r.closed_by, r.representative) for r in S.closed_groups(log).collect()}


@pytest.mark.parametrize("flush", [True, False])
def test_stream_settles_late_frames_in_order(spark, tmp_path, flush):
    """Three batches, every fifth frame one batch late; one camera has nine tenths of the frames."""
    rng = random.Random(3)
    rows = [r if rng.random() < 0.1 else ("a", *r[1:]) for r in random_frames(3)]
    rows = [(c, i, at, svc, mad, True if plate is None else plate, same) for c, i, at, svc, mad, plate, same in rows]
    cut = lambda k: min(2, k // 50 + (k % 5 == 0 and k % 50 > 40))  # noqa: E731  late by up to ten frames
    batches = [[r for k, r in enumerate(rows) if cut(k) == b] for b in range(3)]
    delay = 60_000
    log = land_carrying(stream_in_turn(spark, tmp_path / "in", FRAMES, *batches), S.dish_step(delay), S.DISH_TABLES, "test", flush)
    newest = {c: max(r[2] for r in rows if r[0] == c) for c in "ab"}
    settled = rows if flush else [r for r in rows if r[2] <= newest[r[0]] - datetime.timedelta(milliseconds=delay)]
    assert groups_of(log) == {k: v for k, v in plain_groups(settled).items() if v[3] is not None}
    assert log.filter("role NOT IN ('closed', 'too_late')").count() == len(settled) and log.filter("role = 'too_late'").count() == 0


def test_stream_waits_for_a_verdict_and_logs_what_comes_too_late(spark, tmp_path):
    rows = frames([("c", s, "s", 9.0, True if s != 3 else None, "different" if s == 5 else "same") for s in range(8)])
    again = [(c, i, at, svc, mad, False, "same") for c, i, at, svc, mad, plate, same in rows[3:4]]
    late = [("c", "c-late", T0 + datetime.timedelta(seconds=1.5), "s", 9.0, True, "different")]
    step, done = S.dish_step(0), []

    def spy(batch, carried, flush):
        done.append({k: v.count() for k, v in carried.items()})
        return step(batch, carried, flush)

    log = land_carrying(stream_in_turn(spark, tmp_path / "in", FRAMES, rows, again, late), spy, S.DISH_TABLES, "test")
    want = plain_groups([again[0] if r[1] == again[0][1] else r for r in rows])
    assert groups_of(log) == {k: v for k, v in want.items() if v[3] is not None}
    assert [r.capture_id for r in log.filter("role = 'too_late'").collect()] == ["c-late"]
    assert [d["waiting"] for d in done] == [0, 5, 0, 0] and done[-1]["state"] == 1


def test_silent_cameras_close_their_group(spark, tmp_path):
    rows = frames([("a", 0, "s", 9.0, True, "same"), ("b", 100, "s", 9.0, True, "same")]), frames([("a", 130, "s", 9.0, True, "same"), ("b", 131, "s", 9.0, True, "same")])
    rows = rows[0], [(c, i + "x", *r) for c, i, *r in rows[1]]
    log = land_carrying(stream_in_turn(spark, tmp_path / "in", FRAMES, *rows), S.dish_step(0, idle_ms=60_000), S.DISH_TABLES, "test")
    assert groups_of(log) == {("a", "a-0000"): (1, 1, 0, "idle", "a-0000")}


def test_ingest_keeps_no_attempt_after_a_success(spark, tmp_path):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    schema = "event_id string, at timestamp, row_id long, ok boolean"
    batches = [("e", at(0), 1, False), ("e", at(1), 2, False), ("f", at(1), 3, True)], [("e", at(2), 4, True), ("e", at(3), 5, True), ("f", at(3), 6, True), ("f", at(0), 7, False)], [("e", at(4), 8, False), ("g", at(4), 9, False)] + [("g", at(5), 10 + k, True) for k in range(50)]
    log = land(S.unfinished_deliveries(stream_in_turn(spark, tmp_path / "in", schema, *batches)), "append", "test", S.ROCKSDB, each=S.ingest_attempts)
    assert sorted(r.row_id for r in log.collect()) == [1, 2, 3, 4, 9, 10]


@pytest.mark.parametrize("buckets", [1, 1024])
def test_cameras_of_a_bucket_keep_apart_and_a_frame_sent_again_counts_last(spark, tmp_path, buckets):
    schema = "camera_id string, capture_id string, captured_at timestamp, kind string"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    batches = [
        [("a", "f", at(10), "frame"), ("b", "f", at(10), "frame"), ("a", "g", at(400), "frame")],
        [("a", "f", at(300), "frame"), ("b", "c2", at(320), "calibration")],
        [("a", "c0", at(5), "calibration"), ("a", "c1", at(200), "calibration")],
    ]
    stream = stream_in_turn(spark, tmp_path / "in", schema, *batches)
    part = lambda kind: stream.filter(F.col("kind") == kind).drop("kind")
    log = land(S.focus_rows(part("frame"), part("calibration"), 100_000, buckets), "append", "test", S.ROCKSDB)
    got = sorted((r.camera_id, r.capture_id, r.captured_at, r.cal_id or "") for r in S.focus_join(log).collect())
    assert got == [("a", "f", at(300), "c1"), ("a", "g", at(400), "c1"), ("b", "f", at(10), "")]


def test_late_calibrations_correct_earlier_frames(spark, tmp_path):
    rng = random.Random(7)
    schema = "camera_id string, capture_id string, captured_at timestamp, kind string"
    rows = [(rng.choice("ab"), f"{k:03d}", T0 + datetime.timedelta(seconds=rng.randint(0, 4000)), "calibration" if k % 6 == 0 else "frame") for k in range(240)]
    batches = [[r for k, r in enumerate(rows) if k % 4 == b] for b in range(4)]  # in no order of time at all
    stream = stream_in_turn(spark, tmp_path / "in", schema, *batches)
    part = lambda kind: stream.filter(F.col("kind") == kind).drop("kind")
    log = land(S.focus_rows(part("frame"), part("calibration"), 600), "append", "test", S.ROCKSDB)
    got = {r.capture_id: r.cal_id for r in S.focus_join(log).collect()}
    cals = [(r[2], r[1], r[0]) for r in rows if r[3] == "calibration"]
    assert got == {i: max(((at, c) for at, c, cam2 in cals if cam2 == cam and at <= when), default=(None, None))[1] for cam, i, when, kind in rows if kind == "frame"}


def test_scan_spans_chunks_of_a_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("k"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    c = O.ordered_chunks(df, F.col("k"), F.col("id"))
    assert c.filter("k = 'hot'").select(O.CHUNK).distinct().count() > 1
    got = O.scan(c, ["k"], O.Total("n", F.lit(1)), O.Last("last", F.col("v"), inclusive=True)).orderBy("id").collect()
    seen, last = {}, {}
    for r in got:
        seen[r.k] = seen.get(r.k, 0) + 1
        last[r.k] = r.v if r.v is not None else last.get(r.k)
        assert (r.n, r["last"]) == (seen[r.k], last[r.k])
    ranked = O.global_rank(df, F.col("id").desc()).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 2001)) and ranked[0].id == 1999


def test_provider_status_clears_on_success(spark):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    rows = [("p", at(0), "failed", "GEMINI_BILLING"), ("p", at(1), "succeeded", None), ("p", at(2), "failed", "GEMINI_BILLING"), ("p", at(3), "failed", "TIMEOUT"), ("p", at(4), "failed", "GEMINI_BILLING"), ("q", at(1), "succeeded", None)]
    got = {r.provider: (r.ok, r.since, r.failures) for r in R.provider_status(spark.createDataFrame(rows, "provider string, at timestamp, status string, error_code string")).collect()}
    assert got == {"p": (False, at(2), 2), "q": (True, None, 0)}
