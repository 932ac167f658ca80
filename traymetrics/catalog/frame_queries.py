"""Frame sequences, streams and as-of joins over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from traymetrics.catalog.registry import query, r4
from traymetrics.operators import frames as R
from traymetrics.operators import joins as J
from traymetrics.streaming import operators as S
from traymetrics.streaming.runner import land, land_carrying, latest_update, read_files, write_in_turn

GRACE_MS = 6 * 3600 * 1000  # the median gap of one user is about seven hours


def as_frames(events):
    e = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("camera_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("capture_id"),
        F.col("ts").cast("timestamp").alias("captured_at"),
        F.concat(F.lit("svc-"), F.floor(F.dayofmonth("ts") / 11).cast("string")).alias("service_id"),
        F.when(F.col("event_id") % 7 == 0, 2.0).otherwise(9.0).alias("mad"),
        (e != "error").alias("plate_visible"),
        F.when(e == "signup", "different").when(e == "purchase", "unsure").otherwise("same").alias("same_dish"),
    )


def plain_times(df, *cols):
    """Times as the tables keep them, without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def stream_of(t, late_seconds=1800):
    """The events as a stream of four files, one a batch; every seventh event comes a little late."""
    e = t.read("events")
    late = F.when(F.col("event_id") % 7 == 0, late_seconds).otherwise(0)
    path = write_in_turn(e, F.col("ts").cast("timestamp").cast("double") + late, 4, "events")
    return read_files(t.spark, path, e.schema, 1)


T2_SQL = """
WITH f AS (SELECT CAST(user_id AS VARCHAR) AS camera_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, ts, 'svc-' || CAST(day(ts) // 11 AS VARCHAR) AS svc, event_id % 7 = 0 AS quiet, event_type <> 'error' AS plate, event_type AS e FROM events),
a AS (SELECT *, coalesce(quiet AND lag(svc) OVER (PARTITION BY camera_id ORDER BY ts, id) = svc, FALSE) AS fol FROM f),
b AS (SELECT *, last_value(CASE WHEN NOT fol THEN plate END IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS pl FROM a),
c AS (SELECT *, last_value(CASE WHEN pl THEN svc END IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lps FROM b),
d AS (SELECT *, coalesce(NOT fol AND pl AND (e = 'signup' OR lps IS NULL OR lps <> svc), FALSE) AS opens FROM c),
g AS (SELECT *, last_value(CASE WHEN opens THEN id END IGNORE NULLS) OVER w AS gid, last_value(CASE WHEN opens THEN svc END IGNORE NULLS) OVER w AS gsvc FROM d WINDOW w AS (PARTITION BY camera_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, last_value(CASE WHEN pl THEN ts END IGNORE NULLS) OVER (PARTITION BY camera_id, gid ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS pts FROM g),
k AS (SELECT *, CASE WHEN gid IS NULL THEN NULL WHEN svc <> gsvc THEN 'service_change' WHEN NOT pl AND ts - pts >= INTERVAL 6 HOUR THEN 'gap' END AS cl FROM h),
m AS (SELECT *, count(cl) OVER (PARTITION BY camera_id, gid ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS nc FROM k),
role AS (SELECT *, CASE WHEN gid IS NULL OR NOT pl THEN 'no_plate' WHEN opens THEN 'opened' WHEN nc > 0 THEN 'late' ELSE 'joined' END AS role FROM m),
pos AS (SELECT *, count(*) FILTER (role IN ('opened', 'joined')) OVER (PARTITION BY camera_id, gid ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS i FROM role),
nx AS (SELECT camera_id, lag(id) OVER (PARTITION BY camera_id ORDER BY ts, id) AS gid, CASE WHEN lag(svc) OVER (PARTITION BY camera_id ORDER BY ts, id) <> svc THEN 'service_change' ELSE 'different' END AS nxt FROM g WHERE opens),
grp AS (SELECT p.camera_id, p.gid AS group_id, max(gsvc) AS service_id, count(*) FILTER (role IN ('opened', 'joined')) AS members, count(*) FILTER (role = 'late') AS late_members,
 count(*) FILTER (role IN ('joined', 'late') AND NOT fol AND e = 'purchase') AS unsure_merges, arg_min(cl, (ts, id)) FILTER (cl IS NOT NULL) AS cl FROM pos p WHERE gid IS NOT NULL GROUP BY 1, 2),
res AS (SELECT grp.camera_id, group_id, service_id, members, late_members, unsure_merges, coalesce(grp.cl, nxt) AS closed_by, p.id AS representative
 FROM grp LEFT JOIN nx ON nx.camera_id = grp.camera_id AND nx.gid = group_id LEFT JOIN pos p ON p.camera_id = grp.camera_id AND p.gid = group_id AND p.role IN ('opened', 'joined') AND p.i = (members - 1) // 2 + 1)
"""


@query("t02_group_dishes", T2_SQL + "SELECT * FROM res", domain=False)
def t02(t):
    return R.group_dishes(as_frames(t.read("events")), GRACE_MS)[1]


@query("t02_frame_roles", T2_SQL + "SELECT camera_id, id AS capture_id, CASE WHEN role <> 'no_plate' THEN gid END AS group_id, role FROM pos", domain=False)
def t02_roles(t):
    return R.group_dishes(as_frames(t.read("events")), GRACE_MS)[0].drop("captured_at", "service_id")


@query("t02_group_dishes_stream", T2_SQL + "SELECT * FROM res WHERE closed_by IS NOT NULL", domain=False)
def t02_stream(t):
    log = land_carrying(as_frames(stream_of(t)), S.dish_step(3_600_000, GRACE_MS), S.DISH_TABLES, "dishes")
    return S.closed_groups(log)


@query("t03_manual_frames_only", "SELECT event_id AS group_id FROM events WHERE event_type <> 'view'", domain=False)
def t03(t):
    f = t.read("events").select(F.col("event_id").alias("capture_id"), F.when(F.col("event_type") == "view", "interval").otherwise("manual").alias("trigger"))
    return R.manual_frames_only(f).select("group_id")


SESSION_SQL = """
WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s),
r AS (SELECT CAST(user_id AS VARCHAR) AS camera_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS frames FROM k GROUP BY user_id, g)
"""


@query("t04_gap_sessions", SESSION_SQL + "SELECT * FROM r", domain=False)
def t04(t):
    return plain_times(R.gap_sessions(as_frames(t.read("events")), 6 * 3600).drop("session"), "first_at", "last_at")


@query("t04_session_stream", SESSION_SQL + "SELECT * FROM r WHERE last_at + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)", domain=False)
def t04_stream(t):
    return plain_times(land(S.frame_sessions(as_frames(stream_of(t)), "6 hours"), "append", "sessions").drop("_batch"), "first_at", "last_at")


@query("t05_dedupe_events", "SELECT DISTINCT event_id % 5000 AS event_key FROM events", domain=False)
def t05(t):
    e = stream_of(t).select((F.col("event_id") % 5000).alias("event_key"), F.col("ts").cast("timestamp").alias("captured_at"))
    return land(S.dedupe_events(e, "30 days", key="event_key"), "append", "dedupe").select("event_key")


@query("t05_ingest_attempts", """
WITH e AS (SELECT event_id % 5000 AS event_id, ts + INTERVAL 1 MINUTE * CASE WHEN event_id % 7 = 0 THEN 30 ELSE 0 END AS ts, event_id AS row_id, event_type IN ('click', 'purchase') AS ok FROM events),
f AS (SELECT *, min(CASE WHEN ok THEN row_number END) OVER (PARTITION BY event_id) AS done FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, row_id) AS row_number FROM e))
SELECT event_id, count(*) AS attempts, max(CASE WHEN ok THEN 1 ELSE 0 END) = 1 AS succeeded, max(ts) AS last_at FROM f WHERE done IS NULL OR row_number <= done GROUP BY event_id""", domain=False)
def t05_ingest(t):
    rows = stream_of(t).select((F.col("event_id") % 5000).alias("event_id"), (F.col("ts").cast("timestamp") + F.expr("make_dt_interval(0, 0, if(event_id % 7 = 0, 30, 0))")).alias("at"), F.col("event_id").alias("row_id"), F.col("event_type").isin("click", "purchase").alias("ok"))
    log = land(S.unfinished_deliveries(rows), "append", "attempts", S.ROCKSDB, each=S.ingest_attempts)
    return plain_times(log.groupBy("event_id").agg(F.count(F.lit(1)).alias("attempts"), F.max("ok").alias("succeeded"), F.max("at").alias("last_at")), "last_at")


@query("t06_latest_state", "SELECT user_id AS event_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS changed_at FROM events GROUP BY user_id", domain=False)
def t06(t):
    e = stream_of(t).select(F.col("user_id").alias("event_id"), F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("changed_at"), F.col("event_id").alias("change_id"))
    return plain_times(latest_update(land(S.latest_state(e), "update", "states"), ["event_id"]), "changed_at")


def pixel_events(t):
    return stream_of(t).select(F.col("ts").cast("timestamp").alias("captured_at"), F.floor(F.col("value") * 100).cast("long").alias("pixels"))


@query("t07_daily_pixels", "SELECT ts::DATE AS date, CAST(sum(floor(value * 100)) AS BIGINT) AS pixels, count(*) AS plates FROM events GROUP BY 1", domain=False)
def t07(t):
    return latest_update(land(S.stream_daily_pixels(pixel_events(t)), "update", "daily"), ["date"])


@query("t08_sliding_pixels", """
SELECT CAST(d AS TIMESTAMP) AS window_start, CAST(d AS TIMESTAMP) + INTERVAL 7 DAY AS window_end, CAST(sum(floor(value * 100)) AS BIGINT) AS pixels, count(*) AS plates
FROM (SELECT value, unnest(generate_series(ts::DATE - 6, ts::DATE, INTERVAL 1 DAY)) AS d FROM events) GROUP BY d""", domain=False)
def t08(t):
    return plain_times(latest_update(land(S.stream_sliding_pixels(pixel_events(t)), "update", "sliding"), ["window_start", "window_end"]), "window_start", "window_end")


def outcomes(events):
    e = F.col("event_type")
    return events.select(
        F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("provider"),
        F.col("ts").alias("at"),
        F.when(e == "click", "succeeded").otherwise("failed").alias("status"),
        F.when(e == "error", "GEMINI_BILLING").when(e == "view", "TIMEOUT").alias("error_code"),
    )


OUTCOME_SQL = """
WITH o AS (SELECT 'p' || CAST(user_id % 40 AS VARCHAR) AS provider, ts, event_type AS e FROM events), k AS (SELECT provider, max(ts) FILTER (e = 'click') AS ok_at FROM o GROUP BY 1),
b AS (SELECT o.* FROM o JOIN k USING (provider) WHERE e = 'error' AND (ok_at IS NULL OR ts > ok_at))
"""


@query("t09_provider_status", OUTCOME_SQL + """
SELECT provider, count(b.ts) = 0 AS ok, CASE WHEN count(b.ts) > 0 THEN 'GEMINI_BILLING' END AS code, min(b.ts) AS since, count(b.ts) AS failures FROM k LEFT JOIN b USING (provider) GROUP BY provider""", domain=False)
def t09(t):
    return R.provider_status(outcomes(t.read("events")))


@query("t09_provider_stream", OUTCOME_SQL + """
SELECT provider, count(b.ts) = 0 AS ok, CASE WHEN count(b.ts) > 0 THEN 'GEMINI_BILLING' END AS code FROM k LEFT JOIN b USING (provider) GROUP BY provider""", domain=False)
def t09_stream(t):
    rows = land(S.stream_provider_outcomes(outcomes(stream_of(t)), R.OPERATOR_CODES), "update", "outcomes")
    return latest_update(rows, ["provider"]).select("provider", "ok", "code")


def focus_parts(frames_src, cal_src):
    f = as_frames(frames_src.filter("event_type <> 'signup'")).select("camera_id", "capture_id", "captured_at")
    c = as_frames(cal_src.filter("event_type = 'signup'")).select("camera_id", "capture_id", "captured_at")
    return f, c


ASOF_SQL = """
WITH f AS (SELECT CAST(user_id AS VARCHAR) AS camera_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, ts, event_id FROM events WHERE event_type <> 'signup'),
c AS (SELECT CAST(user_id AS VARCHAR) AS camera_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS cal_id, ts AS cal_at, event_id % 3 AS pos, event_id % 5 AS lk FROM events WHERE event_type = 'signup'),
j AS (SELECT f.*, c.cal_id, c.cal_at, c.pos, c.lk FROM f ASOF LEFT JOIN c ON f.camera_id = c.camera_id AND f.ts >= c.cal_at)
"""


@query("t10_focus_join", ASOF_SQL + "SELECT camera_id, id AS capture_id, cal_id FROM j", domain=False)
def t10(t):
    frames, cals = focus_parts(stream_of(t), stream_of(t, 10 * 86_400))  # every seventh calibration comes ten days late
    log = land(S.focus_rows(frames, cals, 10 * 86_400), "append", "focus", S.ROCKSDB)
    return S.focus_join(log).select("camera_id", "capture_id", "cal_id")


@query("j09_asof_join", ASOF_SQL + "SELECT camera_id, id AS row_id, cal_id FROM j", domain=False)
def j09(t):
    f, c = focus_parts(t.read("events"), t.read("events"))
    hit = J.asof_join(f.withColumnRenamed("capture_id", "row_id"), c.withColumn("cal_id", F.col("capture_id")), ["camera_id"], "captured_at", "capture_id", ["cal_id"])
    return hit.select("camera_id", "row_id", "cal_id")


@query("v23_focus_warnings", ASOF_SQL + """
SELECT id AS row_id, CASE WHEN event_id % 4 = 0 THEN 'not_locked' ELSE 'differs_from_calibration' END AS warning FROM j WHERE event_id % 11 <> 0 AND (event_id % 4 = 0 OR (lk <> 0 AND pos <> event_id % 3))""", domain=False)
def v23(t):
    e, k = t.read("events"), F.col("event_id")
    base = lambda df: df.select(
        F.lpad(k.cast("string"), 12, "0").alias("id"), F.col("user_id").cast("string").alias("camera_id"), F.col("ts").cast("timestamp").alias("captured_at"), (k % 3).alias("focus_absolute"), "event_id"
    )
    frames = base(e.filter("event_type <> 'signup'")).select(
        F.col("id").alias("row_id"), "camera_id", "captured_at", F.when(k % 4 == 0, "auto").otherwise("locked").alias("focus_lock"), "focus_absolute", (k % 11 == 0).alias("simulated")
    )
    cals = base(e.filter("event_type = 'signup'")).select(
        F.col("id").alias("capture_id"), "camera_id", "captured_at", F.when(k % 5 == 0, "auto").otherwise("locked").alias("focus_lock"), "focus_absolute"
    )
    return R.focus_warnings(frames, cals).select("row_id", "warning")


@query("w13_runs_of_data", """
WITH d AS (SELECT DISTINCT o_custkey % 50 AS hall, o_orderdate::DATE AS d FROM orders), k AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY hall ORDER BY d) AS INTEGER) AS a FROM d)
SELECT hall, min(d) AS run_start, max(d) AS run_end, count(*) AS days FROM k GROUP BY hall, a""", domain=False)
def w13(t):
    daily = t.read("orders").groupBy((F.col("o_custkey") % 50).alias("hall"), F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return R.runs_of_data(daily, ["hall"], "d", "n").drop("total")


@query("w14_frame_difference", """
WITH p AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
SELECT vec_id, round((SELECT avg(abs(CAST(embedding[i] AS DOUBLE) - CAST(before[i] AS DOUBLE))) FROM range(1, 65) r(i)), 4) AS mad FROM p""", domain=False)
def w14(t):
    f = t.read("embeddings").select(F.col("label").alias("camera_id"), F.timestamp_seconds("vec_id").alias("captured_at"), F.col("vec_id").alias("capture_id"), F.col("embedding").alias("fingerprint"))
    return r4(R.frame_difference(f).select(F.col("capture_id").alias("vec_id"), "mad"), "mad")


@query("w15_middle_member", """
WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id AS representative FROM k WHERE i = (n - 1) // 2 + 1""", domain=False)
def w15(t):
    return R.middle_member(t.read("events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id")


@query("j10_resolve_service", """
, win AS (SELECT 'hall-' || n_nationkey AS hall_id, CASE r_regionkey WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'dinner' WHEN 3 THEN 'brunch' ELSE 'late' END AS meal,
 CASE r_regionkey WHEN 0 THEN '07:0' WHEN 1 THEN '11:0' WHEN 2 THEN '17:0' WHEN 3 THEN '09:3' ELSE '20:1' END || n_nationkey AS s, CASE r_regionkey WHEN 0 THEN '10:00' WHEN 1 THEN '14:00' WHEN 2 THEN '20:30' WHEN 3 THEN '13:15' ELSE '23:40' END AS e FROM region, nation WHERE n_nationkey <= 4 AND n_nationkey <> r_regionkey),
s AS (SELECT event_id, hall_id, (captured_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Detroit' AS l FROM cap),
m AS (SELECT s.*, meal, s.l::DATE AS d, row_number() OVER (PARTITION BY event_id ORDER BY win.s, win.e, meal) AS k FROM s LEFT JOIN win ON win.hall_id = s.hall_id AND strftime(l, '%H:%M') BETWEEN win.s AND win.e)
SELECT event_id, meal, v.service_id, CASE WHEN meal IS NULL THEN 'no_meal_served' WHEN v.service_id IS NULL THEN 'no_menu_saved' END AS reason FROM m LEFT JOIN svc v ON v.hall_id = m.hall_id AND v.service_date = m.d AND v.meal_label = m.meal WHERE k = 1""")
def j10(t):
    """Each hall leaves out another meal and starts a minute later; brunch and late overlap others."""
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (r + 1).cast("int"))
    halls = t.read("nation").filter(n <= 4).select("n_nationkey").join(t.read("region").select("r_regionkey"), n != r)
    windows = halls.select(
        F.concat(F.lit("hall-"), n.cast("string")).alias("hall_id"), pick("breakfast", "lunch", "dinner", "brunch", "late").alias("meal"),
        F.concat(pick("07:0", "11:0", "17:0", "09:3", "20:1"), n.cast("string")).alias("start"), pick("10:00", "14:00", "20:30", "13:15", "23:40").alias("end"),
    )
    scans = t.captures().select("event_id", "hall_id", F.lit("America/Detroit").alias("hall_timezone"), F.col("captured_at").alias("scanned_at"))
    return J.resolve_service(scans, windows, t.services()).select("event_id", "meal", "service_id", "reason")
