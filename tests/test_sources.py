"""File sources on small hand-made files."""

import hashlib
import json
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from traymetrics.operators import changes as C
from traymetrics.operators import validation as V
from traymetrics.sources import files as R
from traymetrics.streaming.runner import land, write_in_turn


def test_menu_csv_rejects_whole_files(spark, tmp_path):
    good = '﻿date,meal,item_name,description,category\n2026-10-03,Lunch,"Mac, ""Cheese""","two\nlines",Hot\n\n2026-10-03,dinner,Rice,,\n'
    (tmp_path / "good.csv").write_text(good, encoding="utf-8")
    (tmp_path / "bad.csv").write_text("date,meal,item_name\n2026-10-04,lunch,Soup\n2026-02-30,lunch,Stew\n")
    (tmp_path / "twice.csv").write_text("meal,date,item_name\nlunch,2026-10-05,Soup\nlunch,2026-10-05,soup!\n")
    services, items, bad = R.read_menu_csv(spark, str(tmp_path / "good.csv"), "hall-main", "America/Detroit")
    got = {(r.item_id, r.display_name, r.category, r.description) for r in items.collect()}
    assert got == {
        ("item_hall-main_2026-10-03_lunch_mac-cheese", 'Mac, "Cheese"', "Hot", "two lines"),
        ("item_hall-main_2026-10-03_dinner_rice", "Rice", None, None),
    }
    assert {r.service_id for r in services.collect()} == {"svc_hall-main_2026-10-03_lunch", "svc_hall-main_2026-10-03_dinner"} and bad.count() == 0
    for name, reason in (("bad", "invalid_date"), ("twice", "duplicate_item")):
        _, none, bad = R.read_menu_csv(spark, str(tmp_path / f"{name}.csv"), "hall-main", "America/Detroit")
        assert none.count() == 0 and [r.reason for r in bad.collect()] == [reason]


def test_csv_of_many_columns_and_a_repeated_header(spark, tmp_path):
    more = [f"extra {k}" for k in range(96)]
    head = ",".join(["date", "meal", *more, '"item_name"', "category", "description"])
    row = lambda name: ",".join(["2026-10-03", "lunch", *["x"] * 96, name, "Hot", '"a, b"', "beyond"])
    (tmp_path / "a.csv").write_text("\n".join([head, row("Rice"), row("Soup")]) + "\n")
    (tmp_path / "b.csv").write_text("meal,date,item_name\ndinner,2026-10-03,Stew\n")
    _, items, bad = R.read_menu_csv(spark, str(tmp_path), "h", "UTC")
    assert {(r.display_name, r.category, r.description) for r in items.collect()} == {("Rice", "Hot", "a, b"), ("Soup", "Hot", "a, b"), ("Stew", None, None)} and bad.count() == 0
    (tmp_path / "a.csv").write_text("\n".join([head, row("Rice"), head]) + "\n")
    _, items, bad = R.read_menu_csv(spark, str(tmp_path), "h", "UTC")
    assert [r.display_name for r in items.collect()] == ["Stew"] and [r.reason for r in bad.collect()] == ["invalid_date"]  # a header again is a bad row


def test_menus_of_one_file_are_judged_by_many_tasks(spark, tmp_path):
    """A long file, its copy with an item twice and one without its date: items are counted by tasks of a few lines."""
    day = lambda k: f"2026-10-{k % 28 + 1:02d}"
    lines = [f'{day(k)},{("lunch", "dinner")[k % 2]},"Dish\n{k}",,h{k % 3}' for k in range(400)]
    head = "date,meal,item_name,category,hall_id"
    (tmp_path / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([head, *lines, lines[7].replace("Dish", "dish")]) + "\n")
    (tmp_path / "c.csv").write_text("\n".join([head, *lines, ",lunch,Soup,,h1", "2026-10-05,lunch,Stew,,"]) + "\n")
    shape = R.csv_shape(spark, str(tmp_path))
    assert (shape.width, shape.files) == (5, 3) and shape.lines == 801 + 803 + 803
    services, items, bad = R.read_menu_csv(spark, str(tmp_path), None, "UTC", task_rows=50)
    assert {(r.file.rsplit("/")[-1], r.reason) for r in bad.collect()} == {("b.csv", "duplicate_item"), ("c.csv", "invalid_date")}
    assert items.count() == 400 and services.count() == len({(day(k), k % 2, k % 3) for k in range(400)})
    counted = V.judge_menu_items(V.clean_menu_items(items.select(F.lit("h").alias("hall_id"), F.lit("2026-10-01").cast("date").alias("service_date"), F.lit("lunch").alias("meal_label"), F.col("display_name").alias("name"), "category", "description")), tasks=50)
    assert "SortMergeJoin" not in counted._jdf.queryExecution().executedPlan().toString() and counted.filter("reason IS NOT NULL").count() == 0


def test_portions_entries(spark):
    menus = spark.createDataFrame([("s", "h", "2026-10-03", "m", 2, i) for i in "abc"], "service_id string, hall_id string, service_date string, menu_id string, menu_version long, item_id string")
    rows = lambda *r: spark.createDataFrame(list(r), "service_id string, menu_version long, item_id string, count string")
    now = F.lit("2026-10-03 22:00:00").cast("timestamp")
    good, bad = R.check_portions(rows(("s", 2, "a", "10"), ("s", 2, "b", "")), menus, "csv", now)
    assert [(r.item_id, r["count"]) for r in good.collect()] == [("a", 10)] and bad.count() == 0
    for r, why in (((("s", 1, "a", "1"),), "stale_menu"), ((("s", 2, "z", "1"),), "unknown_item"), ((("s", 2, "a", "1"), ("s", 2, "a", "2")), "duplicate_item"), ((("s", 2, "a", "1.5"), ("s", 2, "b", "3")), "invalid_count"), ((("s", 2, "a", "4294967296"),), "invalid_count")):
        good, bad = R.check_portions(rows(*r), menus, "csv", now)
        assert good.count() == 0 and [x.reason for x in bad.collect()] == [why]


def inbox(root):
    def put(name, photo=b"jpeg", meta=True, **over):
        d = root / name
        d.mkdir(parents=True)
        if photo is not None:
            (d / "photo.jpg").write_bytes(photo)
        if meta:
            m = dict(protocolVersion=1, captureId=name, capturedAt="2026-10-03T12:00:00Z", byteLength=len(photo or b""), sha256=hashlib.sha256(photo or b"").hexdigest(), triggerSource="interval")
            (d / "metadata.json").write_text(json.dumps({**m, **over}))

    put("ok")
    put("cal", capturePurpose="calibration", focus={"lock": "locked", "absolute": 30})
    put("broken", sha256="0" * 64)
    put("late", photo=None)
    put("nometa", meta=False)
    put("other", captureId="someone")


def test_inbox_scan_and_stream(spark, tmp_path):
    inbox(tmp_path / "in")
    rows = {r.capture_id: r for r in R.scan_inbox(spark, str(tmp_path / "in")).collect()}
    assert {k: r.issue for k, r in rows.items()} == {"ok": None, "cal": None, "broken": "CHECKSUM_MISMATCH", "late": "INBOX_INCOMPLETE", "nometa": "INBOX_INCOMPLETE", "other": "INBOX_METADATA_INVALID"}
    assert rows["cal"].purpose == "calibration" and rows["cal"].focus_absolute == 30 and rows["ok"].trigger == "interval"
    frames, issues = R.split_inbox(land(R.stream_inbox(spark, str(tmp_path / "in")), "append", "inbox"))
    assert {r.capture_id for r in frames.collect()} == {"ok", "cal"} and issues.count() == 4


@pytest.mark.parametrize("indent, split", [(None, "128m"), (2, "128m"), (2, "300b")])
def test_snapshot_to_tables(spark, tmp_path, indent, split):
    doc = {
        "menus": [{"service": {"serviceId": "s", "hallId": "h", "hallTimezone": "UTC", "serviceDate": "2026-10-03", "mealLabel": "lunch", "menuId": "m", "menuVersion": 1}, "items": [{"itemId": "i", "menuId": "m", "displayName": "Rice"}]}],
        "captureEvents": [{"eventId": "e", "hallId": "h", "serviceId": "s", "capturedAt": "2026-10-03T12:00:00Z", "imageObjectId": "o", "geometry": {"widthPx": 10, "heightPx": 10, "coordinateSpace": "x"}, "source": "camera", "qualityFlags": ["blurred"], "state": "succeeded"}],
        "measurements": [{"measurementId": "m1", "eventId": "e", "attemptId": "a", "itemId": None, "remainingAreaPx": 5, "method": "mask_pixel_count", "qualityFlags": [], "maskCount": {"pixelsWasted": 5, "menuVersion": 1}}],
        "hiddenCaptureIds": ["e"],
    }
    p = tmp_path / "snap.json"
    doc |= {"schemaVersion": 4, "scans": [], "insights": [{}], "note": "[\\n    {"}
    p.write_text(json.dumps(doc, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)  # elements cross the splits
    try:
        t = {k: v.cache() for k, v in R.read_snapshot(spark, str(p)).items()}
        assert all(v.count() < 3 for v in t.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert t["meal_service"].first().service_date.isoformat() == "2026-10-03" and t["menu_item"].first().display_name == "Rice"
    e = t["capture_event"].first()
    assert (e.geometry.width_px, e.quality_flags) == (10, ["blurred"])
    m = t["food_measurement"].first()
    assert (m.mask_count.pixels_wasted, m.item_id) == (5, None)
    assert t["capture_visibility"].first().event_id == "e" and t["attendance"].count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_snapshot_elements_leave_the_scan_whole(spark, tmp_path, end):
    docs = [{"a": [], "b": [{"x": k, "y": [{"z": "},"}]}, {}, {"x": "[{"}], "ids": [f"i{k}", "j"], "o": {"k": 1}, "n": 1, "c": [{"x": k + 10}]} for k in range(3)]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_bytes(json.dumps(doc, indent=2).replace("\n", end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
    try:
        out = R._indented_elements(spark, str(tmp_path), end)
        got = sorted((r["array"], json.dumps(json.loads(r["text"]))) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((a, json.dumps(e)) for doc in docs for a in ("b", "ids", "c") for e in doc[a])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "rangepartitioning" not in plan


def test_stores_of_days_are_files_of_their_own(spark, monkeypatch):
    """No store grows with the number of days, so no task holds more than a day of a hall."""
    from traymetrics.catalog import bindings, source_queries

    paths = []
    monkeypatch.setattr(source_queries.R, "read_snapshot", lambda spark, path: paths.append(path))
    t = bindings.Tables(spark, "/root/testdata/sf0.001")
    source_queries.snapshot(t)
    stores = t.services().filter("hall_id IS NOT NULL").select("hall_id", "service_date").distinct().count()
    assert len(spark.read.text(paths[0]).inputFiles()) == stores > 5


def test_store_rows_become_text_where_they_lie(spark, tmp_path, monkeypatch):
    """A store is whole JSON with a menu in lines of one item each, also for nulls and rows that come twice; frozen text is packed."""
    from traymetrics.catalog import bindings, source_queries

    day = "timestamp '1998-02-03 00:00:00'"
    orders = [(1, 5), (1, 5), (2, 5), (3, 5), (38, 6), (4, None)]
    spark.sql(" UNION ALL ".join(f"SELECT {k}L o_orderkey, CAST({'NULL' if c is None else c} AS BIGINT) o_custkey, {day} o_orderdate, 'F' o_orderstatus, '5-LOW' o_orderpriority" for k, c in orders)).write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 1, 14), (1, 2, 15), (2, 1, 26), (3, 1, 14), (3, 2, None), (38, 1, 16), (38, 1, 16), (4, 1, 17)]
    spark.sql(" UNION ALL ".join(f"SELECT {k}L l_orderkey, {n} l_linenumber, CAST({'NULL' if p is None else p} AS BIGINT) l_partkey, 1L l_suppkey, 2.0D l_quantity, 10.5D l_extendedprice, 'R' l_returnflag, 'O' l_linestatus" for k, n, p in lines)).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(30).select(F.col("id").alias("p_partkey"), F.lit('a, "b').alias("p_name"), F.lit("SMALL").alias("p_type")).write.parquet(str(tmp_path / "part.parquet"))
    paths, read = [], R.read_snapshot
    monkeypatch.setattr(source_queries.R, "read_snapshot", lambda spark, path: paths.append(path) or read(spark, path))
    tables = source_queries.snapshot(bindings.Tables(spark, str(tmp_path)))
    stores = {f: json.loads("\n".join(r.value for r in rows)) for f, rows in groupby(sorted(spark.read.text(paths[0]).select("_metadata.file_path", "value", F.monotonically_increasing_id().alias("at")).collect(), key=lambda r: (r.file_path, r.at)), key=lambda r: r.file_path)}
    assert len(stores) == 2  # halls 0 and 1 on one day; no hall, no store
    menus = {m["service"]["serviceId"]: sorted(i["itemId"] for i in m["items"]) for d in stores.values() for m in d["menus"]}
    assert menus == {"svc_hall-0_1998-02-01_lunch": ["item_14", "item_15"], "svc_hall-0_1998-02-01_dinner": [], "svc_hall-0_1998-02-01_breakfast": ["item_14"], "svc_hall-1_1998-02-01_dinner": ["item_16"]}
    assert sorted(m["measurementId"] for d in stores.values() for m in d["measurements"]) == ["1-1"] * 4 + ["1-2"] * 4 + ["2-1", "3-1", "3-2", "38-1", "38-1"]
    assert [i for d in stores.values() for i in d["hiddenCaptureIds"]] == ["38"]
    assert tables["menu_item"].count() == 4 and tables["menu_item"].first().display_name == 'a, "b' and tables["food_measurement"].count() == 13
    frozen = [f for t in ("menu_item", "food_measurement") for f in tables[t].inputFiles()]
    assert frozen and all(f.endswith(".zstd.parquet") for f in frozen)


def test_parts_of_a_replay_are_written_by_many_tasks(spark):
    rows = spark.range(1000, numPartitions=6)
    for whole, files in ((True, 2), (False, 12)):
        path = write_in_turn(rows, F.col("id") % 2.0, 2, "turns", whole=whole)
        back = spark.read.parquet(path)
        assert len(back.inputFiles()) == files and back.distinct().count() == 1000


def draw(key):
    h = 2166136261
    for ch in key:
        h = (h ^ ord(ch)) * 16777619 % 2**32
    h ^= h << 13 & 0xFFFFFFFF
    h ^= h >> 17
    h ^= h << 5 & 0xFFFFFFFF
    return (h & 0xFFFFFFFF) / 2**32


def test_history_draws(spark):
    foods = spark.createDataFrame([(m, i, f, "Grill") for m in ("breakfast", "lunch", "dinner") for i, f in enumerate(("Rice", "Cheese Pizza", "Bean Soup"))], "meal string, idx int, food string, station string")
    taken = spark.createDataFrame([("h", "2026-10-03", "lunch")], "hall_id string, service_date string, meal_label string").withColumn("service_date", F.col("service_date").cast("date"))
    t = R.generate_history(foods, "h", "2026-10-03", 2, "seed", "America/Detroit", taken)
    slots = [("2026-10-02", m, 1.15) for m in ("breakfast", "lunch", "dinner")] + [("2026-10-03", m, 0.85) for m in ("breakfast", "dinner")]
    plan = {"breakfast": (4, 8), "lunch": (6, 12), "dinner": (8, 14)}
    names = ["rice", "cheese-pizza", "bean-soup"]
    base = {"rice": 12000, "cheese-pizza": 15000, "bean-soup": 12000}
    pick = lambda key, lo, hi: lo + int(draw(key) * (hi - lo + 1))
    want, plates = {}, 0
    for day, meal, trend in slots:
        slot = f"h_{day}_{meal}"
        for p in range(1, pick(f"seed|plates|svc_demo_{slot}", *plan[meal]) + 1):
            plates += 1
            ev = f"cap_demo_{slot}_{p:02d}"
            if draw(f"seed|clean|{ev}") < 0.1:
                continue
            seen = set()
            for k in range(pick(f"seed|count|{ev}", 1, 3)):
                i = pick(f"seed|food|{ev}|{k}", 0, 2)
                if i in seen:
                    continue
                seen.add(i)
                px = base[names[i]] * (0.5 + 1.3 * draw(f"seed|tendency|{names[i]}")) * (0.6 + 0.8 * draw(f"seed|px|{ev}|{k}")) * trend
                want[f"msr_demo_{slot}_{p:02d}_{k}"] = max(200, int(px + 0.5))
    assert t["capture_event"].count() == plates
    assert {r.measurement_id: r.remaining_area_px for r in t["food_measurement"].collect()} == want


def test_an_append_that_breaks_off_is_repeated_whole(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    root = str(tmp_path)
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    attempts = frame([("a1", "ok", None), ("a2", "ok", None), ("a3", "bad", "x")], "attempt_id string, status string, reason string")
    rows = frame([("a1", "m1", None), ("a2", "m2", None), ("a2", "m3", None), ("a3", "m4", None)], "attempt_id string, measurement_id string, reason string")
    regions, counts = rows.select("attempt_id", F.lit("i").alias("item_id")), attempts.select("attempt_id", F.lit(5).alias("capture_pixels_wasted"))
    real = DataFrameWriter.parquet
    for stop in ("segmentation_region", "analysis_attempt", C.COMMITS):  # between any two tables, and before the record

        def broken(self, path, *args, stop=stop, **more):
            if f"/{stop}/" in path:
                raise OSError("lost")
            return real(self, path, *args, **more)

        monkeypatch.setattr(DataFrameWriter, "parquet", broken)
        with pytest.raises(OSError):
            C.append_analysis(root, attempts, rows, regions, counts)
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        assert all(df.isEmpty() for df in C.read_analysis(spark, root).values())
    for again in (attempts, attempts.orderBy(F.desc("attempt_id")), attempts.filter("attempt_id = 'a1'")):
        C.append_analysis(root, again, rows, regions, counts)
    more = frame([("a2", "ok", None), ("a4", "ok", None)], "attempt_id string, status string, reason string")
    rejects = C.append_analysis(root, more, frame([("a4", "m5", None), ("a2", "m9", None)], "attempt_id string, measurement_id string, reason string"), regions, counts)
    assert {(r.attempt_id, r.reason) for r in rejects.collect()} == {("a2", "already_recorded")}
    t = C.read_analysis(spark, root)
    assert sorted(r.attempt_id for r in t["analysis_attempt"].collect()) == ["a1", "a2", "a4"]
    assert sorted(r.measurement_id for r in t["food_measurement"].collect()) == ["m1", "m2", "m3", "m5"]
    assert t["segmentation_region"].count() == 3 and t["capture_count"].count() == 2


def test_gated_append_and_delete(spark):
    a = spark.createDataFrame([("a1", None), ("a2", None), ("a3", "calibration_not_succeeded")], "attempt_id string, reason string")
    m = spark.createDataFrame([("a1", None), ("a2", None), ("a2", "invalid_remaining"), ("a3", None)], "attempt_id string, reason string")
    ok, rows, rejects = C.record_analysis(a, m, spark.createDataFrame([("a9",)], "attempt_id string"))
    assert [r.attempt_id for r in ok.collect()] == ["a1"] and rows.count() == 1
    assert {r.attempt_id: r.reason for r in rejects.collect()} == {"a2": "invalid_remaining", "a3": "calibration_not_succeeded"}


def test_label_sheet_and_menu_json(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('station,food,serving_description,serving_g,calories,allergens_contains,menu_co2_icon\nSoup,"Bean Soup","8 oz, cup",227,274,milk; wheat/rye,high\n')
    r = R.read_labels(spark, str(tmp_path / "labels.csv")).first()
    assert (r.food, r.serving_g, r.calories, r.allergens, r.iron_pct_dv) == ("Bean Soup", 227.0, 274.0, ["milk", "wheat/rye"], None)
    doc = {"hallId": "h", "hallTimezone": "UTC", "days": [{"date": "2026-10-03", "lunch": ["Rice", {"name": "Bean  Soup", "category": "Hot"}], "dinner": []}, {"date": "2026-02-30", "breakfast": ["Eggs"]}]}
    (tmp_path / "menu.json").write_text(json.dumps(doc))
    got = {(x.meal_label, x.name, x.category, x.reason) for x in R.read_menu_json(spark, str(tmp_path / "menu.json")).collect()}
    assert got == {("lunch", "Rice", "", None), ("lunch", "Bean Soup", "Hot", None), ("dinner", "", "", "empty_meal"), ("breakfast", "Eggs", "", "invalid_date")}


def test_sql_functions(spark):
    from traymetrics.functions.sql import register_sql_functions

    register_sql_functions(spark)
    row = spark.sql("SELECT js_round(2.5D, 0) AS a, slug('Crème Brûlée  (Vegan)!') AS b, fnv1a32('a') AS c, impact_points(10000D, 1.0D, 16.06D, 1.94D) AS d").first()
    assert (row.a, row.b, row.c, round(row.d, 3)) == (3.0, "creme-brulee-vegan", (2166136261 ^ 97) * 16777619 % 2**32, 59.614)
