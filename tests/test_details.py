"""Whole details of events and days by hand-made rows."""

import datetime

from traymetrics.operators import answers as A
from traymetrics.operators import services as S
from traymetrics.plans import read_models as Q


def test_nested_capture_detail(spark):
    day = datetime.datetime(2026, 10, 3)
    captures = spark.createDataFrame([("e1", "succeeded"), ("e2", "failed"), ("e3", "pending")], "event_id string, state string")
    attempts = spark.createDataFrame(
        [("a2", "e1", day.replace(hour=2), "succeeded"), ("a1", "e1", day.replace(hour=1), "succeeded"), ("a3", "e1", day.replace(hour=3), "failed"), ("a4", "e2", day, "succeeded")],
        "attempt_id string, event_id string, created_at timestamp, status string",
    )
    rows = spark.createDataFrame(
        [("m2", "e1", "a2", "rice", 5.0), ("m1", "e1", "a2", None, 7.0), ("m0", "e1", "a1", "rice", 9.0), ("m3", "e2", "a4", "rice", 2.0)],
        "measurement_id string, event_id string, attempt_id string, item_id string, remaining_area_px double",
    )
    store = Q.Store(**{name: None for name in Q.Store.__annotations__} | {"captures": captures, "attempts": attempts, "measurements": rows})
    got = {r["event_id"]: r for r in Q.nested_capture_detail(store).collect()}
    assert [a["attempt_id"] for a in got["e1"]["attempts"]] == ["a1", "a2", "a3"] and got["e1"]["counted_attempt_id"] == "a2"
    assert [(m["measurement_id"], m["item_id"], m["remaining_area_px"]) for m in got["e1"]["measurements"]] == [("m1", None, 7.0), ("m2", "rice", 5.0)]
    assert got["e2"]["counted_attempt_id"] is None and [a["attempt_id"] for a in got["e2"]["attempts"]] == ["a4"]
    assert got["e2"]["measurements"] == got["e3"]["attempts"] == got["e3"]["measurements"] == []
    empty = Q.Store(**store.__dict__ | {"captures": captures.limit(0)})
    assert Q.nested_capture_detail(empty).count() == 0


def test_plate_percents_of_a_range(spark):
    services = spark.createDataFrame([("s1", datetime.date(2026, 10, 3)), ("s2", datetime.date(2026, 10, 5))], "service_id string, service_date date")
    plates = spark.createDataFrame([("e1", "s1", 12.5), ("e2", "s1", None), ("e3", "s2", 1.0), ("e4", "gone", 2.0)], "event_id string, service_id string, plate_waste_percent double")
    got = S.plate_percents(plates, services, "2026-10-01", "2026-10-04").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == [("2026-10-03", "e1", 12.5), ("2026-10-03", "e2", None)]


def test_box_answers_are_parsed_once_for_pieces(spark):
    raw = [("a", '{"pieces": [{"menu_id": 1, "ingredient": "rice"}, {"menu_id": 0}]}'), ("b", '[{"menu_id": 9}, {"menu_id": 1}]'), ("c", "nope")]
    answers = spark.createDataFrame([(i, "m", r) for i, r in raw], "answer_id string, menu_id string, raw string")
    menu = spark.createDataFrame([("m", 1, "item_rice")], "menu_id string, number long, item_id string")
    pieces, dishes, rejects = A.parse_box_answers(answers, menu)
    assert sorted((r.answer_id, r.idx, r.item_id) for r in pieces.collect()) == [("a", 0, "item_rice"), ("a", 1, None)]
    assert [(r.answer_id, r.reason) for r in dishes.collect()] == [("a", "not_found")]
    assert sorted((r.answer_id, r.reason) for r in rejects.collect()) == [("b", "menu_id_out_of_range"), ("c", "invalid_json")]
    assert "parse_json" not in pieces._jdf.queryExecution().executedPlan().toString()
