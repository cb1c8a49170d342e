"""Planted violations of every rule, and a gate that raises."""

import datetime

import pytest

from twinleg.operators import guards as G

EVENT = "id string, date string, known_from string, market string, category string, title string, detail string, source string, confounded_with array<string>, supersedes string"


def events(spark, *rows):
    full = {"id": "e", "date": "2024-02-29", "known_from": "2024-01-01", "market": "US", "category": "c", "title": "t", "detail": "d", "source": "s", "confounded_with": None, "supersedes": None}
    return spark.createDataFrame([tuple({**full, **r}.values()) for r in rows], EVENT)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_clean_and_empty_calendars_break_nothing(spark):
    assert found(G.event_violations(events(spark, {"id": "a", "confounded_with": ["b", None]}, {"id": "b", "confounded_with": []}), ["US"])) == []
    assert found(G.event_violations(events(spark, {}).limit(0), ["US"])) == []


def test_every_event_rule(spark):
    df = events(
        spark, {"id": "a", "title": None, "source": None}, {"id": None, "date": None}, {"id": "b", "date": "2023-02-29"}, {"id": "c", "date": "2023-2-1", "market": "XX"},
        {"id": "d"}, {"id": "d"}, {"id": "d"}, {"id": "f", "confounded_with": ["a", "zz", "yy"]}, {"id": "g", "known_from": "TODO(me)"}, {"id": "h", "known_from": "TODO"}, {"id": "i", "supersedes": "h"}, {"id": "j", "supersedes": "zz"},
    )
    want = [("date", "b", "2023-02-29"), ("date", "c", "2023-2-1"), ("duplicate", "d", "3"), ("market", "c", "XX"), ("missing", "(none)", "id,date"), ("missing", "a", "title,source"), ("reference", "f", "yy"), ("reference", "f", "zz"), ("unresolved", "g", "TODO(me)")]
    assert found(G.event_violations(df, ["US"])) == want


def test_identities(spark):
    registry = spark.createDataFrame([(1, "One"), (2, "Two"), (3, None)], "code long, name string")
    returned = spark.createDataFrame([(1, "One"), (2, "Too"), (2, "Too"), (2, None), (2, "Two"), (3, None), (9, "Nine")], "code long, name string")
    assert found(G.identity_violations(returned, registry)) == [("identity", "2", "Two / (none) x 1"), ("identity", "2", "Two / Too x 2")]


def test_forward_tests_and_availability(spark):
    rows = spark.createDataFrame([("SKY",), ("sky",), ("other",), (None,)], "pair_id string")
    assert found(G.forward_test_violations(rows, ["Sky"])) == [("forward_test", "sky", "2")]
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    features = spark.createDataFrame([("a", at(9), at(8)), ("a", at(9), at(9)), ("a", at(9), at(10)), ("b", at(9), None)], "pair_id string, decision_ts timestamp, avail_ts timestamp")
    assert found(G.availability_violations(features)) == [("availability", "a@2024-01-01 09:00:00", "2024-01-01 09:00:00 x 2")]


def test_scalers_and_smoothed_series(spark):
    full = spark.createDataFrame([("a", 1.0, 2.0)], "pair_id string, mean double, std double")
    fits = spark.createDataFrame([("a", 0, 0.9, 1.8), ("a", 1, 1.0, 1.8), ("a", 2, 1.0 + 1e-10, 2.0)], "pair_id string, fold int, mean double, std double")
    assert found(G.scaler_violations(fits, full, ["pair_id"])) == [("scaler", "a/1", "mean"), ("scaler", "a/2", "mean,std")]
    p = spark.createDataFrame([("x", False, 0.2), ("y", True, 0.2), ("z", False, None)], "name string, smoothed boolean, p double")
    assert found(G.smoothed_violations(p)) == [("empty", "z", "no probabilities"), ("smoothed", "y", "descriptive only")]


def test_gate(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "0", "x"), ("b", "2", "y")], "rule string, key string, detail string")
    assert found(G.require_none(rows, ["c"])) == found(rows)
    with pytest.raises(ValueError, match="a: 2 violations, first 0"):
        G.require_none(rows, ["a", "c"])
    assert found(G.require_none(rows.where("rule = 'b'"), ["a"])) == [("b", "2", "y")]
