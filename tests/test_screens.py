"""Manager screens by hand."""

import datetime as dt
import os

import pytest

from twinleg.operators import screens as C

HOLD = "manager string, quarter date, issuer string, value double"
Q = [dt.date(2024, 1, 1), dt.date(2024, 4, 1), dt.date(2024, 7, 1)]


@pytest.fixture
def holdings(spark):
    rows = [("a", Q[0], "LIBERTY ONE CORP", 5.0), ("a", Q[0], "LIBERTY TWO, INC", 1.0), ("a", Q[0], "APPLE", 7.0), ("a", Q[1], "LIBERTY ONE CORP", 4.0), ("a", Q[2], "LIBERTY TWO, INC", 2.0)]
    rows += [("b", Q[0], "LIBERTY ONE CORP", 1.0), ("b", Q[0], "LIBERTY ONE PLC", 1.0), ("b", Q[1], "APPLE", None), ("c", Q[2], None, 3.0)]
    return spark.createDataFrame(rows, HOLD)


def test_two_different_legs_in_one_filing(spark, holdings):
    legs = spark.createDataFrame([("liberty", "Liberty One"), ("liberty", "liberty two"), ("liberty", "NOWHERE"), ("fruit", "APPLE"), (None, "")], "family string, leg string")
    assert [tuple(r) for r in C.families(holdings, legs).collect()] == [("a", Q[0], "liberty", "Liberty One, liberty two", 3)]  # one leg twice, or in two quarters, is no pair
    assert C.families(holdings.limit(0), legs).count() == 0 and C.families(holdings, legs.limit(0)).count() == 0


def test_the_watched_worth_is_of_the_newest_quarter_with_any(spark, holdings):
    watch = spark.createDataFrame([("LIBERTY ONE",), ("apple",), ("apple",)], "needle string")
    got = {r["manager"]: r for r in C.watched_books(holdings, watch).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["newest"], a["quarters"], a["watched_quarters"], a["watched_value"], a["names"], a["breadth"], a["book"]) == (Q[2], 3, 2, 4.0, "Apple, Liberty One", 3, 13.0)
    assert (b["watched_quarters"], b["watched_value"], b["book"]) == (2, 0.0, 2.0) and (c["watched_quarters"], c["watched_value"], c["names"], c["book"]) == (0, 0.0, "", 3.0)


def test_the_manifest_lists_what_did_not_come(spark):
    filings = spark.createDataFrame([("x", Q[1]), ("x", Q[0]), ("y", None), ("z", Q[0])], "issuer string, filed_on date")
    asked = spark.createDataFrame([("x",), ("x",), ("y",), ("w",)], "issuer string")
    assert {tuple(r) for r in C.pull_manifest(filings, asked).collect()} == {("x", 2, Q[0], Q[1]), ("y", 1, None, None), ("w", 0, None, None)}


def test_brokers_by_count_then_name(spark):
    rows = [("a", n) for n in ("Gold", " gold ", "BARK", "bark", "Zed", "Ah", "N/A bank", None, "Moth")] + [("b", "ab")]
    got = [tuple(r) for r in C.common_brokers(spark.createDataFrame(rows, "manager string, name string"), "N/A|NONE", 3).orderBy("manager", "rank").select("manager", "name", "times", "brokers", "rank").collect()]
    assert got == [("a", "BARK", 2, 4, 1), ("a", "GOLD", 2, 4, 2), ("a", "MOTH", 1, 4, 3)]


def test_the_product_is_decided_before_the_order(spark):
    rows = [("a", True, True, 0.1, 1.0), ("b", True, None, 0.9, 1.0), ("c", False, True, 0.9, 2.0), ("d", None, False, 0.5, 9e9), ("e", True, True, None, 9e9), ("f", True, True, 0.1, 1.0)]
    top = [tuple(r)[:3] for r in C.best_fits(spark.createDataFrame(rows, "manager string, may_short boolean, has_local boolean, score double, capacity double"), 5).orderBy("product", "place").collect()]
    assert top == [("b", C.BORROW, 1), ("a", C.FULL, 1), ("f", C.FULL, 2), ("c", C.LOCAL, 1), ("d", C.PASS, 1)]


def test_absence_is_stated(spark, holdings):
    watch = spark.createDataFrame([("LIBERTY ONE",)], "needle string")
    legs = spark.createDataFrame([("liberty", "LIBERTY ONE"), ("liberty", "LIBERTY TWO")], "family string, leg string")
    managers = spark.createDataFrame([("a",), ("c",), ("n",), ("a",)], "manager string")
    owners = spark.createDataFrame([("a", Q[0]), ("a", Q[1])], "manager string, filed_on date")
    advisers = spark.createDataFrame([("a", "Zed LLC"), ("a", "Ant LLC")], "manager string, firm string")
    brokers = C.common_brokers(spark.createDataFrame([("a", "two"), ("a", "two"), ("a", "one")], "manager string, name string"), "NONE")
    got = {r["manager"]: tuple(r)[1:] for r in C.manager_screen(managers, C.watched_books(holdings, watch), C.families(holdings, legs), owners, advisers, brokers).collect()}
    assert got["a"] == ("Liberty One: 2/3 quarters", 4.0, 3, 13.0, "liberty", "2024-04-01", "Ant LLC", "2 named: TWO, ONE")
    assert got["c"] == ("none", 0.0, 1, 3.0, "none", C.NO_OWNER, C.NO_ADVISER, C.NO_BROKER)
    assert got["n"] == (C.NO_FILING, None, None, None, C.NO_FILING, C.NO_OWNER, C.NO_ADVISER, C.NO_BROKER) and len(got) == 3


def test_families_come_with_the_books_from_one_pass(spark, holdings):
    watch = spark.createDataFrame([("LIBERTY ONE",)], "needle string")
    legs = spark.createDataFrame([("liberty", "LIBERTY ONE"), ("liberty", "LIBERTY TWO"), (None, "APPLE"), (None, "LIBERTY ONE")], "family string, leg string")
    managers = spark.createDataFrame([("a",), ("b",), ("c",), ("n",)], "manager string")
    none = spark.createDataFrame([], "manager string, filed_on date, firm string, name string")
    sources = (none, none, C.common_brokers(none, "NONE"))
    apart = C.manager_screen(managers, C.watched_books(holdings, watch), C.families(holdings, legs), *sources)
    at_once = C.manager_screen(managers, C.books_with_families(holdings, watch, legs), None, *sources)
    assert sorted(map(tuple, at_once.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)
    assert {r["manager"]: r["families"] for r in at_once.collect()} == {"a": "liberty", "b": "none", "c": "none", "n": C.NO_FILING}


def test_issuers_may_be_known_by_keys(spark):
    issuers = spark.createDataFrame([(1, "LIBERTY ONE"), (2, "LIBERTY TWO"), (3, "LIBERTY ONE"), (4, None)], "issuer long, name string")
    rows = spark.createDataFrame([("a", Q[0], 1, 2.0), ("a", Q[0], 3, 3.0), ("b", Q[0], 1, 1.0), ("b", Q[0], 2, 1.0), ("b", Q[0], 4, 1.0), ("b", Q[0], None, 1.0)], "manager string, quarter date, issuer long, value double")
    legs = spark.createDataFrame([("liberty", "LIBERTY ONE"), ("liberty", "LIBERTY TWO")], "family string, leg string")
    assert [tuple(r) for r in C.families(rows, legs, issuers).collect()] == [("b", Q[0], "liberty", "LIBERTY ONE, LIBERTY TWO", 4)]
    books = {r["manager"]: (r["watched_value"], r["breadth"], r["book"]) for r in C.watched_books(rows, spark.createDataFrame([("liberty one",)], "needle string"), issuers).collect()}
    assert books == {"a": (5.0, 2, 5.0), "b": (1.0, 4, 4.0)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["join19_manager_screen", "agg48_watched_books", "agg47_families", "top01_best_fits"])
def test_line_items_are_read_once(spark, name):
    from twinleg.plans import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 1
