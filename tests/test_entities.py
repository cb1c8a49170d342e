"""Entity resolution against comparing all pairs, with short, odd and null names, and hand-made cases."""

import datetime
import random

from twinleg.operators import entities as E


def test_containing_equals_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ABC .,") for _ in range(rng.randrange(0, 9)))
    names = [(i, word()) for i in range(300)] + [(300, None), (301, "A.B"), (301, "A.B"), (302, "é,ABC")]
    needles = [word() for _ in range(120)] + [None, "", ".", "A", "b", "é", "zz", "ABCABCABC"]
    plain = lambda t: (t or "").upper().replace(".", "").replace(",", "")
    want = sorted((k, i, n) for k in set(needles) if plain(k) for i, n in names if plain(n) and plain(k) in plain(n))
    got = E.containing(spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([(k,) for k in needles], "needle string"))
    assert sorted((r["needle"], r["id"], r["name"]) for r in got.collect()) == want
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_prefix_before_substring_and_vehicles_last(spark):
    names = [(1, "NORTHERN CAPITAL RESEARCH LLC"), (2, "CAPITAL RESEARCH GLOBAL FUND"), (3, "CAPITAL RESEARCH & MANAGEMENT CO"), (4, "CAPITAL RESEARCH"), (5, "A CAPITAL RESEARCH"), (6, "Other")]
    got = E.candidates(spark.createDataFrame(names, "id int, name string"), spark.createDataFrame([("Capital, Research.",)], "needle string"), 4).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(4, 1), (3, 2), (2, 3), (5, 4)]


def test_dormant_and_empty_filers_are_passed_over(spark):
    day = datetime.date
    ranked = spark.createDataFrame([("x", 1, "a", 1), ("x", 2, "b", 2), ("x", 3, "c", 3), ("y", 1, "a", 1)], "needle string, id int, name string, rank int")
    filings = spark.createDataFrame([(1, day(2005, 3, 31), 9), (2, day(2024, 3, 31), 0), (2, day(2023, 12, 31), 7), (3, day(2024, 3, 31), 4), (3, day(2023, 12, 31), 0), (None, day(2024, 3, 31), 1)], "id int, report_date date, holdings long")
    assert [tuple(r) for r in E.by_capability(ranked, filings, "2022-01-01").collect()] == [("x", 3, "c", 3, 2, day(2024, 3, 31))]
    assert E.by_capability(ranked, filings.where("id = 3"), "2022-01-01", limit=1).first()["filings"] == 1


def test_a_near_miss_is_refused(spark):
    registry = spark.createDataFrame([(1, "Acme Capital Partners", "INACTIVE"), (2, "Acme Capital Partners Asia", "ACTIVE"), (3, "Acme Holdings", "ACTIVE"), (4, "Zeta One Co", "ACTIVE")], "id int, name string, status string")
    needles = spark.createDataFrame([("Acme Capital",), ("Acme Ventures",), ("Zeta One",), ("Nobody",)], "needle string")
    got = {r["needle"]: (r["id"], r["refused"]) for r in E.registration(registry, needles).collect()}
    assert got == {"Acme Capital": (2, False), "Acme Ventures": (None, True), "Zeta One": (4, False)}


def test_watch_list(spark):
    held = spark.createDataFrame([("SK HYNIX INC", 5), ("SAMSUNG ELECTRONICS", 6), ("OTHER", 7)], "issuer string, value int")
    got = E.watched(held, spark.createDataFrame([("Hynix",), ("Samsung",), ("Electronics",)], "needle string")).orderBy("value").collect()
    assert [(r["value"], r["watched"]) for r in got] == [(5, ["Hynix"]), (6, ["Electronics", "Samsung"])]
