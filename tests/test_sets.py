"""Set operations, keep-last and expanding windows by hand arithmetic, with empty tables, ties and nulls."""

from __future__ import annotations

import datetime as dt

from twinleg.operators import series as S
from twinleg.operators import sets as T

DAY = [dt.date(2020, 1, k) for k in range(1, 8)]


def test_calendar_sets(spark):
    rows = [("p", "A", DAY[0]), ("p", "A", DAY[1]), ("p", "N", DAY[1]), ("p", "N", DAY[2]), ("p", "N", DAY[2]), ("p", "R", DAY[3])]
    bars = spark.createDataFrame(rows, "pair_id string, leg string, date date")
    got = {r["date"]: r["side"] for r in T.calendar_sets(bars, "A", "N").collect()}
    assert got == {DAY[0]: "first", DAY[1]: "both", DAY[2]: "second"}
    assert T.calendar_sets(bars.limit(0), "A", "N").count() == 0


def test_keep_last_settles_ties_by_the_order(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 5, None)], "k int, at int, v string")
    assert {tuple(r) for r in T.keep_last(rows, ["k"], ["at", "v"]).collect()} == {(1, 2, "c"), (2, 5, None)}


def test_effective_leaves_the_end_of_a_chain(spark):
    events = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "unknown")], "id string, supersedes string")
    assert {r["id"] for r in T.effective(events).collect()} == {"c", "d"}


def test_expanding_percentile_counts_itself(spark):
    panel = spark.createDataFrame([("p", d, x) for d, x in zip(DAY, [3.0, 1.0, 2.0, 2.0])], "pair_id string, date date, pi double")
    got = [r["percentile"] for r in S.expanding_percentile(panel, 2).orderBy("date").collect()]
    assert got == [None, 0.5, 2 / 3, 0.75]


def test_quintiles_hold_all_rows_with_a_next_session(spark):
    panel = spark.createDataFrame([("p", d, float(k)) for k, d in enumerate(DAY)], "pair_id string, date date, pi double")
    got = T.quintile_changes(panel).collect()
    assert sum(r["n"] for r in got) == 6 and all(r["mean_step"] == 1.0 for r in got)
