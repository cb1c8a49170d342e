"""Provenance by hand arithmetic, with names outside the grammar, nulls and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinleg.operators import records as R


def test_newest_pull_compares_numbers(spark):
    files = spark.createDataFrame([("a", "2026-08-03.9"), ("a", "2026-08-03.25"), ("a", "2026-08-03"), ("a", "latest"), ("b", "tmp"), ("c", "2026-08-01"), ("c", None)], "k string, partition string")
    assert {(r["k"], r["partition"], r["seq"]) for r in R.newest_pull(files, ["k"]).collect()} == {("a", "2026-08-03.25", 25), ("c", "2026-08-01", 0)}
    assert R.newest_pull(files.limit(0), ["k"]).count() == 0


def test_clean_number(spark):
    rows = spark.createDataFrame([("$1,234.50",), ("12%",), ("--",), ("N/A",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(R.clean_number(F.col("t"))).collect()] == [1234.5, 12.0, None, None, None, None]


def test_merge_manifest(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "3")], "path string, sha256 string")
    assert {tuple(r) for r in R.merge_manifest(old, new).collect()} == {("a", "1", "kept", None), ("b", "1", "same", None), ("c", "1", "conflict", None), ("d", "3", "new", None)}
    assert ("c", "2", "updated", "1") in {tuple(r) for r in R.merge_manifest(old, new, True).collect()}


def test_revisions_and_direction(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0), (2, None), (4, 1.0)], "k int, v double")
    assert {tuple(r) for r in R.revisions(a, b, ["k"], ["v"]).collect()} == {(1, "changed"), (3, "removed"), (4, "added")}
    rates = spark.createDataFrame([(1453.0,), (1 / 1453.0,), (0.0,), (None,)], "fx double")
    assert [r["direction"] for r in R.quote_direction(rates, 900.0, 2000.0).collect()] == ["ok", "inverted", "out", "out"]
