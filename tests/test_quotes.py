"""Streams against the same rows in a batch, with late rows, repeats and silence."""

from __future__ import annotations

import datetime as dt
import json

from twinleg.streaming import quotes as Q

T0 = dt.datetime(2024, 1, 2, 15, 0, tzinfo=dt.timezone.utc)


def _rows():
    out = []
    for k in range(30):
        at = T0 + dt.timedelta(seconds=20 * k)
        for symbol, last in (("A", 100.0 + k), ("N", 50.0 + k % 3), ("X", 2.0)):
            bad = symbol == "N" and 9 <= k < 15
            out.append({"captured_at": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "symbol": symbol, "last": None if bad else last, "provider_ts": str(k // 2), "error": "timeout" if bad else None})
    return out


def _folder(tmp_path):
    rows = _rows()
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i * 30 : (i + 1) * 30]))
    return str(tmp_path / "in")


def _run(df, name, tmp_path, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count()


def test_bars_and_gap_equal_a_batch(spark, tmp_path):
    folder = _folder(tmp_path)
    stream, batch = Q.quotes_only(Q.quote_stream(spark, folder)), Q.quotes_only(spark.read.schema(Q.QUOTE).json(folder))
    _same(_run(Q.bars(stream), "bars", tmp_path), Q.bars(batch))
    gaps = Q.contemporaneous_gap(batch, "A", "N", "X", 4.0)
    assert {r["start"].minute for r in gaps.collect()} == {0, 1, 2, 5, 6, 7, 8, 9}  # minutes 3 and 4 have no local quote
    _same(_run(Q.contemporaneous_gap(stream, "A", "N", "X", 4.0), "gaps", tmp_path), gaps)


def test_gap_runs_and_level_changes(spark, tmp_path):
    folder = _folder(tmp_path)
    records, stream = spark.read.schema(Q.QUOTE).json(folder), Q.quote_stream(spark, folder)
    assert [(r["symbol"], r["n"]) for r in Q.gap_runs(records).collect()] == [("N", 6)]
    found = _run(Q.level_changes(Q.quotes_only(stream), 0.03), "levels", tmp_path, "append").collect()
    assert {r["symbol"] for r in found} == {"N"} and all(r["kind"] == "consumption" and r["level"] == 50.0 for r in found if r["previous"] == 52.0)


def test_repeats_are_dropped_and_hours_are_local(spark, tmp_path):
    folder = _folder(tmp_path)
    assert _run(Q.once(Q.quotes_only(Q.quote_stream(spark, folder)).where("symbol = 'A'"), "1 hour"), "once", tmp_path, "append").count() == 15
    batch = spark.read.schema(Q.QUOTE).json(folder)
    assert {r["symbol"] for r in Q.in_hours(batch, {"A": ("America/New_York", "09:30", "16:00"), "N": ("Asia/Seoul", "09:00", "15:30")}).collect()} == {"A"}
