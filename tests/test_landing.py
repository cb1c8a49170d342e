"""The landing sink: repeated pulls, conflicts, next partitions, the log, lost and damaged files, tasks that run twice."""

import hashlib

import pytest
from pyspark.sql import functions as F

from twinleg.sources import landing as L

SHAPE = "source string, partition string, series_id string, body binary"


def pull(spark, *rows):
    return spark.createDataFrame([(s, p, i, b if b is None else bytearray(b)) for s, p, i, b in rows], SHAPE)


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/landing"


def statuses(df):
    return sorted((r["source"], r["partition"], r["series_id"], r["status"]) for r in df.collect())


def test_same_bytes_are_no_work_and_other_bytes_an_error(spark, root, tmp_path):
    first = pull(spark, ("a b", "2026-07-29", "x/y", b"1"), ("a b", "2026-07-29", "z", b""), ("c%", "2026-07-29", ".é+*_", None), ("a b", "2026-07-29", "x/y", b"1"))
    assert statuses(L.land(first, root)) == [("a b", "2026-07-29", "x/y", "written"), ("a b", "2026-07-29", "z", "written"), ("c%", "2026-07-29", ".é+*_", "written")]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "landing/data").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert len(files) == 3 and not any(p.name.endswith(".part") for p in files)
    assert {s for *_, s in statuses(L.land(first, root))} == {"unchanged"}
    with pytest.raises(L.Conflict, match="a b/2026-07-29/z"):
        L.land(pull(spark, ("a b", "2026-07-29", "z", b"other"), ("new", "2026-07-29", "n", b"1")), root)
    assert files == {p: p.stat().st_mtime_ns for p in files} and L.manifest(spark, root).where("source = 'new'").count() == 0
    assert {r["status"] for r in L.verify(spark, root).collect()} == {"ok"} and L.worst(L.verify(spark, root)) == 0
    assert L.manifest(spark, root).where("series_id = 'z'").first()["sha256"] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(L.Conflict):
        L.land(pull(spark, ("q", "2026-07-29", "z", b"1"), ("q", "2026-07-29", "z", b"2")), root, revise=True)


def test_revisions_take_the_next_partition(spark, root):
    for n, body in enumerate((b"1", b"2", b"3")):
        done = L.land(pull(spark, ("s", "2026-07-29", "x", body), ("s", "2026-07-29", "y", b"same"), ("t", "2026-07-30", f"k{n}", b"")), root, revise=True)
        where = "2026-07-29" + (f".{n + 1}" if n else "")
        assert ("s", where, "x", "revised" if n else "written") in statuses(done) and ("s", "2026-07-29", "y", "unchanged" if n else "written") in statuses(done)
    assert {r["partition"] for r in L.manifest(spark, root).where("source = 's'").collect()} == {"2026-07-29", "2026-07-29.2", "2026-07-29.3"}
    free = L.next_partition(pull(spark, ("s", "2026-07-29", "x", b""), ("s", "2026-07-31", "x", b""), ("t", "2026-07-30.7", "x", b"")), L.manifest(spark, root))
    assert sorted(r["partition"] for r in free.collect()) == ["2026-07-29.4", "2026-07-30.2", "2026-07-31"]


def test_lost_and_damaged_files_are_told(spark, root, tmp_path):
    L.land(pull(spark, *(("s", "d", f"k{i}", b"%d" % i) for i in range(4))), root)
    (tmp_path / "landing/data/s/d/k1").unlink()
    (tmp_path / "landing/data/s/d/k2").write_bytes(b"!")
    (tmp_path / "landing/data/s/d/.k2.crc").unlink(missing_ok=True)
    assert [s for *_, s in statuses(L.verify(spark, root))] == ["ok", "missing", "MISMATCH", "ok"] and L.worst(L.verify(spark, root)) == 2
    with pytest.raises(Exception, match="other bytes"):  # a file that the manifest doesn't know is never overwritten
        L.planned(pull(spark, ("s", "d", "k2", b"2")), L.manifest(spark, root).where("false")).drop("status").mapInArrow(L._write(root), L.MANIFEST + ", status string").collect()


def test_a_task_that_runs_twice(spark, root):
    plan = L.planned(pull(spark, ("s", "d", "k", b"1")), L.manifest(spark, root)).drop("status")
    write = lambda: plan.mapInArrow(L._write(root), L.MANIFEST + ", status string").first()["status"]
    assert (write(), write()) == ("written", "unchanged")


def test_nothing_landed_yet(spark, root):
    assert L.manifest(spark, root).count() == 0 and L.pull_log(spark, root).count() == 0 and L.verify(spark, root).count() == 0 and L.worst(L.verify(spark, root)) == 0
    assert L.land(pull(spark), root).count() == 0


def test_the_log_keeps_its_twelve_fields(spark, root):
    line = spark.range(1).select(
        *(F.lit("x").alias(c) for c in ("pulled_at_utc", "source", "series_id", "provider", "source_url", "sha256", "path", "status", "first_obs_date")),
        F.create_map(F.lit("a"), F.lit("b")).alias("params"), F.lit(3).cast("long").alias("rows"), F.lit(None).cast("string").alias("last_obs_date"),
    )
    for n in (1, 2):
        L.append_log(line, root)
        assert L.pull_log(spark, root).count() == n
    assert len(L.pull_log(spark, root).columns) == 12
    with pytest.raises(ValueError):
        L.append_log(line.drop("rows"), root)
    with pytest.raises(Exception, match="sha256 is missing"):
        L.append_log(line.withColumn("sha256", F.lit(None).cast("string")), root)
