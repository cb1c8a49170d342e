"""Immutable landing of payloads: content digests, a manifest, next free partitions, an append-only pull log, verification.

A payload's place is source/partition/series.  Tasks write it under a temporary name and move it there, so a reader never sees half
a file; a place that exists is never written again.  Writing the same bytes is no work, so a task that runs twice, or a whole pull
that is repeated, leaves the same files; other bytes for a landed place are a conflict, and then nothing of the pull is written.
The manifest and the log are appended to, a folder for each pull.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of the pull log (fixed names).
LOG = (
    "pulled_at_utc string, source string, series_id string, provider string, source_url string, params map<string, string>, rows long, "
    "first_obs_date string, last_obs_date string, sha256 string, path string, status string"
)
MANIFEST = "source string, partition string, series_id string, path string, sha256 string, bytes long"
KEY = ["source", "partition", "series_id"]
#: Bytes that are read at once.
PIECE = 1 << 23


class Conflict(Exception):
    """A landed place was given other bytes."""


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``; made here only for a local session without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='landing-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/landing-{uuid.uuid4().hex}"


def _appended(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All rows that were appended to a table under ``root``; none if it doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{name}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return _appended(spark, root, "manifest", MANIFEST)


def pull_log(spark: SparkSession, root: str) -> DataFrame:
    """SNK-05: all lines of the pull log, of every pull."""
    return _appended(spark, root, "log", LOG)


def _name(c: str):
    """A path part: what isn't a plain letter is written as its code, and so is a first point or underscore, which would hide it."""
    coded = F.replace(F.url_encode(F.col(c)), F.lit("*"), F.lit("%2A"))
    return F.regexp_replace(F.regexp_replace(coded, "^_", "%5F"), "^\\.", "%2E").alias(c)


def planned(payloads: DataFrame, known: DataFrame) -> DataFrame:
    """``payloads`` (KEY, body) with sha256, path and status: ``written`` (new), ``unchanged`` or ``conflict``.

    Two payloads of one place with different bytes are a conflict, with the same bytes one payload.  Null bodies are empty.
    """
    body = F.coalesce(F.col("body"), F.lit(b""))
    rows = payloads.select(*KEY, body.alias("body")).withColumn("sha256", F.sha2("body", 256))
    rows = rows.dropDuplicates([*KEY, "sha256"]).withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))
    landed = known.select(*KEY, F.col("sha256").alias("landed")).distinct()
    status = F.when((F.col("n") > 1) | (F.col("landed") != F.col("sha256")), "conflict").when(F.col("landed").isNotNull(), "unchanged").otherwise("written")
    path = F.concat_ws("/", *(_name(c) for c in KEY))
    return rows.join(landed.hint("merge"), KEY, "left").select(*KEY, path.alias("path"), "body", "sha256", status.alias("status"))


def next_partition(payloads: DataFrame, known: DataFrame) -> DataFrame:
    """SNK-07: ``payloads`` with the first free partition of their day in their source: the day itself, then day.2, day.3, ..."""
    day, number = F.substring_index("partition", ".", 1), F.coalesce(F.get(F.split("partition", "\\."), F.lit(1)).try_cast("int"), F.lit(1))
    taken = known.select("source", day.alias("partition"), number.alias("k")).groupBy("source", "partition").agg((F.max("k") + 1).alias("k"))
    rows = payloads.withColumn("partition", day).join(taken.hint("merge"), ["source", "partition"], "left")
    return rows.withColumn("partition", F.when(F.col("k").isNull(), F.col("partition")).otherwise(F.concat_ws(".", "partition", "k"))).select(*payloads.columns)


def _write(root: str):
    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            status = []
            for path, body, sha in zip(*(b.column(c).to_pylist() for c in ("path", "body", "sha256")), strict=True):
                place = f"{base}/data/{path}"
                if system.get_file_info(place).type != fs.FileType.NotFound:
                    with system.open_input_stream(place) as f:
                        if hashlib.sha256(f.read()).hexdigest() != sha:
                            raise Conflict(f"{place} holds other bytes")
                    status.append("unchanged")
                    continue
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(body)
                system.move(part, place)
                status.append("written")
            rest = [b.column(c) for c in (*KEY, "path", "sha256")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) for x in b.column("body").to_pylist()], pa.int64()), pa.array(status, pa.string())], names=[*KEY, "path", "sha256", "bytes", "status"])

    return run


def land(payloads: DataFrame, root: str, revise: bool = False) -> DataFrame:
    """SNK-01: land ``payloads`` (source, partition, series_id, body) under ``root``: KEY, path, sha256, status of each.

    Raises ``Conflict``, before anything is written, if a landed place is given other bytes; with ``revise`` these payloads go to
    the next free partition of their day instead (``revised``), and both stay.
    """
    spark = payloads.sparkSession
    pull = uuid.uuid4().hex
    known = manifest(spark, root)
    # the plan is kept with its bodies: what is judged is what is written
    plan_at = f"{root}/plans/{pull}"
    planned(payloads, known).write.parquet(plan_at)
    plan = spark.read.parquet(plan_at)
    conflicts = plan.where("status = 'conflict'")
    ready = plan.where("status <> 'conflict'")
    bad = conflicts.select(*KEY).limit(5).collect()
    if bad:
        inside = conflicts.groupBy(*KEY).count().where("count > 1").limit(1).collect()
        if not revise or inside:
            raise Conflict("landed places were given other bytes: " + ", ".join("/".join(r) for r in bad))
        moved = next_partition(conflicts.select(*KEY, "body"), known)
        ready = ready.unionByName(planned(moved, known).withColumn("status", F.lit("revised")))
    done = ready.where("status <> 'unchanged'").drop("status").mapInArrow(_write(root), MANIFEST + ", status string")
    done.select(*(f.split()[0] for f in MANIFEST.split(", "))).write.parquet(f"{root}/manifest/{pull}")
    return ready.select(*KEY, "path", "sha256", "status")


def append_log(lines: DataFrame, root: str) -> None:
    """SNK-05: append lines with the twelve fields of LOG; other columns, and missing or null ones other than dates, are errors."""
    names = [f.split()[0] for f in LOG.replace("map<string, string>", "map").split(", ")]
    if sorted(lines.columns) != sorted(names):
        raise ValueError(f"a pull's line has the fields {names}, not {lines.columns}")
    optional = {"first_obs_date", "last_obs_date"}
    held = [F.col(n) if n in optional else F.coalesce(n, F.raise_error(F.lit(f"{n} is missing")).cast(lines.schema[n].dataType)).alias(n) for n in names]
    lines.select(*held).write.parquet(f"{root}/log/{uuid.uuid4().hex}")


def verify(spark: SparkSession, root: str) -> DataFrame:
    """SNK-04: every manifest entry as (KEY, path, status): ok, missing or MISMATCH, by the digests of the files as they are now.

    Tasks read the files of their entries in pieces, so their size doesn't matter, and empty files are files.
    """

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            status = []
            for path, sha in zip(b.column("path").to_pylist(), b.column("sha256").to_pylist(), strict=True):
                place, now = f"{base}/data/{path}", hashlib.sha256()
                if system.get_file_info(place).type == fs.FileType.NotFound:
                    status.append("missing")
                    continue
                with system.open_input_stream(place) as f:
                    while piece := f.read(PIECE):
                        now.update(piece)
                status.append("ok" if now.hexdigest() == sha else "MISMATCH")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*KEY, "path")), pa.array(status, pa.string())], names=[*KEY, "path", "status"])

    known = manifest(spark, root).select(*KEY, "path", "sha256")
    return known.mapInArrow(run, "source string, partition string, series_id string, path string, status string")


def damage(entries: DataFrame, root: str, lost: str) -> None:
    """For drills of ``verify``: the files of these manifest entries are removed where ``lost`` holds, and overwritten elsewhere."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, gone in zip(b.column("path").to_pylist(), b.column("lost").to_pylist(), strict=True):
                place = f"{base}/data/{path}"
                if not gone:
                    with system.open_output_stream(place) as f:
                        f.write(b"damaged")
                elif system.get_file_info(place).type != fs.FileType.NotFound:
                    system.delete_file(place)
            yield b.select(["path"])

    entries.select("path", F.expr(lost).alias("lost")).mapInArrow(run, "path string").count()


def worst(verified: DataFrame) -> int:
    """The exit code of a verification: 0 all ok, 1 something is missing, 2 something doesn't match."""
    code = verified.agg(F.max(F.when(F.col("status") == "MISMATCH", 2).when(F.col("status") == "missing", 1).otherwise(0))).first()[0]
    return code or 0
