"""Shared helpers: tables in the cluster's shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructField, StructType, _parse_datatype_string

#: A side is broadcast only when its rows, counted and measured, hold at most this many bytes.
BROADCAST_BYTES = 16 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Set here only where it is unset and the session is local, as in tests; a cluster without it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/twinleg/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more (what came of them is written itself).

    Shuffle files go when the driver collects the plans that made them, so it is asked to collect now.
    """
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches to Python workers end at ARROW_BYTES, too, beside Spark's 10,000 rows.

    Ten thousand texts or sets are often a task's whole input, which is held by the JVM (outside its heap, twice while it grows)
    and by the worker.  The setting stays in the session, as tables that are returned are computed later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def settle(spark: SparkSession) -> None:
    """Let the driver collect plans that nothing refers to, so that their shuffle files go before the next ones are made.

    Python lets go of the driver's objects by a thread of its own, which looks once a second.
    """
    gc.collect()
    for seconds in (1.2, 0.6):
        time.sleep(seconds)
        spark._jvm.System.gc()


def _width(column: Column, kind: DataType) -> Column:
    """Bytes that a value takes in a row, about."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = 8 if not isinstance(kind.elementType, StructType) else 16 + 24 * len(kind.elementType.fields)
        return F.coalesce(F.size(column), F.lit(0)) * (40 if isinstance(kind.elementType, StringType) else each) + 16
    return F.lit(8 + 8 * len(kind.fields) if isinstance(kind, StructType) else 8)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit`` bytes, else with a sort-merge hint.

    ``df`` should be a written table, so that measuring is cheap.
    """
    rows = df.limit(limit // 16 + 1)
    size = rows.select(sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8)).alias("w")).agg(F.sum("w")).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df.hint("merge")


def schema_with(df: DataFrame, **added: str) -> StructType:
    """The schema of ``df`` and further columns."""
    return StructType([*df.schema.fields, *(StructField(k, _parse_datatype_string(v)) for k, v in added.items())])


def text_of(name: str = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (a, b of any one ordered type), as (node, component); a written table.

    Alternates large-star and small-star steps, in which every node talks only to its neighbourhood's minimum, so rows stay
    proportional to the edges and hubs are aggregated before the shuffle.  The joins read written tables and aggregates of them, so
    the adaptive plan knows their sizes: minima are broadcast while they are small, and beyond that a hub's neighbours are
    split.  Each round is a written table, and the one before it is deleted.
    """
    ends = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc")
    state = ends(links)
    for _ in range(rounds):
        if not state[0]:
            break
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(lower, "hi")
        step = near.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionAll(lower.select("hi", F.col("m").alias("lo"))).distinct()
        before, links = links, written(step, "cc")
        now = ends(links)
        discard(before)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    # Settled links are stars: every node points at the smallest node that it reaches.
    out = links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    out = written(out, "components")
    discard(links)
    return out
