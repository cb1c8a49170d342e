"""Making the package importable in Python workers, and cutting lineage."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to this application's Python workers, once."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="twinleg-")) / "twinleg_src"
        shutil.copytree(root, base / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", base))
        _SHIPPED.add(app)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder that spark.checkpoint.dir names; where it is unset, as in tests, in one of our own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="twinleg-checkpoints-"))
    return df.checkpoint()


def registry(df, row_bytes: int = 256, most: int = 16 << 20):
    """``df`` marked for broadcast if, counted, it takes at most ``most`` bytes at ``row_bytes`` a row, else for a join by sorting
    (whose skewed partitions Spark splits)."""
    from pyspark.sql import functions as F

    rows = most // row_bytes
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")
