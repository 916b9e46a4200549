"""Session settings and the durable lineage cut used by iterative operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that one task may hold at once.  Operators count before they rely on it
# and take a split path for whatever is larger.
TASK_ROWS = 1_000_000


def build_session(app: str = "tabulon", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABULON_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """Folder for intermediate data: the one the session names in ``spark.checkpoint.dir``.

    Only a session on a single machine may leave it unset: a folder inside its warehouse is used then.  On a
    cluster such a folder would be the driver's own, so an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder


_scopes: list[list[str]] = []


@contextmanager
def freed(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that are stored inside the block when it ends well; take a path out of the list to keep it."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
    for path in made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it back: columns can be pruned again.

    The files go at the end of the innermost ``freed`` block around the call, or when the session's driver ends; a
    driver that is killed leaves them to the expiry rule of that folder.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    empty = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]  # Parquet has no such type
    df.drop(*empty).write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    back = spark.read.schema(df.drop(*empty).schema).parquet(path)
    return back.withColumns({c: F.lit(None) for c in empty}).select(*[f"`{c}`" for c in df.columns]) if empty else back
