"""Session defaults, lineage cuts and size-checked small tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A table may be handed to every executor only up to this many bytes.
SMALL_TABLE_BYTES = 64 * 1024 * 1024


def get_session(app: str = "arbora", cores: str | int | None = None, shuffle: int | None = None) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster pass neither argument: master and shuffle width come from spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(SMALL_TABLE_BYTES))
        # Vector moments are kept per key while a task aggregates; the default gives up hashing after 128 keys.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "1024")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "12g")
    if shuffle is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's own setting, else (local mode only) a new folder."""
    context = spark.sparkContext
    configured = (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
                  or context.getCheckpointDir())
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="arbora-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage by writing Parquet to the shared folder and reading it back.

    Unlike a cached plan it survives the loss of executors, and the file sizes let the
    optimizer decide on broadcasts from facts.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Distribute rows evenly by a unique key before costly per-row work whose results are grouped by that key.

    The rows move once, before they multiply, and the grouping afterwards needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def take_small(df: DataFrame, max_rows: int):
    """The rows as an Arrow table if there are at most ``max_rows``, else None. Moves at most max_rows + 1 rows."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None
