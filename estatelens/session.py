"""Session settings and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning and skew handling that every plan here counts on.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split skewed join partitions also where that costs a later shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the cluster already made."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, name: str = "estatelens", **extra: str
) -> SparkSession:
    """A local session for tests and the benchmark; ``extra`` settings have ``__`` for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("ESTATELENS_DRIVER_MEMORY", "8g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    settings = RUNTIME_CONF | {"spark.sql.session.timeZone": "UTC"} | {key.replace("__", "."): value for key, value in extra.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets
    a temporary folder; on a cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="estatelens-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to a new place in the shared checkpoint folder and go on from there.

    Cuts the lineage without depending on any executor staying alive, and lets a table be overwritten
    by a plan that read it. Unlike a checkpoint of rows it is read back column by column, and its size
    is known to the optimizer. Like checkpoints, the files stay until the cluster clears the folder, or
    until ``release`` is called for them.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/durable-{uuid.uuid4().hex}"
    _written.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_written: list[str] = []


def written() -> list[str]:
    """Folders that ``durable`` has written in this process and that are not released, oldest first."""
    return list(_written)


def release(spark: SparkSession, folders: list[str], still_read: DataFrame | None = None) -> list[str]:
    """Delete folders of ``durable`` through the cluster's file system; returns those that were deleted.

    Folders that ``still_read`` reads stay.
    """
    used = "\n".join(still_read.inputFiles()) if still_read is not None else ""
    gone = [f for f in folders if f in _written and f.rsplit("/", 1)[1] not in used]
    for folder in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(folder)
    return gone
