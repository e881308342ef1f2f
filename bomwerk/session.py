"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Runtime settings the plans rely on. Adaptive execution measures every shuffle: it
# broadcasts a join side only when its measured size is below the threshold, splits
# skewed join partitions and merges small ones.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows of whole documents: keeps what a Python worker holds small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bomwerk")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where none is named, a folder below the warehouse; on a cluster the warehouse must then
    be in shared storage, not in a folder of the driver's machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
            if not context.master.startswith("local") and folder.startswith(("file:", "/")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{_scratch.get() or checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All folders of runs started inside are dropped at the end; write results before it."""
    folder = run_folder(spark, "scratch")
    outer = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(outer)
        drop_folder(spark, folder)


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folder_exists(spark: SparkSession, folder: str) -> bool:
    files, path = _file_system(spark, folder)
    return files.exists(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``run_folder`` gave, with all that is in it."""
    if "/" not in folder.rstrip("/").removeprefix(checkpoint_dir(spark).rstrip("/")) or not folder.startswith(checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"{folder} is not below the checkpoint folder")
    files, path = _file_system(spark, folder)
    files.delete(path, True)
