"""Session settings and the shared folder that staged tables live in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Record text and landed rows take about half of what the default codec needs.
SMALL_CODEC = "zstd"
_noted: ContextVar[tuple[list[str], ...]] = ContextVar("noted", default=())


def build_session(app_name: str = "recordloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # call sites of every column expression cost more than the expressions themselves
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def size_session(spark: SparkSession, input_bytes: int, task_bytes: int = 256 * 1024 * 1024) -> None:
    """Fit scans and shuffles to the size of the input.

    Adaptive execution merges shuffle partitions that turn out small but adds none, so
    their number starts at one per ``task_bytes`` of input. Scan tasks grow beyond that
    size once there would be more than a hundred thousand of them.
    """
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // task_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(min(partitions, 1_000_000)))
    scan_bytes = min(max(task_bytes // 2, -(-input_bytes // 100_000)), 1024**3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(scan_bytes))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names, or the session's own checkpoint folder."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application.

    That folder may be deleted once the application has ended and its results are written.
    """
    path = f"{shared_dir(spark).rstrip('/')}/recordloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for paths in _noted.get():
        paths.append(path)
    return path


@contextmanager
def note_staged() -> Iterator[list[str]]:
    """A list that gets the scratch paths taken inside, to :func:`release` them later."""
    paths: list[str] = []
    token = _noted.set((*_noted.get(), paths))
    try:
        yield paths
    finally:
        _noted.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables before the application ends. No frame that is still to be computed may read them."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several
    consumers share one computation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
