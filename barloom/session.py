"""Session helpers: settings the jobs rely on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "barloom") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the submitter sets master and sizes."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; a temporary one only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = context.getCheckpointDir()
        if folder is None:
            folder = tempfile.mkdtemp(prefix="barloom-checkpoint-")
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder. A lost executor re-reads it instead of re-running it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_writers: dict[int, list] = {}
_writers_lock = threading.Lock()


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when a write inside ends: a written table is their only reader.

    The setting belongs to the session, so writers in several threads share it: the first one sets it and the last one
    puts back what was there.
    """
    with _writers_lock:
        state = _writers.setdefault(id(spark), [0, None])
        if state[0] == 0:
            state[1] = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _writers_lock:
            state[0] -= 1
            if state[0] == 0:
                if state[1] is None:
                    spark.conf.unset(SHUFFLE_CLEANUP)
                else:
                    spark.conf.set(SHUFFLE_CLEANUP, state[1])


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame that several branches of a plan use as a parquet table in the shared folder, and read it.

    Each branch then scans only its columns instead of running everything before it again. The folder lives as
    long as the checkpoint folder does.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffle_cleanup(spark):
        df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.scratch_folder = folder
    return out


def discard(table: DataFrame) -> None:
    """Delete the folder of a ``stored`` table that nothing reads any more. Frames that are still lazy must not use it."""
    folder = getattr(table, "scratch_folder", None)
    if folder is None:
        raise ValueError("not a stored table")
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_series(df: DataFrame, keys: tuple[str, ...] = ("sym",)) -> DataFrame:
    """Hash by series with the session's partition count.

    Window work per row is far heavier than its bytes suggest; a plain shuffle would be packed by size into a
    few tasks. A fixed count keeps every core busy, and all windows and grouped passes by the key reuse it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row: a scalar subquery, so no join and no cross product."""
    packed = row.select(F.struct(*row.columns)).scalar()
    out = df.withColumn("_row", packed)
    return out.select(*[F.col(c) for c in df.columns], *[F.col("_row").getField(c).alias(c) for c in row.columns])
