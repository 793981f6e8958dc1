"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only a local session may lack
it (as in tests); then a folder of this process is used and removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

_own: dict[str, str] = {}

#: Bytes of a batch of rows that is handed to Python: two or three of these and one text are what a task holds beside its own state.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, bound the batches that they are handed, and let small results be few files.

    Partitions are merged up to the advisory size instead of down to the number of cores: the
    many small tables of a join would else be a file and a task for every core.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")


def wide(spark: SparkSession) -> int:
    """Partitions for stages whose work is large against their bytes: they should not be merged."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """Base folder for intermediate tables; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        path = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        _own[key] = f"file://{path}"
        atexit.register(shutil.rmtree, path, True)
    return _own[key]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


_made: list[list[DataFrame]] = []


def store(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages survive lost executors.

    It is deleted with the session at the latest, and before by ``drop`` or ``scratch``.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    at, files = _place(out)
    files.deleteOnExit(at)
    if _made:
        _made[-1].append(out)
    return out


def _place(df: DataFrame):
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    return at, at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def drop(*frames: DataFrame) -> None:
    """Delete stored tables that no later stage reads."""
    for df in frames:
        at, files = _place(df)
        files.delete(at, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Delete the tables that are stored within, but for those that the caller puts into the list."""
    keep: list[DataFrame] = []
    _made.append([])
    try:
        yield keep
    finally:
        made = _made.pop()
    if _made:
        _made[-1].extend(keep)
    kept = {df._stored_path for df in keep}
    drop(*(df for df in made if df._stored_path not in kept))
