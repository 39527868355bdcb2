"""Tables written to the cluster's shared folder to cut lineage.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where that is unset,
as in tests, a fresh temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MOST_PINNED_ROWS = 100_000
CHECKPOINT_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_stored: dict[tuple[str, str], DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder every executor can reach.")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _local_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write once as Parquet and read back: later passes prune columns and survive lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)


def store_once(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table for a label; ``build`` stores it on its first use in this application."""
    key = (spark.sparkContext.applicationId, label)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def _located(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``store`` wrote, once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    system, path = _located(spark, folder)
    system.delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    system, path = _located(spark, folder)
    return system.exists(path)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a complete folder: readers of ``target`` see all of it or nothing."""
    system, path = _located(spark, source)
    _, goal = _located(spark, target)
    if goal.getParent() is not None:
        system.mkdirs(goal.getParent())
    if system.exists(goal) or not system.rename(path, goal):
        raise FileExistsError(f"{target} could not be taken by a new table.")


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Put a small text file in the place of another in one step: readers see the old one or the new one."""
    system, goal = _located(spark, path)
    hadoop, settings = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    draft = hadoop.Path(f"{path}.{uuid.uuid4().hex}.draft")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    rename = getattr(hadoop, "Options$Rename")
    modes = spark.sparkContext._gateway.new_array(rename, 1)
    modes[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(system.getUri(), settings).rename(system.makeQualified(draft), system.makeQualified(goal), modes)


def folders_below(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder, the oldest first."""
    system, path = _located(spark, folder)
    found = [s for s in system.listStatus(path) if s.isDirectory()]
    return [s.getPath().getName() for s in sorted(found, key=lambda s: s.getModificationTime())]


def pin(df: DataFrame, most: int = MOST_PINNED_ROWS) -> DataFrame:
    """Keep a frame of aggregated facts, whose size follows the schema: as literal rows, or, beyond
    ``most`` of them, as a stored table."""
    rows = df.limit(most + 1).collect()
    return store(df, "pinned") if len(rows) > most else df.sparkSession.createDataFrame(rows, df.schema)
