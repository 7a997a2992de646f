"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "attest", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ATTEST_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the checkpoint folder the session names.

    Only a local-mode session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_written = threading.local()


def scratch() -> list[str]:
    """Scratch paths this thread has handed out and not released, oldest first."""
    return _written.__dict__.setdefault("paths", [])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    scratch().append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return scratch()[-1]


def release(paths: list[str]) -> None:
    """Delete scratch folders that no frame to come will read; other paths are left alone."""
    from pyarrow import fs
    for path in [p for p in paths if p in scratch()]:
        system, place = fs.FileSystem.from_uri(path)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)
        scratch().remove(path)


def release_since(mark: int, keep: tuple[str, ...] = ()) -> None:
    """Release what this thread wrote since ``len(scratch())`` was ``mark``, but for tables of the names given."""
    release([p for p in scratch()[mark:] if p.rpartition("/")[2].rpartition("-")[0] not in keep])


def materialised(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back, so later steps scan it once more
    instead of computing it once more, and a lost executor costs a re-read.

    A file of few bytes is read by one task, however long its rows take; ``file_rows`` bounds the rows of a file, if positive."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
