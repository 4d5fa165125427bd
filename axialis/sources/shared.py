"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; without that setting one of this machine, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="axialis-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = "file://" + _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(folder: str):
    """The pyarrow file system of a folder's address and the path in it."""
    from pyarrow import fs

    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def single_file(spark: SparkSession, folder: str, target: str) -> None:
    """Makes the one part file that Spark wrote to `folder` the file `target` and removes the folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("part-")]
    files.delete(hadoop.Path(target), False)
    files.rename(part, hadoop.Path(target))
    files.delete(path, True)
