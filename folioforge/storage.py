"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_stored: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("intermediate tables need a folder that driver and executors share: set spark.checkpoint.dir")
    if _own_folder is None:
        folder = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, folder, True)
        _own_folder = "file://" + folder
    return _own_folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None, rows_a_file: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    rows_a_file bounds the rows of a file, and so what a reader of wide rows decodes at a time; 0 for no bound.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path, compression=compression)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files and folders of the file system behind a path, whatever it is: what a job's driver keeps beside its tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *below: str):
        out = self.at
        for x in below:
            out = self.jvm.org.apache.hadoop.fs.Path(out, x)
        return out

    def exists(self, *below: str) -> bool:
        return self.fs.exists(self.path(*below))

    def names(self, *below: str) -> list[str]:
        """Names in a folder, in their order; none if there is no such folder."""
        at = self.path(*below)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *below: str) -> str:
        stream = self.fs.open(self.path(*below))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *below: str) -> None:
        """A file that is there as a whole or not at all: written beside its place, then renamed."""
        at = self.path(*below)
        beside = self.jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        self.fs.delete(at, False)
        if not self.fs.rename(beside, at):
            raise OSError(f"cannot write {at}")

    def move(self, source: str, *below: str) -> None:
        """A folder takes the place of another one, or of none."""
        at = self.path(*below)
        self.fs.delete(at, True)
        self.fs.mkdirs(at.getParent())
        if not self.fs.rename(self.jvm.org.apache.hadoop.fs.Path(source), at):
            raise OSError(f"cannot move {source} to {at}")

    def delete(self, *below: str) -> None:
        self.fs.delete(self.path(*below), True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at its end, and nothing else: write the results that read it before."""
    begin = len(_stored)
    try:
        yield
    finally:
        clear(spark, begin)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that this driver has stored (behind the first `since` of them), once their results are written or no longer needed; their number."""
    from pyarrow import fs

    many = 0
    while len(_stored) > since:
        path = _stored.pop()
        if path.startswith("file:"):
            shutil.rmtree(fs.FileSystem.from_uri(path)[1], True)
        else:
            jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
            at = jvm.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        many += 1
    return many
