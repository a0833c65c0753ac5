"""Shared-folder storage: materialised tables and binary files.

Every intermediate that outlives a task goes to the folder which the cluster
names in ``spark.checkpoint.dir``; a folder of our own is chosen only where the
setting is absent (single-machine tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import shared_folder


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_folder(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd", small_rows: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here.

    ``small_rows``: narrow rows that come from many tasks are dealt again, so
    that files have a useful size whatever the number of tasks.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.hint("rebalance") if small_rows else df).write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(pyarrow filesystem, path inside it) of a URI or a plain local path."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def make_folder(path: str) -> None:
    where, inside = filesystem(path)
    where.create_dir(inside, recursive=True)


class PublishedFile:
    """A binary file that appears under its name only when it is complete.

    Each attempt of a task writes under a name of its own, so a lost or repeated
    task can't damage a file that another attempt has published; readers take
    file names from a manifest, so an orphan is never read.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.path = f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self._fs, self._inside = filesystem(self.path)
        self._out = self._fs.open_output_stream(self._inside + ".part")
        self.position = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which ``data`` starts."""
        at = self.position
        self._out.write(data)
        self.position += len(data)
        return at

    def publish(self) -> str:
        self._out.close()
        self._fs.move(self._inside + ".part", self._inside)
        return self.path

    def discard(self) -> None:
        """Leave nothing behind: the attempt has failed."""
        self._out.close()
        self._fs.delete_file(self._inside + ".part")


class RangeReader:
    """Random reads from one stored file."""

    def __init__(self, path: str):
        where, inside = filesystem(path)
        self._file = where.open_input_file(inside)
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._file.read_at(length, offset)

    def close(self) -> None:
        self._file.close()
