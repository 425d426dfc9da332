"""Files of a table folder, in whatever store the session reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


class Store:
    """Moves and removes whole files; their contents stay with Spark's readers and writers."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(self._path(folder)).toString()

    def data_files(self, folder: str) -> Iterator[str]:
        """Paths of the data files below a folder, relative to it."""
        top = self._fs.makeQualified(self._path(folder)).toUri().getPath()
        found = self._fs.listFiles(self._path(folder), True)
        while found.hasNext():
            path = found.next().getPath()
            if not path.getName().startswith(("_", ".")):
                yield path.toUri().getPath()[len(top) :].lstrip("/")

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))
