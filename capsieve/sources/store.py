"""Folders of any file system that Spark reaches: listing, removal, and putting a name in place just once."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder by its path; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def entries(self, name: str = "") -> list[tuple[str, int]]:
        """Names below ``name`` with the time of their last change in ms; none if there is no such folder."""
        try:
            found = self._fs.listStatus(self._at(name))
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception):
                return []
            raise
        return sorted((f.getPath().getName(), f.getModificationTime()) for f in found)

    def names(self, name: str = "") -> Iterator[str]:
        return (n for n, _ in self.entries(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def place(self, name: str, final: str) -> bool:
        """Give ``name`` its final name unless that is taken; whether it got it.

        One step on file systems whose rename is, such as HDFS and local ones.
        """
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kind, 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, kind.getEnumConstants()[0])  # NONE: never over another
        try:
            files.rename(self._at(name), self._at(final), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        return True
