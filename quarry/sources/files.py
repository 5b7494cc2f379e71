"""Small files and folders on any file system that Spark's Hadoop client reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by its URI; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.uri(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replaces a file in one step: readers see the old text or the new one."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._path(part), True)
        stream.write(text.encode())
        stream.close()
        # the array of rename options is made by reflection, as the gateway makes arrays of plain types only
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(over.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, over)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf).rename(self._path(part), self._path(name), options)

    def rename(self, name: str, to: str) -> None:
        self.fs.rename(self._path(name), self._path(to))

    def delete(self, name: str) -> None:
        if self.exists(name):
            self.fs.delete(self._path(name), True)

    def room(self) -> int:
        """Bytes that the file system can still take."""
        return self.fs.getStatus().getRemaining()
