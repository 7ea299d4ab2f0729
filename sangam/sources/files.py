"""Small files and folders on any file system that Spark can reach."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs(path).listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whole and only if there is no such file yet, in one step; False if there is."""
        target, new = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}.new")
        fs = self._fs(path)
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._rename(fs, new, target, "NONE")
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception) or fs.exists(target):
                return False
            raise
        return True

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: the new file takes the old one's place in one step."""
        target, new = self._path(path), self._path(path + ".new")
        fs = self._fs(path)
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._rename(fs, new, target, "OVERWRITE")

    def _rename(self, fs, old, new, option: str) -> None:
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = getattr(kind, option)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        context.rename(fs.makeQualified(old), fs.makeQualified(new), how)
