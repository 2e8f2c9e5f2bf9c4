"""Small files beside the tables, through the file system that Spark itself uses for a path."""

from __future__ import annotations

import time

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; false if there is one already."""
        fs, p = self._at(path)
        if not fs.createNewFile(p):
            return False
        self._write(fs, p, text)
        return True

    def _write(self, fs, p, text: str) -> None:
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def replace(self, path: str, text: str) -> None:
        """Readers see the old text or the new one."""
        fs, p = self._at(path)
        new = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        self._write(fs, new, text)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        many = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        array = SparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        many.rename(fs.makeQualified(new), fs.makeQualified(p), array)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def age_seconds(self, path: str) -> float:
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
