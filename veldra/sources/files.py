"""Small files and folders of whatever store a path belongs to, by Hadoop's file systems."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes beside the file and renames without replacing; False if the file is there already."""
        fs, new = self._at(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(new, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        made = fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(path))
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self._conf).rename(fs.makeQualified(new), made, options)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []

    def forget_at_exit(self, path: str) -> None:
        """The path goes when the driver ends."""
        fs, p = self._at(path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def keep(self, path: str) -> None:
        """Takes ``forget_at_exit`` back."""
        fs, p = self._at(path)
        fs.cancelDeleteOnExit(p)

    def fingerprint(self, path: str) -> str:
        """Of the paths, lengths and times of all data files below a path; Spark lists them, and their contents aren't read."""
        files = self._spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("not path rlike '/[_.][^/]*$'")
        each = F.xxhash64("path", "length", "modificationTime")
        return "-".join(map(str, files.agg(F.count("*"), F.bit_xor(each), F.sum(each.cast("decimal(38,0)"))).first()))
