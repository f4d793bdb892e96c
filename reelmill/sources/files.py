"""Small files on whatever file system a path names, through Hadoop's interface: pointers, manifests, listings."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Reads, lists, replaces and deletes; the executors' shared folder may be local, on HDFS or in an object store."""

    def __init__(self, spark: SparkSession) -> None:
        self._gateway = spark.sparkContext._gateway
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def names(self, path: str) -> list[str]:
        """Names in a folder, in order; none where there is no folder."""
        system, where = self._at(path)
        if not system.exists(where):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(where))

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files below a folder."""
        system, where = self._at(path)
        return system.getContentSummary(where).getLength()

    def is_folder(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where) and system.getFileStatus(where).isDirectory()

    def read(self, path: str) -> str | None:
        """The text of a file; None where there is none."""
        system, where = self._at(path)
        if not system.exists(where):
            return None
        stream = system.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write the file beside its place and move it there, so that readers see the old text or the new one."""
        system, where = self._at(path)
        system.mkdirs(where.getParent())
        beside = self._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.new")
        stream = system.create(beside, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        how = self._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        how[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(system.getUri(), self._conf).rename(system.makeQualified(beside), system.makeQualified(where), how)

    def delete(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)
