"""Small files through Hadoop's file systems, so that a root may be a local folder or any URI that Spark can write."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: object):
        self.spark, self.root = spark, str(root).rstrip("/")

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _hadoop(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        p, fs = self._hadoop(name)
        return fs.exists(p)

    def make(self, name: str) -> None:
        p, fs = self._hadoop(name)
        fs.mkdirs(p)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        p, fs = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> str:
        p, fs = self._hadoop(name)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _aside(self, name: str, pieces: Iterable[str]):
        """(temporary file beside a name that holds the pieces, its path, file system)."""
        p, fs = self._hadoop(name)
        temp = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temp, True)
        try:
            for piece in pieces:
                stream.write(bytearray(piece.encode("utf-8")))
        finally:
            stream.close()
        return temp, p, fs

    def _move(self, temp, p, fs, mode: str) -> None:
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        modes = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = getattr(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), mode)
        context.rename(fs.makeQualified(temp), fs.makeQualified(p), modes)

    def write(self, name: str, text: str) -> None:
        """Written beside its place and moved there whole: readers see the old file or the new one."""
        self.write_all(name, [text])

    def write_all(self, name: str, pieces: Iterable[str]) -> None:
        """write() of a text that comes in pieces."""
        self._move(*self._aside(name, pieces), "OVERWRITE")

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is. Of several writers one succeeds, and readers see it whole.

        A rename that does not overwrite is atomic on HDFS; on local disks, where it is not, a hard link is.
        """
        temp, p, fs = self._aside(name, [text])
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":
                at = lambda x: jvm.java.io.File(fs.makeQualified(x).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(at(p), at(temp))
            else:
                self._move(temp, p, fs, "NONE")
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(temp, False)
        return True

    def delete(self, name: str) -> None:
        p, fs = self._hadoop(name)
        fs.delete(p, True)
