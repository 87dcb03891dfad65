"""Files of the engine through Hadoop's file systems: small metadata, listings, folders for a session."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that its machines share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Creates a file with its whole content, or returns False if it is there already; it is never overwritten.

        Readers never see a part of it: it is written beside its place and gets its name when whole, by a hard link on a local
        disk and elsewhere by a rename, which Hadoop's file system refuses where the name is taken.
        """
        fs, p = self._at(path)
        if fs.getScheme() == "file":
            local = self.jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            own = f"{local}.{uuid.uuid4().hex}.tmp"
            with open(own, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(own, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
        own = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(own, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if not fs.exists(p) and fs.rename(own, p):
                return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
        fs.delete(own, False)
        return False

    def list(self, path: str) -> list[tuple[str, int, bool]]:
        """(path, bytes, is a folder) of what is directly inside; nothing if there is no such folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p)]

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)
