"""Hand-over tables, input spreading, and folders of any file system."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither recompute the rows nor depend on
    the executors that made them. The folder is the session's ``spark.checkpoint.dir``; a session on one
    machine (local master) without that setting gets a folder of its own, a cluster without it is an
    error. The table is removed when the application ends."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition only where the input has fewer splits than the cluster has cores (small files
    before a CPU-bound step). Large inputs keep their splits and aren't shuffled."""
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


class Folder:
    """A path and its file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def rename(self, target: Folder) -> None:
        if not self.fs.rename(self.at(), target.at()):
            raise OSError(f"cannot rename {self.path} to {target.path}")

    def size(self) -> int:
        return self.fs.getContentSummary(self.at()).getLength()

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Through a file beside it, so that a reader sees the whole text or none."""
        out = self.fs.create(self.at(f".{name}.tmp"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(self.at(f".{name}.tmp"), self.at(name)):
            raise OSError(f"cannot write {self.path}/{name}")

    def files(self, ending: str = "") -> list[tuple[str, int, int]]:
        """(path, bytes, time of change) of every file below, in order."""
        out, it = [], self.fs.listFiles(self.at(), True)
        while it.hasNext():
            f = it.next()
            if f.getPath().getName().endswith(ending):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def digests(self, without: tuple[str, ...]) -> dict[str, str]:
        """Name -> SHA-256 of every file below; files are read by tasks. One row per file comes back."""
        root = self.fs.resolvePath(self.at()).toString()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.path).select("path", F.sha2("content", 256).alias("h"))
        names = {r.path.split(root.split(":", 1)[-1].lstrip("/"), 1)[-1].lstrip("/"): r.h for r in files.collect()}
        return {n: h for n, h in sorted(names.items()) if n not in without}
