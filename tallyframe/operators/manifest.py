"""Sinks with receipts: staged writes, schema manifests, verified stages.

Files are reached through Hadoop's file system interface, so a folder may lie on any file system that
the session knows; contents are hashed by tasks, not on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import Folder


def recover(spark: SparkSession, path: str) -> None:
    """Put back what a :func:`publish` that was killed between its two renames has moved aside."""
    target, old = Folder(spark, path), Folder(spark, path + ".old")
    if old.exists() and not target.exists():
        old.rename(target)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write zstd Parquet to a staging folder beside the target and rename it into place; a failure
    leaves what was there. A writer that is killed between the two renames leaves the former table in
    ``path``.old, and :func:`recover`, which every publish begins with, puts it back. Object stores without
    renames need a committer."""
    spark = df.sparkSession
    recover(spark, path)
    target, staging, old = (Folder(spark, path + end) for end in ("", ".staging", ".old"))
    staging.delete()
    old.delete()
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(staging.path)
    if target.exists():
        target.rename(old)
    try:
        staging.rename(target)
    except Exception:
        recover(spark, path)
        raise
    old.delete()


def write_manifest(spark: SparkSession, directory: str, tables: list[str]) -> dict:
    """Rows, bytes and schema of each table, in ``manifest.json``."""
    out = {}
    for t in tables:
        df = spark.read.parquet(f"{directory}/{t}.parquet")
        out[t] = {"rows": df.count(), "bytes": Folder(spark, f"{directory}/{t}.parquet").size(), "schema": df.schema.jsonValue()}
    Folder(spark, directory).write_text("manifest.json", json.dumps(out, indent=1))
    return out


class Stage:
    """An output folder that is written once: inputs and outputs are hashed into ``receipt.json``."""

    def __init__(self, directory: str, inputs: dict[str, str], spark: SparkSession | None = None):
        self.folder, self.inputs = Folder(spark or SparkSession.active(), str(directory)), inputs

    def _receipt(self) -> dict:
        return json.loads(self.folder.read_text("receipt.json"))

    def begin(self) -> bool:
        """True if there is work: no finished receipt for the same inputs. Other inputs are an error."""
        if self.folder.exists("receipt.json"):
            if self._receipt()["inputs"] != self.inputs:
                raise ValueError("stage was finished for other inputs")
            return False
        self.folder.fs.mkdirs(self.folder.at())
        return True

    def finish(self) -> None:
        self.folder.write_text("receipt.json", json.dumps({"inputs": self.inputs, "outputs": self.folder.digests(("receipt.json",))}, indent=1))

    def verify(self) -> None:
        if self._receipt()["outputs"] != self.folder.digests(("receipt.json",)):
            raise ValueError("stage outputs differ from their receipt")


def write_shards(parts: dict[str, DataFrame], path: str) -> list[str]:
    """Each part once as a shard with a receipt of its own; shards that are finished are verified and kept, so
    a run that was stopped goes on where it was. Returns the shards written now."""
    written = []
    for name, df in parts.items():
        spark = df.sparkSession
        shard = Stage(f"{path}/{name}", {"shard": name, "schema": df.schema.json()}, spark)
        if not shard.begin():
            shard.verify()
            continue
        publish(df, f"{path}/{name}/rows")
        shard.finish()
        written.append(name)
    return written


def upsert_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``df`` holds, keep the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one CSV (with header) or JSON file folder."""
    one = df.coalesce(1).write.mode("overwrite")
    one.option("header", True).csv(path) if kind == "csv" else one.json(path)


def publish_checked(df: DataFrame, path: str, keys: list[str], ranges: dict[str, tuple[float, float]] | None = None) -> None:
    """Publish after the keys proved unique and the ranges hold."""
    from . import checks

    bad = [n for n, v in {"keys": checks.repeated(df, keys), **{c: checks.outside(df, c, *r) for c, r in (ranges or {}).items()}}.items() if v.limit(1).count()]
    if bad:
        raise ValueError(f"not published, checks failed: {bad}")
    publish(df, path)
