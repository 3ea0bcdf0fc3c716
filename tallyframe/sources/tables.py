"""Parquet sources: named tables of a snapshot directory, with schema checks on open."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import Folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily scan ``{sf_dir}/{name}.parquet`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class SchemaDrift(ValueError):
    """A table no longer has the columns or types its manifest records."""


class Snapshot:
    """A directory of Parquet tables with an optional ``manifest.json`` of schemas.

    With a manifest, column order and types are compared on open and a difference raises
    :class:`SchemaDrift`; ``allowed`` restricts which tables may be scanned.
    """

    def __init__(self, spark: SparkSession, directory: str, allowed: list[str] | None = None):
        self.spark, self.directory = spark, directory
        self.allowed = set(allowed) if allowed is not None else None
        self.folder = Folder(spark, directory)
        self.manifest = json.loads(self.folder.read_text("manifest.json")) if self.folder.exists("manifest.json") else {}
        for name, entry in self.manifest.items():
            want = T.StructType.fromJson(entry["schema"])
            have = read_table(spark, directory, name).schema
            if [(f.name, f.dataType) for f in want] != [(f.name, f.dataType) for f in have]:
                raise SchemaDrift(f"{name}: expected {want.simpleString()}, found {have.simpleString()}")

    def scan(self, name: str) -> DataFrame:
        if self.allowed is not None and name not in self.allowed:
            raise KeyError(f"table {name!r} is not part of this snapshot")
        return read_table(self.spark, self.directory, name)

    def identity(self) -> str:
        """Digest over table names, sizes and modification times."""
        parts = [f"{p.rsplit(self.folder.path, 1)[-1]}|{size}|{changed}" for p, size, changed in self.folder.files(".parquet")]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()
