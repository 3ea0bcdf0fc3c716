"""Readers besides Parquet: text CSV with a layout check, declared types, shards, HTML tables."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared column types and what they become.
DECLARED = {"TEXT": T.StringType(), "INTEGER": T.LongType(), "REAL": T.DoubleType(), "DATE": T.DateType(), "DATETIME": T.TimestampNTZType()}


def declared_schema(columns: list[tuple[str, str]]) -> T.StructType:
    """Schema from (name, declared type) pairs; an unknown type is an error."""
    for name, kind in columns:
        if kind.upper() not in DECLARED:
            raise ValueError(f"column {name!r} has the unknown type {kind!r}")
    return T.StructType([T.StructField(n, DECLARED[k.upper()]) for n, k in columns])


def read_csv_text(spark: SparkSession, path: str, layout: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column text. ``layout``: the header wanted, in order."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    if layout is not None and df.columns != layout:
        raise ValueError(f"expected the columns {layout}, found {df.columns}")
    return df


def read_shards(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet shards under a folder, with differing columns merged where no schema is given."""
    if schema is not None:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(folder)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int = 64, **options: str) -> DataFrame:
    """Table of a database in ``parts`` key ranges, so the load is spread over executors."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts), **options).load()


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cell, self.cells = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None
        elif tag == "tr" and len(self.cells) >= 2 and self.cells[0]:
            self.rows.append((self.cells[0], self.cells[1]))

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def html_table_pairs(html: pd.Series) -> pd.Series:
    """Two-column table rows of a page as label -> value (the first of repeated labels)."""

    def pairs(page):
        if page is None:
            return None
        p = _Rows()
        p.feed(page)
        return dict(reversed(p.rows))

    return html.map(pairs)
