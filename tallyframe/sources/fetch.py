"""Paged and keyed web sources: fetch state as a table, bodies through Arrow batches, JSON into rows.

The state is a table (key, url, state, attempts, next_at, body, fetched_at), so a run that was stopped goes
on where it was, and retries wait for their time. Nothing here opens a connection but :func:`fetch`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import sha_hex
from ..operators.frames import catalog_key

STATE = "key string, url string, state string, attempts int, next_at timestamp, body string, fetched_at timestamp"
_RESULT = "key string, url string, status int, body string"


def http_get(url: str, timeout: float = 30.0) -> tuple[int, str | None]:
    """(status, body) of a request; 0 where there was no answer."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return getattr(r, "status", None) or 200, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return 0, None


def due(requests: DataFrame, state: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """key, url of the requests that are to be fetched: never tried, or waiting with their time come and fewer
    than ``most`` attempts. A repeated key counts once, a null key not at all."""
    wanted = requests.filter("key IS NOT NULL").groupBy("key").agg(F.min("url").alias("url"))
    known = state.select("key", F.col("state").alias("__s"), F.col("attempts").alias("__a"), F.col("next_at").alias("__n"))
    j = wanted.join(known, "key", "left")
    return j.filter(F.col("__s").isNull() | ((F.col("__s") == "waiting") & (F.col("__n") <= now) & (F.col("__a") < most))).select("key", "url")


def fetch(todo: DataFrame, get: Callable[[str], tuple[int, str | None]] = http_get, per_second: float = 5.0, tasks: int = 4) -> DataFrame:
    """key, url, status, body. ``tasks`` tasks share the rate ``per_second``; an exception is status 0."""
    gap = tasks / per_second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for pdf in batches:
            rows = []
            for key, url in zip(pdf["key"], pdf["url"]):
                time.sleep(max(0.0, last + gap - time.monotonic()))
                last = time.monotonic()
                try:
                    status, body = get(url)
                except Exception:
                    status, body = 0, None
                rows.append((key, url, status, body))
            yield pd.DataFrame(rows, columns=["key", "url", "status", "body"])

    return todo.select("key", "url").repartition(tasks).mapInPandas(run, _RESULT)


def advance(state: DataFrame, results: DataFrame, now: Column, wait: int = 60, most: int = 5, gone: tuple[int, ...] = (404, 410)) -> DataFrame:
    """The state after ``results``: complete on 200, absent on ``gone``, else waiting for ``wait`` seconds doubled
    by every attempt, or failed after ``most``. Keys without a result keep their row; a body once fetched is
    never lost to a later failure."""
    r = results.select("key", F.col("url").alias("__u"), F.col("status").alias("__st"), F.col("body").alias("__b"))
    j = state.join(r, "key", "full")
    tried = F.col("__u").isNotNull()
    attempts = F.coalesce("attempts", F.lit(0)) + tried.cast("int")
    outcome = F.when(F.col("__st") == 200, "complete").when(F.col("__st").isin(*gone), "absent").when(attempts >= most, "failed").otherwise("waiting")
    new = F.when(~tried, F.col("state")).when(F.col("state") == "complete", "complete").otherwise(outcome)
    later = F.timestamp_seconds(F.unix_timestamp(now) + F.lit(wait) * F.pow(F.lit(2.0), attempts - 1))
    return j.select(
        "key", F.coalesce("__u", "url").alias("url"), new.alias("state"), attempts.alias("attempts"), F.when(new == "waiting", F.when(tried, later).otherwise(F.col("next_at"))).alias("next_at"),
        F.coalesce(F.when(F.col("__st") == 200, F.col("__b")), F.col("body")).alias("body"), F.when(tried & (F.col("__st") == 200), now).otherwise(F.col("fetched_at")).alias("fetched_at"),
    )


def json_rows(state: DataFrame, path: str, fields: dict[str, str]) -> DataFrame:
    """key, place (from 0), ``fields`` (name -> member of the object) as text: one row per object of the array at
    ``path`` of each body. Member names match whatever their case and punctuation; bodies that don't parse or
    have no such array give no rows."""
    array = F.from_json(F.get_json_object("body", path), "array<string>")
    rows = state.select("key", F.posexplode(array).alias("place", "__o"))
    members = F.map_from_entries(F.transform(F.map_entries(F.from_json("__o", "map<string,string>")), lambda e: F.struct(catalog_key(e["key"]).alias("k"), e["value"].alias("v"))))
    rows = rows.withColumn("__m", members)
    plain = lambda n: "".join(c for c in n.lower() if c.isascii() and c.isalnum())
    return rows.select("key", F.col("place").cast("bigint").alias("place"), *[F.try_element_at("__m", F.lit(plain(m))).alias(n) for n, m in fields.items()])


def widen_decodes(state: DataFrame, taken: list[str], prefix: str = "json_") -> DataFrame:
    """key and one text column per member of the bodies (flat JSON objects): the columns are those that occur,
    sorted, and get ``prefix`` where their name is in ``taken`` or already used. The names are collected: they
    are the result's columns."""
    bodies = state.filter("state = 'complete'").select("key", F.from_json("body", "map<string,string>").alias("__m")).filter("__m IS NOT NULL")
    names = sorted(r[0] for r in bodies.select(F.explode(F.map_keys("__m"))).distinct().collect())
    used, cols = {c.lower() for c in [*taken, "key"]}, []
    for n in names:
        out = n
        while out.lower() in used:
            out = prefix + out
        used.add(out.lower())
        cols.append(F.try_element_at("__m", F.lit(n)).alias(out))
    return bodies.select("key", *cols)


def request_key(*parts: Column | str) -> Column:
    """A key of a request from its parts, 24 hex characters."""
    return F.substring(sha_hex(*parts), 1, 24)
