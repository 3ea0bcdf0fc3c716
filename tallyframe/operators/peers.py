"""Peers: blockwise mixed-type distances, adaptive retrieval, diverse top-k, vector neighbours."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import quantile, with_row


def numeric_bounds(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, error: float = 0.0) -> DataFrame:
    """One row of clip bounds per column (see :func:`quantile` for ``error``)."""
    return df.agg(*[quantile(F.col(c), p, error).alias(f"__{s}_{c}") for c in columns for s, p in (("lo", low), ("hi", high))])


def scaled(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Numeric columns clipped to their bounds and divided by their range, once per row; constant ones are 0
    and missing ones stay null."""
    if not numeric:
        return df
    cols = {}
    for c in numeric:
        lo, hi, v = F.col(f"__lo_{c}"), F.col(f"__hi_{c}"), F.col(c).cast("double")
        cols[c] = F.when(v.isNotNull(), F.when(hi > lo, (F.least(F.greatest(v, lo), hi) - lo) / (hi - lo)).otherwise(0.0))
    return with_row(df, numeric_bounds(df, numeric)).withColumns(cols).select(*df.columns)


def block_distance(numeric: list[str], categorical: list[str], least: int = 2) -> Column:
    """Mean of the observed differences of one block between columns a_* and b_* (numeric ones
    :func:`scaled`); null with fewer than half of the fields shared, or fewer than ``least`` where it has
    so many."""
    parts = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in numeric]
    parts += [F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), 0.0).when(F.col(f"a_{c}") != F.col(f"b_{c}"), 1.0) for c in categorical]
    n = len(parts)
    shared = reduce(lambda a, b: a + b, [p.isNotNull().cast("int") for p in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(shared >= max(min(least, n), -(-n // 2)), total / shared)


def candidate_pairs(df: DataFrame, key: str, family: str, equal: list[str], near: str, window: float, columns: list[str]) -> DataFrame:
    """Pairs of different families with equal ``equal`` and |near| difference within ``window``.

    ``near`` is bucketed by the window, and each row meets only its own and the two next buckets, so
    a large ``equal`` group splits by bucket instead of forming all its pairs.
    """
    a = df.select(*equal, F.floor(F.col(near) / window).alias("__b"), *[F.col(c).alias(f"a_{c}") for c in dict.fromkeys([key, family, near, *columns])])
    b = df.select(*equal, F.explode(F.array(*[F.floor(F.col(near) / window) + i for i in (-1, 0, 1)])).alias("__b"), *[F.col(c).alias(f"b_{c}") for c in dict.fromkeys([key, family, near, *columns])])
    return a.join(b, [*equal, "__b"]).filter((F.col(f"a_{family}") != F.col(f"b_{family}")) & (F.abs(F.col(f"a_{near}") - F.col(f"b_{near}")) <= window)).drop("__b")


def nearest_peers(df: DataFrame, key: str, family: str, equal: list[str], near: str, window: float, blocks: list[tuple[list[str], list[str]]], k: int = 5) -> DataFrame:
    """The k nearest rows of other families, one per family: key, peer, distance, peer_rank.

    Distance is the mean of the block distances, rounded to 9 digits; ties go to the smaller key.
    """
    columns = [c for num, cat in blocks for c in (*num, *cat)]
    nums = [c for num, _ in blocks for c in num]
    pairs = candidate_pairs(scaled(df.withColumn("__near", F.col(near)), nums), key, family, equal, "__near", window, columns)
    ds = [block_distance(num, cat) for num, cat in blocks]
    n = reduce(lambda a, b: a + b, [d.isNotNull().cast("int") for d in ds])
    total = reduce(lambda a, b: a + b, [F.coalesce(d, F.lit(0.0)) for d in ds])
    scored = pairs.select(F.col(f"a_{key}").alias(key), F.col(f"b_{key}").alias("peer"), F.col(f"b_{family}").alias("__f"), F.round(F.when(n > 0, total / n), 9).alias("distance")).filter("distance IS NOT NULL")
    best = scored.groupBy(key, "__f").agg(F.min(F.struct("distance", "peer")).alias("__m")).select(key, F.col("__m.distance").alias("distance"), F.col("__m.peer").alias("peer"))
    w = W.partitionBy(key).orderBy("distance", "peer")
    return best.withColumn("peer_rank", F.row_number().over(w).cast("bigint")).filter(F.col("peer_rank") <= k)


@dataclass(frozen=True)
class Approach:
    """A way to rank peers: distance less ``bonus`` times the shared categories plus ``penalty`` times the
    share of differing clusters, and, with ``text``, distance and text mixed by that weight of the text."""

    name: str
    bonus: float = 0.0
    penalty: float = 0.0
    text: float = 0.0


#: Ways to rank as the inventory has them.
APPROACHES = (Approach("direct"), Approach("categories", bonus=0.1), Approach("clusters", penalty=0.1), Approach("categories_clusters", bonus=0.1, penalty=0.1), Approach("with_text", text=0.2))


def _shared_categories(dimensions: list[str]) -> Column:
    """Mean over the dimensions that a has labels in of the best product of both sides' probabilities."""
    def best(a: Column, b: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.map_keys(a), lambda k: a[k] * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))), F.lit(0.0))

    scores, known = [], []
    for c in dimensions:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        scores.append(best(a, b))
        known.append(F.coalesce(F.size(F.map_filter(a, lambda _, v: v > 0)) > 0, F.lit(False)).cast("int"))
    return reduce(lambda x, y: x + y, scores) / F.greatest(F.lit(1), reduce(lambda x, y: x + y, known)) if scores else F.lit(0.0)


def _differing_clusters(clusters: list[str]) -> Column:
    """Share of the clusterings both sides are in that put them apart; 0 where there is none."""
    both = [F.col(f"a_{c}").isNotNull() & F.col(f"b_{c}").isNotNull() for c in clusters]
    apart = [F.when(x & (F.col(f"a_{c}") != F.col(f"b_{c}")), 1.0).otherwise(0.0) for x, c in zip(both, clusters)]
    return F.coalesce(F.try_divide(reduce(lambda x, y: x + y, apart), reduce(lambda x, y: x + y, [x.cast("double") for x in both])), F.lit(0.0)) if clusters else F.lit(0.0)


def ranked_peers(
    df: DataFrame, key: str, family: str, equal: list[str], near: str, windows: tuple[float, ...], blocks: list[tuple], approaches: tuple[Approach, ...] = APPROACHES[:1],
    k: int = 5, categories: list[str] = (), clusters: list[str] = (), vector: str | None = None, eligible: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(peers, statuses) of every row of ``df``.

    peers: key, approach, peer_rank, peer, distance, ranking_distance, window: the k nearest eligible rows of
    other families with equal ``equal``, one per family, ties by key. Every block (numeric fields,
    categorical fields and how many of them at least) must be shared enough (see :func:`block_distance`). The window on ``near`` is the smallest of ``windows`` in
    which k families qualify, else the largest. ``categories`` are map columns label -> probability,
    ``clusters`` columns of cluster ids, ``vector`` an array column for approaches with text, which rank
    only pairs where both have one.

    statuses: key, approach, slate_size, window, status (query_ineligible, no_compatible_family,
    no_shared_evidence, shortfall or complete), one row per row and approach, whatever was found.

    Pairs are formed within the largest window by buckets (see :func:`candidate_pairs`) and reduced to one
    per family before any ranking; each approach is one aggregate of that reduction.
    """
    names = [c for num, cat, *_ in blocks for c in (*num, *cat)]
    extra = [*categories, *clusters, *([vector] if vector else [])]
    fit = df.filter(F.col(eligible)) if eligible else df
    fit = fit.dropna(subset=[*equal, near, family])
    fit = scaled(fit.withColumn("__near", F.col(near)), [c for num, *_ in blocks for c in num])
    pairs = candidate_pairs(fit, key, family, equal, "__near", max(windows), [*names, *extra])
    each = [block_distance(*block) for block in blocks]
    distance = F.round(reduce(lambda a, b: a + b, each) / len(each), 9)  # null where a block has too little
    similar = F.round((cosine(F.col(f"a_{vector}"), F.col(f"b_{vector}")) + 1) / 2, 9) if vector else F.lit(None).cast("double")
    scored = pairs.select(
        F.col(f"a_{key}").alias(key), F.col(f"b_{key}").alias("peer"), F.col(f"b_{family}").alias("__f"), F.abs(F.col("a___near") - F.col("b___near")).alias("__gap"),
        distance.alias("distance"), _shared_categories(list(categories)).alias("__bonus"), _differing_clusters(list(clusters)).alias("__apart"), similar.alias("__text"),
    ).filter("distance IS NOT NULL")

    def best(a: Approach, window: float) -> Column:
        base = (1 - a.text) * F.col("distance") + a.text * (1 - F.col("__text")) if a.text else F.col("distance")
        rank = F.round(base - a.bonus * F.col("__bonus") + a.penalty * F.col("__apart"), 9)
        return F.min(F.when((F.col("__gap") <= window) & rank.isNotNull(), F.struct(rank.alias("r"), F.col("peer").alias("p"), F.col("distance").alias("d"))))

    per_family = scored.groupBy(key, "__f").agg(F.min("__gap").alias("__gap"), *[best(a, w).alias(f"__{i}_{j}") for i, a in enumerate(approaches) for j, w in enumerate(windows)])
    counts = per_family.groupBy(key).agg(*[F.count_if(F.col("__gap") <= w).alias(f"__n{j}") for j, w in enumerate(windows)])
    chosen, found = F.lit(float(windows[-1])), F.col(f"__n{len(windows) - 1}")
    for j in reversed(range(len(windows) - 1)):
        chosen, found = F.when(F.col(f"__n{j}") >= k, float(windows[j])).otherwise(chosen), F.when(F.col(f"__n{j}") >= k, F.col(f"__n{j}")).otherwise(found)
    counts = counts.select(key, chosen.alias("window"), found.alias("__families"))

    def at_window(i: int) -> Column:
        pick = None
        for j, w in enumerate(windows):
            pick = F.when(F.col("window") == float(w), F.col(f"__{i}_{j}")) if pick is None else pick.when(F.col("window") == float(w), F.col(f"__{i}_{j}"))
        return pick

    long = per_family.join(counts, key).select(key, "window", F.explode(F.array(*[F.struct(F.lit(a.name).alias("approach"), at_window(i).alias("m")) for i, a in enumerate(approaches)])).alias("x")).filter("x.m IS NOT NULL")
    w = W.partitionBy(key, "approach").orderBy("ranking_distance", "peer")
    peers = long.select(key, F.col("x.approach").alias("approach"), F.col("x.m.p").alias("peer"), F.col("x.m.d").alias("distance"), F.col("x.m.r").alias("ranking_distance"), "window")
    peers = peers.withColumn("peer_rank", F.row_number().over(w).cast("bigint")).filter(F.col("peer_rank") <= k).select(key, "approach", "peer_rank", "peer", "distance", "ranking_distance", "window")

    others = fit.groupBy(*equal).agg(F.min(family).alias("__lo"), F.max(family).alias("__hi"))
    base = df.select(key, *equal, family, (F.coalesce(F.col(eligible), F.lit(False)) if eligible else F.lit(True)).alias("__ok"), near)
    base = base.withColumn("__ok", F.col("__ok") & F.col(near).isNotNull() & F.col(family).isNotNull()).join(others, equal, "left").join(counts, key, "left")
    sizes = peers.groupBy(key, "approach").agg(F.count("*").alias("slate_size"))
    rows = base.withColumn("approach", F.explode(F.array(*[F.lit(a.name) for a in approaches]))).join(sizes, [key, "approach"], "left")
    size = F.coalesce("slate_size", F.lit(0)).cast("bigint")
    compatible = (F.col("__lo") != F.col(family)) | (F.col("__hi") != F.col(family))
    status = F.when(~F.col("__ok"), "query_ineligible").when(~F.coalesce(compatible, F.lit(False)), "no_compatible_family").when(size == 0, "no_shared_evidence").when(size < k, "shortfall").otherwise("complete")
    statuses = rows.select(key, "approach", size.alias("slate_size"), F.coalesce("window", F.lit(float(windows[-1]))).alias("window"), status.alias("status"))
    return peers, statuses


def compare_approaches(peers: DataFrame, key: str, base: str) -> DataFrame:
    """approach, queries, mean_distance, mean_overlap: each approach against ``base`` over the rows for which
    both have peers (matched populations); overlap is the share of the base's peers it keeps."""
    lists = peers.groupBy(key, "approach").agg(F.collect_set("peer").alias("p"), F.avg("distance").alias("d"))  # at most k peers
    ref = lists.filter(F.col("approach") == base).select(key, F.col("p").alias("bp"))
    both = lists.join(ref, key)
    overlap = F.size(F.array_intersect("p", "bp")) / F.size("bp")
    return both.groupBy("approach").agg(F.count("*").alias("queries"), F.round(F.avg("d"), 6).alias("mean_distance"), F.round(F.avg(overlap), 6).alias("mean_overlap"))


def diverse_top(df: DataFrame, family: str, order: list[Column], k: int) -> DataFrame:
    """Best row of each family first, then the rest, k in all.

    The first 2k rows overall hold every row that can fill up, and tell their families' leaders; the
    leaders of other families come from a rank-one cut that is applied before the shuffle.
    """
    w = W.partitionBy(family).orderBy(*order)
    first = df.orderBy(*order).limit(2 * k).withColumn("__leader", (F.row_number().over(w) == 1).cast("int"))
    others = df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r").withColumn("__leader", F.lit(1))
    seen = first.select(F.col(family).alias("__f")).distinct()
    others = others.join(F.broadcast(seen), F.col(family).eqNullSafe(F.col("__f")), "left_anti")  # at most 2k families
    return first.unionByName(others).orderBy(F.col("__leader").desc(), *order).limit(k).drop("__leader")


def round_robin(lists: list[DataFrame], key: str, rank: str, k: int) -> DataFrame:
    """Ranked lists merged turn by turn, each key once, the first k."""
    tagged = [x.select(key, F.col(rank).alias("__r"), F.lit(i).alias("__l")) for i, x in enumerate(lists)]
    first = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min(F.struct("__r", "__l")).alias("__m"))
    return first.select(key, F.col("__m.__r").cast("bigint").alias("list_rank"), F.col("__m.__l").cast("bigint").alias("list_no")).orderBy("list_rank", "list_no", key).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "neighbour")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def _unit(rows) -> np.ndarray:
    m = np.asarray([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def _top(ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one batch for each query, by (rounded cosine, id)."""
    c = np.round(queries @ vectors.T, 9)
    c[query_ids[:, None] == ids[None, :]] = -2.0
    n = min(k, c.shape[1])
    order = np.lexsort((np.broadcast_to(ids, c.shape), -c), axis=1)[:, :n]
    flat = pd.DataFrame({"query_id": np.repeat(query_ids, n), "neighbour": ids[order].ravel(), "cosine": np.take_along_axis(c, order, 1).ravel()})
    return flat[flat["cosine"] > -2.0]


_SCORED = "query_id bigint, neighbour bigint, cosine double"


def neighbours_of(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """query_id, neighbour, cosine, rank: the exact k nearest rows of every query, itself left out.

    Queries are held in blocks of ``block`` vectors (the bound of what is broadcast), one pass over the
    rows each; a batch is scored by one matrix product and only its k best go on. Null vectors are left
    out, zero vectors have cosine 0, ties go to the smaller id.
    """
    rows = df.select(F.col(key).cast("bigint").alias("i"), F.col(vector).alias("v")).filter("i IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(key).cast("bigint").alias("i"), F.col(vector).alias("v")).filter("i IS NOT NULL AND v IS NOT NULL")
    context, held, part = df.sparkSession.sparkContext, [], []

    def hand_over() -> None:
        if part:
            held.append(context.broadcast((np.array([i for i, _ in part]), _unit([v for _, v in part]))))
            part.clear()

    for r in asked.toLocalIterator():  # the stated query set: the driver has one block of it at a time
        part.append((r.i, r.v))
        if len(part) == block:
            hand_over()
    hand_over()
    out = None
    for shared in held:

        def run(batches, shared=shared):
            ids, q = shared.value
            for pdf in batches:
                if len(pdf):
                    yield _top(pdf["i"].to_numpy(), q, ids, _unit(pdf["v"]), k)

        got = rows.mapInPandas(run, _SCORED)
        out = got if out is None else out.unionByName(got)
    return _best(out if out is not None else df.sparkSession.createDataFrame([], _SCORED), k)


def _sample(df: DataFrame, key: str, vector: str, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of about ``rows`` rows with both."""
    some = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), vector)
    n = some.count()
    got = some.sample(min(1.0, 1.2 * rows / n), seed).limit(rows).collect() if n else []
    return (np.array([r[0] for r in got]), _unit([r[1] for r in got])) if got else (np.zeros(0, np.int64), np.zeros((0, 0)))


def fit_cells(x: np.ndarray, cells: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Centres of ``cells`` cells of unit vectors."""
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        some = np.linalg.norm(sums, axis=1) > 0
        centres[some] = _unit(sums[some])
    return centres


def probes_for(centres: np.ndarray, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """Nearest cells a query must look into so that the queries ``q`` find the share ``recall`` of their
    k nearest rows of ``x``."""
    own = (x @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell for each query
    best = _top(ids, q, query_ids, x, k)
    at = {int(i): n for n, i in enumerate(query_ids)}
    cell = {int(i): int(c) for i, c in zip(ids, own)}
    needed = np.sort([place[at[int(a)], cell[int(b)]] + 1 for a, b in zip(best["query_id"], best["neighbour"])])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def indexed_neighbours(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, cells: int = 64, probes: int = 16, salts: int = 8, recall: float = 0.95, sample: int = 20_000, seed: int = 7) -> DataFrame:
    """As :func:`neighbours_of`, by an inverted index: every row is in the cell of its nearest centre, a
    query looks into its nearest cells. Rows meet queries by a join on (cell, salt), the salt spreading a
    crowded cell over tasks.

    Centres are fitted on about ``sample`` rows. A query looks into ``probes`` cells, or into as many more
    as up to 500 of the queries need to find the share ``recall`` of their k nearest rows of the sample,
    so vectors without clusters cost more cells rather than neighbours.
    """
    ids, x = _sample(df, key, vector, sample, seed)
    centres = fit_cells(x, cells, seed)
    if not len(centres):
        return _best(df.sparkSession.createDataFrame([], _SCORED), k)
    query_ids, q = _sample(queries, key, vector, 500, seed)
    if len(q):
        probes = max(probes, probes_for(centres, ids, x, query_ids, q, k, recall))
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def cell_udf(n: int):
        @F.pandas_udf("array<int>")
        def run(v: pd.Series) -> pd.Series:
            near = _unit(v) @ shared.value.T
            return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)))

        return run

    base = df.select(F.col(key).cast("bigint").alias("i"), F.col(vector).alias("v")).filter("i IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(key).cast("bigint").alias("query_id"), F.col(vector).alias("q")).filter("query_id IS NOT NULL AND q IS NOT NULL")
    rows = base.withColumn("cell", F.get(cell_udf(1)(F.col("v")), 0)).withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(salts).cast("bigint")))
    looks = asked.withColumn("cell", F.explode(cell_udf(min(probes, len(centres)))(F.col("q")))).withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    scored = rows.join(looks, ["cell", "salt"]).filter("i <> query_id").select("query_id", F.col("i").alias("neighbour"), F.round(F.coalesce(cosine(F.col("v"), F.col("q")), F.lit(0.0)), 9).alias("cosine"))
    return _best(scored, k)
