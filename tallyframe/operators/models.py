"""Model selection around MLlib: regressors with a baseline, nested out-of-fold training, growth until a
plateau, contributions that reconcile, calibrated labels behind gates, stability of partitions.

Loops run over folds, kinds, labels or refits, never over rows; what reaches the driver is one row of
counts or errors for each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_mod
from ..sources.shared import materialise
from . import ml
from .metrics import adjusted_rand, poisson_count, wilson, wilson_gate

#: Kinds of regressors, by what they are called with the column names of label and features.
REGRESSORS = {
    "linear": lambda **c: LinearRegression(**c),
    "ridge": lambda **c: LinearRegression(regParam=0.1, elasticNetParam=0.0, **c),
    "lasso": lambda **c: LinearRegression(regParam=0.01, elasticNetParam=1.0, **c),
    "elastic": lambda **c: LinearRegression(regParam=0.01, elasticNetParam=0.5, **c),
    "huber": lambda **c: LinearRegression(loss="huber", regParam=0.01, **c),
    "tree": lambda **c: DecisionTreeRegressor(maxDepth=8, maxBins=256, seed=42, **c),
    "forest": lambda **c: RandomForestRegressor(numTrees=40, maxDepth=8, maxBins=256, seed=42, **c),
    "boosted": lambda **c: GBTRegressor(maxIter=20, maxBins=256, seed=42, **c),
}
BASELINE = "median"


@dataclass
class LogModel:
    """A model of log(1 + target), or the median of the target where ``model`` is None."""

    kind: str
    numeric: list[str]
    pipe: PipelineModel | None
    model: object | None
    median: float | None

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction in the target's own scale; missing features are imputed."""
        if self.model is None:
            return df.withColumn(out, F.lit(self.median).cast("double"))
        scored = self.model.transform(self.pipe.transform(ml.with_flags(df, self.numeric)))
        return scored.withColumn("__out", F.expm1("prediction")).select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__out").alias(out))


def fit_log_model(train: DataFrame, target: str, numeric: list[str], categorical: list[str], kind: str) -> LogModel:
    """Rows with a positive target count. ``median``: nearest-rank sketch, off by 1/10000 of the ranks."""
    rows = train.filter(F.col(target) > 0)
    median = rows.agg(F.percentile_approx(F.col(target).cast("double"), 0.5, 10000)).first()[0]
    if kind == BASELINE or median is None:
        return LogModel(BASELINE, numeric, None, None, median)
    base = ml.with_flags(rows, numeric).withColumn("__y", F.log1p(target))
    pipe = ml.features(numeric, categorical).fit(base)
    return LogModel(kind, numeric, pipe, REGRESSORS[kind](labelCol="__y", featuresCol="features").fit(pipe.transform(base)), median)


def _mae(scored: DataFrame, target: str) -> tuple[int, float | None]:
    r = scored.filter(F.col(target).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col(target))).alias("mae")).first()
    return r.n, r.mae


def compare_regressors(train: DataFrame, valid: DataFrame, target: str, numeric: list[str], categorical: list[str], kinds: tuple[str, ...] = (BASELINE, *REGRESSORS)) -> DataFrame:
    """kind, n, mae, place, beats_median on ``valid`` for each kind fitted on ``train``; ties go to the
    earlier kind. An empty table gives null errors."""
    scores = [(k, *_mae(fit_log_model(train, target, numeric, categorical, k).predict(valid), target)) for k in kinds]
    order = sorted(range(len(scores)), key=lambda i: (scores[i][2] is None, scores[i][2] or 0.0, i))
    base = next((s[2] for s in scores if s[0] == BASELINE), None)
    rows = [(k, n, mae, order.index(i) + 1, None if mae is None or base is None else mae < base) for i, (k, n, mae) in enumerate(scores)]
    return train.sparkSession.createDataFrame(rows, "kind string, n bigint, mae double, place int, beats_median boolean")


def nested_out_of_fold(df: DataFrame, key: str, group: str, target: str, numeric: list[str], categorical: list[str], fold: str, folds: int, kinds: tuple[str, ...] = (BASELINE, "elastic", "boosted"), inner: int = 5) -> tuple[DataFrame, DataFrame]:
    """(predictions, receipts): every row predicted by a model that never saw its fold.

    Within the other folds, the groups with hash 0 of ``inner`` choose the kind by their error; the choice is
    fitted again on all rows of the other folds. ``fold`` must be the same for all rows of a ``group``,
    which is checked. receipts: fold, chosen, n_fit, n_valid, n_held, valid_mae, held_mae.
    """
    torn = df.groupBy(group).agg(F.count_distinct(fold).alias("n")).filter("n > 1").limit(1).count()
    if torn:
        raise ValueError(f"a {group!r} lies in several folds")
    rows = materialise(df.withColumn("__inner", hash_mod(group, inner, salt="inner")), "nested")
    parts, receipts = [], []
    for k in range(folds):
        seen, held = rows.filter(F.col(fold) != k), rows.filter(F.col(fold) == k)
        fit, valid = seen.filter("__inner <> 0"), seen.filter("__inner = 0")
        scores = [(_mae(fit_log_model(fit, target, numeric, categorical, kind).predict(valid), target), kind) for kind in kinds]
        (n_valid, error), chosen = min(scores, key=lambda s: (s[0][1] is None, s[0][1] or 0.0, kinds.index(s[1])))
        model = fit_log_model(seen, target, numeric, categorical, chosen)
        scored = model.predict(held).drop("__inner")
        n_held, held_error = _mae(scored, target)
        receipts.append((k, chosen, seen.count() - n_valid, n_valid, n_held, error, held_error))
        parts.append(scored)
    out = reduce(DataFrame.unionByName, parts)
    return out, df.sparkSession.createDataFrame(receipts, "fold int, chosen string, n_fit bigint, n_valid bigint, n_held bigint, valid_mae double, held_mae double")


def grow_until_plateau(train: DataFrame, valid: DataFrame, key: str, label: str, batch: int = 100, gain: float = 0.001, stale: int = 3, depth: int = 8, most: int = 50) -> tuple[list, DataFrame]:
    """(forests, history): a forest grown by ``batch`` trees at a time until ``stale`` batches in a row
    lower the error on ``valid`` by less than ``gain`` of the best so far; the batches after the best are
    dropped. ``train`` and ``valid`` have ``features`` and ``label``, ``key`` is unique in ``valid``.

    Trees are independent, so a batch is a forest of its own and the prediction is the mean over batches;
    nothing is fitted twice. history: trees, mae, improved. ``most`` batches are an error, not an end.
    """
    forests, history, best, since, at = [], [], None, 0, 0
    sums = None
    while since < stale:
        if len(forests) == most:
            raise ValueError(f"no plateau within {most} batches")
        model = RandomForestRegressor(numTrees=batch, maxDepth=depth, maxBins=256, seed=1000 + len(forests), labelCol=label, featuresCol="features").fit(train)
        forests.append(model)
        one = model.transform(valid).select(F.col(key).alias("__k"), F.col(label).alias("__y"), F.col("prediction").alias("__s"))
        sums = materialise(one if sums is None else sums.join(one.select("__k", F.col("__s").alias("__add")), "__k").select("__k", "__y", (F.col("__s") + F.col("__add")).alias("__s")), "forest")
        mae = sums.agg(F.avg(F.abs(F.col("__s") / len(forests) - F.col("__y")))).first()[0]
        improved = best is None or mae is not None and mae < best * (1 - gain)
        history.append((batch * len(forests), mae, improved))
        if improved:
            best, since, at = mae, 0, len(forests)
        else:
            since += 1
    return forests[:at], train.sparkSession.createDataFrame(history, "trees int, mae double, improved boolean")


def forest_prediction(forests: list, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Mean of the batches' predictions."""
    scored = df
    for i, model in enumerate(forests):
        scored = model.transform(scored).withColumnRenamed(model.getPredictionCol(), f"__p{i}")
    total = reduce(lambda a, b: a + b, [F.col(f"__p{i}") for i in range(len(forests))])
    return scored.withColumn("__out", total / len(forests)).select(*df.columns, F.col("__out").alias(out))


def linear_parts(scored: DataFrame, coefficients: list[float], intercept: float, names: list[str], means: list[float] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """``parts`` (map name -> signed contribution against the mean), ``base``, and ``reconciles``: base and
    parts add up to the model's ``prediction``. ``scored`` has ``features``."""
    centre = means or [0.0] * len(names)
    base = intercept + sum(c * m for c, m in zip(coefficients, centre))
    x = vector_to_array("features")
    values = F.zip_with(F.zip_with(x, F.array(*[F.lit(float(m)) for m in centre]), lambda a, m: a - m), F.array(*[F.lit(float(c)) for c in coefficients]), lambda d, c: d * c)
    total = F.lit(base) + F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    near = F.abs(total - F.col("prediction")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col("prediction")))
    return scored.withColumn("parts", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), values)).withColumn("base", F.lit(base)).withColumn("reconciles", near)


def explain_log_model(model: LogModel, df: DataFrame, categorical: list[str]) -> DataFrame:
    """``df`` with prediction (of log(1 + target)), base, parts and reconciles of a linear model; an error for
    another kind or if a row doesn't reconcile."""
    if model.model is None or not hasattr(model.model, "coefficients"):
        raise ValueError("only linear models are sums of parts")
    names = [*model.numeric, *[f"{c} missing" for c in model.numeric], *categorical]
    scored = model.model.transform(model.pipe.transform(ml.with_flags(df, model.numeric)))
    out = linear_parts(scored, list(model.model.coefficients), float(model.model.intercept), names)
    wrong = out.filter(~F.col("reconciles")).limit(1).count()
    if wrong:
        raise ValueError("contributions don't add up to the prediction")
    return out.select(*df.columns, "prediction", "base", "parts", "reconciles")


def family_split(family: str) -> Column:
    """train, calibration or test (6, 2 and 2 of 10) by the family's hash."""
    h = hash_mod(family, 10, salt="labels")
    return F.when(h < 6, "train").when(h < 8, "calibration").otherwise("test")


def gated_labels(df: DataFrame, key: str, family: str, labels: str, vocabulary: list[str], least_families: int = 3, point: float = 0.8, lower: float = 0.6, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(decisions, report): labels that calibrated classifiers emit, one classifier per label, gated.

    Families are split into train, calibration and test. A label needs ``least_families`` train families
    with and without it. Scores are calibrated by a logistic curve on the calibration part; the threshold
    is the lowest of 0.50, 0.55 ... 0.95 at which what would be emitted there is right in ``point`` of the
    cases with a Wilson lower end of ``lower``; the same gate then holds on the test part. Rows with a
    null ``labels`` are never used to fit and get decisions like the others.

    report: label, status (insufficient_support, no_threshold, failed_gate, accepted), families, threshold,
    emitted, correct and lower end on the test part. decisions: key, label, probability of accepted labels.
    ``df`` has ``features``.
    """
    spark = df.sparkSession
    rows = materialise(df.select(F.col(key).alias("__k"), F.col(family).alias("__f"), F.col(labels).alias("__l"), "features", family_split(family).alias("__split")), "labels")
    decisions, report = [], []
    for name in vocabulary:
        one = rows.withColumn("__y", F.array_contains("__l", name).cast("double"))
        known = one.filter("__y IS NOT NULL")
        support = known.filter("__split = 'train'").agg(F.count_distinct(F.when(F.col("__y") == 1, F.col("__f"))).alias("with"), F.count_distinct(F.when(F.col("__y") == 0, F.col("__f"))).alias("without")).first()
        if min(support) < least_families:
            report.append((name, "insufficient_support", support[0], None, None, None, None))
            continue
        model = LogisticRegression(labelCol="__y", featuresCol="features", regParam=0.01, maxIter=50, rawPredictionCol="__raw", probabilityCol="__prob", predictionCol="__pred").fit(known.filter("__split = 'train'"))
        scored = materialise(model.transform(one).select("__k", "__y", "__split", vector_to_array("__raw")[1].alias("__s")), "scores")
        ml_scores = lambda d: ml.VectorAssembler(inputCols=["__s"], outputCol="__v").transform(d)
        cal = ml_scores(scored.filter("__split = 'calibration' AND __y IS NOT NULL"))
        if cal.agg(F.count_distinct("__y")).first()[0] < 2:
            report.append((name, "no_threshold", support[0], None, None, None, None))
            continue
        curve = LogisticRegression(labelCol="__y", featuresCol="__v", maxIter=50).fit(cal)
        a, b = float(curve.coefficients[0]), float(curve.intercept)
        final = scored.select("__k", "__y", "__split", (1 / (1 + F.exp(-(F.col("__s") * a + b)))).alias("__p"))
        grid = final.filter("__split <> 'train' AND __y IS NOT NULL").withColumn("t", F.explode(F.array(*[F.lit(i / 100) for i in range(50, 100, 5)]))).filter("__p >= t")
        counts = grid.groupBy("__split", "t").agg(F.count("*").alias("n"), F.sum("__y").alias("hits"))
        counts = {(r["__split"], r.t): r for r in counts.withColumn("ok", wilson_gate(F.col("hits"), F.col("n"), point, lower, least)).withColumn("low", wilson(F.col("hits"), F.col("n"))[0]).collect()}
        threshold = min((t for (part, t), r in counts.items() if part == "calibration" and r.ok), default=None)
        if threshold is None:
            report.append((name, "no_threshold", support[0], None, None, None, None))
            continue
        test = counts.get(("test", threshold))
        accepted = bool(test and test.ok)
        report.append((name, "accepted" if accepted else "failed_gate", support[0], threshold, test.n if test else 0, int(test.hits) if test else 0, test.low if test else 0.0))
        if accepted:
            decisions.append(final.filter(F.col("__p") >= threshold).select(F.col("__k").alias(key), F.lit(name).alias("label"), F.col("__p").alias("probability")))
    empty = rows.limit(0).select(F.col("__k").alias(key), F.lit("").alias("label"), F.lit(0.0).alias("probability"))
    schema = "label string, status string, families bigint, threshold double, emitted bigint, correct bigint, lower_end double"
    return reduce(DataFrame.unionByName, decisions, empty), spark.createDataFrame(report, schema)


def bootstrap_weight(family: str, draw: int) -> Column:
    """How often a family is drawn in a bootstrap: a Poisson number of mean 1 from its hash."""
    u = F.pmod(F.xxhash64(F.lit(f"refit{draw}"), family), F.lit(1 << 30).cast("bigint")) / float(1 << 30)
    return poisson_count(u)


def stability_screen(df: DataFrame, key: str, family: str, numeric: list[str], categorical: list[str], ks: tuple[int, ...], refits: int = 30, median: float = 0.7, tenth: float = 0.6, cohesion: float = 0.1, share: float = 0.05) -> DataFrame:
    """k, silhouette, smallest_share, median_ari, ari_q10, status of partitions into k clusters.

    A fifth of the families (by hash) is the anchor. Each k is fitted on the others and again on
    ``refits`` bootstraps of their families; agreement is the adjusted Rand index of both assignments of
    the anchor. accepted: the median is at least ``median``, the tenth percentile at least ``tenth``, the
    silhouette at least ``cohesion`` and the smallest cluster holds ``share`` of the anchor.
    """
    base = ml.with_flags(df, numeric).withColumn("__anchor", hash_mod(family, 5, salt="anchor") == 0)
    if not base.limit(1).count():
        return df.sparkSession.createDataFrame([], "k int, silhouette double, smallest_share double, median_ari double, ari_q10 double, status string")
    x = materialise(ml.features(numeric, categorical).fit(base.filter("NOT __anchor")).transform(base).select(key, F.col(family).alias("__f"), "__anchor", "features"), "partition")
    train, anchor = x.filter("NOT __anchor"), x.filter("__anchor")
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=42, featuresCol="features", predictionCol="a").fit(train)
        ref = materialise(model.transform(anchor).select(key, "features", "a"), "reference")
        sizes = [r.n for r in ref.groupBy("a").agg(F.count("*").alias("n")).collect()]
        cohesive = ClusteringEvaluator(featuresCol="features", predictionCol="a").evaluate(ref) if len(sizes) > 1 else 0.0
        aris = []
        for i in range(refits):
            drawn = train.withColumn("__w", bootstrap_weight("__f", i).cast("double")).filter("__w > 0")
            again = KMeans(k=k, seed=1000 + i, featuresCol="features", predictionCol="b", weightCol="__w").fit(drawn)
            aris.append(adjusted_rand(again.transform(ref), "a", "b").first().ari)
        aris.sort()
        at = lambda p: aris[min(len(aris) - 1, int(p * len(aris)))]
        small = min(sizes) / sum(sizes) if len(sizes) == k else 0.0
        ok = at(0.5) >= median and at(0.1) >= tenth and cohesive >= cohesion and small >= share
        rows.append((k, cohesive, small, at(0.5), at(0.1), "accepted" if ok else "unstable" if at(0.5) < median or at(0.1) < tenth else "unsupported"))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, smallest_share double, median_ari double, ari_q10 double, status string")


def isolated_vectors(df: DataFrame, key: str, text: str, fold: str, folds: int, buckets: int = 1 << 14) -> DataFrame:
    """``key``, ``fold`` and ``tfidf``: text vectors whose rarity is fitted without the row's own fold and
    without any document that shares a text with it."""
    from pyspark.ml.feature import IDF

    tf = materialise(ml.term_counts(df.select(key, fold, F.coalesce(text, F.lit("")).alias("__text")), "__text", buckets, True).withColumn("__h", F.xxhash64("__text")).drop("__text"), "terms")
    parts = []
    for k in range(folds):
        held = tf.filter(F.col(fold) == k)
        seen = tf.filter(F.col(fold) != k).join(held.select("__h").distinct(), "__h", "left_anti")
        if not seen.limit(1).count():
            parts.append(held.select(key, fold, F.col("__tf").alias("tfidf")))
            continue
        parts.append(IDF(inputCol="__tf", outputCol="tfidf", minDocFreq=2).fit(seen).transform(held).select(key, fold, "tfidf"))
    return reduce(DataFrame.unionByName, parts)
