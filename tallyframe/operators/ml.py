"""MLlib pipelines behind the statistical operators."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Imputer, NGram, StandardScaler, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialise


def _none(df: DataFrame, **columns) -> DataFrame | None:
    """An empty table has no model: the empty frame with the result columns, or None if there are rows."""
    if df.limit(1).count():
        return None
    extra = [T.StructField(n, k) for n, k in columns.items()]
    return df.sparkSession.createDataFrame([], T.StructType([*[f for f in df.schema.fields if f.name not in columns], *extra]))


def features(numeric: list[str], categorical: list[str]) -> Pipeline:
    """Imputation with missing flags, vocabularies that keep unseen values, scaling."""
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric])]
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep", stringOrderType="frequencyDesc") for c in categorical]
    cols = [f"{c}__i" for c in numeric] + [f"{c}__m" for c in numeric] + [f"{c}__x" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=cols, outputCol="__raw", handleInvalid="keep"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True)])


def with_flags(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__m": F.col(c).isNull().cast("double") for c in numeric} | {c: F.col(c).cast("double") for c in numeric})


def cluster(df: DataFrame, numeric: list[str], categorical: list[str], k: int, seed: int = 42, weight: str | None = None) -> DataFrame:
    """``cluster`` and ``cluster_distance`` (to the centre) of every row."""
    if (empty := _none(df, cluster=T.IntegerType(), features=VectorUDT())) is not None:
        return empty
    base = with_flags(df, numeric)
    x = features(numeric, categorical).fit(base).transform(base)
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")
    if weight:
        km = km.setWeightCol(weight)
    model = km.fit(x)
    return model.transform(x)


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(clustered)


def log_price_model(train: DataFrame, test: DataFrame, target: str, numeric: list[str], categorical: list[str], kind: str = "linear") -> DataFrame:
    """``prediction`` in the target's own scale, of a model of its logarithm."""
    if (empty := _none(train, prediction=T.DoubleType())) is not None:
        return empty
    fit_on = with_flags(train.filter(F.col(target) > 0), numeric).withColumn("__y", F.log1p(target))
    pipe = features(numeric, categorical).fit(fit_on)
    reg = LinearRegression(labelCol="__y", featuresCol="features", regParam=0.01, elasticNetParam=0.5) if kind == "linear" else GBTRegressor(labelCol="__y", featuresCol="features", maxIter=20, maxBins=256)
    model = reg.fit(pipe.transform(fit_on))
    out = model.transform(pipe.transform(with_flags(test, numeric)))
    return out.withColumn("prediction", F.expm1("prediction"))


def term_counts(df: DataFrame, text: str, buckets: int, pairs: bool, characters: tuple[int, ...] = ()) -> DataFrame:
    """``__tf``: hashed words (and word pairs, and n-grams of ``characters`` letters) of every row."""
    base = df.withColumn("__t", F.coalesce(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), F.lit("")))
    words = Tokenizer(inputCol="__t", outputCol="__w").transform(base)
    if pairs:
        words = NGram(n=2, inputCol="__w", outputCol="__p").transform(words).withColumn("__w", F.concat("__w", "__p")).drop("__p")
    if characters:
        words = words.withColumn("__c", F.transform(F.split("__t", ""), lambda c: F.when(c == " ", "_").otherwise(c)))
        for n in characters:
            grams = NGram(n=n, inputCol="__c", outputCol="__g").transform(words)
            words = grams.withColumn("__w", F.concat("__w", F.transform("__g", lambda g: F.concat(F.lit("#"), g)))).drop("__g")
        words = words.drop("__c")
    return HashingTF(inputCol="__w", outputCol="__tf", numFeatures=buckets).transform(words).drop("__t", "__w")


def tfidf(df: DataFrame, text: str, buckets: int = 1 << 14, pairs: bool = True) -> DataFrame:
    """``tfidf``: hashed words (and word pairs), weighted by rarity over all rows."""
    if (empty := _none(df, tfidf=VectorUDT())) is not None:
        return empty
    tf = term_counts(df, text, buckets, pairs)
    return IDF(inputCol="__tf", outputCol="tfidf", minDocFreq=2).fit(tf).transform(tf).drop("__tf")


def project(df: DataFrame, numeric: list[str], k: int = 2, development: Column | None = None) -> DataFrame:
    """``projection``: principal components of standardised columns, fitted on the ``development`` rows (by
    default all) and applied to every row."""
    if (empty := _none(df, projection=VectorUDT())) is not None:
        return empty
    base = with_flags(df, numeric)
    x = Pipeline(stages=[Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric]), VectorAssembler(inputCols=[f"{c}__i" for c in numeric], outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__s", withMean=True), PCA(k=k, inputCol="__s", outputCol="projection")])
    return x.fit(base if development is None else base.filter(development)).transform(base)


def reject_far(clustered: DataFrame, centres: list, share: float = 0.95) -> DataFrame:
    """``cluster`` with rows beyond their cluster's ``share`` radius as null."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array

    dims = [F.array(*[F.lit(float(x)) for x in np.asarray(c)]) for c in centres]
    near = F.create_map(*[y for i, d in enumerate(dims) for y in (F.lit(i), d)])
    d2 = F.aggregate(F.zip_with(vector_to_array("features"), near[F.col("cluster")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = clustered.withColumn("distance", F.sqrt(d2))
    radius = rows.groupBy("cluster").agg(F.percentile_approx("distance", share, 10000).alias("radius"))
    return rows.join(radius, "cluster").withColumn("assigned", F.when(F.col("distance") <= F.col("radius"), F.col("cluster")))


def topics(df: DataFrame, text: str, k: int, seed: int = 42, buckets: int = 1 << 17) -> DataFrame:
    """``topics``: mixture of k topics of every row. Each of the five iterations fits on all rows; every
    word but the stop words counts, hashed into ``buckets`` (words may share one), which bounds the model."""
    if (empty := _none(df, topics=VectorUDT())) is not None:
        return empty
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import StopWordsRemover

    base = df.withColumn("__t", F.coalesce(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), F.lit("")))
    words = StopWordsRemover(inputCol="__w", outputCol="__k").transform(Tokenizer(inputCol="__t", outputCol="__w").transform(base))
    words = words.withColumn("__k", F.filter("__k", lambda w: w != ""))
    counts = HashingTF(inputCol="__k", outputCol="features", numFeatures=buckets).transform(words)
    model = LDA(k=k, seed=seed, maxIter=5, optimizer="online", subsamplingRate=1.0, featuresCol="features", topicDistributionCol="topics").fit(counts)
    return model.transform(counts).drop("__t", "__w", "__k", "features")


def text_classifier(df: DataFrame, text: str, label: str, fold: str, folds: int) -> DataFrame:
    """Out-of-fold probability of a binary label from hashed words, word pairs and n-grams of 3 and 4
    characters. Rarity and model are fitted on the other folds only."""
    if (empty := _none(df, probability_1=T.DoubleType())) is not None:
        return empty
    from functools import reduce

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    tf = materialise(term_counts(df, text, 1 << 12, True, (3, 4)), "terms")
    out = []
    for k in range(folds):  # one model per fold
        train = tf.filter(F.col(fold) != k)
        idf = IDF(inputCol="__tf", outputCol="tfidf", minDocFreq=2).fit(train)
        model = LogisticRegression(featuresCol="tfidf", labelCol=label, regParam=0.01, maxIter=20).fit(idf.transform(train))
        scored = model.transform(idf.transform(tf.filter(F.col(fold) == k))).drop("__tf")
        out.append(scored.withColumn("probability_1", vector_to_array("probability")[1]))
    return reduce(DataFrame.unionByName, out)
