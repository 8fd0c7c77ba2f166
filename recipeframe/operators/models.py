"""Model families on Spark ML, grid search by folds, and models from aggregates.

Estimators are entries of a registry (or any Spark estimator that the caller
brings). Closed-form models gather one small matrix by an aggregate and solve it
on the driver; its size is that of the features, never of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, Transformer
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as G
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Binarizer, MaxAbsScaler, MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window as W

from recipeframe.functions.shared import fresh_path, materialize


@dataclass
class Spec:
    """An estimator, its grid, whether it wants scaled features, and how it takes rows of equal features as one: ``weights`` (by their number and mean label), ``draws`` (a forest: by those of each tree's draws) or not at all."""

    make: Callable
    grid: dict = field(default_factory=dict)
    scaling: str = "none"
    grouped: str | None = None


def _ovr(make):
    return lambda **o: C.OneVsRest(classifier=make(**o))


def _bernoulli(threshold: float = 0.0, **o):
    """Naive Bayes on whether a (scaled) feature is above a threshold."""
    return Pipeline(stages=[Binarizer(threshold=threshold, outputCol="binary"), C.NaiveBayes(modelType="bernoulli", featuresCol="binary", **o)])


class FromZero(Transformer, HasInputCol, HasOutputCol):
    """A vector whose entries below zero are zero: a scaler's range is that of the rows it was fitted on."""

    def setInputCol(self, value: str):
        return self._set(inputCol=value)

    def _transform(self, df: DataFrame) -> DataFrame:
        entries = F.transform(vector_to_array(self.getInputCol()), lambda x: F.greatest(x, F.lit(0.0)))
        return df.withColumn(self.getOutputCol(), array_to_vector(entries))


def _counting_bayes(kind: str):
    """Naive Bayes over features that count, so must not be below zero."""

    def make(**o):
        first = FromZero()._set(outputCol="from_zero")
        return Pipeline(stages=[first, C.NaiveBayes(modelType=kind, featuresCol="from_zero", **o)])

    return make


def perceptron(features: int, classes: int, hidden: tuple = ((8,), (16,))) -> Spec:
    """A multilayer perceptron for as many features and classes, with some hidden layers to choose from."""
    return Spec(C.MultilayerPerceptronClassifier, {"layers": [[features, *h, classes] for h in hidden], "maxIter": [100], "seed": [42]}, "standard")


class MeanOf(Transformer):
    """The mean of some fitted models' predictions."""

    def __init__(self, models: list):
        super().__init__()
        self.models = models

    def _transform(self, df: DataFrame) -> DataFrame:
        out, names = df, [f"_prediction{i}" for i in range(len(self.models))]
        for name, model in zip(names, self.models, strict=True):
            out = model.transform(out).withColumnRenamed("prediction", name)
        return out.withColumn("prediction", sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)


CLASSIFIERS = {
    "dt": Spec(C.DecisionTreeClassifier, {"maxDepth": [3, 6]}), "rf": Spec(C.RandomForestClassifier, {"numTrees": [20], "maxDepth": [5]}), "hgbc": Spec(_ovr(lambda **o: C.GBTClassifier(**o)), {"maxIter": [10]}),
    "gnb": Spec(lambda **o: C.NaiveBayes(modelType="gaussian", **o)), "mnb": Spec(_counting_bayes("multinomial"), scaling="minmax"), "compnb": Spec(_counting_bayes("complement"), scaling="minmax"),
    "bnb": Spec(_bernoulli, scaling="standard"), "lsvc": Spec(_ovr(lambda **o: C.LinearSVC(**o)), {"regParam": [0.01]}, "standard"), "sgd": Spec(C.LogisticRegression, {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}, "standard"),
}
REGRESSORS = {
    "linear": Spec(G.LinearRegression), "ridge": Spec(lambda **o: G.LinearRegression(elasticNetParam=0.0, **o), {"regParam": [0.1, 1.0]}, "standard"), "lasso": Spec(lambda **o: G.LinearRegression(elasticNetParam=1.0, **o), {"regParam": [0.1]}, "standard"),
    "elasticnet": Spec(lambda **o: G.LinearRegression(elasticNetParam=0.5, **o), {"regParam": [0.1]}, "standard"), "huber": Spec(lambda **o: G.LinearRegression(loss="huber", **o), {"epsilon": [1.35]}, "standard"),
    "decision_tree": Spec(G.DecisionTreeRegressor, {"maxDepth": [3, 6]}, grouped="weights"), "random_forest": Spec(G.RandomForestRegressor, {"numTrees": [20]}, grouped="draws"), "boosting": Spec(G.GBTRegressor, {"maxIter": [10]}, grouped="weights"),
}
CLUSTERERS = {
    "kmeans": Spec(K.KMeans, {"k": [2, 3]}, "standard"), "gmm": Spec(K.GaussianMixture, {"k": [2]}, "standard"), "bisecting": Spec(K.BisectingKMeans, {"k": [2, 3]}, "standard"),
}
SCALERS = {"standard": lambda: StandardScaler(withMean=True), "minmax": MinMaxScaler, "robust": lambda: RobustScaler(withCentering=True), "maxabs": MaxAbsScaler}


def assemble(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """A ``features`` vector; missing, not finite and non-numeric cells are an error."""
    bad = [F.sum((F.col(f"`{c}`").cast("string").try_cast("double").isNull() | F.isnan(F.col(f"`{c}`").cast("string").try_cast("double"))).cast("long")).alias(c) for c in features + ([target] if target else [])]
    counts = df.agg(*bad).first().asDict()
    if any(counts.values()):
        raise ValueError(f"not numeric or missing: { {c: n for c, n in counts.items() if n} }")
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def pipeline(spec: Spec, params: dict, scaling: str = "auto", **columns) -> Pipeline:
    scaling = spec.scaling if scaling == "auto" else scaling
    stages, at = [], "features"
    if scaling != "none":
        stages.append(SCALERS[scaling]().setInputCol("features").setOutputCol("scaled"))
        at = "scaled"
    model = spec.make(**params)
    if isinstance(model, Pipeline):  # its first stage reads the features
        model.getStages()[0].setInputCol(at)
        return Pipeline(stages=[*stages, *model.getStages()])
    return Pipeline(stages=[*stages, model.setFeaturesCol(at)])


def candidates(grid: dict) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def grid_search(df: DataFrame, spec: Spec, fold: str, task: str = "classification", metric: str | None = None) -> DataFrame:
    """Cross-validated score of each candidate: ``params, mean, std, rank, failed``; a candidate that fails doesn't stop the others."""
    if task == "classification":
        judge, larger = MulticlassClassificationEvaluator(metricName=metric or "accuracy"), True
    else:
        judge, larger = RegressionEvaluator(metricName=metric or "rmse"), False
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    rows = []
    for params in candidates(spec.grid):
        scores, failed = [], 0
        for k in folds:
            try:
                model = pipeline(spec, params).fit(df.filter(F.col(fold) != k))
                scores.append(float(judge.evaluate(model.transform(df.filter(F.col(fold) == k)))))
            except Exception:  # noqa: BLE001  counted, and shown in the result
                failed += 1
        rows.append((str(sorted(params.items())), float(np.mean(scores)) if scores else None, float(np.std(scores)) if scores else None, failed))
    out = df.sparkSession.createDataFrame(rows, "params string, mean double, std double, failed int")
    order = F.col("mean").desc_nulls_last() if larger else F.col("mean").asc_nulls_last()
    return out.withColumn("rank", F.rank().over(W.orderBy(order)))


def cluster_search(df: DataFrame, spec: Spec, repeats: int = 3) -> DataFrame:
    """Silhouette (squared Euclidean) of each candidate and repeat."""
    rows, judge = [], ClusteringEvaluator()
    for params in candidates(spec.grid):
        for seed in range(repeats):
            try:
                model = pipeline(spec, params | {"seed": 42 + seed}).fit(df)
                rows.append((str(sorted(params.items())), seed, float(judge.evaluate(model.transform(df)))))
            except Exception:  # noqa: BLE001
                rows.append((str(sorted(params.items())), seed, None))
    return df.sparkSession.createDataFrame(rows, "params string, repeat int, silhouette double")


# ---------------------------------------------------------------- models from aggregates

def _sums(batches, groups: int):
    """Sums and second moments of the number columns of some rows, for each group in the first column."""
    held: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[groups:]], axis=1)
        full = np.hstack([np.ones((len(x), 1)), x])
        keys = np.array(b.column(0).to_pylist(), dtype=object) if groups else np.zeros(len(x), dtype=object)
        for key in set(keys.tolist()):
            own = full[keys == key] if groups else full
            held[key] = held.get(key, 0) + own.T @ own
    for key, p in held.items():
        at = np.arange(p.size)
        yield pa.RecordBatch.from_arrays([pa.array([None if not groups else str(key)] * p.size, pa.string()), pa.array(at), pa.array(p.ravel())], names=["group", "at", "value"])


def moments(df: DataFrame, columns: list[str], by: str | None = None) -> dict:
    """For each group (by its text; None without groups) ``n``, sums and second moments of columns; what comes back is the square of the features in size."""
    own = df.select(*([F.col(f"`{by}`").cast("string").alias("_by")] if by else []), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    k, groups, out = len(columns) + 1, int(by is not None), {}
    for r in own.mapInArrow(lambda it: _sums(it, groups), "group string, at long, value double").groupBy("group", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["group"], np.zeros(k * k))[r["at"]] = r["value"]
    full = {g: p.reshape(k, k) for g, p in out.items()}
    return {g: (float(p[0, 0]), p[0, 1:], p[1:, 1:]) for g, p in full.items()}


def _vector_sums(batches, shift: np.ndarray):
    """Row number, sums and second moments of vectors less ``shift``, of each task."""
    total = np.zeros((len(shift) + 1,) * 2)
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - shift
            full = np.hstack([np.ones((len(x), 1)), x])
            total += full.T @ full
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])


def vector_moments(df: DataFrame, vector: str, centred: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, means, and the sums of outer products of vectors (``centred``: about their means); null vectors don't count.

    Sums are taken about the first row, so that large means don't swallow small spreads.
    """
    own = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).filter("v IS NOT NULL")
    first = own.first()
    if first is None:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    shift = np.array(first["v"], dtype=np.float64) if centred else np.zeros(len(first["v"]))
    k, out = len(shift) + 1, np.zeros((len(shift) + 1) ** 2)
    for r in own.mapInArrow(lambda it: _vector_sums(it, shift), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    full = out.reshape(k, k)
    n, s = full[0, 0], full[0, 1:]
    return float(n), shift + s / n, full[1:, 1:] - np.outer(s, s) / n if centred else full[1:, 1:]


def project(c: Column, weights: np.ndarray) -> Column:
    """A vector times a matrix (features by components) of literals."""
    dot = lambda w: F.aggregate(F.zip_with(c, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return F.array(*[dot(weights[:, i]) for i in range(weights.shape[1])])


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of least squares with an L2 penalty, from the normal equations."""
    k = len(features)
    n, s, p = moments(df, [*features, target])[None]
    c = p - np.outer(s, s) / n
    w = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k])
    return float(s[k] / n - w @ s[:k] / n), w


def matching_pursuit(df: DataFrame, features: list[str], target: str, most: int) -> dict[str, float]:
    """Orthogonal matching pursuit on the Gram matrix."""
    k = len(features)
    n, s, p = moments(df, [*features, target])[None]
    c = p - np.outer(s, s) / n
    chosen: list[int] = []
    rest, w = c[:k, k].copy(), np.zeros(0)
    for _ in range(min(most, k)):
        score = np.abs(rest) / np.sqrt(np.maximum(np.diag(c)[:k], 1e-12))
        score[chosen] = -1
        chosen.append(int(score.argmax()))
        w = np.linalg.solve(c[np.ix_(chosen, chosen)], c[chosen, k])
        rest = c[:k, k] - c[:k][:, chosen] @ w
    return {features[i]: float(x) for i, x in zip(chosen, w, strict=True)}


def discriminant(df: DataFrame, features: list[str], label: str, quadratic: bool = False) -> Column:
    """The predicted class as an expression: linear (shared covariance) or quadratic discriminant."""
    k, found = len(features), moments(df, features, label)
    kind, order = df.schema[label].dataType, sorted(found)
    total = sum(found[g][0] for g in order)
    cov = {g: found[g][2] - np.outer(found[g][1], found[g][1]) / found[g][0] for g in order}
    shared = sum(cov.values()) / max(total - len(order), 1)
    x, entries = [F.col(f"`{f}`").cast("double") for f in features], []
    for g in order:
        n, s, _ = found[g]
        mean, prior = s / n, float(np.log(n / total))
        if quadratic:  # squares of the features turned by the covariance's inverse root
            values, vectors = np.linalg.eigh(cov[g] / max(n - 1, 1))
            values = np.maximum(values, 1e-12)
            turned = (vectors / np.sqrt(values)).T
            parts = [sum((v * float(c) for v, c in zip(x, row, strict=True)), F.lit(float(-row @ mean))) for row in turned]
            score = F.lit(prior - 0.5 * float(np.log(values).sum())) - 0.5 * sum((p * p for p in parts), F.lit(0.0))
        else:
            w = np.linalg.pinv(shared) @ mean
            score = sum((v * float(c) for v, c in zip(x, w, strict=True)), F.lit(prior - 0.5 * float(w @ mean)))
        entries.append(F.struct(score.alias("score"), F.lit(g).cast(kind).alias("label")))
    return F.array_max(F.array(*entries))["label"]


def _quadratic_classes(batches, centres: np.ndarray, roots: np.ndarray, base: np.ndarray):
    for b in batches:
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, centres.shape[1]))
        score = np.stack([c - 0.5 * (((x - m) @ r) ** 2).sum(1) for m, r, c in zip(centres, roots, base, strict=True)], axis=1) if len(x) else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score.argmax(1) if len(x) else [], pa.int32())], names=[*b.schema.names[1:], "_class"])


def quadratic_discriminant(train: DataFrame, rows: DataFrame, features: list[str], label: str, keep: list[str], ridge: float = 1e-9) -> DataFrame:
    """``keep`` and ``prediction`` of ``rows``: a covariance for each class, for any number of features.

    The classes' moments are one aggregate; the quadratic forms go to the tasks as
    matrices and are worked out for whole batches. Of equal scores the smaller class wins.
    """
    found = moments(train, features, label)
    kind = train.schema[label].dataType
    order = [str(r[0]) for r in train.select(label).distinct().orderBy(label).collect() if r[0] is not None]
    total, centres, roots, base = sum(found[g][0] for g in order), [], [], []
    for g in order:
        n, s, p = found[g]
        cov = (p - np.outer(s, s) / n) / max(n - 1, 1)
        values, vectors = np.linalg.eigh(cov)
        values = np.maximum(values, ridge * max(float(values.max(initial=0.0)), ridge))
        centres.append(s / n)
        roots.append(vectors / np.sqrt(values))
        base.append(float(np.log(n / total) - 0.5 * np.log(values).sum()))
    own = rows.select(F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_x"), *keep)
    fields = ", ".join(f"`{c}` {t}" for c, t in own.dtypes[1:])
    sent = tuple(np.array(v) for v in (centres, roots, base))
    out = own.mapInArrow(lambda it: _quadratic_classes(it, *sent), f"{fields}, _class int")
    return out.select(*keep, F.element_at(F.array(*[F.lit(g) for g in order]), F.col("_class") + 1).cast(kind).alias("prediction"))


def ridge_classifier(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> Column:
    """The predicted class as an expression: the largest of one ridge regression for each class, on targets of one and minus one."""
    x, entries = [F.col(f"`{f}`").cast("double") for f in features], []
    for r in df.select(label).distinct().orderBy(label).collect():
        own = df.withColumn("_t", F.when(F.col(label) == F.lit(r[0]), 1.0).otherwise(-1.0))
        b, w = ridge(own, features, "_t", alpha)
        entries.append(F.struct(sum((v * float(c) for v, c in zip(x, w, strict=True)), F.lit(float(b))).alias("score"), F.lit(r[0]).alias("label")))
    return F.array_max(F.array(*entries))["label"]


def quantile_regression(df: DataFrame, features: list[str], target: str, q: float = 0.5, rounds: int = 12) -> tuple[float, np.ndarray]:
    """Iteratively reweighted least squares for the ``q``-quantile; each round is one aggregate."""
    k, (b, w) = len(features), ridge(df, features, target)
    x, y = [F.col(f"`{c}`").cast("double") for c in features], F.col(f"`{target}`").cast("double")
    for _ in range(rounds):
        e = y - (F.lit(float(b)) + sum((v * float(c) for v, c in zip(x, w, strict=True)), F.lit(0.0)))
        weight = F.when(e >= 0, q).otherwise(1 - q) / F.greatest(F.abs(e), F.lit(1e-4))
        full = [F.lit(1.0), *x, y]
        sums = [F.sum(weight * a * c).alias(f"p{i}_{j}") for i, a in enumerate(full) for j, c in enumerate(full) if j >= i]
        row, p = df.agg(*sums).first(), np.zeros((k + 2, k + 2))
        for i in range(k + 2):
            for j in range(i, k + 2):
                p[i, j] = p[j, i] = row[f"p{i}_{j}"]
        solved = np.linalg.solve(p[: k + 1, : k + 1] + 1e-9 * np.eye(k + 1), p[: k + 1, k + 1])
        b, w = float(solved[0]), solved[1:]
    return b, w


#: Distances between one row and many.
DISTANCES = {
    "euclidean": lambda d, q, x: np.sqrt((d * d).sum(-1)), "manhattan": lambda d, q, x: np.abs(d).sum(-1), "chebyshev": lambda d, q, x: np.abs(d).max(-1),
    "canberra": lambda d, q, x: np.divide(np.abs(d), np.abs(q) + np.abs(x), out=np.zeros_like(d), where=(np.abs(q) + np.abs(x)) > 0).sum(-1),
}


def _top_k(batches, asked, vectors, metric: str, k: int):
    """The ``k`` nearest of a task's rows to each query."""
    best: dict = {}
    for b in batches:
        ids, labels, x = b.column(0).to_pylist(), b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), dtype=np.float64)
        if not len(x):
            continue
        step = max(1, 4_000_000 // x.size)
        for i in range(0, len(asked), step):
            q = vectors[i : i + step, None, :]
            d = DISTANCES[metric](q - x[None], q, x[None])
            for row, name in enumerate(asked[i : i + step]):
                near = np.argpartition(d[row], min(k, len(x) - 1))[: k + 1] if len(x) > k + 1 else np.arange(len(x))
                edge = d[row][near].max()
                near = np.flatnonzero(d[row] <= edge)  # ties at the edge are settled by id
                own = [(float(d[row][j]), ids[j], labels[j]) for j in near if ids[j] != name]
                best[name] = sorted(best.get(name, []) + own, key=lambda r: r[:2])[:k]
    rows = [(q, i, y, d) for q, found in best.items() for d, i, y in found]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], names=["query", "id", "label", "d"])


def neighbours(train: DataFrame, queries: DataFrame, vector: str, label: str, key: str, k: int = 5, metric: str = "euclidean", block: int = 4096) -> DataFrame:
    """``query, id, label, d, r`` of the ``k`` nearest training rows of each query (itself left out), ties to the smaller id.

    Queries come in blocks, each sent by itself to all rows; a task keeps ``k``
    rows for each query, so pairs are never written out.
    """
    if metric not in DISTANCES:
        raise ValueError(f"unknown distance {metric}")
    own = train.select(F.col(key).cast("long").alias("id"), F.col(label).cast("double").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    asked = materialize(queries.select(F.col(key).cast("long").alias("query"), F.transform(vector, lambda x: x.cast("double")).alias("q")), "queries")
    blocks, spark = max(1, -(-asked.count() // block)), train.sparkSession
    schema, path = "query long, id long, label double, d double", fresh_path(spark, "neighbours")
    for i in range(blocks):  # each block is sent by itself, and released when what it found is stored
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).collect()
        sent = spark.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["q"] for r in rows], dtype=np.float64)))
        part = own.mapInArrow(lambda it, sent=sent: _top_k(it, *sent.value, metric, k) if len(sent.value[0]) else iter(()), schema)
        part.write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(schema).parquet(path)
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("d", "id")))
    return ranked.filter(F.col("r") <= k)


def nearest_neighbours(train: DataFrame, queries: DataFrame, vector: str, label: str, key: str, k: int = 5, metric: str = "euclidean", weights: str = "uniform", task: str = "classification") -> DataFrame:
    """``query, prediction``: the label of most of the nearest rows' weight (ties to the smaller), or their weighted mean.

    With ``weights="distance"`` a row counts by one over its distance; rows at
    distance zero then outweigh all others.
    """
    near = neighbours(train, queries, vector, label, key, k, metric)
    if weights == "distance":
        same = F.max((F.col("d") == 0).cast("int")).over(W.partitionBy("query"))
        near = near.withColumn("w", F.when(same == 1, (F.col("d") == 0).cast("double")).otherwise(1 / F.when(F.col("d") > 0, F.col("d"))))
    else:
        near = near.withColumn("w", F.lit(1.0))
    if task == "regression":
        return near.groupBy("query").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))
    votes = near.withColumn("label", F.col("label").cast(train.schema[label].dataType)).groupBy("query", "label").agg(F.sum("w").alias("n"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("l"))).alias("prediction"))


def _center_sums(batches, centers: np.ndarray):
    total, n = np.zeros_like(centers), np.zeros(len(centers))
    for b in batches:
        x = np.array(b.column(0).to_pylist(), dtype=np.float64)
        if len(x):
            at = np.argmin((centers**2).sum(1)[None] - 2 * (x @ centers.T), axis=1)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=len(centers))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers))), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], names=["c", "n", "s"])


def mini_batch_kmeans(df: DataFrame, vector: str, key: str, k: int, rounds: int = 20, share: float = 0.2, seed: int = 42) -> np.ndarray:
    """Centres of ``k`` clusters: each round moves them towards the means of a seeded share of the rows, by less the more rows they have seen."""
    own = materialize(df.select(F.transform(vector, lambda x: x.cast("double")).alias("v"), F.col(key).alias("id")), "vectors")
    first = own.orderBy(F.xxhash64(F.lit(seed), "id")).limit(32 * k).collect()  # farthest-first among a few seeded rows
    pool = np.array([r["v"] for r in first], dtype=np.float64)
    centers = pool[:1]
    for _ in range(k - 1):
        centers = np.vstack([centers, pool[((pool[:, None] - centers[None]) ** 2).sum(2).min(1).argmax()]])
    seen = np.zeros(k)
    for i in range(rounds):
        part = own.filter(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v")
        rows = part.mapInArrow(lambda it, c=centers: _center_sums(it, c), "c long, n double, s array<double>").collect()
        n, total = np.zeros(k), np.zeros_like(centers)
        for r in rows:
            n[r["c"]] += r["n"]
            total[r["c"]] += np.array(r["s"])
        seen += n
        met = n > 0
        centers[met] += (n[met] / seen[met])[:, None] * (total[met] / n[met][:, None] - centers[met])
    return centers


def dbscan(df: DataFrame, x: str, y: str, key: str, eps: float, least: int) -> DataFrame:
    """Clusters of a plane's points, noise and rows without a finite point as -1: density clusters of two coordinates, so no close pair is stored."""
    from recipeframe.operators.vector_clusters import density_clusters  # which reads this module

    own = df.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fine = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))
    found = density_clusters(own.filter(fine).select("id", F.array("x", "y").alias("v")), "v", "id", eps, least)
    return found.unionByName(own.filter(~fine).select("id", F.lit(-1).alias("cluster"))).select("id", F.col("cluster").cast("long").alias("cluster"))


def principal_components(df: DataFrame, vector: str, k: int | float) -> tuple[DataFrame, list[float]]:
    """Centred projections on the first ``k`` components (largest weight positive) and their explained shares.

    ``k`` below one is a share of the variance: the fewest components that explain more than it.
    The components are eigenvectors of the covariance, whose sums are one aggregate.
    """
    n, mean, scatter = vector_moments(df, vector)
    if n < 2:
        raise ValueError("components need at least two rows")
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    share = values / values.sum() if values.sum() > 0 else np.zeros_like(values)
    if 0 < k < 1:
        k = min(int(np.searchsorted(np.cumsum(share), k, side="right")) + 1, len(share))
    if not 1 <= int(k) <= len(share):
        raise ValueError(f"components must be a share below one, or a number from 1 to {len(share)}")
    weights = vectors[:, : int(k)]
    weights = weights * np.where(weights[np.abs(weights).argmax(axis=0), range(weights.shape[1])] < 0, -1.0, 1.0)
    centred = F.zip_with(F.transform(vector, lambda x: x.cast("double")), F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    return df.withColumn("components", project(centred, weights)), [float(x) for x in share[: int(k)]]


def synthetic_gaussian(df: DataFrame, columns: list[str], rows: int, seed: int = 42, correlated: bool = True) -> DataFrame:
    """Rows drawn from a normal distribution with the columns' means and (co)variances."""
    k = len(columns)
    n, s, p = moments(df, columns)[None]
    cov = (p - np.outer(s, s) / n) / max(n - 1, 1)
    if not correlated:
        cov = np.diag(np.diag(cov))
    values, vectors = np.linalg.eigh(cov)
    root = vectors * np.sqrt(np.maximum(values, 0.0))
    base = df.sparkSession.range(rows).select("id", *[F.randn(seed + i).alias(f"z{i}") for i in range(k)])
    return base.select("id", *[(F.lit(float(s[i] / n)) + sum((F.col(f"z{j}") * float(root[i, j]) for j in range(k)), F.lit(0.0))).alias(c) for i, c in enumerate(columns)])


#: How synthetic rows can be made; fixed values.
SYNTHETIC = ("bootstrap", "independent_gaussian", "correlated_gaussian", "student_t")


def synthetic_plan_errors(plan: dict, most_rows: int = 1_000_000_000) -> list[str]:
    """What is wrong with a plan for synthetic rows (``method, rows, seed, df``): none, if it can be run."""
    out = [] if plan.get("method") in SYNTHETIC else [f"unknown method {plan.get('method')}"]
    rows, seed, df = plan.get("rows"), plan.get("seed", 42), plan.get("df", 5.0)
    if not isinstance(rows, int) or isinstance(rows, bool) or not 1 <= rows <= most_rows:
        out.append(f"rows must be a whole number from 1 to {most_rows}")
    if not isinstance(seed, int) or isinstance(seed, bool) or seed < 0:
        out.append("seed must be a whole number from 0")
    if plan.get("method") == "student_t" and not df > 2:
        out.append("df must be above 2: the covariance is matched")
    return out
