"""Random search over typed parameters, boosting and support vectors from Spark jobs, and tables of runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeframe.operators.profile import systematic_sample


@dataclass
class Parameter:
    """``continuous``, ``log``, ``integer``, ``integer_log`` between two bounds, or ``categorical`` values."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 1.0
    values: tuple = ()

    def decode(self, u: Column) -> Column:
        """The value at a place between zero and one."""
        if self.kind == "categorical":
            return F.element_at(F.array(*[F.lit(v) for v in self.values]), F.least(F.floor(u * len(self.values)), F.lit(len(self.values) - 1)).cast("int") + 1)
        if self.kind.endswith("log"):
            v = F.exp(F.lit(float(np.log(self.low))) + u * float(np.log(self.high) - np.log(self.low)))
        elif self.kind in ("continuous", "integer"):
            v = F.lit(float(self.low)) + u * float(self.high - self.low)
        else:
            raise ValueError(f"unknown kind {self.kind}")
        return F.round(v).cast("long") if self.kind.startswith("integer") else v


def candidate_table(spark: SparkSession, space: list[Parameter], n: int, seed: int = 42) -> DataFrame:
    """``candidate`` and a column for each parameter. Places come from hashes of the candidate, so they don't depend on partitions."""
    place = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 52)) / float(1 << 52)
    return spark.range(n).select(F.col("id").alias("candidate"), *[p.decode(place(i)).alias(p.name) for i, p in enumerate(space)])


@dataclass
class Evaluation:
    """What an evaluator found for a candidate: ``terms`` by name, and the ``fitness`` or weights to compose it of them."""

    fitness: float | None = None
    terms: dict[str, float] | None = None
    status: str = "ok"


def compose(terms: dict[str, float], weights: dict[str, tuple[float, bool]]) -> float:
    """Fitness (smaller is better) of terms with ``(weight, whether larger is better)``; a missing or not finite term is an error."""
    wrong = [n for n in weights if not np.isfinite(terms.get(n, np.nan))]
    if wrong:
        raise ValueError(f"no finite value of {', '.join(sorted(wrong))}")
    return float(sum(w * (-terms[n] if larger else terms[n]) for n, (w, larger) in weights.items()))


def random_search(spark: SparkSession, space: list[Parameter], fitness: Callable[[dict], float | dict | Evaluation], n: int, seed: int = 42, worst: float = float("inf"), weights: dict[str, tuple[float, bool]] | None = None) -> DataFrame:
    """Every candidate with ``fitness`` (smaller is better; ``worst`` where the fit failed), ``terms``, ``error``, ``failed`` and ``best``.

    An evaluator may return a number, an ``Evaluation``, or a dict of one: several
    terms, whose fitness is given or composed by ``weights``.
    """

    def judged(params: dict) -> tuple[float, dict | None]:
        out = fitness(params)
        if isinstance(out, dict):
            out = Evaluation(**out)
        if not isinstance(out, Evaluation):
            return float(out), {"objective": float(out)}
        terms = {k: float(v) for k, v in (out.terms or {}).items()}
        if out.status != "ok":
            raise RuntimeError(out.status)
        if out.fitness is None and weights is None:
            raise ValueError("terms need a fitness or weights")
        return float(out.fitness) if out.fitness is not None else compose(terms, weights), terms

    rows = []
    for r in candidate_table(spark, space, n, seed).orderBy("candidate").collect():  # as many as were asked for
        params = r.asDict()
        try:
            rows.append((params["candidate"], *judged({p.name: params[p.name] for p in space}), None, False))
        except Exception as e:  # noqa: BLE001  a failed fit is the worst candidate
            rows.append((params["candidate"], worst, None, str(e).splitlines()[0][:200] if str(e) else type(e).__name__, True))
    found = spark.createDataFrame(rows, "candidate long, fitness double, terms map<string,double>, error string, failed boolean")
    scored = candidate_table(spark, space, n, seed).join(F.broadcast(found), "candidate")
    best = min(rows, key=lambda r: (r[1], r[0]))[0] if rows else -1
    return scored.withColumn("best", F.col("candidate") == best)


def boosted_trees(df: DataFrame, label: str, rounds: int = 5, depth: int = 1) -> tuple[list, Callable[[DataFrame], DataFrame]]:
    """AdaBoost (SAMME) over decision trees on ``features``: the stages with their weights, and a function that adds ``boosted``.

    Labels are whole numbers from zero. A row's weight is a function of the trees
    so far, so a round is a fit and one aggregate, and no weights are stored.
    """
    classes = int(df.agg(F.max(label)).first()[0]) + 1
    stages: list[tuple] = []

    def weighted(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_w", F.lit(0.0))
        for model, alpha in stages:
            out = model.transform(out).withColumn("_w", F.col("_w") + F.when(F.col("_p") != F.col(label), alpha).otherwise(0.0)).drop("_p", "_raw", "_prob")
        return out.withColumn("_w", F.exp("_w"))

    for _ in range(rounds):
        own = weighted(df)
        model = DecisionTreeClassifier(maxDepth=depth, labelCol=label, weightCol="_w", predictionCol="_p", rawPredictionCol="_raw", probabilityCol="_prob").fit(own)
        error = model.transform(own).agg(F.sum(F.when(F.col("_p") != F.col(label), F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
        if error >= 1 - 1 / classes:
            break
        alpha = float(np.log((1 - max(error, 1e-10)) / max(error, 1e-10)) + np.log(classes - 1))
        stages.append((model, alpha))
        if error <= 1e-10:
            break

    def predict(rows: DataFrame) -> DataFrame:
        out = rows.withColumns({f"_v{c}": F.lit(0.0) for c in range(classes)})
        for model, alpha in stages:
            out = model.transform(out).withColumns({f"_v{c}": F.col(f"_v{c}") + F.when(F.col("_p") == c, alpha).otherwise(0.0) for c in range(classes)}).drop("_p", "_raw", "_prob")
        votes = F.array(*[F.struct(F.col(f"_v{c}").alias("v"), F.lit(-c).alias("c")) for c in range(classes)])
        return out.withColumn("boosted", (-F.array_max(votes)["c"]).cast("double")).drop(*[f"_v{c}" for c in range(classes)])

    return stages, predict


def support_vector_regression(df: DataFrame, features: list[str], target: str, epsilon: float = 0.1, c: float = 1.0, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of linear support vector regression: full subgradients of the epsilon-insensitive loss on standardised columns, one aggregate a round."""
    x, y = [F.col(f"`{f}`").cast("double") for f in features], F.col(f"`{target}`").cast("double")
    s = df.agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate([*x, y])], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate([*x, y])]).first()
    k, n = len(x), s["n"]
    mean, sd = np.array([s[f"m{i}"] for i in range(k + 1)]), np.array([s[f"s{i}"] or 1.0 for i in range(k + 1)])
    z = [(v - float(mean[i])) / float(sd[i]) for i, v in enumerate([*x, y])]
    w, b, total_w, total_b, kept = np.zeros(k), 0.0, np.zeros(k), 0.0, 0
    for step in range(1, rounds + 1):
        e = z[k] - (F.lit(float(b)) + sum((v * float(a) for v, a in zip(z[:k], w, strict=True)), F.lit(0.0)))
        sign = F.when(e > epsilon, 1.0).when(e < -epsilon, -1.0).otherwise(0.0)
        g = df.agg(F.avg(sign), *[F.avg(sign * v) for v in z[:k]]).first()
        rate = 1.0 / step**0.5
        w = w + rate * (np.array(g[1:], dtype=float) - w / (c * n))
        b = b + rate * float(g[0])
        if step > rounds // 2:  # the mean of the later half is steadier than the last step
            total_w, total_b, kept = total_w + w, total_b + b, kept + 1
    w, b = total_w / kept, total_b / kept
    coefficients = w * sd[k] / sd[:k]
    return float(mean[k] + b * sd[k] - coefficients @ mean[:k]), coefficients


# ---------------------------------------------------------------- run tables

def history_points(df: DataFrame, order: str, most: int = 500) -> DataFrame:
    """At most ``most`` points of a history, the last among them."""
    return systematic_sample(df, order, most)


def cohort_report(runs: DataFrame, cohort: list[str], comparable: list[str], score: str) -> DataFrame:
    """Runs, mean and best score of each cohort; ``suppressed``, without scores, where its runs aren't comparable."""
    mixed = F.lit(False)
    for c in comparable:
        mixed = mixed | (F.count_distinct(c) > 1)
    by = runs.groupBy(*cohort).agg(F.count("*").alias("runs"), mixed.alias("suppressed"), F.avg(score).alias("mean"), F.min(score).alias("best"))
    return by.select(*cohort, "runs", "suppressed", *[F.when(~F.col("suppressed"), F.col(c)).alias(c) for c in ("mean", "best")])
