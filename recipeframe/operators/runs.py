"""Tables of runs and trials: metrics out of results, comparisons, traces and fitness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.ranks import running_extreme

#: What can be optimised, and whether more of it is better; fixed values.
METRICS = {"accuracy": True, "balanced_accuracy": True, "f1": True, "mcc": True, "auc": True, "r2": True, "silhouette": True, "rmse": False, "mae": False, "log_loss": False}


def extract_metrics(runs: DataFrame, key: str, result: str, paths: dict[str, str]) -> DataFrame:
    """``key, metric, value`` of the finite numbers at JSON paths of a result text; anything else there is left out."""
    entries = F.array(*[F.struct(F.lit(name).alias("metric"), F.get_json_object(result, path).try_cast("double").alias("value")) for name, path in paths.items()])
    long = runs.select(key, F.explode(entries).alias("e")).select(key, "e.*")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))


def compare_runs(runs: DataFrame, key: str, cohort: list[str], metrics: DataFrame, names: list[str]) -> DataFrame:
    """``key``, the cohort columns, ``comparable`` and a column for each metric: runs are comparable to the others of their cohort, if there are any and no cohort column is null."""
    wide = metrics.groupBy(key).pivot("metric", names).agg(F.avg("value"))
    sizes = runs.groupBy(*cohort).agg(F.count("*").alias("_n"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in cohort]
    placed = runs.select(key, *cohort).alias("r").join(sizes.alias("s"), same).select(f"r.{key}", *[f"r.{c}" for c in cohort], "_n")
    whole = F.lit(True)
    for c in cohort:
        whole = whole & F.col(c).isNotNull()
    return placed.join(wide, key, "left").select(key, *cohort, (whole & (F.col("_n") > 1)).alias("comparable"), *names)


def best_so_far(trials: DataFrame, order: str, objective: str, larger: bool = False) -> DataFrame:
    """Trials with an objective, in order, with the ``best`` so far."""
    return running_extreme(trials.filter(F.col(objective).isNotNull()), [order], F.col(objective), "best", larger)


def weighted_fitness(df: DataFrame, by: str, term: str, value: Column, terms: dict[str, tuple[float, bool]]) -> DataFrame:
    """``by, fitness``: the sum of the terms' values by weight; a term that is to be small counts against it."""
    weight = F.lit(None).cast("double")
    for name, (w, larger) in terms.items():
        weight = F.when(F.col(term) == name, F.lit(w if larger else -w)).otherwise(weight)
    return df.filter(weight.isNotNull()).groupBy(by).agg(F.sum(weight * value).alias("fitness"))


def plan_errors(plan: dict) -> list[str]:
    """What is wrong with an optimisation plan: none, if it can be run."""
    out = []
    if plan.get("metric") not in METRICS:
        out.append(f"unknown metric {plan.get('metric')}")
    elif plan.get("direction", "auto") not in ("auto", "maximize" if METRICS[plan["metric"]] else "minimize"):
        out.append(f"{plan['metric']} can't be {plan['direction']}d")
    for name, least, most in (("trials", 1, 10_000), ("parallel", 1, 256)):
        n = plan.get(name, 1)
        if not isinstance(n, int) or isinstance(n, bool) or not least <= n <= most:
            out.append(f"{name} must be a whole number from {least} to {most}")
    if not isinstance(plan.get("space"), dict) or not plan.get("space"):
        out.append("a search space is needed")
    for name, entry in (plan.get("space") or {}).items():
        kind = entry.get("type") if isinstance(entry, dict) else None
        if kind not in ("continuous", "log", "integer", "categorical"):
            out.append(f"{name}: unknown type {kind}")
        elif kind == "categorical":
            if not entry.get("values"):
                out.append(f"{name}: values are needed")
        elif not entry.get("low", 0) < entry.get("high", 0):
            out.append(f"{name}: low must be below high")
        elif kind == "log" and entry["low"] <= 0:
            out.append(f"{name}: a log scale begins above zero")
    return out
