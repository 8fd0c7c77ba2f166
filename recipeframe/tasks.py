"""Named tasks with JSON-shaped payloads: one table that says what each needs and which Spark job it starts.

Every task returns its results as DataFrames by name; nothing is collected but
what the operators themselves need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeframe.operators import clusterings as K
from recipeframe.operators import compare as C
from recipeframe.operators import model_selection as Y
from recipeframe.operators import models as M
from recipeframe.operators import profile as P
from recipeframe.operators import recipe as R
from recipeframe.operators import representations as L
from recipeframe.operators import stores as S
from recipeframe.sources import delimited as D

Results = dict[str, DataFrame]


class PayloadError(ValueError):
    """A payload that doesn't fit its task, or a task that isn't there."""


@dataclass(frozen=True)
class Task:
    run: Callable[[SparkSession, dict], Results]
    needs: dict[str, type | tuple]  # what a payload must hold
    takes: dict[str, type | tuple]  # what else it may hold


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, or a delimited file with its own dialect; rows of delimited files are numbered by ``_row_id``."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df if R.ROW in df.columns else df.withColumn(R.ROW, F.monotonically_increasing_id())
    found = D.inspect_files(D.discover(spark, path)).first()
    if found is None or found["status"] != "parsed":
        raise PayloadError(f"{path} can't be read as a table")
    columns = D.display_columns(list(found["columns"]))
    df = D.read_delimited(spark, path, columns, found["delimiter"], found["has_header"], found["encoding"])
    return D.regular_rows(df, len(columns), found["delimiter"])


def _inspect(spark, p):
    files = D.inspect_files(D.discover(spark, p["path"], p.get("recursive", True), hidden=p.get("include_hidden", False)))
    return {"files": files, "summary": D.inventory_summary(files)}


def _profile(spark, p):
    df = read_table(spark, p["path"]).drop(R.ROW)
    profiles = P.column_profiles(df)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    out = {"columns": profiles, "top_values": P.top_values(df, p.get("top", 5)), "duplicates": P.duplicate_rows(df)}
    if numeric:
        out["numeric"] = P.numeric_summary(df, numeric)
    return out


def _compare(spark, p):
    if len(p["paths"]) < 2:
        raise PayloadError("data.compare needs at least two paths")
    tables = {path: read_table(spark, path).drop(R.ROW) for path in p["paths"]}
    compared = C.compare_collection(tables, p.get("max_pairs", 200) or None)
    return {"pairs": compared, "summary": C.collection_summary(compared, len(tables))}


def _page(spark, p):
    direction = p.get("sort_direction", "asc")
    if direction not in ("asc", "desc"):
        raise PayloadError("sort_direction is asc or desc")
    df = read_table(spark, p["path"])
    unknown = [c for c in [*p.get("filters", {}), *([p["sort_column"]] if p.get("sort_column") else [])] if c not in df.columns]
    if unknown:
        raise PayloadError(f"no column {', '.join(unknown)}")
    return {"page": D.table_page(df, p.get("page", 1), p.get("page_size", 50), p.get("search", ""), p.get("filters"), p.get("sort_column"), direction == "desc")}


def _preview(spark, p):
    df = read_table(spark, p["path"])
    return {"steps": R.diagnose(df, p["recipe"]), "before": df.orderBy(R.ROW).limit(p.get("preview_rows", 50)), "after": R.run_recipe(df, p["recipe"]).limit(p.get("preview_rows", 50))}


def _apply(spark, p):
    return {"manifest": S.publish_derived(R.run_recipe(read_table(spark, p["path"]), p["recipe"]), p["output"], p["path"], p["recipe"], p.get("overwrite", False))}


def _lineage(spark, p):
    events = read_table(spark, p["path"])
    leaves = events.filter(F.col("event").isin(p["events"])) if p.get("events") else events
    return {"trace": C.trace_lineage(events, leaves, p.get("max_depth", 100))}


def _supervised(registry: dict[str, M.Spec], kind: str):
    def run(spark, p):
        names = p.get("estimators") or list(registry)
        unknown = [n for n in names if n not in registry]
        if unknown:
            raise PayloadError(f"unknown estimators {', '.join(unknown)}; there are {', '.join(registry)}")
        df = read_table(spark, p["path"])
        key = p.get("key", R.ROW)
        own = M.assemble(df, p["features"], p["target"]).withColumn("label", F.col(f"`{p['target']}`").cast("double"))
        suite, found = Y.run_suite(own.select(key, "features", "label"), {n: registry[n] for n in names}, key, kind, **{k: p[k] for k in ("folds", "test", "seed", "metric") if k in p})
        out = {"suite": suite}
        for name, chosen in found.items():
            out |= {f"{name}.candidates": chosen.candidates, f"{name}.metrics": chosen.metrics, f"{name}.predictions": chosen.predictions}
        return out

    return run


def _clustering(spark, p):
    names = p.get("estimators") or list(M.CLUSTERERS)
    if unknown := [n for n in names if n not in M.CLUSTERERS]:
        raise PayloadError(f"unknown estimators {', '.join(unknown)}; there are {', '.join(M.CLUSTERERS)}")
    key = p.get("key", R.ROW)
    own = M.assemble(read_table(spark, p["path"]), p["features"]).select(key, "features")
    return {"candidates": K.select_clustering(own, {n: M.CLUSTERERS[n] for n in names}, key, p.get("selection_metric", "silhouette"), p.get("repeats", 3))}


def _representation(spark, p):
    key = p.get("key", R.ROW)
    own = M.assemble(read_table(spark, p["path"]), p["features"]).select(key, vector_to_array("features").alias("vector"))
    return {"methods": L.compare_representations(own, "vector", key, p.get("components", 2), tuple(p.get("methods", ("pca", "svd"))))}


_PATH = {"path": str}
_RECIPE = {"path": str, "recipe": list}
_MODEL = {"path": str, "features": list, "target": str}
TASKS: dict[str, Task] = {
    "data.inspect": Task(_inspect, _PATH, {"recursive": bool, "include_hidden": bool}),
    "data.profile": Task(_profile, _PATH, {"top": int}),
    "data.compare": Task(_compare, {"paths": list}, {"max_pairs": int}),
    "data.table": Task(_page, _PATH, {"page": int, "page_size": int, "search": str, "filters": dict, "sort_column": str, "sort_direction": str}),
    "data.transform.preview": Task(_preview, _RECIPE, {"preview_rows": int}),
    "data.transform.apply": Task(_apply, _RECIPE | {"output": str}, {"overwrite": bool}),
    "data.lineage": Task(_lineage, _PATH, {"events": list, "max_depth": int}),
    "classification": Task(_supervised(M.CLASSIFIERS, "classification"), _MODEL, {"key": str, "estimators": list, "folds": int, "test": float, "seed": int, "metric": str}),
    "regression": Task(_supervised(M.REGRESSORS, "regression"), _MODEL, {"key": str, "estimators": list, "folds": int, "test": float, "seed": int, "metric": str}),
    "clustering": Task(_clustering, {"path": str, "features": list}, {"key": str, "estimators": list, "selection_metric": str, "repeats": int}),
    "representation": Task(_representation, {"path": str, "features": list}, {"key": str, "components": int, "methods": list}),
}


def execute_task(spark: SparkSession, task: str, payload: dict) -> Results:
    """Run a task; a payload that lacks something, or holds something unknown or of another type, is refused before any job starts."""
    if task not in TASKS:
        raise PayloadError(f"unknown task {task}; there are {', '.join(TASKS)}")
    if not isinstance(payload, dict):
        raise PayloadError("a payload is a JSON object")
    known = TASKS[task].needs | TASKS[task].takes
    wrong = [f"{k} is missing" for k in TASKS[task].needs if payload.get(k) in (None, "", [])]
    wrong += [f"{k} is unknown" for k in payload if k not in known]
    wrong += [f"{k} must be {known[k].__name__}" for k, v in payload.items() if k in known and v is not None and (not isinstance(v, known[k]) or isinstance(v, bool) and known[k] is not bool)]
    if wrong:
        raise PayloadError(f"{task}: {'; '.join(wrong)}")
    return TASKS[task].run(spark, {k: v for k, v in payload.items() if v is not None})
