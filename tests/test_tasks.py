import pytest

from recipeframe.tasks import TASKS, PayloadError, execute_task

SF = "/root/testdata/sf0.001"


def test_payloads_are_checked_before_any_job(spark):
    for task, payload, said in (
        ("data.nothing", {}, "unknown task"), ("data.table", [], "JSON object"), ("data.table", {}, "path is missing"), ("data.table", {"path": "x", "pages": 1}, "pages is unknown"),
        ("data.table", {"path": "x", "page": "2"}, "page must be int"), ("data.table", {"path": "x", "page": True}, "page must be int"), ("data.compare", {"paths": ["a"]}, "two paths"),
        ("classification", {"path": f"{SF}/part.parquet", "features": ["p_size"], "target": "p_size", "estimators": ["x"]}, "unknown estimators"),
        ("data.table", {"path": f"{SF}/nation.parquet", "filters": {"nope": "a"}}, "no column nope"), ("data.table", {"path": f"{SF}/nation.parquet", "sort_direction": "up"}, "asc or desc"),
    ):
        with pytest.raises(PayloadError, match=said):
            execute_task(spark, task, payload)


def test_table_tasks(spark, tmp_path):
    nation = f"{SF}/nation.parquet"
    page = execute_task(spark, "data.table", {"path": nation, "page_size": 3, "sort_column": "n_name", "sort_direction": "desc", "filters": {"n_name": "an"}})["page"].collect()
    names = sorted((r["n_name"] for r in spark.read.parquet(nation).collect() if "an" in r["n_name"].lower()), reverse=True)
    assert [r["n_name"] for r in page] == names[:3]
    out = execute_task(spark, "data.profile", {"path": nation})
    assert out["columns"].count() == 3 and out["numeric"].count() == 2 and out["duplicates"].count() == 1
    both = execute_task(spark, "data.compare", {"paths": [nation, f"{SF}/region.parquet"]})
    assert both["pairs"].count() == 1 and both["summary"].first()["truncated"] is False
    recipe = [{"type": "select_columns", "columns": ["n_name", "n_regionkey"]}, {"type": "rename_columns", "mapping": {"n_name": "name"}}]
    seen = execute_task(spark, "data.transform.preview", {"path": nation, "recipe": recipe, "preview_rows": 4})
    assert seen["after"].columns == ["name", "n_regionkey"] and seen["before"].count() == 4 and seen["steps"].count() == 2
    target = str(tmp_path / "derived")
    assert execute_task(spark, "data.transform.apply", {"path": nation, "recipe": recipe, "output": target})["manifest"].first()["rows"] == 25
    assert spark.read.parquet(f"{target}/data").columns == ["name", "n_regionkey"]


def test_delimited_files_and_lineage(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;5\n2;4\n3;9\n")
    found = execute_task(spark, "data.inspect", {"path": str(tmp_path)})
    assert found["summary"].first()["files"] == 1 and found["files"].first()["delimiter"] == ";"
    page = execute_task(spark, "data.table", {"path": str(tmp_path / "a.csv"), "sort_column": "y"})["page"]
    assert [r["x"] for r in page.collect()] == ["2", "1", "3"]
    (tmp_path / "b.csv").write_bytes(b"\0\1")
    with pytest.raises(PayloadError, match="can't be read"):
        execute_task(spark, "data.table", {"path": str(tmp_path / "b.csv")})
    spark.createDataFrame([("e1", "s0", "s1"), ("e2", "s1", "s2"), ("e3", "s2", "s3")], "event string, source_sha string, derived_sha string").write.parquet(str(tmp_path / "events.parquet"))
    trace = execute_task(spark, "data.lineage", {"path": str(tmp_path / "events.parquet"), "events": ["e3"]})["trace"]
    assert [(r["step"], r["event"]) for r in trace.orderBy("step").collect()] == [(0, "e3"), (1, "e2"), (2, "e1")]


def test_model_tasks(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 11), float((i % 7) > 3), (i % 7) * 2.0 + (i % 11)) for i in range(160)]
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame(rows, "id long, a double, b double, kind double, y double").write.parquet(path)
    own = {"path": path, "features": ["a", "b"], "key": "id"}
    out = execute_task(spark, "classification", own | {"target": "kind", "estimators": ["dt"], "folds": 2})
    assert out["suite"].first()["score"] > 0.95 and out["dt.predictions"].count() > 0 and {"dt.candidates", "dt.metrics"} <= set(out)
    out = execute_task(spark, "regression", own | {"target": "y", "estimators": ["linear"], "folds": 2})
    assert out["suite"].first()["score"] < 0.01
    out = execute_task(spark, "clustering", own | {"estimators": ["kmeans"], "repeats": 1})
    assert out["candidates"].count() == 2 and out["candidates"].filter("best").count() == 1
    out = execute_task(spark, "representation", own | {"components": 2})
    assert {r["method"]: r["mse"] < 1e-12 for r in out["methods"].collect()} == {"pca": True, "svd": True}
    assert set(TASKS) >= {"data.inspect", "data.profile", "data.compare", "data.table", "data.lineage"}
