"""Selections and rules, ranks, and the models that SQL can't express."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from recipeframe.functions.ranks import numbered, running_sum
from recipeframe.operators import clusterings as K
from recipeframe.operators import representations as R
from recipeframe.operators import search as S
from recipeframe.operators import xml_selection as Z
from recipeframe.sources.xml import shred_documents


def test_rules():
    assert Z.rule_errors({"strategy": "join", "delimiter": ";"}) == [] and Z.rule_errors({"strategy": "aggregate", "function": "sum"}) == []
    assert Z.rule_errors({"strategy": "join"}) and Z.rule_errors({"strategy": "aggregate", "function": "mode"}) and Z.rule_errors({"strategy": "other"}) and Z.rule_errors({"strategy": "first", "key": "a"})


def test_unique_names_and_signature():
    assert Z.unique_names(["a", "b", "a", "a", "a__2"]) == ["a", "b", "a__2", "a__3", "a__2__2"]
    one = Z.signature("s", "/r", {"a": "text:/r/a", "b": "text:/r/b"})
    assert one == Z.signature("s", "/r", {"b": "text:/r/b", "a": "text:/r/a"}) != Z.signature("s", "/r", {"a": "text:/r/a"})


def test_align_columns_refuses_conflicts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        Z.align_columns([(df, {"a": "x", "b": "x"})])
    with pytest.raises(ValueError):
        Z.align_columns([(df.select("a"), {"a": "x"}), (df.select("a"), {"a": "y"})])


def test_nested_branches(spark):
    x = "<r><p i='1'><g><m>1</m><m>2</m></g><g><m>3</m></g></p><p i='2'><g><m>4</m></g><t>a<b/>c</t></p></r>"
    nodes = shred_documents(spark.createDataFrame([("s", bytearray(x.encode()))], "source_file string, content binary"))
    plan = Z.collection_plan(nodes, "/r/p", ["text:/r/p/g/m", "attribute:/r/p@i"]).collect()
    assert {(r["branch"], r["parent"], r["fields"], r["resolved"]) for r in plan} == {("/r/p/g", None, 1, False), ("/r/p/g/m", "/r/p/g", 1, False)}
    fields = {r["field"]: (r["repeated"], r["optional"]) for r in Z.selectable_fields(nodes, "/r/p").collect()}
    assert fields == {"attribute:/r/p@i": (False, False), "text:/r/p/g/m": (True, False), "text:/r/p/t/b": (False, True)}


def test_groups_in_path_order(spark):
    docs = {"a": "<r><x/><y/></r>", "b": "<r><x/><y/><z/></r>", "c": "<q><w/></q>", "d": "<r><x/><y/></r>"}
    nodes = shred_documents(spark.createDataFrame([(k, bytearray(v.encode())) for k, v in docs.items()], "source_file string, content binary"))
    got = {r["source_file"]: r["group"] for r in Z.complete_link_groups(nodes).collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 1}


def test_running_sums(spark):
    rows = [(i, (i * 7) % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    got = {r["k"]: r["s"] for r in running_sum(df, ["k"], F.col("v"), "s").collect()}
    assert got == {i: sum(v for _, v in rows[: i + 1]) for i in range(200)}
    assert [r["number"] for r in numbered(df, [F.desc("k")]).orderBy(F.desc("k")).collect()] == list(range(1, 201))
    assert numbered(df.limit(0), ["k"]).count() == 0


def _points(n=120):
    rng = np.random.default_rng(3)
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(n, 2)) * 0.2 + (np.arange(n)[:, None] % 3) * 3)]


def test_single_linkage_against_brute_force(spark):
    points = [*_points(), (900, 0.0, 0.0), (901, 0.0, 0.0), (902, None, 1.0), (903, 50.0, 50.0)]
    cut = 0.25
    got = {r["id"]: r["cluster"] for r in K.single_linkage(spark.createDataFrame(points, "id long, x double, y double"), "x", "y", "id", cut).collect()}
    known = {i: (x, y) for i, x, y in points if x is not None}
    want = {i: i for i in known}
    for _ in known:
        new = {i: min(want[j] for j in known if math.dist(known[i], known[j]) <= cut) for i in known}
        if new == want:
            break
        want = new
    assert got == want


def test_micro_clusters_find_far_groups(spark):
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(_points(), "id long, x double, y double"))
    got = K.micro_clusters(df, "features", 3, 12).select("id", "cluster").collect()
    assert len({(r["id"] % 3, r["cluster"]) for r in got}) == 3


def test_spectral_keeps_far_groups_apart(spark):
    df = spark.createDataFrame(_points(60), "id long, x double, y double")
    got = K.spectral(df, "x", "y", "id", 1.0, 3).collect()
    assert len(got) == 60 and all(r["cluster"] in (-1, 0, 1, 2) for r in got)


def test_boosting_beats_one_stump(spark):
    df = spark.createDataFrame([(float(i), float(40 <= i < 80)) for i in range(120)], "x double, label double")
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    stages, predict = S.boosted_trees(df, "label", 12, 1)
    right = predict(df).filter("boosted = label").count()
    assert len(stages) > 1 and right >= 114


def test_support_vector_regression_ignores_an_outlier(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(100)] + [(50.0, 4000.0)], "x double, y double")
    b, w = S.support_vector_regression(df, ["x"], "y", 0.01, rounds=150)
    assert abs(w[0] - 3) < 0.35 and abs(b + w[0] * 50 - 151) < 25


def test_search_space_and_failures(spark):
    space = [S.Parameter("a", "integer", 1, 3), S.Parameter("b", "log", 0.01, 1.0)]
    a = S.candidate_table(spark, space, 50).orderBy("candidate").collect()
    assert a == S.candidate_table(spark, space, 50).repartition(7).orderBy("candidate").collect() and {r["a"] for r in a} == {1, 2, 3}

    def fitness(p):
        if p["a"] == 2:
            raise RuntimeError("no")
        return p["b"]

    out = S.random_search(spark, space, fitness, 20).collect()
    assert sum(r["best"] for r in out) == 1 and all(r["failed"] == (r["a"] == 2) for r in out)
    assert next(r["b"] for r in out if r["best"]) == min(r["b"] for r in out if not r["failed"])


def test_representations_against_numpy(spark):
    x = np.abs(np.random.default_rng(1).normal(size=(60, 6)))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    u, sv, vt = np.linalg.svd(x, full_matrices=False)
    out, values = R.truncated_svd(df, "v", 2)
    assert np.allclose(values, sv[:2])
    assert math.isclose(R.restoration_error(out, "v").first()["mse"], float(((x - (u[:, :2] * sv[:2]) @ vt[:2]) ** 2).mean()), rel_tol=1e-6)
    c = x - x.mean(0)
    u, sv, vt = np.linalg.svd(c, full_matrices=False)
    assert math.isclose(R.restoration_error(R.pca_restored(df, "v", 3), "v").first()["mse"], float((sv[3:] ** 2).sum() / x.size), rel_tol=1e-6)
    rows = {r["method"]: r for r in R.compare_representations(df, "v", "id", 3).collect()}
    assert rows["nmf"]["error"] is None and rows["svd"]["mse"] <= rows["nmf"]["mse"] + 1e-9


def test_student_rows_keep_the_mean(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(100)], "a double, b double")
    m = R.student_rows(df, ["a", "b"], 20_000).agg(F.avg("a").alias("a"), F.corr("a", "b").alias("c")).first()
    assert abs(m["a"] - 49.5) < 1.5 and m["c"] > 0.999
