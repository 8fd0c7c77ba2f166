"""Components, factors, linkages, discriminants, relationships and searches against numpy or plain loops."""

import math

import numpy as np
import pytest
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from recipeframe.operators import clusterings as K
from recipeframe.operators import models as M
from recipeframe.operators import profile as P
from recipeframe.operators import representations as R
from recipeframe.operators import search as S


def rows(spark, x, ids=None, kind="long"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in zip(ids, x, strict=True)], f"id {kind}, v array<double>")


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_components_equal_numpy(spark, offset):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 7)) @ np.diag([5, 3, 2, 1, 0.5, 0.2, 0.0]) + offset
    c = x - x.mean(0)
    _, sv, vt = np.linalg.svd(c, full_matrices=False)
    share = sv**2 / (sv**2).sum()
    df = rows(spark, x)
    for k, want in ((3, 3), (0.5, int(np.searchsorted(np.cumsum(share), 0.5, side="right")) + 1), (0.95, int(np.searchsorted(np.cumsum(share), 0.95, side="right")) + 1), (7, 7)):
        out, got = M.principal_components(df, "v", k)
        assert len(got) == want and np.allclose(got, share[:want], atol=1e-8)
        found = np.array([r["components"] for r in out.orderBy("id").collect()])
        w = vt[:want].T * np.where(vt[:want][range(want), np.abs(vt[:want]).argmax(1)] < 0, -1, 1)
        assert np.allclose(found[:, : min(want, 5)], (c @ w)[:, : min(want, 5)], atol=1e-7)
    for wrong in (0, 8, -1):
        with pytest.raises(ValueError):
            M.principal_components(df, "v", wrong)


def test_components_never_fail(spark):
    for seed in range(10):
        rng = np.random.default_rng(seed)
        x = np.repeat(rng.normal(size=(1, 30)), 40, axis=0) if seed < 2 else rng.integers(0, 2, (40, 30)) * (rng.random(30) < 0.3)
        out, share = M.principal_components(rows(spark, x), "v", 3)
        assert out.count() == 40 and all(math.isfinite(s) for s in share)
    with pytest.raises(ValueError):
        M.principal_components(rows(spark, x).limit(0), "v", 1)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_factors_of_any_key_and_not_worse_than_alternating_least_squares(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.random((60, 3)) @ rng.random((3, 9)) + rng.random((60, 9)) * 0.1
    ids = [2**40 + i if kind == "long" else f"row {i}" for i in range(60)]
    df = rows(spark, x, ids, kind)
    out = R.factorise_nonnegative(df, "v", "id", 3).collect()
    assert {r["id"] for r in out} == set(ids) and all(min(r["components"]) >= 0 for r in out)
    error = sum(((np.array(r["v"]) - np.array(r["restored"])) ** 2).sum() for r in out)
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(9)], "row int, cell int, value double")
    model = ALS(rank=3, maxIter=5, regParam=1e-3, nonnegative=True, userCol="row", itemCol="cell", ratingCol="value", seed=42).fit(cells)
    als = model.transform(cells).agg(F.sum((F.col("value") - F.col("prediction")) ** 2)).first()[0]
    assert error <= als * 1.001
    with pytest.raises(ValueError):
        R.factorise_nonnegative(rows(spark, -x), "v", "id", 2)
    assert R.factorise_nonnegative(df.limit(0), "v", "id", 2).count() == 0


@pytest.mark.parametrize("linkage", list(K.LINKAGES))
def test_linkages_equal_brute_force(linkage):
    """Groups of weighted centres, as if each centre stood there as often as it weighs."""
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(14, 3)), rng.integers(1, 5, 14)

    def between(a, b):
        if linkage == "ward":
            ma, mb = (np.average(x[g], axis=0, weights=n[g]) for g in (a, b))
            na, nb = n[a].sum(), n[b].sum()
            return na * nb / (na + nb) * ((ma - mb) ** 2).sum()
        d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
        return {"complete": d.max, "single": d.min, "average": lambda: (d * n[a][:, None] * n[b][None]).sum() / (n[a].sum() * n[b].sum())}[linkage]()

    groups = [[i] for i in range(14)]
    for k in range(13, 0, -1):
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: between(groups[p[0]], groups[p[1]]))
        groups[j] = groups[j] + groups.pop(i)
        assert sorted(K.merged_centres(x, n, k, linkage)) == sorted(sorted(g) for g in groups), k
    with pytest.raises(ValueError):
        K.merged_centres(x, n, 2, "median")


def test_quadratic_discriminant_equals_numpy(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 20)) * (1 + 0.4 * y[:, None]) + y[:, None] * 0.5
    names = [f"x{i}" for i in range(20)]
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, y int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["prediction"] for r in M.quadratic_discriminant(df, df, names, "y", ["id"]).collect()}
    score = []
    for c in range(3):
        own = x[y == c]
        cov = np.cov(own.T)
        d = x - own.mean(0)
        score.append(np.log(len(own) / 300) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert [got[i] for i in range(300)] == np.argmax(score, axis=0).tolist()


def test_all_pairs_of_columns_equal_the_single_ones(spark):
    rng = np.random.default_rng(6)
    data = [tuple(None if rng.random() < 0.1 else str(rng.integers(0, 2 + k)) for k in range(20)) for _ in range(200)]
    df = spark.createDataFrame(data, ", ".join(f"c{k} string" for k in range(20)))
    found = {(r["left"], r["right"]): r for r in P.pairwise_information(df, df.columns).collect()}
    assert len(found) == 190
    for a, b in [("c0", "c1"), ("c3", "c17"), ("c18", "c19"), ("c2", "c9")]:
        one = P.mutual_information(df, a, b).first()
        assert math.isclose(one["mi"], found[a, b]["mi"], abs_tol=1e-9) and math.isclose(one["nmi"], found[a, b]["nmi"], abs_tol=1e-9)
        assert found[a, b]["n"] == df.filter(f"{a} IS NOT NULL AND {b} IS NOT NULL").count()
    assert P.pairwise_information(df, ["c0"]).count() == 0


def test_distance_ranks_of_any_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6))
    df = rows(spark, x).withColumn("low", F.slice("v", 1, 2))
    asked = df.filter("id % 3 = 0")
    whole = R.rank_agreement(df, asked, "id", "v", "low").first()[0], R.trustworthiness(df, asked, "id", "v", "low").first()[0]
    monkeypatch.setattr(R, "MOST_QUERIES", 7)
    parts = R.rank_agreement(df, asked, "id", "v", "low").first()[0], R.trustworthiness(df, asked, "id", "v", "low").first()[0]
    assert np.allclose(whole, parts, atol=1e-12)
    over = 0
    d, low = (np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)) for y in (x, x[:, :2]))
    for q in range(0, 120, 3):
        order = [i for i in np.lexsort((np.arange(120), d[q])) if i != q]
        near = [i for i in np.lexsort((np.arange(120), low[q])) if i != q][:5]
        over += sum(max(0, order.index(i) + 1 - 5) for i in near)
    assert math.isclose(parts[1], 1 - 2 / (40 * 5 * (240 - 16)) * over, rel_tol=1e-12)


def test_search_by_several_terms(spark):
    space = [S.Parameter("x", "continuous", -2.0, 2.0)]
    weights = {"loss": (1.0, False), "gain": (0.5, True)}
    got = S.random_search(spark, space, lambda p: {"terms": {"loss": p["x"] ** 2, "gain": p["x"]}}, 12, weights=weights).collect()
    assert all(math.isclose(r["fitness"], r["terms"]["loss"] - 0.5 * r["terms"]["gain"], abs_tol=1e-12) for r in got)
    assert [r["best"] for r in got].count(True) == 1 and min(got, key=lambda r: r["fitness"])["best"]
    assert all(r["terms"] == {"objective": r["fitness"]} for r in S.random_search(spark, space, lambda p: p["x"], 3).collect())
    bad = S.random_search(spark, space, lambda p: {"terms": {"loss": 1.0}}, 3, weights=weights, worst=9.0).collect()
    assert all(r["failed"] and r["fitness"] == 9.0 and "gain" in r["error"] for r in bad)
    assert all(r["failed"] for r in S.random_search(spark, space, lambda p: S.Evaluation(1.0, {}, "out of memory"), 2).collect())
    with pytest.raises(ValueError):
        S.compose({"a": float("nan")}, {"a": (1.0, False)})


def test_every_registered_family_is_fitted_and_beats_chance(spark):
    from recipeframe.operators import model_selection as Y

    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 160)
    x = rng.normal(size=(160, 4)) + 1.6 * y[:, None] * np.array([1, 0, 1, 0])
    names = list("abcd")
    df = M.assemble(spark.createDataFrame([(i, float(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, label double, a double, b double, c double, d double"), names)
    first = lambda specs: {k: M.Spec(v.make, {n: g[:1] for n, g in v.grid.items()}, v.scaling) for k, v in specs.items()}
    table, found = Y.run_suite(df, first(M.CLASSIFIERS), "id", folds=2)
    rows = {r["estimator"]: r for r in table.collect()}
    assert set(rows) == set(M.CLASSIFIERS) and all(r["failed"] is None and r["score"] > 0.6 for r in rows.values()), rows
    table, found = Y.run_suite(df.withColumn("label", F.col("a") * 2 + F.col("c")), first(M.REGRESSORS), "id", "regression", folds=2)
    rows = {r["estimator"]: r for r in table.collect()}
    assert set(rows) == set(M.REGRESSORS) and all(r["failed"] is None and r["score"] < 2.2 for r in rows.values()), rows
