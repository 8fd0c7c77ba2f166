"""Queries over further clusterings, representations, synthetic rows and searches.

``embeddings`` are points; where a plane is asked for, it is that of the first
two coordinates. Queries of distances are the rows whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from recipeframe.operators import clusterings as K
from recipeframe.operators import models as M
from recipeframe.operators import representations as R
from recipeframe.operators import search as S
from recipeframe.plans.metric_queries import _AGREE, _RUNS, _runs
from recipeframe.plans.model_queries import _vectors
from recipeframe.plans.recipe_queries import round_signed, rounded
from recipeframe.plans.registry import query, table

_CUT = 0.05


def _plane(s, d):
    return table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _asked(s, d):
    return table(s, d, "embeddings").filter("vec_id % 100 = 0")


@query("m13_adaboost")
def _(s, d):
    v = _vectors(s, d)
    _, predict = S.boosted_trees(v, "label", 4, 3)
    return predict(v).groupBy("label", "boosted").agg(F.count("*").alias("n"))


@query("m26_linear_svr")
def _(s, d):
    names = ["l_quantity", "l_discount"]
    b, w = S.support_vector_regression(table(s, d, "lineitem"), names, "l_extendedprice")
    return s.createDataFrame([*zip(names, map(float, w), strict=True), ("intercept", float(b))], "feature string, weight double")


@query("m29_spectral")
def _(s, d):
    return K.spectral(_plane(s, d), "x", "y", "vec_id", 0.3, 3).select(F.col("id").alias("vec_id"), "cluster")


@query("m31_micro_clusters")
def _(s, d):
    return K.micro_clusters(_vectors(s, d), "features", 4, 24).select("vec_id", "cluster")


_D2 = "pow(CAST(a.embedding[1] AS DOUBLE) - CAST(b.embedding[1] AS DOUBLE), 2) + pow(CAST(a.embedding[2] AS DOUBLE) - CAST(b.embedding[2] AS DOUBLE), 2)"


@query("m32_single_linkage", f"WITH RECURSIVE e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON {_D2} <= {_CUT} * {_CUT}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS vec_id, min(b) AS cluster FROM r GROUP BY 1")
def _(s, d):
    return K.single_linkage(_plane(s, d), "x", "y", "vec_id", _CUT).select(F.col("id").alias("vec_id"), "cluster")


@query("m33_cluster_selection")
def _(s, d):
    return K.select_clustering(_vectors(s, d), {n: M.Spec(M.CLUSTERERS[n].make, {"k": [2, 3]}, "standard") for n in ("kmeans", "bisecting")}, "vec_id")


@query("m45_agreement_matrix", _AGREE + f" SELECT l AS \"left\", r AS \"right\", round(ari, 6) AS ari FROM (SELECT l, r, ari FROM ag UNION ALL SELECT r, l, ari FROM ag UNION ALL SELECT DISTINCT run, run, 1.0 FROM {_RUNS})")
def _(s, d):
    wide = K.agreement_matrix(_runs(s, d))
    names = wide.columns[1:]
    kind = dict(_runs(s, d).dtypes)["run"]
    long = wide.unpivot(["left"], [F.col(f"`{n}`") for n in names], "right", "ari")
    return rounded(long.select("left", F.col("right").cast(kind).alias("right"), "ari"))


@query("r02_reconstruction")
def _(s, d):
    return R.restoration_error(R.pca_restored(table(s, d, "embeddings"), "embedding", 4), "embedding")


@query("r03_truncated_svd")
def _(s, d):
    out, values = R.truncated_svd(table(s, d, "embeddings"), "embedding", 3)
    return out.select("vec_id", "components", F.array(*[F.lit(v) for v in values]).alias("singular_values"))


def _squares(s, d):
    return table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x).alias("squares"))


@query("r04_nonnegative_factors")
def _(s, d):
    return R.factorise_nonnegative(_squares(s, d), "squares", "vec_id", 3).select("vec_id", "components")


@query("r05_compare_representations")
def _(s, d):
    return R.compare_representations(_squares(s, d), "squares", "vec_id", 3)


_HALF = "list_sum(list_transform(list_zip(a.embedding[1:{n}], b.embedding[1:{n}]), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
_PAIRS = f"p AS (SELECT a.vec_id AS q, b.vec_id AS id, {_HALF.format(n=100000)} AS da, {_HALF.format(n=8)} AS db FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


def _latent(df):
    return df.withColumn("latent", F.slice("embedding", 1, 8))


@query("r06_distance_ranks", f"WITH {_PAIRS}, r AS (SELECT rank() OVER (ORDER BY da) + (count(*) OVER (PARTITION BY da) - 1) / 2 AS ra, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2 AS rb FROM p) SELECT round(corr(ra, rb), 6) AS spearman FROM r")
def _(s, d):
    return rounded(R.rank_agreement(_latent(table(s, d, "embeddings")), _latent(_asked(s, d)), "vec_id", "embedding", "latent"))


@query("r07_trustworthiness", f"WITH {_PAIRS}, r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY da, id) AS ra, row_number() OVER (PARTITION BY q ORDER BY db, id) AS rb FROM p), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 100 = 0) AS m FROM embeddings) SELECT round(1 - 2.0 / (max(m) * 5 * (2 * max(n) - 16)) * sum(greatest(ra - 5, 0)), 6) AS trustworthiness FROM r, c WHERE rb <= 5")
def _(s, d):
    return rounded(R.trustworthiness(_latent(table(s, d, "embeddings")), _latent(_asked(s, d)), "vec_id", "embedding", "latent"))


@query("r08_tokens", "SELECT vec_id, CAST(t AS INT) AS token, list_transform(range(7), lambda i: coalesce(round(CAST(embedding[7 * t + i + 1] AS DOUBLE), 6), 0.0)) AS \"values\", list_transform(range(7), lambda i: CAST(7 * t + i < len(embedding) AS INT)) AS mask FROM (SELECT vec_id, embedding, unnest(range((len(embedding) + 6) // 7)) AS t FROM embeddings)")
def _(s, d):
    return R.tokens(table(s, d, "embeddings"), "embedding", "vec_id", 7).withColumn("values", F.transform("values", lambda x: F.coalesce(round_signed(x), F.lit(0.0))))


@query("r08_tokens_restored", "SELECT vec_id, true AS same FROM embeddings")
def _(s, d):
    e = table(s, d, "embeddings")
    back = R.from_tokens(R.tokens(e, "embedding", "vec_id", 7), "vec_id")
    return e.join(back, "vec_id").select("vec_id", (F.transform("embedding", lambda x: x.cast("double")) == F.col("vector")).alias("same"))


@query("g01_bootstrap", "SELECT count(*) AS rows, true AS known FROM orders")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    drawn = R.bootstrap(o, ["o_orderkey"], o.count())
    known = drawn.join(o.withColumn("k", F.lit(True)), "o_orderkey", "left")
    return known.agg(F.count("*").alias("rows"), F.bool_and(F.coalesce("k", F.lit(False))).alias("known"))


@query("g04_student_rows")
def _(s, d):
    o = table(s, d, "lineitem")
    return R.student_rows(o, ["l_quantity", "l_extendedprice"], o.count())


@query("o04_history_points", "WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, round(value, 6) AS value FROM r WHERE n <= 500 OR k IN (SELECT (i * (n - 1)) // 499 FROM range(500) t(i), (SELECT count(*) AS n FROM events))")
def _(s, d):
    return rounded(S.history_points(table(s, d, "events").select("event_id", "value"), "event_id"))


@query("o05_cohort_report", "SELECT user_id, count(*) AS runs, count(DISTINCT event_type) > 1 AS suppressed, CASE WHEN count(DISTINCT event_type) = 1 THEN round(avg(value), 6) END AS mean, CASE WHEN count(DISTINCT event_type) = 1 THEN round(min(value), 6) END AS best FROM events GROUP BY 1")
def _(s, d):
    return rounded(S.cohort_report(table(s, d, "events"), ["user_id"], ["event_type"], "value"))


_SPACE = [S.Parameter("rate", "log", 1e-3, 10.0), S.Parameter("depth", "integer", 1, 8), S.Parameter("leaves", "integer_log", 1, 64), S.Parameter("share", "continuous", 0.0, 1.0), S.Parameter("loss", "categorical", values=("squared", "huber"))]


@query("o06_search_space", "SELECT count(*) AS candidates, true AS inside FROM orders")
def _(s, d):
    c = S.candidate_table(s, _SPACE, table(s, d, "orders").count())
    inside = "rate BETWEEN 0.001 AND 10 AND depth BETWEEN 1 AND 8 AND leaves BETWEEN 1 AND 64 AND share BETWEEN 0 AND 1 AND loss IN ('squared', 'huber')"
    return c.agg(F.count("*").alias("candidates"), F.bool_and(F.expr(inside)).alias("inside"))


@query("o07_random_search")
def _(s, d):
    rows = M.assemble(table(s, d, "lineitem").withColumn("label", F.col("l_extendedprice")), ["l_quantity", "l_discount"], "label")
    judge = RegressionEvaluator(metricName="rmse")
    fit = lambda p: judge.evaluate(M.REGRESSORS["ridge"].make(regParam=p["rate"]).fit(rows).transform(rows))
    return S.random_search(s, _SPACE[:1], fit, 4)
