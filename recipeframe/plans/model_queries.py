"""Queries over models, run tables, graphs and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.functions.shared import materialize
from recipeframe.operators import byte_views as B
from recipeframe.operators import graphs as G
from recipeframe.operators import metrics as E
from recipeframe.operators import model_selection as Y
from recipeframe.operators import models as M
from recipeframe.operators import runs as N
from recipeframe.plans.recipe_queries import rounded
from recipeframe.plans.registry import query, table

_LINES = ["l_quantity", "l_discount"]


@query("m21_ridge", """WITH m AS (SELECT covar_samp(l_quantity, l_quantity) AS qq, covar_samp(l_quantity, l_discount) AS qd, covar_samp(l_discount, l_discount) AS dd, covar_samp(l_quantity, l_extendedprice) AS qy, covar_samp(l_discount, l_extendedprice) AS dy, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_extendedprice) AS y FROM lineitem),
    w AS (SELECT *, (dd * qy - qd * dy) / (qq * dd - qd * qd) AS wq, (qq * dy - qd * qy) / (qq * dd - qd * qd) AS wd FROM m) SELECT 'l_quantity' AS feature, round(wq, 3) AS weight FROM w UNION ALL SELECT 'l_discount', round(wd, 3) FROM w UNION ALL SELECT 'intercept', round(y - wq * q - wd * d, 3) FROM w""")
def _(s, d):
    b, w = M.ridge(table(s, d, "lineitem"), _LINES, "l_extendedprice")
    return s.createDataFrame([(n, round(float(x), 3)) for n, x in [*zip(_LINES, w, strict=True), ("intercept", b)]], "feature string, weight double")


_ONE = "SELECT '{0}' AS feature, covar_samp({0}, l_extendedprice) / var_samp({0}) AS w, abs(corr({0}, l_extendedprice)) AS c FROM lineitem"


@query("m24_matching_pursuit", f"SELECT feature, round(w, 3) AS weight FROM ({_ONE.format('l_quantity')} UNION ALL {_ONE.format('l_discount')}) ORDER BY c DESC LIMIT 1")
def _(s, d):
    w = M.matching_pursuit(table(s, d, "lineitem"), _LINES, "l_extendedprice", 1)
    return s.createDataFrame([(k, round(x, 3)) for k, x in w.items()], "feature string, weight double")


def _coordinates(s, d):
    """``vec_id, label`` and a column for each dimension of the embeddings, and the columns' names."""
    e = table(s, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    names = [f"x{i}" for i in range(size)]
    return e.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query("m15_linear_discriminant")
def _(s, d):
    e, names = _coordinates(s, d)
    return e.select("vec_id", M.discriminant(e, names, "label").alias("prediction"))


@query("m15_quadratic_discriminant")
def _(s, d):
    e, names = _coordinates(s, d)
    return e.select("vec_id", M.discriminant(e, names[:12], "label", quadratic=True).alias("prediction"))


@query("m18_ridge_classifier")
def _(s, d):
    e, names = _coordinates(s, d)
    return e.select("vec_id", M.ridge_classifier(e, names, "label").alias("prediction"))


@query("m25_quantile_regression")
def _(s, d):
    b, w = M.quantile_regression(table(s, d, "lineitem"), _LINES, "l_extendedprice")
    return s.createDataFrame([(b, float(w[0]), float(w[1]))], "intercept double, l_quantity double, l_discount double")


def _vectors(s, d):
    e, names = _coordinates(s, d)
    return E.stratified_folds(M.assemble(e, names, "label"), "label", "vec_id", 3)


def _classes(s, d):
    e, names = _coordinates(s, d)
    return M.assemble(e, names, "label").select("vec_id", "label", "features")


@query("m02_plain_split", "SELECT count(*) AS rows, CAST(greatest(least(round(count(*) * 0.25), count(*) - 1), 1) AS BIGINT) AS test_rows FROM orders")
def _(s, d):
    split = E.plain_split(table(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return split.agg(F.count("*").alias("rows"), F.count_if("is_test").alias("test_rows"))


@query("m06_selection")
def _(s, d):
    return Y.select_model(_classes(s, d), M.CLASSIFIERS["dt"], "vec_id").metrics


def _two_classes(s, d):
    """Odd and even labels."""
    return _classes(s, d).withColumn("label", F.col("label") % 2)


def _plain(names):
    return {k: M.Spec(M.CLASSIFIERS[k].make, {}, M.CLASSIFIERS[k].scaling) for k in names}


@query("m07_suite")
def _(s, d):
    return Y.run_suite(_two_classes(s, d), _plain(("dt", "gnb", "bnb")), "vec_id", folds=2)[0]


@query("m19_perceptron")
def _(s, d):
    df = _two_classes(s, d)
    spec = M.perceptron(len(df.select("features").first()[0]), 2, ((8,),))
    return M.pipeline(spec, M.candidates(spec.grid)[0]).fit(df).transform(df).select("vec_id", "prediction")


@query("m07_regression_suite")
def _(s, d):
    o = table(s, d, "lineitem").withColumn("row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    df = M.assemble(o, [*_LINES, "l_tax"], "l_extendedprice").select("row", "features", F.col("l_extendedprice").alias("label"))
    return Y.run_suite(df, {k: M.REGRESSORS[k] for k in ("linear", "huber", "decision_tree")}, "row", "regression", folds=2)[0]


@query("m08_multi_output")
def _(s, d):
    o = table(s, d, "lineitem").withColumn("row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    df = M.assemble(o, _LINES).select("row", "features", "l_extendedprice", "l_tax")
    return Y.multi_output(df, M.REGRESSORS["linear"], "row", ["l_extendedprice", "l_tax"], folds=2)[0]


@query("m09_predictions")
def _(s, d):
    return Y.select_model(_classes(s, d), M.CLASSIFIERS["gnb"], "vec_id", folds=2).predictions


@query("m06_m11_grid_search_tree")
def _(s, d):
    return M.grid_search(_vectors(s, d), M.CLASSIFIERS["dt"], "fold")


@query("m17_logistic_regression")
def _(s, d):
    df = _vectors(s, d)
    model = M.pipeline(M.CLASSIFIERS["sgd"], {"regParam": 0.01}).fit(df.filter("fold > 0"))
    return E.classification_metrics(model.transform(df.filter("fold = 0")))


@query("m27_kmeans_search")
def _(s, d):
    return M.cluster_search(_vectors(s, d), M.Spec(M.K.KMeans, {"k": [2, 3]}, "standard"), 2)


@query("m20_nearest_neighbours", """WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query, v.label, v.vec_id, row_number() OVER (PARTITION BY query ORDER BY list_sum(list_transform(list_zip(q.e, v.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), v.vec_id) AS r FROM q JOIN embeddings v ON v.vec_id <> query),
    n AS (SELECT query, label, count(*) AS n FROM d WHERE r <= 5 GROUP BY 1, 2), o AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY n DESC, label) AS k FROM n) SELECT query, label AS prediction FROM o WHERE k = 1""")
def _(s, d):
    e = table(s, d, "embeddings")
    return M.nearest_neighbours(e, e.filter("vec_id % 50 = 0"), "embedding", "label", "vec_id")


_DISTANCE_SQL = {
    "manhattan": "sum(abs(a - b))", "chebyshev": "max(abs(a - b))", "canberra": "sum(CASE WHEN abs(a) + abs(b) > 0 THEN abs(a - b) / (abs(a) + abs(b)) ELSE 0 END)",
}


def _distance_query(metric, sql):
    rows = "(SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"
    near = f"SELECT q.vec_id AS query, v.vec_id AS id, v.label, {sql} AS d FROM (SELECT vec_id, i, x AS a FROM {rows} WHERE vec_id % 50 = 0) q JOIN (SELECT vec_id, label, i, x AS b FROM {rows}) v ON q.i = v.i AND q.vec_id <> v.vec_id GROUP BY 1, 2, 3"

    @query(f"m20_{metric}", f"SELECT query, id, CAST(r AS INT) AS r, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS r FROM ({near})) WHERE r <= 5")
    def build(s, d):
        e = table(s, d, "embeddings")
        return rounded(M.neighbours(e, e.filter("vec_id % 50 = 0"), "embedding", "label", "vec_id", 5, metric).select("query", "id", "r", "d"))


for _metric, _sql in _DISTANCE_SQL.items():
    _distance_query(_metric, _sql)


@query("m20_weighted_regression")
def _(s, d):
    e = table(s, d, "embeddings")
    return M.nearest_neighbours(e, e.filter("vec_id % 50 = 0"), "embedding", "label", "vec_id", weights="distance", task="regression")


@query("m27_mini_batch_kmeans")
def _(s, d):
    centers = M.mini_batch_kmeans(table(s, d, "embeddings"), "embedding", "vec_id", 4)
    return s.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, centre array<double>")


@query("m28_gaussian_mixture")
def _(s, d):
    model = M.pipeline(M.CLUSTERERS["gmm"], {"k": 2, "seed": 42, "maxIter": 20}).fit(_classes(s, d))
    return model.transform(_classes(s, d)).select("vec_id", "prediction")


@query("m30_dbscan")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return M.dbscan(e, "x", "y", "vec_id", 0.02, 4)


@query("r01_pca")
def _(s, d):
    out, share = M.principal_components(table(s, d, "embeddings"), "embedding", 3)
    return out.select("vec_id", "components", F.lit(float(sum(share))).alias("explained"))


@query("g03_correlated_gaussian")
def _(s, d):
    return M.synthetic_gaussian(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], 1000)


# ---- run tables

_TRIALS = "(SELECT event_id, CASE WHEN event_id % 6 > 0 THEN value END AS objective FROM events)"


@query("o03_best_so_far", f"SELECT event_id, objective, min(objective) OVER (ORDER BY event_id) AS best FROM {_TRIALS} WHERE objective IS NOT NULL")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 6 > 0, F.col("value")).alias("objective"))
    return N.best_so_far(e, "event_id", "objective")


_RESULT = "CASE event_id % 5 WHEN 0 THEN '{\"loss\":\"none\"}' WHEN 1 THEN '{\"loss\":NaN,\"acc\":' || (event_id % 10) || '}' ELSE '{\"loss\":' || (event_id % 100) || ',\"acc\":' || (event_id % 10) || '}' END"


def _results(s, d):
    return table(s, d, "events").select("event_id", "user_id", F.expr(_RESULT.replace('\\"', '"')).alias("result"))


@query("o01_run_metrics", "SELECT event_id, 'loss' AS metric, CAST(event_id % 100 AS DOUBLE) AS value FROM events WHERE event_id % 5 > 1 UNION ALL SELECT event_id, 'acc', event_id % 10 FROM events WHERE event_id % 5 > 1")
def _(s, d):
    r = _results(s, d).filter("event_id % 5 <> 1")
    return N.extract_metrics(r, "event_id", "result", {"loss": "$.loss", "acc": "$.acc"})


@query("o02_run_comparison", "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN user_id END AS cohort, event_id % 7 > 0 AND count(*) OVER (PARTITION BY CASE WHEN event_id % 7 > 0 THEN user_id END) > 1 AS comparable, CASE WHEN event_id % 5 > 1 THEN CAST(event_id % 100 AS DOUBLE) END AS loss, CASE WHEN event_id % 5 > 1 THEN CAST(event_id % 10 AS DOUBLE) END AS acc FROM events WHERE event_id % 5 <> 1")
def _(s, d):
    r = _results(s, d).filter("event_id % 5 <> 1").withColumn("cohort", F.when(F.col("event_id") % 7 > 0, F.col("user_id")))
    return N.compare_runs(r, "event_id", ["cohort"], N.extract_metrics(r, "event_id", "result", {"loss": "$.loss", "acc": "$.acc"}), ["loss", "acc"])


@query("o08_weighted_fitness", "SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -2 * l_quantity ELSE l_quantity END), 6) AS fitness FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1")
def _(s, d):
    return rounded(N.weighted_fitness(table(s, d, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_quantity"), {"R": (2.0, False), "A": (1.0, True)}))


# ---- graphs: parts bought together are linked

_EDGE = "(SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey)"
_SEED = "(SELECT min(l_partkey) AS node FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) UNION SELECT max(l_partkey) FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem))"


def _edges(s, d):
    x = table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = x.alias("a"), x.alias("b")
    return materialize(a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") != F.col("b.l_partkey"))).select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).distinct(), "edges")


def _first_order(s, d):
    """The parts of the first order: the least and the largest."""
    lines = table(s, d, "lineitem")
    least = lines.agg(F.min("l_orderkey")).first()[0]
    return sorted({*lines.filter(F.col("l_orderkey") == least).agg(F.min("l_partkey"), F.max("l_partkey")).first()})


@query("k01_is_clique", f"SELECT (SELECT count(*) FROM {_EDGE} WHERE src IN (SELECT node FROM {_SEED}) AND dst IN (SELECT node FROM {_SEED})) = (SELECT count(*) * (count(*) - 1) FROM {_SEED}) AS is_clique, (SELECT count(*) FROM {_EDGE} WHERE src IN (0, 1, 2) AND dst IN (0, 1, 2)) = 6 AS first_parts")
def _(s, d):
    e = _edges(s, d)
    one = G.is_clique(e, _first_order(s, d)).withColumn("k", F.lit(1))
    return one.join(G.is_clique(e, [0, 1, 2]).select(F.col("is_clique").alias("first_parts"), F.lit(1).alias("k")), "k").drop("k")


@query("k02_valid_additions", f"SELECT dst AS node FROM {_EDGE} WHERE src IN (SELECT node FROM {_SEED}) AND dst NOT IN (SELECT node FROM {_SEED}) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM {_SEED})")
def _(s, d):
    return G.valid_additions(_edges(s, d), _first_order(s, d))


@query("k03_greedy_clique", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGE}), g AS MATERIALIZED (SELECT src AS node, count(*) AS degree, list(dst) AS near FROM e GROUP BY 1),
    c AS (
        SELECT 1 AS place, node, [node] AS members, near AS left_ FROM (SELECT * FROM g ORDER BY degree DESC, node LIMIT 1)
        UNION ALL SELECT place + 1, x.node, list_append(members, x.node), list_intersect(left_, x.near) FROM (SELECT c.place, c.members, c.left_, arg_min(g.node, g.degree * -1000000 + g.node) AS pick FROM c JOIN g ON list_contains(c.left_, g.node) GROUP BY 1, 2, 3) t JOIN g x ON x.node = t.pick
    ) SELECT CAST(place AS INT) AS place, node FROM c""")
def _(s, d):
    return G.greedy_clique(_edges(s, d))


# ---- bytes


@query("s02_fingerprint", "SELECT page_id, sha256(html) AS sha FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))


_BYTE = "CAST('0x' || substring(rpad(hex(encode(html)), {size}, '0'), {at} + 1, 2) AS INT)"


@query("b01_rgb_cells", "SELECT page_id, CAST(i AS INT) AS cell, " + ", ".join(_BYTE.format(size=384, at=f"2 * (3 * i + {k})") + f" AS {c}" for k, c in enumerate("rgb")) + " FROM pages, range(64) t(i)")
def _(s, d):
    p = table(s, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return B.rgb_cells(p, "page_id", "content", 64)


@query("b02_patch_tokens", "SELECT page_id, CAST(i AS INT) AS patch, [" + ", ".join("round(" + _BYTE.format(size=512, at=f"2 * (16 * i + {k})") + " / 255, 6)" for k in range(16)) + "] AS token FROM pages, range(16) t(i)")
def _(s, d):
    p = table(s, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return B.patch_tokens(p, "page_id", "content", 16, 16).withColumn("token", F.transform("token", lambda v: F.round(v, 6)))


@query("s13_s14_table_page", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE '%build%' ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25")
def _(s, d):
    from recipeframe.sources.delimited import table_page

    c = table(s, d, "customer")
    return table_page(c, 2, 25, filters={"c_mktsegment": "BUILD"}, sort="c_acctbal", descending=True, order="c_custkey").select("c_custkey")


@query("a08_union_aligned", "SELECT n_name AS name, n_regionkey AS region, NULL AS size FROM nation UNION ALL SELECT p_name, NULL, p_size FROM part")
def _(s, d):
    a = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("size")), allowMissingColumns=True)
