"""Queries over whole vectors: clusterings, linkages, components; and over all pairs of columns at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.operators import clusterings as K
from recipeframe.operators import models as M
from recipeframe.operators import profile as P
from recipeframe.operators import vector_clusters as V
from recipeframe.operators import model_selection as Y
from recipeframe.operators import search as S
from recipeframe.plans.model_queries import _LINES, _coordinates, _plain, _two_classes, _vectors
from recipeframe.plans.recipe_queries import rounded
from recipeframe.plans.registry import query, table

_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
_EPS, _LEAST, _CUTS = 1.15, 4, (1.05, 1.1, 1.15)


@query("m29_spectral_whole")
def _(s, d):
    return V.spectral_clusters(table(s, d, "embeddings"), "embedding", "vec_id", 3).select(F.col("id").alias("vec_id"), "cluster")


@query(
    "m30_dbscan_whole",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON {_D2} <= {_EPS} * {_EPS}), c AS MATERIALIZED (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= {_LEAST}),
    k AS MATERIALIZED (SELECT e.a, e.b FROM e JOIN c ON c.id = e.a JOIN c AS o ON o.id = e.b), r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a), l AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1),
    n AS (SELECT e.a AS id, min(l.cluster) AS cluster FROM e JOIN l ON l.id = e.b GROUP BY 1) SELECT vec_id, coalesce(l.cluster, n.cluster, -1) AS cluster FROM embeddings LEFT JOIN l ON l.id = vec_id LEFT JOIN n ON n.id = vec_id""",
)
def _(s, d):
    return V.density_clusters(table(s, d, "embeddings"), "embedding", "vec_id", _EPS, _LEAST).select(F.col("id").alias("vec_id"), "cluster")


@query(
    "m32_single_linkage_whole",
    f"""WITH RECURSIVE w AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {_D2} AS d FROM embeddings a JOIN embeddings b ON {_D2} <= {max(_CUTS)} * {max(_CUTS)}), cuts AS (SELECT unnest([{', '.join(map(str, _CUTS))}]) AS cut),
    e AS MATERIALIZED (SELECT cut, a, b FROM w JOIN cuts ON d <= cut * cut), r(cut, a, b) AS (SELECT cut, a, b FROM e UNION SELECT r.cut, r.a, e.b FROM r JOIN e ON r.b = e.a AND r.cut = e.cut) SELECT CAST(cut AS DOUBLE) AS cut, a AS vec_id, min(b) AS cluster FROM r GROUP BY 1, 2""",
)
def _(s, d):
    made = V.Linkage(table(s, d, "embeddings"), "embedding", "vec_id", max(_CUTS))  # one forest, three cuts
    parts = [made.cut(c).select(F.lit(c).alias("cut"), F.col("id").alias("vec_id"), "cluster") for c in _CUTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m31_linkages")
def _(s, d):
    v, out = _vectors(s, d), None
    for linkage in K.LINKAGES:
        part = K.micro_clusters(v, "features", 4, 24, linkage=linkage).groupBy("cluster").agg(F.count("*").alias("n")).select(F.lit(linkage).alias("linkage"), "cluster", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("r01_pca_share")
def _(s, d):
    """As many components as explain half of the variance."""
    out, share = M.principal_components(table(s, d, "embeddings"), "embedding", 0.5)
    return out.select("vec_id", "components", F.lit(len(share)).alias("n_components"), F.lit(float(sum(share))).alias("explained"))


_CELLS = """SELECT '{a}' AS l, '{b}' AS r, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS c FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"""
_USED = ("l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax")


@query(
    "q16_q17_all_pairs",
    "WITH j AS ("
    + " UNION ALL ".join(_CELLS.format(a=a, b=b) for i, a in enumerate(_USED) for b in _USED[i + 1 :])
    + """), t AS (SELECT l, r, sum(c) AS n FROM j GROUP BY 1, 2), x AS (SELECT l, r, a, sum(c) AS na FROM j GROUP BY 1, 2, 3), y AS (SELECT l, r, b, sum(c) AS nb FROM j GROUP BY 1, 2, 3),
    m AS (SELECT l, r, sum(c / n * ln(c * n / (na * nb))) AS mi FROM j JOIN x USING (l, r, a) JOIN y USING (l, r, b) JOIN t USING (l, r) GROUP BY 1, 2),
    hx AS (SELECT l, r, -sum(na / n * ln(na / n)) AS ha FROM x JOIN t USING (l, r) GROUP BY 1, 2), hy AS (SELECT l, r, -sum(nb / n * ln(nb / n)) AS hb FROM y JOIN t USING (l, r) GROUP BY 1, 2)
    SELECT l AS "left", r AS "right", CAST(n AS BIGINT) AS n, round(mi, 6) AS mi, round(mi / ((ha + hb) / 2), 6) AS nmi FROM m JOIN t USING (l, r) JOIN hx USING (l, r) JOIN hy USING (l, r)""",
)
def _(s, d):
    return rounded(P.pairwise_information(table(s, d, "lineitem"), list(_USED)))


# ---- families of the registries

@query("m12_m14_m16_classifiers")
def _(s, d):
    """Boosting, three kinds of naive Bayes and linear support vectors, by cross-validated accuracy."""
    return Y.run_suite(_two_classes(s, d), _plain(("hgbc", "mnb", "compnb", "bnb", "lsvc")), "vec_id", folds=2)[0]


@query("m23_regressors")
def _(s, d):
    o = table(s, d, "lineitem").withColumn("row", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"))
    df = M.assemble(o, [*_LINES, "l_tax"], "l_extendedprice").select("row", "features", F.col("l_extendedprice").alias("label"))
    return Y.run_suite(df, {k: M.Spec(M.REGRESSORS[k].make, {n: v[:1] for n, v in M.REGRESSORS[k].grid.items()}, grouped=M.REGRESSORS[k].grouped) for k in ("decision_tree", "random_forest", "boosting")}, "row", "regression", folds=2)[0]


@query("m15_quadratic_discriminant_whole")
def _(s, d):
    """All dimensions; the classes are odd and even labels."""
    e, names = _coordinates(s, d)
    own = e.withColumn("odd", F.col("label") % 2)
    return M.quadratic_discriminant(own, own, names, "odd", ["vec_id"])


@query("o07_terms_search")
def _(s, d):
    """Ridge regressions of random strength, by two terms: the error and the size of the weights."""
    lines = table(s, d, "lineitem")

    def judge(p):
        b, w = M.ridge(lines, _LINES, "l_extendedprice", p["alpha"])
        error = lines.agg(F.avg(F.pow(F.col("l_extendedprice") - (F.lit(b) + sum((F.col(c) * float(v) for c, v in zip(_LINES, w, strict=True)), F.lit(0.0))), 2)).alias("e")).first()["e"]
        return {"terms": {"error": error**0.5, "size": float(abs(w).sum())}}

    found = S.random_search(s, [S.Parameter("alpha", "log", 0.1, 1e6)], judge, 4, weights={"error": (1.0, False), "size": (0.001, False)})
    return found.select("candidate", "fitness", F.map_keys("terms").alias("terms"), "failed", "best")
