"""Queries over comparisons, lineage, metrics and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.operators import compare as C
from recipeframe.operators import metrics as M
from recipeframe.plans.recipe_queries import rounded
from recipeframe.plans.registry import query, table

# ---- comparison


@query("c03_row_overlap", """WITH a AS (SELECT user_id, event_type, count(*) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS b FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
    j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (user_id, event_type)), s AS (SELECT sum(a) AS l, sum(b) AS r, sum(least(a, b)) AS s, sum(greatest(a, b)) AS g FROM j)
    SELECT CAST(l AS BIGINT) AS left_rows, CAST(r AS BIGINT) AS right_rows, CAST(s AS BIGINT) AS shared, round(s / l, 6) AS left_fraction, round(s / r, 6) AS right_fraction, round(s / g, 6) AS row_jaccard FROM s""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_type", "event_id")
    return rounded(C.row_overlap(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 3 = 0").drop("event_id")))


@query("c04_identifier_candidates", "SELECT 'c_custkey' AS \"column\", count(*) AS n FROM customer HAVING count(*) = count(DISTINCT c_custkey) UNION ALL SELECT 'c_name', count(*) FROM customer HAVING count(*) = count(DISTINCT c_name) UNION ALL SELECT 'c_acctbal', count(*) FROM customer HAVING count(*) = count(DISTINCT c_acctbal)")
def _(s, d):
    return C.identifier_candidates(table(s, d, "customer"))


@query("c05_identifier_overlap", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer), x AS (SELECT (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM b) AS r, (SELECT count(*) FROM a JOIN b USING (k)) AS s) SELECT l AS left_ids, r AS right_ids, s AS shared_ids, round(s / l, 6) AS left_fraction, round(s / r, 6) AS right_fraction FROM x")
def _(s, d):
    return rounded(C.identifier_overlap(table(s, d, "orders"), table(s, d, "customer"), "o_custkey", "c_custkey"))


_NATIONS = {
    "all_v1": "true", "all_v1_copy": "true", "all_v2": "n_nationkey < 20", "nation_train": "n_nationkey < 10", "nation_test": "n_nationkey >= 10", "changed": "n_nationkey >= 0",
}


def _collection(s, d):
    """The nations in parts, a changed copy, and two other tables; equal hashes stand for equal files."""
    n = table(s, d, "nation")
    out = {name: n.filter(rule) for name, rule in _NATIONS.items()}
    out["changed"] = n.withColumn("n_name", F.concat("n_name", F.lit("!")))
    out["named"] = n.select("n_nationkey", "n_name")
    return out | {"other": table(s, d, "region")}


_PAIRS = """WITH d AS (
        SELECT name, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('all_v1'), ('all_v1_copy'), ('all_v2'), ('nation_train'), ('nation_test'), ('changed')) v(name)
        WHERE CASE name WHEN 'all_v2' THEN n_nationkey < 20 WHEN 'nation_train' THEN n_nationkey < 10 WHEN 'nation_test' THEN n_nationkey >= 10 ELSE true END
    ), full_ AS (SELECT name, n_nationkey, CASE WHEN name = 'changed' THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM d),
    k AS (SELECT name, count(*) AS n FROM full_ GROUP BY 1 UNION ALL SELECT 'named', count(*) FROM nation UNION ALL SELECT 'other', count(*) FROM region),
    rows_ AS (SELECT name, n_nationkey, n_name, n_regionkey, false AS part FROM full_ UNION ALL SELECT name, n_nationkey, n_name, NULL, true FROM full_ UNION ALL SELECT 'named', n_nationkey, n_name, NULL, true FROM nation),
    shared AS (SELECT x.name AS a, y.name AS b, x.part, count(*) AS s, count(DISTINCT x.n_nationkey) AS ids FROM rows_ x JOIN rows_ y ON x.name < y.name AND x.part = y.part AND x.n_nationkey = y.n_nationkey AND x.n_name = y.n_name AND x.n_regionkey IS NOT DISTINCT FROM y.n_regionkey GROUP BY 1, 2, 3),
    keys_ AS (SELECT x.name AS a, y.name AS b, count(*) AS ids FROM rows_ x JOIN rows_ y ON x.name < y.name AND x.part AND y.part AND x.n_nationkey = y.n_nationkey GROUP BY 1, 2),
    p AS (
        SELECT x.name AS a, y.name AS b, x.n AS ln, y.n AS rn, CASE WHEN y.name = 'other' THEN 0.0 WHEN y.name = 'named' OR x.name = 'named' THEN 2 / 3 ELSE 1.0 END AS j, y.name NOT IN ('other', 'named') AND x.name <> 'named' AS same,
               coalesce(s.s, 0) AS s, coalesce(i.ids, 0) AS ids
        FROM k x JOIN k y ON x.name < y.name LEFT JOIN shared s ON s.a = x.name AND s.b = y.name AND s.part = (y.name = 'named' OR x.name = 'named') LEFT JOIN keys_ i ON i.a = x.name AND i.b = y.name
    ), m AS (SELECT *, s / ln AS lf, s / rn AS rf, s / (ln + rn - s) AS rj, CASE WHEN b = 'other' OR least(ln, rn) < 10 THEN 0.0 ELSE greatest(ids / ln, ids / rn) END AS top_ids, a = 'nation_test' AND b = 'nation_train' AS split_ FROM p)
    SELECT a AS "left", b AS "right", round(j, 6) AS schema_jaccard, ln AS left_rows, rn AS right_rows, s AS shared, round(lf, 6) AS left_fraction, round(rf, 6) AS right_fraction, round(rj, 6) AS row_jaccard,
           CASE WHEN a = 'all_v1' AND b = 'all_v1_copy' THEN 'exact_duplicate' WHEN same AND ln = rn AND s = ln THEN 'content_equivalent' WHEN same AND ln <= rn AND lf = 1 AND NOT (rn <= ln AND rf = 1) THEN 'left_subset_of_right'
                WHEN same AND rn <= ln AND rf = 1 THEN 'right_subset_of_left' WHEN same AND split_ AND rj < 0.25 THEN 'likely_train_test_split' WHEN same AND greatest(lf, rf, top_ids) >= 0.7 THEN 'likely_version_or_derivative'
                WHEN same THEN 'same_schema_distinct_data' WHEN j >= 0.5 THEN 'related_schema' ELSE 'weak_or_unknown_relationship' END AS label
    FROM m"""


@query("c08_c09_collection", _PAIRS)
def _(s, d):
    c = C.compare_collection(_collection(s, d), hashes={"all_v1": "h", "all_v1_copy": "h", "all_v2": "g"})
    return rounded(c.select("left", "right", "schema_jaccard", "left_rows", "right_rows", "shared", "left_fraction", "right_fraction", "row_jaccard", "label"))


@query("c07_subset_flags", f"SELECT \"left\", \"right\", label IN ('exact_duplicate', 'content_equivalent') AS content_equivalent, label IN ('exact_duplicate', 'content_equivalent', 'left_subset_of_right') AS left_subset, label IN ('exact_duplicate', 'content_equivalent', 'right_subset_of_left') AS right_subset FROM ({_PAIRS})")
def _(s, d):
    return C.compare_collection(_collection(s, d), hashes={"all_v1": "h", "all_v1_copy": "h"}).select("left", "right", "content_equivalent", "left_subset", "right_subset")


@query("a10_label_counts", f"SELECT label, count(*) AS pairs, 28 AS compared, 28 AS possible, false AS truncated FROM ({_PAIRS}) GROUP BY 1")
def _(s, d):
    c = _collection(s, d)
    return C.collection_summary(C.compare_collection(c, hashes={"all_v1": "h", "all_v1_copy": "h"}), len(c))


@query("c09_truncated", f"SELECT label, count(*) AS pairs, 5 AS compared, 28 AS possible, true AS truncated FROM (SELECT * FROM ({_PAIRS}) ORDER BY \"left\", \"right\" LIMIT 5) GROUP BY 1")
def _(s, d):
    c = _collection(s, d)
    return C.collection_summary(C.compare_collection(c, 5, {"all_v1": "h", "all_v1_copy": "h"}), len(c))


@query("c01_schema_signature", "SELECT sha256('[\"n_nationkey\",\"n_name\",\"n_regionkey\"]') AS signature, count(*) AS rows FROM nation")
def _(s, d):
    n = table(s, d, "nation")
    return n.agg(F.count("*").alias("rows")).select(C.schema_signature(n.columns).alias("signature"), "rows")


@query("c02_canonical_text", "SELECT event_id, coalesce(printf('%.17g', CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN floor(value) ELSE value END END), '<NA>') AS value, CAST(user_id AS VARCHAR) AS user FROM events")
def _(s, d):
    e = table(s, d, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.when(F.col("event_id") % 5 == 0, F.floor("value").cast("double")).otherwise(F.col("value"))))
    return e.select("event_id", C.canonical_text(e, "value").alias("value"), C.canonical_text(e, "user_id").alias("user"))


@query("l01_table_fingerprint", "SELECT count(*) AS rows, true AS same_bag, false AS same_as_changed FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    a, b, c = (C.table_fingerprint(x) for x in (o, o.repartition(7, "o_custkey"), o.withColumn("o_custkey", F.when(F.col("o_orderkey") == F.lit(o.agg(F.min("o_orderkey")).first()[0]), -1).otherwise(F.col("o_custkey")).cast("long"))))
    one = a.withColumn("k", F.lit(1)).join(b.select(F.col("fingerprint").alias("b"), F.lit(1).alias("k")), "k").join(c.select(F.col("fingerprint").alias("c"), F.lit(1).alias("k")), "k")
    return one.select("rows", (F.col("fingerprint") == F.col("b")).alias("same_bag"), (F.col("fingerprint") == F.col("c")).alias("same_as_changed"))


def _chain(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("event"), F.concat(F.lit("h"), F.col("n_nationkey")).alias("source_sha"), F.concat(F.lit("h"), F.col("n_nationkey") + 5).alias("derived_sha"))


@query("l04_parent_links", "SELECT CAST(n_nationkey AS VARCHAR) AS event, CASE WHEN n_nationkey >= 5 THEN CAST(n_nationkey - 5 AS VARCHAR) END AS parent FROM nation")
def _(s, d):
    return C.link_parents(_chain(s, d)).select("event", "parent")


@query("l05_trace_lineage", "WITH RECURSIVE t AS (SELECT n_nationkey AS leaf, 0 AS step, n_nationkey AS event FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT leaf, step + 1, event - 5 FROM t WHERE event >= 5) SELECT CAST(leaf AS VARCHAR) AS leaf, step, CAST(event AS VARCHAR) AS event, false AS cycle FROM t")
def _(s, d):
    e = _chain(s, d)
    return C.trace_lineage(e, e.filter("CAST(event AS INT) >= 20"))


@query("l06_verify_hashes", "SELECT o_orderkey AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'modified' ELSE 'available' END AS status FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    now = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(sha).alias("sha"))
    return C.verify_hashes(o.select(F.col("o_orderkey").alias("name"), sha.alias("sha")), now)


# ---- metrics, over labels that SQL derives alike

LABELLED = "(SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS label, CASE WHEN o_totalprice + (o_orderkey % 7 - 3) * 20000 > 150000 THEN 1 ELSE 0 END AS prediction, o_orderkey % 4 AS a, CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey + 1) % 4 ELSE o_orderkey % 4 END AS b, (o_totalprice + (o_orderkey % 7 - 3) * 20000) / 1000 AS score, o_totalprice FROM orders)"


def _labelled(s, d):
    shifted = F.col("o_totalprice") + (F.col("o_orderkey") % 7 - 3) * 20000
    return table(s, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 150000).cast("int").alias("label"), (shifted > 150000).cast("int").alias("prediction"), (F.col("o_orderkey") % 4).alias("a"),
        F.when(F.col("o_orderkey") % 10 == 0, (F.col("o_orderkey") + 1) % 4).otherwise(F.col("o_orderkey") % 4).alias("b"), (shifted / 1000).alias("score"), "o_totalprice",
    )


@query("m34_binary_metrics", f"""WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) AS fn FROM {LABELLED}),
    m AS (SELECT *, (tp + tn) / n AS acc, tp / (tp + fp) AS p, tp / (tp + fn) AS r, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe FROM c)
    SELECT round(acc, 6) AS accuracy, round((r + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(5 * p * r / (4 * p + r), 6) AS f2, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
    round((acc - pe) / (1 - pe), 6) AS kappa, round(tp / (tp + fp + fn), 6) AS jaccard, round(1 - acc, 6) AS hamming, round(1 - acc, 6) AS zero_one FROM m""")
def _(s, d):
    return rounded(M.classification_metrics(_labelled(s, d)))


@query("m34_multiclass_accuracy", f"SELECT round(avg(CAST(a = b AS INT)), 6) AS accuracy, round(avg(CAST(a = b AS INT)), 6) AS recall FROM {LABELLED}")
def _(s, d):
    return rounded(M.classification_metrics(_labelled(s, d), "a", "b").select("accuracy", "recall"))


@query("m35_roc_auc", f"WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM {LABELLED}), t AS (SELECT sum(label) AS p, sum(1 - label) AS q, sum(k * label) AS s FROM r) SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t")
def _(s, d):
    return rounded(M.roc_auc(_labelled(s, d), "label", "score"))


@query("m36_regression_metrics", f"WITH e AS (SELECT o_totalprice AS y, o_totalprice - score * 1000 AS e FROM {LABELLED}) SELECT round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(quantile_cont(abs(e), 0.5), 4) AS median_ae, round(1 - var_pop(e) / var_pop(y), 4) AS explained_variance FROM e")
def _(s, d):
    return rounded(M.regression_metrics(_labelled(s, d).withColumn("p", F.col("score") * 1000), "o_totalprice", "p"), 4)


@query("m39_cluster_sizes", "WITH c AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_custkey % 5 END AS k FROM orders), n AS (SELECT k, count(*) AS n FROM c GROUP BY 1), m AS (SELECT sum(n) AS m FROM n WHERE k <> -1) SELECT count(*) FILTER (WHERE k <> -1) AS clusters, round(sum(n) FILTER (WHERE k = -1) / sum(n), 6) AS noise_fraction, round(-sum(n / m * ln(n / m)) FILTER (WHERE k <> -1), 6) AS size_entropy, min(n) FILTER (WHERE k <> -1) AS smallest, max(n) FILTER (WHERE k <> -1) AS largest FROM n, m")
def _(s, d):
    o = table(s, d, "orders").select(F.when(F.col("o_orderkey") % 9 == 0, -1).otherwise(F.col("o_custkey") % 5).alias("k"))
    return rounded(M.cluster_sizes(o, "k"))


@query("m40_external_metrics", f"""WITH c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM {LABELLED} GROUP BY 1, 2), l AS (SELECT sum(n) AS n FROM c GROUP BY a), r AS (SELECT sum(n) AS n FROM c GROUP BY b),
    x AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS pij, (SELECT sum(n * (n - 1) / 2) FROM l) AS pa, (SELECT sum(n * (n - 1) / 2) FROM r) AS pb, (SELECT sum(n * ln(n)) FROM c) AS lij, (SELECT sum(n * ln(n)) FROM l) AS la, (SELECT sum(n * ln(n)) FROM r) AS lb),
    y AS (SELECT *, pa * pb / (n * (n - 1) / 2) AS e, ln(n) - la / n AS ha, ln(n) - lb / n AS hb, ln(n) + (lij - la - lb) / n AS mi FROM x)
    SELECT round((pij - e) / ((pa + pb) / 2 - e), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure FROM y""")
def _(s, d):
    return rounded(M.external_metrics(_labelled(s, d), "a", "b"))


_VEC = "(SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query("m38_dispersion", f"""WITH x AS (SELECT vec_id, label AS k, CAST(x AS DOUBLE) AS x, i FROM {_VEC}), s AS (SELECT k, i, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT i, avg(x) AS g FROM x GROUP BY 1),
    w AS (SELECT sum((x - m) * (x - m)) AS w FROM x JOIN s USING (k, i)), b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM s JOIN t USING (i)), z AS (SELECT count(*) AS n, count(DISTINCT label) AS c FROM embeddings),
    sc AS (SELECT k, avg(d) AS s FROM (SELECT vec_id, k, sqrt(sum((x - m) * (x - m))) AS d FROM x JOIN s USING (k, i) GROUP BY 1, 2) GROUP BY 1),
    p AS (SELECT a.k, max((sa.s + sb.s) / d) AS r FROM (SELECT a.k, b.k AS o, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM s a JOIN s b ON a.i = b.i AND a.k <> b.k GROUP BY 1, 2) a JOIN sc sa ON a.k = sa.k JOIN sc sb ON a.o = sb.k GROUP BY 1)
    SELECT round((b / (c - 1)) / (w / (n - c)), 5) AS calinski_harabasz, round((SELECT avg(r) FROM p), 5) AS davies_bouldin FROM w, b, z""")
def _(s, d):
    return rounded(M.dispersion_metrics(table(s, d, "embeddings"), "embedding", "label"), 5)


@query("m37_silhouette")
def _(s, d):
    return rounded(M.silhouette(table(s, d, "embeddings"), "embedding", "label", "vec_id"))


_RUNS = "(SELECT r AS run, o_orderkey AS row, CASE WHEN (o_orderkey + r) % 13 = 0 THEN -1 ELSE (o_orderkey % 100) // (20 + r) END AS label FROM orders, range(3) t(r))"


def _runs(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("row"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("run"))
    return o.select("run", "row", F.when((F.col("row") + F.col("run")) % 13 == 0, F.lit(-1)).otherwise(F.floor((F.col("row") % 100) / (20 + F.col("run")))).cast("long").alias("label"))


_AGREE = f"""WITH g AS (SELECT * FROM {_RUNS}), j AS (SELECT a.run AS l, b.run AS r, a.label AS x, b.label AS y, CAST(count(*) AS DOUBLE) AS n FROM g a JOIN g b ON a.row = b.row AND a.run < b.run WHERE a.label <> -1 AND b.label <> -1 GROUP BY 1, 2, 3, 4),
    t AS (SELECT l, r, sum(n) AS n, sum(n * (n - 1) / 2) AS pij FROM j GROUP BY 1, 2), pa AS (SELECT l, r, sum(n * (n - 1) / 2) AS pa FROM (SELECT l, r, sum(n) AS n FROM j GROUP BY l, r, x) GROUP BY 1, 2), pb AS (SELECT l, r, sum(n * (n - 1) / 2) AS pb FROM (SELECT l, r, sum(n) AS n FROM j GROUP BY l, r, y) GROUP BY 1, 2),
    ag AS (SELECT l, r, n, n / (SELECT count(*) FROM orders) AS coverage, (pij - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) AS ari FROM t JOIN pa USING (l, r) JOIN pb USING (l, r))"""


@query("m41_label_agreement", _AGREE + " SELECT l AS \"left\", r AS \"right\", CAST(n AS BIGINT) AS n, round(coverage, 6) AS coverage, round(ari, 6) AS ari FROM ag")
def _(s, d):
    return rounded(M.label_agreement(_runs(s, d)))


@query("m44_stability_report", _AGREE + " SELECT round(avg(ari), 6) AS mean_ari, round(stddev_pop(ari), 6) AS std_ari, round(min(ari), 6) AS min_ari, round(max(ari), 6) AS max_ari, round(avg(coverage), 6) AS coverage FROM ag")
def _(s, d):
    return rounded(M.stability_report(_runs(s, d)))


_CLASSES = f"""WITH v AS (SELECT row, {', '.join(f'max(CASE WHEN run = {r} THEN label END) AS l{r}' for r in range(3))} FROM {_RUNS} GROUP BY 1), c AS (SELECT min(row) AS class, count(*) AS n, l0, l1, l2 FROM v GROUP BY l0, l1, l2),
    p AS (SELECT x.class AS a, y.class AS b, CASE WHEN x.class = y.class THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS pairs, {' + '.join(f'CAST(x.l{r} <> -1 AND y.l{r} <> -1 AS INT)' for r in range(3))} AS eligible, {' + '.join(f'CAST(x.l{r} <> -1 AND x.l{r} = y.l{r} AS INT)' for r in range(3))} AS same FROM c x JOIN c y ON x.class <= y.class),
    q AS (SELECT a, b, CAST(pairs AS BIGINT) AS pairs, CAST(eligible AS BIGINT) AS eligible, same / eligible AS consensus FROM p WHERE eligible > 0 AND pairs > 0)"""


@query("m42_coassignment", f"{_CLASSES} SELECT a, b, pairs, eligible, round(consensus, 6) AS consensus FROM q")
def _(s, d):
    return rounded(M.coassignment(_runs(s, d))[1])


@query("m42_class_members", f"{_CLASSES} SELECT row, class FROM v JOIN c ON v.l0 = c.l0 AND v.l1 = c.l1 AND v.l2 = c.l2")
def _(s, d):
    return M.coassignment(_runs(s, d))[0]


@query("m43_consensus_consistency", f"{_CLASSES} SELECT round(sum(greatest(consensus, 1 - consensus) * pairs) / sum(pairs), 6) AS consistency FROM q")
def _(s, d):
    return rounded(M.consensus_consistency(M.coassignment(_runs(s, d))[1]))


@query("m01_stratified_split", "SELECT toxic, count(*) AS n, CAST(round(count(*) * 0.25) AS BIGINT) AS n_test FROM labels GROUP BY 1")
def _(s, d):
    return M.stratified_split(table(s, d, "labels"), "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("long")).alias("n_test"))


@query("m03_a11_stratified_folds", "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), f AS (SELECT CAST(f AS INT) AS fold FROM range(5) t(f)) SELECT toxic, fold, (n + 4 - fold) // 5 AS n FROM c, f")
def _(s, d):
    return M.stratified_folds(table(s, d, "labels"), "toxic", "doc_id").groupBy("toxic", "fold").agg(F.count("*").alias("n"))


_HALVES = "SELECT {} FROM lineitem WHERE l_linenumber {}"


@query("r09_wasserstein", "WITH q AS (SELECT (i + 0.5) / 100 AS q FROM range(100) t(i)) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(abs(x - y)), 6) AS distance FROM (SELECT unnest(quantile_cont({c}, [{', '.join(str((i + 0.5) / 100) for i in range(100))}]) FILTER (WHERE l_linenumber <= 2)) AS x, unnest(quantile_cont({c}, [{', '.join(str((i + 0.5) / 100) for i in range(100))}]) FILTER (WHERE l_linenumber > 2)) AS y FROM lineitem)" for c in ("l_quantity", "l_extendedprice")))
def _(s, d):
    x = table(s, d, "lineitem")
    return rounded(M.wasserstein(x.filter("l_linenumber <= 2"), x.filter("l_linenumber > 2"), ["l_quantity", "l_extendedprice"]))


@query("r10_moment_shift", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}) FILTER (WHERE l_linenumber > 2) - avg({c}) FILTER (WHERE l_linenumber <= 2), 6) AS mean_shift, round(stddev_pop({c}) FILTER (WHERE l_linenumber > 2) - stddev_pop({c}) FILTER (WHERE l_linenumber <= 2), 6) AS std_shift FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def _(s, d):
    x = table(s, d, "lineitem")
    return rounded(M.moment_shift(x.filter("l_linenumber <= 2"), x.filter("l_linenumber > 2"), ["l_quantity", "l_extendedprice"]))
