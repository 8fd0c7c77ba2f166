"""Queries over profiles, relationships and feature views."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.operators import profile as P
from recipeframe.plans.recipe_queries import EVENTS, _events, rounded
from recipeframe.plans.registry import query, table
from recipeframe.operators.recipe import ROW


def _e(s, d):
    return _events(s, d).drop(ROW)


_CELLS = f"(SELECT 'event_id' AS c, 0 AS p, CAST(event_id AS VARCHAR) AS v FROM {EVENTS} UNION ALL SELECT 'user_id', 1, CAST(user_id AS VARCHAR) FROM {EVENTS} UNION ALL SELECT 'value', 2, CAST(value AS VARCHAR) FROM {EVENTS} UNION ALL SELECT 'event_type', 3, event_type FROM {EVENTS})"
_BASE = f"SELECT c AS \"column\", p AS position, count(*) AS rows, count(v) AS non_missing, count(*) - count(v) AS missing, count(DISTINCT v) AS unique_count FROM {_CELLS} GROUP BY 1, 2"


@query("a06_column_counts", f"SELECT \"column\", position, rows, non_missing, missing, round(missing / rows, 6) AS missing_rate, unique_count, round(unique_count / non_missing, 6) AS cardinality_ratio, (SELECT round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM {_CELLS} x WHERE x.c = b.\"column\" AND v IS NOT NULL GROUP BY v)) AS dominant_rate FROM ({_BASE}) b")
def _(s, d):
    return rounded(P.column_profiles(_e(s, d)).select("column", "position", "rows", "non_missing", "missing", "missing_rate", "unique_count", "cardinality_ratio", "dominant_rate"))


@query("q02_inferred_types", "SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'float'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'categorical'), ('flag', 'boolean'), ('none', 'empty')) t(\"column\", inferred_type)")
def _(s, d):
    o = table(s, d, "orders").withColumns({"flag": F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no"), "none": F.lit("N/A")})
    return P.column_profiles(o).select("column", "inferred_type")


@query("q03_likely_identifiers", "SELECT 'event_id' AS \"column\"")
def _(s, d):
    return P.column_profiles(_e(s, d)).filter("likely_identifier").select("column")


@query("s07_missing_tokens", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CASE event_id % 3 WHEN 1 THEN 'kept ' WHEN 2 THEN event_type END END AS v FROM events")
def _(s, d):
    raw = F.when(F.col("event_id") % 3 == 0, " N/A ").when(F.col("event_id") % 3 == 1, "kept ").otherwise(F.col("event_type"))
    return table(s, d, "events").select("event_id", P.clean_cell(raw).alias("v"))


@query("a05_top_values", f"SELECT c AS \"column\", v AS value, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS k FROM (SELECT c, v, count(*) AS n FROM {_CELLS} WHERE v IS NOT NULL AND c IN ('user_id', 'event_type') GROUP BY 1, 2)) WHERE k <= 5")
def _(s, d):
    return P.top_values(_e(s, d).select("user_id", "event_type"))


_NUM = "SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem"


@query(
    "q04_numeric_summary",
    f"""WITH x AS ({_NUM}) SELECT c AS "column", count(*) AS count, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
    round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(skewness(v), 6) AS skew, count(*) FILTER (WHERE v = 0) AS zero_count, count(*) FILTER (WHERE v < 0) AS negative_count, round(count(*) FILTER (WHERE v = 0) / count(*), 6) AS zero_rate FROM x GROUP BY 1""",
)
def _(s, d):
    n = P.numeric_summary(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return rounded(n.select("column", "count", "min", "max", "mean", "std", "q1", "median", "q3", "iqr", "skew", "zero_count", "negative_count", "zero_rate"))


@query(
    "q05_outlier_fences",
    f"""WITH x AS (SELECT 'value' AS c, value AS v FROM {EVENTS} WHERE value IS NOT NULL), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM x)
    SELECT 'value' AS "column", round(q1 - 1.5 * (q3 - q1), 6) AS outlier_lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS outlier_upper_bound, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outlier_count,
    round(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*), 6) AS outlier_rate FROM x, q GROUP BY q1, q3""",
)
def _(s, d):
    return rounded(P.numeric_summary(_e(s, d), ["value"]).select("column", "outlier_lower_bound", "outlier_upper_bound", "outlier_count", "outlier_rate"))


@query("q06_text_lengths", "SELECT 'text' AS \"column\", min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 6) AS mean_length, round(quantile_cont(length(text), 0.5), 6) AS median_length FROM documents WHERE trim(text) <> ''")
def _(s, d):
    return rounded(P.text_summary(table(s, d, "documents"), ["text"]))


@query("q07_datetime_range", "SELECT 'o_orderdate' AS \"column\", strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max FROM orders")
def _(s, d):
    return P.datetime_summary(table(s, d, "orders"), ["o_orderdate"]).select("column", F.date_format("min", "yyyy-MM-dd").alias("min"), F.date_format("max", "yyyy-MM-dd").alias("max"))


@query("q08_quality_issues", "SELECT * FROM (VALUES ('error', 'all_missing', 'none'), ('warning', 'high_missingness', 'sparse'), ('warning', 'constant_column', 'same'), ('info', 'likely_identifier', 'event_id'), ('warning', 'constant_column', 'sparse')) t(severity, code, \"column\")")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.lit("").alias("none"), F.when(F.col("event_id") % 3 == 0, "x").alias("sparse"), F.lit("a").alias("same"))
    return P.quality_issues(P.column_profiles(e))


@query("a04_duplicate_rows", "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS duplicates, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events))) / count(*), 6) AS duplicate_rate FROM events")
def _(s, d):
    return rounded(P.duplicate_rows(table(s, d, "events").select("user_id", "event_type")))


_PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
_AVG_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


@query("q13_q14_correlations", " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT {a} AS x, {b} AS y, {_AVG_RANK.format(a)} AS rx, {_AVG_RANK.format(b)} AS ry FROM lineitem)" for a, b in _PAIRS))
def _(s, d):
    return rounded(P.pair_correlations(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("q11_complete_pairs", f"SELECT 'user_id' AS \"left\", 'value' AS \"right\", count(*) AS n FROM {EVENTS} WHERE value IS NOT NULL")
def _(s, d):
    return P.pair_correlations(_e(s, d), ["user_id", "value"]).select("left", "right", "n")


@query(
    "q16_q17_mutual_information",
    """WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM j), l AS (SELECT a, sum(n) AS na FROM j GROUP BY 1), r AS (SELECT b, sum(n) AS nb FROM j GROUP BY 1),
    m AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM j JOIN l USING (a) JOIN r USING (b), t), h AS (SELECT (SELECT -sum(na / t * ln(na / t)) FROM l, t) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM r, t) AS hb)
    SELECT round(mi, 6) AS mi, round(mi / ((ha + hb) / 2), 6) AS nmi FROM m, h""",
)
def _(s, d):
    return rounded(P.mutual_information(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"))


_EDGES = ", ".join(f"quantile_cont(p_retailprice, {i / 10})" for i in range(1, 10))


@query("q15_quantile_bins", f"WITH q AS (SELECT [{_EDGES}] AS e FROM part) SELECT CAST(len(list_filter(e, lambda x: p_retailprice > x)) AS INT) AS bin, count(*) AS n FROM part, q GROUP BY 1")
def _(s, d):
    part = table(s, d, "part")
    return part.groupBy(P.discretise(part, "p_retailprice").alias("bin")).agg(F.count("*").alias("n"))


@query("q19_association_matrix", "WITH c AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS v FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem), b AS (SELECT a, b, v FROM c UNION ALL SELECT b, a, v FROM c) SELECT a AS \"left\", b AS \"right\", round(v, 6) AS value, CAST(ceil(4 * abs(v) / (SELECT max(abs(v)) FROM c)) AS INT) AS strength FROM b")
def _(s, d):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(P.association_matrix(P.pair_correlations(table(s, d, "lineitem"), columns), "pearson", columns))


@query("q20_suggested_roles", "SELECT * FROM (VALUES ('event_id', 'integer', 'identifier'), ('value', 'float', 'continuous'), ('event_type', 'categorical', 'discrete')) t(\"column\", inferred_type, role) UNION ALL SELECT 'user_id', 'integer', CASE WHEN count(DISTINCT user_id) <= 20 THEN 'discrete' ELSE 'continuous' END FROM events")
def _(s, d):
    return P.suggested_roles(P.column_profiles(_e(s, d)))


@query("q22_histogram", f"WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 12 AS w FROM {EVENTS}) SELECT CAST(least(floor((value - lo) / w), 11) AS INT) AS bin, round(lo + least(floor((value - lo) / w), 11) * w, 6) AS start, count(*) AS n FROM {EVENTS}, m WHERE value IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return rounded(P.histogram(_e(s, d), "value"))


@query("q23_top_categories", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def _(s, d):
    return P.top_categories(table(s, d, "documents"), "lang")


@query("q25_contingency", "WITH a AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), b AS (SELECT lang FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) SELECT source AS \"left\", lang AS \"right\", count(*) AS n FROM documents JOIN a USING (source) JOIN b USING (lang) GROUP BY 1, 2")
def _(s, d):
    return P.contingency(table(s, d, "documents"), "source", "lang")


@query("q26_group_quartiles", "SELECT o_orderpriority AS value, count(*) AS n, round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(max(o_totalprice), 6) AS max FROM orders GROUP BY 1")
def _(s, d):
    return rounded(P.group_quartiles(table(s, d, "orders"), "o_orderpriority", "o_totalprice"))


@query("a07_systematic_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events) WHERE k IN (SELECT (i * (n - 1)) // 99 FROM range(100) r(i))")
def _(s, d):
    return P.systematic_sample(table(s, d, "events").select("event_id"), "event_id", 100)


@query("q01_seeded_sample")
def _(s, d):
    return P.sample_rows(table(s, d, "events"), ["event_id"], 1000).select("event_id")
