"""Smaller queries: file roles, references and events, schema algebra, eligibility, bytes, synthetic rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.operators import compare as C
from recipeframe.operators import models as M
from recipeframe.operators import profile as P
from recipeframe.plans.recipe_queries import EVENTS, _events, rounded
from recipeframe.plans.registry import query, table
from recipeframe.operators.recipe import ROW

_NAME = "CASE o_orderkey % 6 WHEN 0 THEN '/data/' || o_orderkey || '_train.csv' WHEN 1 THEN '/train/' || o_orderkey || '-Test.csv' WHEN 2 THEN 'validation_' || o_orderkey || '.parquet' WHEN 3 THEN '/train/' || o_orderkey || '.test.csv' WHEN 4 THEN 'a/Training' ELSE 'latest.csv' END"


@query("c06_filename_roles", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'test' WHEN 4 THEN 'train' END AS role FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", C.filename_role(F.expr(_NAME)).alias("role"))


@query("a09_schema_algebra", "SELECT 'n_name,n_nationkey' AS shared, 'n_regionkey' AS left_only, 'extra' AS right_only, 0.5 AS jaccard, count(*) AS rows FROM nation")
def _(s, d):
    n = table(s, d, "nation")
    a = C.schema_algebra(n.columns, n.drop("n_regionkey").withColumn("extra", F.lit(1)).columns)
    text = lambda k: F.lit(",".join(sorted(a[k])))
    return n.agg(F.count("*").alias("rows")).select(text("shared").alias("shared"), text("left_only").alias("left_only"), text("right_only").alias("right_only"), F.lit(float(a["jaccard"])).alias("jaccard"), "rows")


@query("l02_dataset_reference", "SELECT count(*) AS rows, 6 AS columns, 64 AS fingerprint_length FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    return C.table_fingerprint(o).select("rows", F.lit(len(o.columns)).alias("columns"), F.length("fingerprint").alias("fingerprint_length"))


@query("l03_event_ids", "SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS event FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", C.event_id("o_orderkey", "o_orderstatus").alias("event"))


@query("q09_eligible_columns", "SELECT * FROM (VALUES ('user_id'), ('value'), ('event_type')) t(\"column\")")
def _(s, d):
    return P.eligible_columns(P.column_profiles(_events(s, d).drop(ROW)))


@query("q24_scatter_ranges", f"SELECT min(user_id) AS x_low, max(user_id) AS x_high, round(min(value), 6) AS y_low, round(max(value), 6) AS y_high, least(count(*), 240) AS points FROM {EVENTS} WHERE value IS NOT NULL")
def _(s, d):
    e = _events(s, d).filter("value IS NOT NULL")
    points = P.sample_rows(e, ["event_id"], 240).agg(F.count("*").alias("points"), F.lit(1).alias("one"))
    ranges = e.agg(F.min("user_id").alias("x_low"), F.max("user_id").alias("x_high"), F.min("value").alias("y_low"), F.max("value").alias("y_high"), F.lit(1).alias("one"))
    return rounded(ranges.join(points, "one").drop("one"))


@query("q27_boolean_zero_rate", "SELECT round(avg(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS zero_rate FROM events")
def _(s, d):
    flag = F.when(F.col("event_id") % 3 == 0, " No ").otherwise("TRUE")
    return rounded(P.boolean_zero_rate(table(s, d, "events").select(flag.alias("flag")), "flag"))


@query("p29_impute_scale", f"SELECT event_id, round((coalesce(value, m) - m) / sd, 6) AS value FROM {EVENTS}, (SELECT avg(value) AS m, (SELECT stddev_pop(coalesce(value, (SELECT avg(value) FROM {EVENTS}))) FROM {EVENTS}) AS sd FROM {EVENTS})")
def _(s, d):
    from recipeframe.operators.recipe import run_recipe

    steps = [{"type": "select_columns", "columns": ["event_id", "value"]}, {"type": "fill_missing", "columns": ["value"], "method": "mean"}, {"type": "scale", "columns": ["value"]}]
    return rounded(run_recipe(_events(s, d), steps))


@query("p30_numeric_handoff", f"SELECT 'event_type' AS \"column\", count(*) AS bad FROM {EVENTS} UNION ALL SELECT 'user_id', 0 UNION ALL SELECT 'value', count(*) - count(value) FROM {EVENTS}")
def _(s, d):
    return P.not_finite(_events(s, d), ["event_type", "user_id", "value"])


@query("g02_independent_gaussian")
def _(s, d):
    return M.synthetic_gaussian(table(s, d, "lineitem"), ["l_quantity", "l_tax"], 1000, correlated=False)


@query("o10_pinned_dataset", "SELECT 'available' AS status, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'missing', count(*) FROM orders WHERE o_orderkey % 5 = 0")
def _(s, d):
    pins = table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.sha2("o_orderstatus", 256).alias("sha"))
    return C.verify_hashes(pins, pins.filter("name % 5 <> 0")).groupBy("status").agg(F.count("*").alias("n"))


@query("q18_ranked_relationships", f"""WITH p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)
    SELECT a AS "left", b AS "right", round(c, 6) AS pearson, CAST(row_number() OVER (ORDER BY abs(c) DESC, a, b) AS INT) AS place FROM p QUALIFY place <= 2""")
def _(s, d):
    pairs = P.pair_correlations(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("nmi", F.lit(0.5))
    return rounded(P.ranked_relationships(pairs, 2).select("left", "right", "pearson", "place"))


@query("q21_role_overrides", "SELECT * FROM (VALUES ('event_id', 'identifier', false), ('user_id', 'discrete', true), ('event_type', 'exclude', true), ('value', 'continuous', false)) t(\"column\", role, overridden)")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "value")
    return P.override_roles(P.suggested_roles(P.column_profiles(e)), {"user_id": "discrete", "event_type": "exclude"}).select("column", "role", "overridden")
