"""Queries over stores: profiles, verified exports, collection events, artifacts and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.functions.shared import fresh_path
from recipeframe.operators import compare as C
from recipeframe.operators import profile as P
from recipeframe.operators import stores as S
from recipeframe.plans.recipe_queries import rounded
from recipeframe.plans.registry import query, table


@query("s15_derived_manifest", "SELECT count(*) AS rows, true AS same FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    m = S.publish_derived(o, fresh_path(s, "derived"), f"{d}/orders.parquet", [{"type": "select_columns"}])
    return m.join(C.table_fingerprint(o).select("rows", F.col("fingerprint").alias("f")), "rows").select("rows", (F.col("f") == F.col("fingerprint")).alias("same"))


@query("s16_profile_runs", "SELECT 'first' AS run_id, 4 AS rows UNION ALL SELECT 'second', 4")
def _(s, d):
    store, p = fresh_path(s, "profile-runs"), P.column_profiles(table(s, d, "events").select("event_id", "user_id", "event_type", "value"))
    for run in ("first", "second"):
        S.save_run(p, store, run, table="events")
    return S.recent_runs(s, store).select("run_id", "rows")


@query("s19_verified_import", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS key, CASE o_orderkey % 5 WHEN 1 THEN '' WHEN 2 THEN '\\N' WHEN 3 THEN '\\\\x' WHEN 4 THEN o_orderstatus || chr(10) || '\",' END AS note, '' AS wrong FROM orders")
def _(s, d):
    note = F.when(F.col("o_orderkey") % 5 == 1, "").when(F.col("o_orderkey") % 5 == 2, "\\N").when(F.col("o_orderkey") % 5 == 3, "\\\\x").when(F.col("o_orderkey") % 5 == 4, F.concat("o_orderstatus", F.lit('\n",')))
    path = fresh_path(s, "export")
    S.export_encoded(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), note.alias("note")), path)
    back, wrong = S.import_verified(s, path)
    return back.select(F.col("key").cast("long").alias("o_orderkey"), "key", "note", F.lit(",".join(wrong)).alias("wrong"))


@query("s20_file_bytes", "SELECT 'nation.parquet' AS name, true AS whole, 64 AS digest")
def _(s, d):
    b = S.read_bytes(s, d, "nation.parquet")
    return b.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), (F.octet_length("bytes") == F.col("size")).alias("whole"), F.length("sha256").alias("digest"))


@query("s21_report", "SELECT o_orderpriority, count(*) AS orders, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(s, d):
    report = rounded(table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean")), 4)
    path = fresh_path(s, "report")
    S.write_report(report, path)
    return s.read.schema(report.schema).json(path)


@query("q28_profile_tables", "SELECT 'nation' AS \"table\", 3 AS columns, CAST(NULL AS VARCHAR) AS failed UNION ALL SELECT 'region', 2, NULL UNION ALL SELECT 'absent', 0, 'AnalysisException'")
def _(s, d):
    return S.profiled_counts({n: (lambda n=n: table(s, d, n)) for n in ("nation", "region", "absent")}, s)


@query("q29_whole_profile")
def _(s, d):
    return S.whole_profile(table(s, d, "events").select("event_id", "user_id", "event_type", "value"))


@query("q30_profile_reuse", "SELECT 'columns,top' AS first, '' AS second, 'top' AS refreshed, count(*) AS columns FROM (VALUES (1), (2), (3), (4)) t(c)")
def _(s, d):
    e, store = table(s, d, "events").select("event_id", "user_id", "event_type", "value"), fresh_path(s, "profile-cache")
    views = {"columns": P.column_profiles, "top": P.top_values}
    made = [S.reused_profile(e, store, {"k": 5}, views, refresh) for refresh in ((), (), ("top",))]
    names = [F.lit(",".join(m[1])).alias(n) for m, n in zip(made, ("first", "second", "refreshed"), strict=True)]
    return made[-1][0]["columns"].agg(F.count("*").alias("columns")).select(*names, "columns")


def _members(s, d):
    return table(s, d, "orders").select((F.col("o_orderkey") % 50).alias("output"), F.col("o_orderkey").alias("name"), F.sha2("o_orderstatus", 256).alias("sha"), F.lit("all").alias("recipe"))


@query("l07_collection_events", "SELECT o_orderkey % 50 AS output, count(*) AS members, 64 AS id FROM orders GROUP BY 1")
def _(s, d):
    return S.collection_events(_members(s, d)).select("output", "members", F.length("event").alias("id"))


@query("l08_verify_events", "SELECT output, CASE WHEN kept = n AND output % 5 <> 1 THEN 'verified' WHEN kept = 0 THEN 'missing' WHEN kept < n THEN 'members_missing' ELSE 'membership_changed' END AS status FROM (SELECT o_orderkey % 50 AS output, count(*) AS n, count(*) FILTER (WHERE NOT (o_orderkey % 50 % 5 = 0 AND o_orderkey % 7 = 0)) AS kept FROM orders GROUP BY 1)")
def _(s, d):
    m = _members(s, d)
    now = m.filter("NOT (output % 5 = 0 AND name % 7 = 0)").withColumn("sha", F.when(F.col("output") % 5 == 1, F.reverse("sha")).otherwise(F.col("sha")))
    return S.verify_events(S.collection_events(m), now)


@query("l09_regenerate", "SELECT true AS same, count(*) AS rows FROM orders WHERE o_totalprice > 1000")
def _(s, d):
    make = lambda: table(s, d, "orders").filter("o_totalprice > 1000")
    return S.regenerated(C.table_fingerprint(make()).first()["fingerprint"], make)


def _artifacts(s, d):
    return S.artifacts(table(s, d, "orders"), F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey"))


@query("l10_artifact_edges", "SELECT o_orderpriority AS kind, count(*) AS artifacts, count(DISTINCT o_custkey) AS sources FROM orders GROUP BY 1")
def _(s, d):
    rows, edges = _artifacts(s, d)
    return rows.join(edges, "artifact").groupBy("kind").agg(F.count("*").alias("artifacts"), F.count_distinct("source").alias("sources"))


@query("x47_extraction_history", "SELECT o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' WHEN o_orderkey % 4 = 1 THEN 'modified' ELSE 'available' END AS status FROM orders WHERE o_orderstatus = 'O'")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("source"), F.sha2("o_orderpriority", 256).alias("sha"))
    now = o.filter("name % 4 <> 0").select("name", F.when(F.col("name") % 4 == 1, "changed").otherwise(F.col("sha")).alias("sha"))
    return S.extraction_history(o.withColumn("event", C.event_id("name", "sha")), now, "O").select("name", "status")


@query("x49_catalog_page", "SELECT o_orderpriority AS kind, CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' ORDER BY name LIMIT 50 OFFSET 50")
def _(s, d):
    return S.browse(_artifacts(s, d)[0], {"kind": "Urgent"}, page=2).select("kind", "name")


@query("x50_handoff", "SELECT o_orderstatus AS dataset, 'child' AS kind, count(*) AS rows FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'main', 'main', count(*) FROM orders")
def _(s, d):
    o = table(s, d, "orders")
    main = o.agg(F.lit("main").alias("dataset"), F.count("*").alias("rows"))
    parts = o.groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count("*").alias("rows"))
    manifest = main.unionByName(parts).withColumns({"verified": F.col("dataset") != "P", "path": F.concat(F.lit("tables/"), "dataset")})
    return S.handoff(manifest).select("dataset", "kind", "rows")
