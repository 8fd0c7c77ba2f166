"""Queries over selections, recipes and groups of the XML made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.functions.shared import fresh_path
from recipeframe.operators import stores as S
from recipeframe.operators import xml_selection as Z
from recipeframe.operators import xml_tables as X
from recipeframe.plans.registry import query, table
from recipeframe.plans.xml_queries import _REASON, _REASONS, _STATUS, BLOCK_SQL, FLAG, ITEM, KEY, NUM, PRICE, QTY, ROOT, STATUS, VARIED, _documents, _nodes, _varied_nodes
from recipeframe.sources.xml import shred_documents

NIL = f"attribute:{ROOT}/status@{{http://www.w3.org/2001/XMLSchema-instance}}nil"
_NONE = "(SELECT min(n) = 0 FROM (SELECT count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey))"
_BLOCKS = f"(SELECT {BLOCK_SQL} AS b, count(*) AS n FROM orders GROUP BY 1)"
_LINES = f"(SELECT b, sum(m) AS n, max(m) AS most FROM (SELECT {BLOCK_SQL} AS b, o_orderkey, count(*) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1)"


@query("x10_selectable_fields", f"SELECT * FROM (VALUES ('{KEY}', '{ROOT}', 'attribute', false, false), ('{STATUS}', '{ROOT}/status', 'text', false, false), ('{NIL}', '{ROOT}/status', 'attribute', false, true), ('{PRICE}', '{ROOT}/price', 'text', false, true)) t(field, path, kind, repeated, optional) UNION ALL SELECT f, p, k, true, {_NONE} FROM (VALUES ('{QTY}', '{ITEM}/qty', 'text'), ('{FLAG}', '{ITEM}/flag', 'text'), ('{NUM}', '{ITEM}', 'attribute')) t(f, p, k)")
def _(s, d):
    return Z.selectable_fields(_nodes(s, d), ROOT)


@query("x11_collection_plan", f"SELECT '{ITEM}' AS branch, CAST(NULL AS VARCHAR) AS parent, 3 AS fields, true AS resolved")
def _(s, d):
    return Z.collection_plan(_nodes(s, d), ROOT, [KEY, QTY, FLAG, NUM], {ITEM: {"strategy": "aggregate", "function": "sum"}})


@query("x25_bounded_preview", "SELECT CAST(least(count(*), 200) AS BIGINT) AS shown, count(*) > 200 AS truncated FROM orders")
def _(s, d):
    rows, more = Z.preview(X.extract(_nodes(s, d), ROOT, {"key": KEY}))
    return s.createDataFrame([(len(rows), more)], "shown long, truncated boolean")


@query("x27_collection_inventory", "SELECT 'orders-' || b AS source_file, CASE WHEN b % 5 = 0 THEN 'failed' ELSE 'parsed' END AS status FROM " + _BLOCKS)
def _(s, d):
    broken = F.when(F.substring_index("source_file", "-", -1) % 5 == 0, F.concat(F.lit("<!DOCTYPE x>").cast("binary"), F.col("content"))).otherwise(F.col("content"))
    return Z.collection_inventory(shred_documents(_documents(s, d).withColumn("content", broken))).select("source_file", "status")


@query("x30_complete_link_groups", f"SELECT source_file, CAST(dense_rank() OVER (ORDER BY first) AS INT) AS \"group\" FROM (SELECT source_file, min(source_file) OVER (PARTITION BY CASE kind WHEN 'priced' THEN 'plain' ELSE kind END) AS first FROM {VARIED})")
def _(s, d):
    return Z.complete_link_groups(_varied_nodes(s, d))


@query("x32_review", f"SELECT CASE reason WHEN 'different_expanded_root_qname' THEN 'incompatible' WHEN 'mixed_content_shape_differs' THEN 'review_required' ELSE 'compatible_variant_candidate' END AS classification, reason, count(*) AS pairs, reason <> 'null_tolerant_shared_record_root' AS blocking FROM (SELECT {_REASON} AS reason FROM (SELECT DISTINCT kind FROM {VARIED}) x JOIN (SELECT DISTINCT kind FROM {VARIED}) y ON x.kind < y.kind) GROUP BY 2, 1, 4")
def _(s, d):
    n = _varied_nodes(s, d)
    return Z.review(n, n.select("source_file").distinct())


@query("x33_shared_roots", f"SELECT '{ROOT}' AS path, count(*) AS sources, min(n) AS min_records, 1.0 AS score FROM {_BLOCKS} UNION ALL SELECT '{ITEM}', count(*), CAST(min(n) AS BIGINT), 0.8 FROM {_LINES}")
def _(s, d):
    return Z.shared_roots(_nodes(s, d))


@query("x33_field_catalog", f"SELECT p AS path, present, (SELECT count(*) FROM {_BLOCKS}) - present AS missing, repeated_in FROM (SELECT '{ROOT}/status' AS p, count(*) AS present, 0 AS repeated_in FROM {_BLOCKS} UNION ALL SELECT '{ROOT}/price', count(*), 0 FROM {_BLOCKS} WHERE b % 4 <> 0 UNION ALL SELECT '{ITEM}', count(*), count(*) FILTER (WHERE most > 1) FROM {_LINES} UNION ALL SELECT '{ITEM}/qty', count(*), 0 FROM {_LINES} UNION ALL SELECT '{ITEM}/flag', count(*), 0 FROM {_LINES})")
def _(s, d):
    return Z.field_catalog(_nodes(s, d), ROOT)


@query("x34_align_recipe", f"SELECT 'orders-' || b AS source_file, f AS field, CASE f WHEN 'lang' THEN 'attribute_absent' WHEN 'price' THEN CASE WHEN b % 4 = 0 THEN 'path_absent' ELSE 'aligned' END ELSE 'aligned' END AS status FROM {_BLOCKS}, (VALUES ('key'), ('price'), ('lang')) t(f)")
def _(s, d):
    return Z.align_recipe(_nodes(s, d), ROOT, {"key": KEY, "price": PRICE, "lang": f"attribute:{ROOT}@lang"})


@query("x35_full_recipe", f"SELECT '{ROOT}' AS root, f AS field, r AS strategy FROM (VALUES ('{KEY}', 'first'), ('{STATUS}', 'first'), ('{NIL}', 'first'), ('{PRICE}', 'first'), ('{QTY}', 'keep_nested'), ('{FLAG}', 'keep_nested'), ('{NUM}', 'keep_nested')) t(f, r)")
def _(s, d):
    return Z.full_recipe(_nodes(s, d))


@query("x36_align_columns", "SELECT n_name, n_regionkey, n_nationkey FROM nation UNION ALL SELECT r_name, r_regionkey, NULL FROM region")
def _(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return Z.align_columns([(n, {"n_name": "name", "n_regionkey": "region", "n_nationkey": "nation"}), (r, {"r_name": "name", "r_regionkey": "region"})])


@query("x37_null_catalog", f"SELECT field, CASE field WHEN 'price' THEN (SELECT count(*) FROM {_BLOCKS} WHERE b % 4 <> 0) ELSE (SELECT count(*) FROM {_BLOCKS}) END AS present_sources, CASE field WHEN 'price' THEN (SELECT count(*) FROM {_BLOCKS} WHERE b % 4 = 0) ELSE 0 END AS missing_sources, count(*) AS records, count(*) FILTER (WHERE status = 'value') AS \"values\", count(*) FILTER (WHERE status <> 'value') AS nulls FROM ({_REASONS}) WHERE field IN ('status', 'price') GROUP BY 1")
def _(s, d):
    return Z.null_catalog(_nodes(s, d), ROOT, {"status": STATUS, "price": PRICE})


_COMMENT = "CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN '{\"price\":\"path_absent\",\"status\":\"explicit_xsi_nil\"}' WHEN 1 THEN '{\"price\":\"path_absent\",\"status\":\"empty_element\"}' ELSE '{\"price\":\"path_absent\"}' END WHEN o_orderkey % 3 = 0 THEN '{\"status\":\"explicit_xsi_nil\"}' WHEN o_orderkey % 3 = 1 THEN '{\"status\":\"empty_element\"}' END"
_MAIN = f"SELECT 'orders-' || {BLOCK_SQL} AS __source_file, CAST(row_number() OVER (PARTITION BY {BLOCK_SQL} ORDER BY o_orderkey) AS BIGINT) AS __source_row, CAST(o_orderkey AS VARCHAR) AS key, {_STATUS} AS status, CASE WHEN o_orderkey % 4 <> 0 THEN printf('%.2f', o_totalprice) END AS price, {_COMMENT} AS Comments FROM orders"


def _main(s, d):
    return Z.consolidated(_nodes(s, d), ROOT, {"key": KEY, "status": STATUS, "price": PRICE})


@query("x41_consolidated", _MAIN)
def _(s, d):
    return _main(s, d)


@query("x42_consolidated_preview", f"SELECT * FROM ({_MAIN}) WHERE __source_row <= 25")
def _(s, d):
    return Z.source_preview(_main(s, d))


@query("x43_representations", f"SELECT * FROM (VALUES ('/orders', ['object', 'content_tokens', 'path_tokens', 'linked_children']), ('{ROOT}', ['object', 'list', 'content_tokens', 'path_tokens', 'linked_children']), ('{ITEM}', ['object', 'list', 'content_tokens', 'path_tokens', 'linked_children']), ('{ROOT}/status', ['scalar', 'object', 'content_tokens', 'path_tokens']), ('{ROOT}/price', ['scalar', 'content_tokens', 'path_tokens']), ('{ITEM}/qty', ['scalar', 'content_tokens', 'path_tokens']), ('{ITEM}/flag', ['scalar', 'content_tokens', 'path_tokens'])) t(path, kinds)")
def _(s, d):
    return Z.representations(_nodes(s, d))


_N = "(SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


@query("x44_typed_records", f"SELECT {BLOCK_SQL.replace('o_orderkey', 'k')} AS b, CAST(sum(2 * n + CAST(k % 3 = 2 AS INT) + CAST(k % 4 <> 0 AS INT)) AS BIGINT) AS content, CAST(sum(3 * n + 2 + CAST(k % 4 <> 0 AS INT)) AS BIGINT) AS paths, CAST(sum(n + 1 + CAST(k % 4 <> 0 AS INT)) AS BIGINT) AS children FROM {_N} GROUP BY 1")
def _(s, d):
    r = Z.typed_records(_nodes(s, d), ROOT)
    total = lambda c: F.sum(F.size(c)).cast("long")
    return r.groupBy(F.substring_index("source_file", "-", -1).cast("long").alias("b")).agg(total("content_tokens").alias("content"), total("path_tokens").alias("paths"), total("children").alias("children"))


@query("x45_json_lines", "SELECT count(*) AS rows, true AS verified, count(*) AS ids FROM orders")
def _(s, d):
    out = S.write_json_lines(Z.identified_records(_documents(s, d), ROOT, F.sha2("source_file", 256)), fresh_path(s, "json-lines"))
    return out["table"].agg(F.count_distinct("id").alias("ids")).select(F.lit(out["rows"]).cast("long").alias("rows"), F.lit(out["verified"]).alias("verified"), "ids")


@query("x48_recipe_changes", f"SELECT f AS field, CASE WHEN f = '{PRICE}' THEN 'added' ELSE 'unchanged' END AS change FROM (VALUES ('{KEY}'), ('{STATUS}'), ('{NIL}'), ('{PRICE}'), ('{QTY}'), ('{FLAG}'), ('{NUM}')) t(f)")
def _(s, d):
    n = _nodes(s, d)
    old = Z.full_recipe(n.filter("substring_index(source_file, '-', -1) % 4 = 0"))
    return Z.recipe_changes(old, Z.full_recipe(n))
