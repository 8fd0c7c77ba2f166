"""Queries over XML made from orders and their lines: a document for each thousand orders.

Documents are numbered by the rest of their orders' keys by four and by the keys'
block of four thousand, so their number grows with the orders, and some have no price.

An order has ``@key``, ``status`` (nil where the key is divisible by three, empty
where the rest is one), ``price``, and an ``item`` for each line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.functions.shared import fresh_path, materialize
from recipeframe.operators import xml_tables as X
from recipeframe.operators.xml_selection import shape_pairs
from recipeframe.plans.recipe_queries import rounded
from recipeframe.plans.registry import query, table
from recipeframe.sources.xml import escape, namespaces, shred_documents
from recipeframe.streaming.xml_export import export_collection, source_states

ROOT, ITEM = "/orders/order", "/orders/order/item"
KEY, STATUS, PRICE = f"attribute:{ROOT}@key", f"text:{ROOT}/status", f"text:{ROOT}/price"
QTY, NUM, FLAG = f"text:{ITEM}/qty", f"attribute:{ITEM}@n", f"text:{ITEM}/flag"


#: An order's document, in Spark's SQL and in DuckDB's.
BLOCK, BLOCK_SQL = "o_orderkey % 4 + 4 * (o_orderkey div 4000)", "(o_orderkey % 4 + 4 * (o_orderkey // 4000))"
_WRITTEN: dict = {}


def _documents(s, d):
    """Written once for each session and set of tables."""
    key = (s.sparkContext.applicationId, d)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(_made(s, d), "documents")
    return _WRITTEN[key]


def _made(s, d):
    lines = table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_returnflag", F.concat(F.lit('<item n="'), F.col("l_linenumber"), F.lit('"><qty>'), F.col("l_quantity").cast("int"), F.lit("</qty><flag>"), escape(F.col("l_returnflag")), F.lit("</flag></item>")).alias("x")).alias("i"))
    items = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "").alias("items"))
    o = table(s, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderkey") % 3 == 0, '<status xsi:nil="true"/>').when(F.col("o_orderkey") % 3 == 1, "<status/>").otherwise(F.concat(F.lit("<status>"), escape(F.col("o_orderstatus")), F.lit("</status>")))
    price = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("<price>"), F.format_string("%.2f", "o_totalprice"), F.lit("</price>")))
    body = F.concat(F.lit('<order key="'), F.col("o_orderkey"), F.lit('">'), status, price, F.coalesce("items", F.lit("")), F.lit("</order>"))
    blocks = o.groupBy(F.expr(BLOCK).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", body.alias("x")))), lambda i: i["x"]), "").alias("x"))
    return blocks.select(F.concat(F.lit("orders-"), "b").alias("source_file"), F.concat(F.lit('<orders xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'), "x", F.lit("</orders>")).cast("binary").alias("content"))


def _nodes(s, d):
    """Parsed once and stored, for queries that read the nodes several times."""
    return materialize(_parsed(s, d), "nodes")


def _parsed(s, d):
    """For queries that read the nodes once: nothing is stored."""
    return shred_documents(_documents(s, d))


_STATUS = "CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN '' END"


@query("x46_export_states", f"SELECT 'done' AS state, count(DISTINCT {BLOCK_SQL}) AS sources, CAST(NULL AS BIGINT) AS records FROM orders UNION ALL SELECT 'exported', NULL, count(*) FROM orders")
def _(s, d):
    """Documents as files of their own, exported twice: the second run finds them all in the ledger and adds nothing."""
    files, out, check = (fresh_path(s, f"export-{x}") for x in ("in", "out", "check"))
    _documents(s, d).select("source_file", F.col("content").cast("string")).write.partitionBy("source_file").text(files)
    for _ in range(2):
        export_collection(s, files, out, check, ROOT, {"key": KEY}, pattern="*.txt")
    states = source_states(s, files, check, "*.txt").groupBy("state").agg(F.count("*").alias("sources"), F.lit(None).cast("long").alias("records"))
    return states.unionByName(s.read.parquet(out).agg(F.lit("exported").alias("state"), F.lit(None).cast("long").alias("sources"), F.count("key").alias("records")))


@query("x01_shred", f"SELECT 'order' AS tag, count(*) AS n FROM orders UNION ALL SELECT 'orders', count(DISTINCT {BLOCK_SQL}) FROM orders UNION ALL SELECT 'status', count(*) FROM orders UNION ALL SELECT 'price', count(*) FILTER (WHERE o_orderkey % 4 <> 0) FROM orders UNION ALL SELECT t, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (VALUES ('item'), ('qty'), ('flag')) v(t) GROUP BY 1")
def _(s, d):
    return _parsed(s, d).groupBy("tag").agg(F.count("*").alias("n"))


_LINES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("x02_path_profile", f"""WITH k AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    b AS (SELECT {BLOCK_SQL} AS b, count(*) AS n FROM orders GROUP BY 1)
    SELECT '{ITEM}' AS path, CAST(sum(n) AS BIGINT) AS occurrences, count(*) FILTER (WHERE n > 0) AS parents_with, min(n) AS min_per_parent, max(n) AS max_per_parent, max(n) > 1 AS repeated, min(n) = 0 AS optional, false AS leaf FROM k
    UNION ALL SELECT p, CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT), 1, 1, false, false, true FROM k, (VALUES ('{ITEM}/qty'), ('{ITEM}/flag')) t(p) GROUP BY 1
    UNION ALL SELECT '{ROOT}', CAST(sum(n) AS BIGINT), count(*), min(n), max(n), max(n) > 1, false, false FROM b
    UNION ALL SELECT '/orders', count(*), 0, 1, 1, false, false, false FROM b
    UNION ALL SELECT '{ROOT}/price', count(*) FILTER (WHERE o_orderkey % 4 <> 0), count(*) FILTER (WHERE o_orderkey % 4 <> 0), 0, 1, false, true, true FROM orders UNION ALL SELECT '{ROOT}/status', count(*), count(*), 1, 1, false, false, true FROM orders""")
def _(s, d):
    return X.path_profile(_parsed(s, d)).select("path", "occurrences", "parents_with", F.col("min_per_parent").cast("long").alias("min_per_parent"), "max_per_parent", "repeated", "optional", "leaf")


@query("x03_text_presence", f"""SELECT '{ROOT}/status' AS path, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS with_text FROM orders
    UNION ALL SELECT '{ROOT}/price', count(*) FILTER (WHERE o_orderkey % 4 <> 0) FROM orders UNION ALL SELECT p, count(*) {_LINES}, (VALUES ('{ITEM}/qty'), ('{ITEM}/flag')) t(p) GROUP BY 1
    UNION ALL SELECT * FROM (VALUES ('/orders', 0), ('{ROOT}', 0), ('{ITEM}', 0))""")
def _(s, d):
    return X.path_profile(_parsed(s, d)).select("path", "with_text")


@query("x04_attribute_profile", f"""SELECT '{ROOT}' AS path, 'key' AS name, count(*) AS present, count(DISTINCT o_orderkey) AS distinct_values, true AS likely_id FROM orders UNION ALL SELECT '{ITEM}', 'n', count(*), count(DISTINCT l_linenumber), false {_LINES}
    UNION ALL SELECT '{ROOT}/status', '{{http://www.w3.org/2001/XMLSchema-instance}}nil', count(*), 1, false FROM orders WHERE o_orderkey % 3 = 0""")
def _(s, d):
    return X.attribute_profile(_nodes(s, d)).select("path", "name", "present", "distinct_values", "likely_id")


def _customers(s, d):
    """A document for each hundred customers, in namespaces whose prefixes differ between documents."""
    c = table(s, d, "customer")
    block = F.expr("c_custkey div 100")
    prefix = F.when(block % 3 == 0, "c").otherwise("k")
    tag = lambda name, v: F.concat(F.lit("<"), prefix, F.lit(f":{name}>"), v, F.lit("</"), prefix, F.lit(f":{name}>"))
    row = F.concat(F.lit("<row>"), tag("id", F.col("c_custkey").cast("string")), tag("segment", escape(F.col("c_mktsegment"))), tag("account_id", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("")), F.lit("</row>"))
    rows = c.groupBy(block.alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("x")))), lambda i: i["x"]), "").alias("x"))
    head = F.concat(F.lit("<rows xmlns:"), F.when(F.col("b") % 3 == 0, "c").otherwise("k"), F.lit('="urn:customers" xmlns="urn:rows">'))
    return rows.select(F.concat(F.lit("customers-"), "b").alias("source_file"), F.concat(head, "x", F.lit("</rows>")).cast("binary").alias("content"))


@query("x05_text_identifiers", """SELECT p AS path, round(presence, 6) AS presence, round(rate, 6) AS distinct_rate, likely_id FROM (
    SELECT '/{urn:rows}rows' AS p, 0.0 AS presence, 0.0 AS rate, false AS likely_id UNION ALL SELECT '/{urn:rows}rows/{urn:rows}row', 0.0, 0.0, false
    UNION ALL SELECT '/{urn:rows}rows/{urn:rows}row/{urn:customers}id', 1.0, count(DISTINCT c_custkey) / count(*), count(DISTINCT c_custkey) / count(*) >= 0.95 FROM customer
    UNION ALL SELECT '/{urn:rows}rows/{urn:rows}row/{urn:customers}segment', 1.0, count(DISTINCT c_mktsegment) / count(*), false FROM customer
    UNION ALL SELECT '/{urn:rows}rows/{urn:rows}row/{urn:customers}account_id', count(*) FILTER (WHERE c_custkey % 2 = 0) / count(*), 1.0, false FROM customer)""")
def _(s, d):
    ids = X.text_identifiers(shred_documents(_customers(s, d)))
    return ids.select("path", F.round("presence", 6).alias("presence"), F.round("distinct_rate", 6).alias("distinct_rate"), "likely_id")


@query("x07_namespaces", "WITH b AS (SELECT c_custkey // 100 AS b FROM customer GROUP BY 1) SELECT 'urn:rows' AS uri, '' AS prefix, count(*) AS sources FROM b UNION ALL SELECT 'urn:customers', CASE WHEN count(*) FILTER (WHERE b % 3 = 0) >= count(*) FILTER (WHERE b % 3 <> 0) THEN 'c' ELSE 'k' END, greatest(count(*) FILTER (WHERE b % 3 = 0), count(*) FILTER (WHERE b % 3 <> 0)) FROM b")
def _(s, d):
    return X.namespace_inventory(namespaces(_customers(s, d)))


@query("x07_display_paths", "WITH b AS (SELECT c_custkey // 100 AS b FROM customer GROUP BY 1), p AS (SELECT CASE WHEN count(*) FILTER (WHERE b % 3 = 0) >= count(*) FILTER (WHERE b % 3 <> 0) THEN 'c' ELSE 'k' END AS prefix FROM b) SELECT '/rows' AS display, count(*) AS n FROM b UNION ALL SELECT '/rows/row', count(*) FROM customer UNION ALL SELECT '/rows/row/' || prefix || ':' || t, count(*) FROM customer, p, (VALUES ('id'), ('segment'), ('account_id')) v(t) GROUP BY 1")
def _(s, d):
    docs = _customers(s, d)
    paths = shred_documents(docs).groupBy("path").agg(F.count("*").alias("n"))
    return X.display_paths(paths, X.namespace_inventory(namespaces(docs))).select("display", "n")


@query("x06_record_candidates", f"SELECT '{ROOT}' AS path, 1.0 AS score UNION ALL SELECT '{ITEM}', 0.8")
def _(s, d):
    return X.record_candidates(_nodes(s, d)).filter(F.col("path").isin(ROOT, ITEM)).select("path", "score")


@query("x08_structure_summary", f"SELECT CAST((SELECT count(*) FROM (SELECT {BLOCK_SQL} FROM orders GROUP BY 1)) + (SELECT 2 * count(*) + count(*) FILTER (WHERE o_orderkey % 4 <> 0) FROM orders) + (SELECT 3 * count(*) {_LINES}) AS BIGINT) AS elements, 7 AS paths, 4 AS depth, 4 AS leaf_paths, 2 AS repeated_paths, 2 AS optional_paths")
def _(s, d):
    return X.structure_summary(_parsed(s, d)).select("elements", "paths", "depth", "leaf_paths", "repeated_paths", "optional_paths")


@query("x09_hierarchy", f"SELECT * FROM (VALUES ('/orders', NULL, 'orders'), ('{ROOT}', '/orders', 'order'), ('{ROOT}/status', '{ROOT}', 'status'), ('{ROOT}/price', '{ROOT}', 'price'), ('{ITEM}', '{ROOT}', 'item'), ('{ITEM}/qty', '{ITEM}', 'qty'), ('{ITEM}/flag', '{ITEM}', 'flag')) t(path, parent_path, label)")
def _(s, d):
    return X.hierarchy(_parsed(s, d))


@query("x13_direct_fields", f"SELECT CAST(o_orderkey AS VARCHAR) AS key, {_STATUS} AS status, CASE WHEN o_orderkey % 4 <> 0 THEN printf('%.2f', o_totalprice) END AS price FROM orders")
def _(s, d):
    return X.extract(_parsed(s, d), ROOT, {"key": KEY, "status": STATUS, "price": PRICE}).select("key", "status", "price")


_L = "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


def _strategy(name, field, rule, sql):
    @query(name, f"SELECT CAST(o_orderkey AS VARCHAR) AS key, {sql} AS v {_L}")
    def build(s, d):
        return rounded(X.extract(_parsed(s, d), ROOT, {"key": KEY, "v": field}, {"v": rule}).select("key", "v"))


_strategy("x14_keep_nested", FLAG, {"strategy": "nested"}, "coalesce(list(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_returnflag IS NOT NULL), [])")
_strategy("x15_first", FLAG, {"strategy": "first"}, "arg_min(l_returnflag, printf('%05d%s', l_linenumber, l_returnflag))")
_strategy("x16_last", FLAG, {"strategy": "last"}, "arg_max(l_returnflag, printf('%05d%s', l_linenumber, l_returnflag))")
_strategy("x17_count", f"text:{ITEM}", {"strategy": "count"}, "count(l_orderkey)")
_strategy("x18_join", FLAG, {"strategy": "join", "delimiter": "|"}, "coalesce(string_agg(l_returnflag, '|' ORDER BY l_linenumber, l_returnflag), '')")
_strategy("x19_aggregate_sum", QTY, {"strategy": "aggregate", "function": "sum"}, "sum(floor(l_quantity))")
_strategy("x19_aggregate_mean", QTY, {"strategy": "aggregate", "function": "mean"}, "round(avg(floor(l_quantity)), 6)")


@query("x20_pivot", "SELECT o_orderkey AS k, " + ", ".join(f"max(CASE WHEN l_linenumber = {i} THEN l_returnflag END) AS \"{i}\"" for i in (1, 2, 3)) + f" {_L}")
def _(s, d):
    n = _nodes(s, d)
    wide = X.pivot_branch(n, ROOT, ITEM, NUM, FLAG, ["1", "2", "3"])
    return wide.join(X.extract(n, ROOT, {"k": KEY}), ["source_file", "record"]).select(F.col("k").cast("long").alias("k"), "1", "2", "3")


@query("x21_explode_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS VARCHAR) AS n, CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS qty FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def _(s, d):
    return X.explode_rows(_nodes(s, d), ROOT, {"key": KEY}, ITEM, {"n": NUM, "qty": QTY}).select("key", "n", "qty")


@query("x22_j08_separate_table", "SELECT CAST(l_linenumber AS VARCHAR) AS n, l_returnflag AS flag, count(*) AS rows, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS parents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(s, d):
    rows = X.branch_rows(_parsed(s, d), ROOT, ITEM, {"n": NUM, "flag": FLAG})
    return rows.groupBy("n", "flag").agg(F.count("*").alias("rows"), F.count_distinct("source_file", "record").alias("parents"))


def _varied(s, d):
    """The documents, but some hold text beside their orders, and some are named otherwise."""
    b = F.substring_index("source_file", "-", -1).cast("long")
    text = F.col("content").cast("string")
    other = F.replace(F.replace(text, F.lit("<orders "), F.lit("<archive ")), F.lit("</orders>"), F.lit("</archive>"))
    return _documents(s, d).withColumn("content", F.when(b % 8 == 6, other).when(b % 8 == 2, F.replace(text, F.lit("</orders>"), F.lit("note</orders>"))).otherwise(text).cast("binary"))


def _varied_nodes(s, d):
    return materialize(shred_documents(_varied(s, d)), "nodes")


#: Sources of the varied documents, with what sets them apart.
VARIED = f"(SELECT 'orders-' || b AS source_file, CASE WHEN b % 8 = 6 THEN 'archive' WHEN b % 8 = 2 THEN 'mixed' WHEN b % 4 = 0 THEN 'plain' ELSE 'priced' END AS kind FROM (SELECT {BLOCK_SQL} AS b FROM orders GROUP BY 1))"
_REASON = "CASE WHEN (x.kind = 'archive') <> (y.kind = 'archive') THEN 'different_expanded_root_qname' WHEN x.kind = y.kind THEN 'identical_structural_fingerprint' WHEN (x.kind = 'mixed') <> (y.kind = 'mixed') THEN 'mixed_content_shape_differs' ELSE 'null_tolerant_shared_record_root' END"
_CLASS = "CASE reason WHEN 'different_expanded_root_qname' THEN 'incompatible' WHEN 'identical_structural_fingerprint' THEN 'exact' WHEN 'mixed_content_shape_differs' THEN 'review_required' ELSE 'compatible_variant_candidate' END"


@query("x28_shape_fingerprint", f"SELECT x.source_file, CAST(count(*) AS BIGINT) AS of_its_shape FROM {VARIED} x JOIN {VARIED} y ON x.kind = y.kind GROUP BY 1")
def _(s, d):
    prints = X.shape_fingerprint(_varied_nodes(s, d))
    return prints.join(prints.groupBy("shape").agg(F.count("*").alias("of_its_shape")), "shape").select("source_file", "of_its_shape")


@query("x29_shape_pairs", f"""WITH k AS (SELECT kind, min(source_file) AS rep, count(*) AS n FROM {VARIED} GROUP BY 1), c AS (SELECT x.rep AS "left", y.rep AS "right", x.kind AS xk, y.kind AS yk, {_REASON} AS reason, x.n * y.n AS pairs FROM k AS x JOIN k AS y ON x.rep < y.rep)
    SELECT "left", "right", {_CLASS} AS classification, reason, CASE WHEN reason = 'different_expanded_root_qname' THEN 0.0 WHEN (xk = 'plain') <> (yk = 'plain') THEN round(0.8 * 6 / 7 + 0.2, 6) ELSE 1.0 END AS similarity, pairs FROM c""")
def _(s, d):
    """One row for each two shapes, with how many pairs of sources it stands for: all pairs, without writing them."""
    members, pairs = shape_pairs(_varied_nodes(s, d))
    sizes = members.groupBy("representative").agg(F.count("*").alias("n"))
    of = lambda side: sizes.select(F.col("representative").alias(side), F.col("n").alias(f"n_{side}"))
    return rounded(pairs.join(of("left"), "left").join(of("right"), "right").select("left", "right", "classification", "reason", "similarity", (F.col("n_left") * F.col("n_right")).alias("pairs")))


@query("x29_pair_similarity", f"""SELECT source_file AS "left", other AS "right", {_CLASS} AS classification, reason, CASE WHEN reason = 'different_expanded_root_qname' THEN 0.0 WHEN (x = 'plain') <> (y = 'plain') THEN round(0.8 * 6 / 7 + 0.2, 6) ELSE 1.0 END AS similarity
    FROM (SELECT x.source_file, y.source_file AS other, x.kind AS x, y.kind AS y, {_REASON} AS reason FROM {VARIED} x JOIN {VARIED} y ON x.source_file < y.source_file)""")
def _(s, d):
    return X.pair_similarity(_varied_nodes(s, d)).select("left", "right", "classification", "reason", "similarity")


@query("x31_observed_union", f"SELECT '{ROOT}/price' AS path, count(DISTINCT CASE WHEN o_orderkey % 4 <> 0 THEN {BLOCK_SQL} END) AS present_sources, count(DISTINCT {BLOCK_SQL}) - count(DISTINCT CASE WHEN o_orderkey % 4 <> 0 THEN {BLOCK_SQL} END) AS missing_sources, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS occurrences, true AS optional FROM orders")
def _(s, d):
    return X.observed_union(_nodes(s, d)).filter(F.col("path") == f"{ROOT}/price")


_REASONS = "SELECT o_orderkey AS k, 'status' AS field, CASE o_orderkey % 3 WHEN 0 THEN 'explicit_xsi_nil' WHEN 1 THEN 'empty_element' ELSE 'value' END AS status FROM orders UNION ALL SELECT o_orderkey, 'price', CASE WHEN o_orderkey % 4 = 0 THEN 'path_absent' ELSE 'value' END FROM orders UNION ALL SELECT o_orderkey, 'key', 'value' FROM orders UNION ALL SELECT o_orderkey, 'lang', 'attribute_absent' FROM orders"


@query("x38_null_status", f"SELECT field, status, count(*) AS n FROM ({_REASONS}) GROUP BY 1, 2")
def _(s, d):
    r = X.null_reasons(_parsed(s, d), ROOT, {"status": STATUS, "price": PRICE, "key": KEY, "lang": f"attribute:{ROOT}@lang"})
    return r.groupBy("field", "status").agg(F.count("*").alias("n"))


@query("x40_comments", "SELECT CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN '{\"price\":\"path_absent\",\"status\":\"explicit_xsi_nil\"}' WHEN 1 THEN '{\"price\":\"path_absent\",\"status\":\"empty_element\"}' ELSE '{\"price\":\"path_absent\"}' END WHEN o_orderkey % 3 = 0 THEN '{\"status\":\"explicit_xsi_nil\"}' ELSE '{\"status\":\"empty_element\"}' END AS Comments, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 < 2 GROUP BY 1")
def _(s, d):
    return X.comments(X.null_reasons(_parsed(s, d), ROOT, {"status": STATUS, "price": PRICE})).groupBy("Comments").agg(F.count("*").alias("n"))


@query("s17_s18_null_round_trip", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '\\N' WHEN 1 THEN '\\E' WHEN 2 THEN '\\\\N' WHEN 3 THEN '\\\\\\x' ELSE o_orderstatus END AS encoded, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '\\N' WHEN 3 THEN '\\\\x' ELSE o_orderstatus END AS decoded FROM orders")
def _(s, d):
    raw = F.when(F.col("o_orderkey") % 5 == 1, "").when(F.col("o_orderkey") % 5 == 2, "\\N").when(F.col("o_orderkey") % 5 == 3, "\\\\x").when(F.col("o_orderkey") % 5 == 4, F.col("o_orderstatus"))
    e = table(s, d, "orders").select("o_orderkey", X.encode_null(raw).alias("encoded"))
    return e.withColumn("decoded", X.decode_null(F.col("encoded")))
