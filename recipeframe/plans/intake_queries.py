"""Queries over delimited files, made from the customers: a file for each two hundred of them, of six kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeframe.functions.shared import fresh_path
from recipeframe.plans.registry import query, table
from recipeframe.sources import delimited as D

#: What sets the files apart, by block modulo six.
KINDS = ("comma", "semicolon", "tab", "repeated", "wide", "binary")
_FILES: dict = {}


def _files(s, d) -> str:
    """The folder of the files, written once for each session and set of tables."""
    key = (s.sparkContext.applicationId, d)
    if key in _FILES:
        return _FILES[key]
    c = table(s, d, "customer").withColumn("block", F.expr("c_custkey div 200")).withColumn("kind", F.col("block") % len(KINDS))
    sep = F.when(F.col("kind") == 1, ";").when(F.col("kind") == 2, "\t").otherwise(",")
    cells = [F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", sep, F.lit('"')), F.format_string("%.2f", "c_acctbal")]
    line = F.concat(cells[0], sep, cells[1], sep, cells[2], F.when((F.col("kind") == 4) & (F.col("c_custkey") % 7 == 0), F.concat(sep, F.lit("more"))).otherwise(""))
    lines = c.groupBy("block", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("x")))), lambda i: i["x"]), "\n").alias("body"), F.first(sep).alias("sep"))
    head = F.when(F.col("kind") == 3, F.lit("key,,key")).otherwise(F.concat(F.lit("key"), "sep", F.lit("name"), "sep", F.lit("balance")))
    text = F.concat(head, F.lit("\n"), "body", F.when(F.col("kind") == 5, F.lit("\u0000")).otherwise(""))
    path = fresh_path(s, "delimited")
    lines.select("block", "kind", text.alias("value")).repartition("block").write.partitionBy("kind", "block").text(path)
    _FILES[key] = path
    return path


_BLOCKS = "(SELECT c_custkey // 200 AS block, c_custkey // 200 % 6 AS kind, count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 = 0) AS wide FROM customer GROUP BY 1, 2)"


def _of(name):
    return F.regexp_extract("path", f"{name}=([0-9]+)", 1).cast("long").alias(name)


@query("s01_discovery", f"SELECT block, kind FROM {_BLOCKS}")
def _(s, d):
    return D.discover(s, _files(s, d)).select(_of("block"), _of("kind"))


@query("s03_s04_s08_dialects", f"SELECT block, CASE WHEN kind < 5 THEN 'utf-8' END AS encoding, CASE kind WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 5 THEN NULL ELSE ',' END AS delimiter, CASE WHEN kind < 5 THEN '\"' END AS quote, CASE WHEN kind < 5 THEN true END AS has_header, CASE kind WHEN 3 THEN 'key|column_2|key.1' WHEN 5 THEN NULL ELSE 'key|name|balance' END AS columns, CASE WHEN kind < 5 THEN 3 END AS width FROM {_BLOCKS}")
def _(s, d):
    f = D.inspect_files(D.discover(s, _files(s, d)))
    return f.select(_of("block"), "encoding", "delimiter", "quote", "has_header", F.when(F.col("columns").isNotNull(), F.array_join("columns", "|")).alias("columns"), F.col("modal_width").alias("width"))


@query("s05_read", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ';' AS name, printf('%.2f', c_acctbal) AS balance FROM customer WHERE c_custkey // 200 % 6 = 1")
def _(s, d):
    if not _has(s, d, 1):
        return s.createDataFrame([], "key string, name string, balance string")
    return D.regular_rows(D.read_delimited(s, f"{_files(s, d)}/kind=1", ["key", "name", "balance"], ";"), 3, ";").select("key", "name", "balance")


@query("s06_malformed", "SELECT count(*) FILTER (WHERE c_custkey % 7 = 0) AS malformed, count(*) FILTER (WHERE c_custkey % 7 <> 0) AS kept, CASE WHEN count(*) FILTER (WHERE c_custkey % 7 = 0) > 0 THEN '4 of 3' END AS observed FROM customer WHERE c_custkey // 200 % 6 = 4")
def _(s, d):
    if not _has(s, d, 4):
        return s.createDataFrame([(0, 0, None)], "malformed long, kept long, observed string")
    df = D.read_delimited(s, f"{_files(s, d)}/kind=4", ["key", "name", "balance"])
    n, first = D.malformed_rows(df, 3)
    kept = D.regular_rows(df, 3, allow_malformed=True)
    seen = {f"{m.observed} of {m.expected}" for m in first}
    return kept.agg(F.lit(n).cast("long").alias("malformed"), F.count("key").alias("kept"), F.lit(",".join(sorted(seen)) or None).cast("string").alias("observed"))


def _has(s, d, kind: int) -> bool:
    return table(s, d, "customer").filter(f"c_custkey div 200 % 6 = {kind}").limit(1).count() > 0


@query("s09_exported_index", "SELECT 'c_custkey' AS \"column\", false AS exported_index FROM (SELECT 1) UNION ALL SELECT 'row_number', true UNION ALL SELECT 'column_1', true UNION ALL SELECT 'column_2', false UNION ALL SELECT 'rownum', false")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") - F.lit(table(s, d, "customer").agg(F.min("c_custkey")).first()[0])).alias("n"))
    c = c.select("c_custkey", *[F.col("n").alias(x) for x in ("row_number", "column_1", "column_2")], (F.col("n") * 2).alias("rownum"))
    asked = [("c_custkey", None, False), ("row_number", None, False), ("column_1", "", True), ("column_2", "", False), ("rownum", None, False)]
    parts = [D.exported_index(c, name, raw, first) for name, raw, first in asked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("s10_s11_inventory", f"SELECT CASE WHEN kind = 5 THEN 'failed' ELSE 'parsed' END AS status, count(*) AS files FROM {_BLOCKS} GROUP BY 1")
def _(s, d):
    return D.inventory_summary(D.inspect_files(D.discover(s, _files(s, d)))).select("status", "files")


@query("s12_load_features", "SELECT CAST(c_custkey AS VARCHAR) AS key, printf('%.2f', c_acctbal) AS balance FROM customer WHERE c_custkey // 200 % 6 IN (0, 1)")
def _(s, d):
    frames = [D.regular_rows(D.read_delimited(s, f"{_files(s, d)}/kind={k}", ["key", "name", "balance"], sep), 3, sep) for k, sep in ((0, ","), (1, ";")) if _has(s, d, k)]
    return D.load_features(frames, ["balance"], ["key"])[0]


@query("p31_column_roles", "SELECT 'c_acctbal' AS target, 'c_custkey,c_name,c_nationkey' AS features, 'c_mktsegment' AS ignored, count(*) AS rows FROM customer")
def _(s, d):
    c = table(s, d, "customer")
    roles = D.column_roles([*c.columns, "Comments"], [x for x in c.columns if x not in ("c_acctbal", "c_mktsegment")], ["c_acctbal"])
    ignored = [x for x in roles["ignored"] if x not in D.RESERVED]
    return c.agg(F.lit(",".join(roles["targets"])).alias("target"), F.lit(",".join(sorted(roles["features"]))).alias("features"), F.lit(",".join(ignored)).alias("ignored"), F.count("*").alias("rows"))
