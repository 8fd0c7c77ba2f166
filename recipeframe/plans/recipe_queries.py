"""Queries over the recipe operations, joins and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeframe.operators import recipe as R
from recipeframe.plans.registry import query, table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(f"`{f.name}`", digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def round_signed(c, digits: int = 6):
    """A double rounded as the SQL twins do it: half away from zero after scaling, and what is below zero stays there (-0.0)."""
    up = F.abs(c) * F.lit(float(10**digits))
    return F.when(F.isnan(c) | (up == F.lit(float("inf"))), c).otherwise(F.signum(c) * F.round(up) / F.lit(float(10**digits)))


def _events(spark, d):
    """Events with holes: every seventh value and every fifth type of user is missing."""
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return R.prepare(e, ["event_id"])


EVENTS = "(SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type FROM events)"
SOURCES = {
    "events": _events,
    "orders": lambda s, d: R.prepare(table(s, d, "orders"), ["o_orderkey"]),
    "customer": lambda s, d: R.prepare(table(s, d, "customer"), ["c_custkey"]),
    "part": lambda s, d: R.prepare(table(s, d, "part"), ["p_partkey"]),
    "documents": lambda s, d: R.prepare(table(s, d, "documents"), ["doc_id"]),
    "lineitem": lambda s, d: R.prepare(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "nation": lambda s, d: R.prepare(table(s, d, "nation"), ["n_nationkey"]),
}


def recipe_query(name: str, source: str, steps, sql: str, tables=()):
    steps = [steps] if isinstance(steps, dict) else steps

    @query(name, sql)
    def build(spark: SparkSession, d: str) -> DataFrame:
        return rounded(R.run_recipe(SOURCES[source](spark, d), steps, {t: table(spark, d, t) for t in tables}))


op = lambda kind, **o: {"type": kind, **o}

# ---- the flagship: filter, coerce, derive, join, pivot

recipe_query(
    "recipe_orders", "orders",
    [
        op("filter_rows", column="o_totalprice", operator="gt", value=1000),
        op("coerce_types", mapping={"o_totalprice": "float", "o_custkey": "float"}),
        op("derive", target="price_per_key", method="arithmetic", left="o_totalprice", right="o_custkey", operator="divide"),
        op("join", right="customer", left_on="o_custkey", right_on="c_custkey", how="left"),
        op("pivot", index=["c_mktsegment"], columns="o_orderstatus", values="price_per_key", aggfunc="sum"),
    ],
    """SELECT c_mktsegment, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / nullif(o_custkey, 0) END), 6) AS "F", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / nullif(o_custkey, 0) END), 6) AS "O",
       round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice / nullif(o_custkey, 0) END), 6) AS "P" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1""",
    ("customer",),
)

# ---- columns

recipe_query("p01_select_columns", "orders", op("select_columns", columns=["o_orderstatus", "o_orderkey"]), "SELECT o_orderstatus, o_orderkey FROM orders")
recipe_query("p02_drop_columns", "orders", op("drop_columns", columns=["o_totalprice", "o_orderdate"]), "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
recipe_query("p04_rename_columns", "customer", op("rename_columns", mapping={"c_custkey": "key", "c_name": "label"}), "SELECT c_custkey AS key, c_name AS label, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
recipe_query("p05_reorder_columns", "nation", op("reorder_columns", columns=["n_name"]), "SELECT n_name, n_nationkey, n_regionkey FROM nation")


@query("p03_drop_quality_columns", "SELECT event_id, user_id, round(value, 6) AS value FROM " + EVENTS)
def _(spark, d):
    df = _events(spark, d).drop("event_type").withColumns({"nothing": F.lit(None).cast("string"), "same": F.lit(1)})
    return rounded(R.run_recipe(df, [op("drop_quality_columns", constant=True)]))


# ---- types

RAW = """(SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'yes' WHEN 1 THEN ' F ' WHEN 2 THEN '12' WHEN 3 THEN '3.5' WHEN 4 THEN '2024-02-03' WHEN 5 THEN 'oops' WHEN 6 THEN '0' WHEN 7 THEN '-7.0' END AS raw FROM events)"""


def _raw(spark, d):
    c = F.expr("CASE event_id % 9 WHEN 0 THEN 'yes' WHEN 1 THEN ' F ' WHEN 2 THEN '12' WHEN 3 THEN '3.5' WHEN 4 THEN '2024-02-03' WHEN 5 THEN 'oops' WHEN 6 THEN '0' WHEN 7 THEN '-7.0' END")
    return R.prepare(table(spark, d, "events").select("event_id", c.alias("raw")), ["event_id"])


SOURCES["raw"] = _raw
_DOUBLE = "try_cast(raw AS DOUBLE)"
recipe_query("p06a_coerce_string", "events", op("coerce_types", mapping={"user_id": "string"}), f"SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, round(value, 6) AS value, event_type FROM {EVENTS}")
recipe_query("p06b_coerce_integer", "raw", op("coerce_types", mapping={"raw": "integer"}), f"SELECT event_id, CASE WHEN abs({_DOUBLE} - round({_DOUBLE})) <= 1e-12 THEN CAST({_DOUBLE} AS BIGINT) END AS raw FROM {RAW}")
recipe_query("p06c_coerce_float", "raw", op("coerce_types", mapping={"raw": "float"}), f"SELECT event_id, {_DOUBLE} AS raw FROM {RAW}")
recipe_query("p06d_coerce_boolean", "raw", op("coerce_types", mapping={"raw": "boolean"}), f"SELECT event_id, CASE WHEN lower(trim(raw)) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(trim(raw)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS raw FROM {RAW}")
recipe_query("p06f_coerce_category", "orders", [op("coerce_types", mapping={"o_orderpriority": "category"}), op("select_columns", columns=["o_orderkey", "o_orderpriority"])], "SELECT o_orderkey, o_orderpriority FROM orders")


@query("p06e_coerce_datetime", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def _(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))
    out = R.run_recipe(text, [op("coerce_types", mapping={"at": "datetime"})])
    return out.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "p06g_coercion_failures",
    f"""SELECT 'boolean' AS target, count(*) FILTER (WHERE raw IS NOT NULL AND lower(trim(raw)) NOT IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0')) AS failures FROM {RAW}
    UNION ALL SELECT 'float', count(*) FILTER (WHERE raw IS NOT NULL AND {_DOUBLE} IS NULL) FROM {RAW}
    UNION ALL SELECT 'integer', count(*) FILTER (WHERE raw IS NOT NULL AND ({_DOUBLE} IS NULL OR abs({_DOUBLE} - round({_DOUBLE})) > 1e-12)) FROM {RAW}""",
)
def _(spark, d):
    df, out = _raw(spark, d), None
    for target in ("boolean", "float", "integer"):
        one = R.coercion_failures(df, {"raw": target}).select(F.lit(target).alias("target"), "failures")
        out = one if out is None else out.unionByName(one)
    return out


# ---- missing values

recipe_query("p07_sentinel_to_missing", "orders", [op("sentinel_to_missing", columns=["o_orderstatus", "o_custkey"], values=["P", 10, 11]), op("select_columns", columns=["o_orderkey", "o_orderstatus", "o_custkey"])], "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_custkey NOT IN (10, 11) THEN o_custkey END AS o_custkey FROM orders")
_FILL = "SELECT event_id, user_id, round({}, 6) AS value, {} AS event_type FROM " + EVENTS
recipe_query("p08a_fill_constant", "events", [op("fill_missing", columns=["value"], value=-1.0), op("fill_missing", columns=["event_type"], value="none")], _FILL.format("coalesce(value, -1)", "coalesce(event_type, 'none')"))
recipe_query("p08b_fill_mean_median", "events", [op("derive", target="other", method="arithmetic", left="value", right="value"), op("fill_missing", columns=["value"], method="mean"), op("fill_missing", columns=["other"], method="median")], f"SELECT event_id, user_id, round(coalesce(value, avg(value) OVER ()), 6) AS value, event_type, round(coalesce(value + value, quantile_cont(value + value, 0.5) OVER ()), 6) AS other FROM {EVENTS}")
recipe_query("p08c_fill_mode", "events", op("fill_missing", columns=["event_type"], method="mode"), _FILL.format("value", f"coalesce(event_type, (SELECT event_type FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"))
recipe_query("p08d_fill_forward", "events", op("fill_missing", columns=["value", "event_type"], method="forward"), _FILL.format("last_value(value IGNORE NULLS) OVER w", "last_value(event_type IGNORE NULLS) OVER w") + " WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
recipe_query("p08e_fill_backward", "events", op("fill_missing", columns=["value", "event_type"], method="backward"), _FILL.format("first_value(value IGNORE NULLS) OVER w", "first_value(event_type IGNORE NULLS) OVER w") + " WINDOW w AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
recipe_query("p09_drop_missing_rows", "events", op("drop_missing_rows", columns=["value", "event_type"], how="all"), f"SELECT event_id, user_id, round(value, 6) AS value, event_type FROM {EVENTS} WHERE value IS NOT NULL OR event_type IS NOT NULL")

# ---- row filters

_ROWS = f"SELECT event_id, user_id, round(value, 6) AS value, event_type FROM {EVENTS} WHERE "
recipe_query("p10_filter_missing", "events", op("filter_rows", column="value", operator="is_missing"), _ROWS + "value IS NULL")
recipe_query("p11_filter_not_contains", "events", op("filter_rows", column="event_type", operator="not_contains", value="LI"), _ROWS + "NOT coalesce(contains(lower(event_type), 'li'), false)")
recipe_query("p11_filter_contains_regex", "events", op("filter_rows", column="event_type", operator="contains", value="^c.*k$", regex=True, case_sensitive=True), _ROWS + "regexp_matches(event_type, '^c.*k$')")
recipe_query("p12_filter_not_in", "events", op("filter_rows", column="event_type", operator="not_in", value=["click", "view"]), _ROWS + "event_type IS NULL OR event_type NOT IN ('click', 'view')")
recipe_query("p13_filter_number", "events", op("filter_rows", column="value", operator="ge", value=10), _ROWS + "value >= 10")
recipe_query("p14_filter_ne", "events", op("filter_rows", column="event_type", operator="ne", value="click"), _ROWS + "event_type IS DISTINCT FROM 'click'")

# ---- text and derived columns

recipe_query("p15_clean_strings", "documents", [op("clean_strings", columns=["text"], collapse_whitespace=True, case="lower"), op("derive", target="size", method="regex_extract", source="text", pattern="^(\\S*)"), op("select_columns", columns=["doc_id", "size"])], "SELECT doc_id, regexp_extract(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), '^(\\S*)', 1) AS size FROM documents")
recipe_query("p16_derive_regex", "part", [op("derive", target="num", method="regex_extract", source="p_brand", pattern="([A-Za-z]+)#?([0-9])", group=1), op("select_columns", columns=["p_partkey", "num"])], "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '([A-Za-z]+)#?([0-9])') THEN regexp_extract(p_brand, '([A-Za-z]+)#?([0-9])', 2) END AS num FROM part")
recipe_query("p17_derive_combine", "events", op("derive", target="both", method="combine_text", columns=["event_type", "user_id"], separator="|"), f"SELECT event_id, user_id, round(value, 6) AS value, event_type, coalesce(event_type, '') || '|' || user_id AS both FROM {EVENTS}")
recipe_query("p18_derive_arithmetic", "lineitem", [op("derive", target="net", method="arithmetic", left="l_extendedprice", right="l_discount", operator="multiply"), op("derive", target="ratio", method="arithmetic", left="l_extendedprice", right="l_discount", operator="divide"), op("select_columns", columns=["l_orderkey", "l_linenumber", "net", "ratio"])], "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 6) AS net, CASE WHEN l_discount <> 0 THEN round(l_extendedprice / l_discount, 6) END AS ratio FROM lineitem")
recipe_query("p19_one_hot", "orders", [op("select_columns", columns=["o_orderkey", "o_orderstatus"]), op("encode_categorical", columns=["o_orderstatus"], drop_first=True)], "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders")
recipe_query("p20_ordinal", "orders", [op("select_columns", columns=["o_orderkey", "o_orderstatus"]), op("encode_categorical", columns=["o_orderstatus"], method="ordinal", mappings={"o_orderstatus": {"O": 1, "F": 2}})], "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS o_orderstatus FROM orders")

# ---- numbers

_Q = "(SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_extendedprice, 0.25) AS e1, quantile_cont(l_extendedprice, 0.75) AS e3 FROM lineitem)"
_LINES = op("select_columns", columns=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
recipe_query("p21_scale_standard", "lineitem", [_LINES, op("scale", columns=["l_quantity", "l_extendedprice"])], "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem")
recipe_query("p21_scale_minmax", "lineitem", [_LINES, op("scale", columns=["l_quantity"], method="minmax")], "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem")
recipe_query("p21_scale_robust", "lineitem", [_LINES, op("scale", columns=["l_quantity"], method="robust")], f"SELECT l_orderkey, l_linenumber, round((l_quantity - q2) / (q3 - q1), 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem, {_Q}")
recipe_query("p22_clip_outliers", "lineitem", [_LINES, op("outliers", columns=["l_extendedprice"], iqr_multiplier=0.5)], f"SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(greatest(least(l_extendedprice, e3 + 0.5 * (e3 - e1)), e1 - 0.5 * (e3 - e1)), 6) AS l_extendedprice FROM lineitem, {_Q}")
recipe_query("p23_drop_outliers", "lineitem", [_LINES, op("outliers", columns=["l_extendedprice", "l_quantity"], method="drop_iqr", iqr_multiplier=0.4)], f"SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem, {_Q} WHERE l_extendedprice BETWEEN e1 - 0.4 * (e3 - e1) AND e3 + 0.4 * (e3 - e1) AND l_quantity BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)")

# ---- joins: missing keys meet missing keys

_KEYED = f"(SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM {EVENTS} WHERE coalesce(event_type, '') <> 'click' GROUP BY 1)"


def _join_query(name, how, sql_how):
    @query(name, f"SELECT coalesce(l.event_type, r.event_type) AS event_type, event_id, user_id, n FROM (SELECT event_id, user_id, event_type FROM {EVENTS} WHERE event_type IS DISTINCT FROM 'view') l {sql_how} JOIN {_KEYED} r ON l.event_type IS NOT DISTINCT FROM r.event_type")
    def build(spark, d):
        e = _events(spark, d)
        right = e.filter("coalesce(event_type, '') <> 'click'").groupBy("event_type").agg(F.count("*").alias("n"))
        left = e.filter(~F.col("event_type").eqNullSafe(F.lit("view"))).drop("value")
        return R.run_recipe(left, [op("join", right="r", on="event_type", how=how), op("select_columns", columns=["event_type", "event_id", "user_id", "n"])], {"r": right})


for _id, _how, _sql in (("j01_join_inner", "inner", "INNER"), ("j02_join_left", "left", "LEFT"), ("j03_join_right", "right", "RIGHT"), ("j04_join_outer", "outer", "FULL")):
    _join_query(_id, _how, _sql)

# ---- shapes and duplicates

for _agg, _sql in (("mean", "avg(value)"), ("sum", "coalesce(sum(value), CASE WHEN count(*) > 0 THEN 0 END)"), ("min", "min(value)"), ("max", "max(value)"), ("first", "arg_min(value, event_id)"), ("last", "arg_max(value, event_id)"), ("count", "CASE WHEN count(*) > 0 THEN count(value) END")):
    _cells = ", ".join(f"round({_sql.replace(')', f") FILTER (WHERE event_type = '{t}')", 1) if _agg not in ('sum', 'count') else ('coalesce(sum(value) FILTER (WHERE event_type = ' + repr(t) + '), CASE WHEN count(*) FILTER (WHERE event_type = ' + repr(t) + ') > 0 THEN 0 END)' if _agg == 'sum' else 'CASE WHEN count(*) FILTER (WHERE event_type = ' + repr(t) + ') > 0 THEN count(value) FILTER (WHERE event_type = ' + repr(t) + ') END')}, 6) AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view"))
    _where = "" if _agg in ("sum", "count") else "WHERE value IS NOT NULL"
    recipe_query(f"a01_pivot_{_agg}", "events", op("pivot", index="user_id", columns="event_type", values="value", aggfunc=_agg), f"SELECT user_id, {_cells} FROM {EVENTS} {_where + (' AND' if _where else 'WHERE')} event_type IS NOT NULL GROUP BY 1")
recipe_query("a02_melt", "lineitem", op("melt", id_vars=["l_orderkey", "l_linenumber"], value_vars=["l_quantity", "l_tax"]), "SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, round(l_quantity, 6) AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', round(l_tax, 6) FROM lineitem")
_DUP = "SELECT event_id, user_id, round(value, 6) AS value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {}) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM " + EVENTS + ") WHERE {} = 1"
recipe_query("a03_drop_duplicates_first", "events", op("drop_duplicates", columns=["user_id", "event_type"]), _DUP.format("", "k"))
recipe_query("a03_drop_duplicates_last", "events", op("drop_duplicates", columns=["user_id", "event_type"], keep="last"), _DUP.format("DESC", "k"))
recipe_query("a03_drop_duplicates_none", "events", op("drop_duplicates", columns=["user_id", "event_type"], keep=False), _DUP.format("", "n"))

# ---- edits, diagnostics, previews


@query("p24_cell_edits", f"SELECT event_id, user_id, CASE WHEN event_id = 3 THEN 0.5 ELSE round(value, 6) END AS value, CASE WHEN event_id = 4 THEN 'edited' ELSE event_type END AS event_type FROM {EVENTS}")
def _(spark, d):
    edits = spark.createDataFrame([(3, "value", "0.5"), (4, "event_type", "edited")], "row long, column string, value string")
    return rounded(R.patch_cells(_events(spark, d), edits).drop(R.ROW))


_STEPS = [op("filter_rows", column="value", operator="not_missing"), op("fill_missing", columns=["event_type"], value="none"), op("coerce_types", mapping={"event_type": "boolean"})]


@query(
    "p26_recipe_diagnostics",
    f"""WITH e AS (SELECT * FROM {EVENTS}), s AS (SELECT count(*) AS n, count(value) AS v, count(*) - count(event_type) AS t, count(*) FILTER (WHERE value IS NOT NULL AND event_type IS NULL) AS vt FROM e)
    SELECT 0 AS "index", 'filter_rows' AS type, n AS rows_before, v AS rows_after, 0 AS changed_cells, 0 AS affected_rows, 0 AS coercion_failures, n - v + t AS missing_before, vt AS missing_after FROM s
    UNION ALL SELECT 1, 'fill_missing', v, v, vt, vt, 0, vt, 0 FROM s UNION ALL SELECT 2, 'coerce_types', v, v, v, v, v, 0, v FROM s""",
)
def _(spark, d):
    return R.diagnose(_events(spark, d), _STEPS).select("index", "type", "rows_before", "rows_after", "changed_cells", "affected_rows", "coercion_failures", "missing_before", "missing_after")


@query("p27_changed_cells", f"SELECT event_id AS _row_id, 'event_type' AS \"column\", event_type AS before, upper(event_type) AS after FROM {EVENTS} WHERE event_type IS NOT NULL")
def _(spark, d):
    df = _events(spark, d)
    return R.changes(df, R.apply_recipe(df, [op("clean_strings", columns=["event_type"], case="upper")]))


@query("p28_recipe_preview", f"SELECT event_id, event_type FROM {EVENTS} WHERE value > 20 ORDER BY event_id LIMIT 25")
def _(spark, d):
    steps = [op("filter_rows", column="value", operator="gt", value=20), op("select_columns", columns=["event_id", "event_type"])]
    return R.apply_recipe(_events(spark, d), steps).orderBy(R.ROW).limit(25).drop(R.ROW)
