"""Column profiles, quality issues, relationships and feature views, as grouped aggregates.

A table is unpivoted to (column, value) once; types, counts and summaries of all
columns are then aggregates of that one table, so the number of jobs doesn't grow
with the number of columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.quantiles import column_quantiles, quantiles
from recipeframe.functions.ranks import numbered, running_sum
from recipeframe.functions.shared import materialize, nan_to_null

#: Tokens and patterns of the type rules; fixed values.
MISSING = ("", "na", "n/a", "null", "none", "nan", "missing", "<na>")
TRUE, FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
ID_NAME = r"(?i)(^id$|_id$|^id_|identifier|uuid|guid|primary[_ -]?key|^key$)"
DATE_NAME = r"(?i)date|time|timestamp|datetime|created|updated"
DATE_VALUE = r"(?:\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b|T\d{1,2}:\d{2}|\b\d{1,2}:\d{2}(?::\d{2})?\b)"


def clean_cell(c: Column) -> Column:
    """NULL for the usual tokens that mean missing."""
    text = c.cast("string")
    return F.when(~F.lower(F.trim(text)).isin(*MISSING), text)


def cells(df: DataFrame) -> DataFrame:
    """``column, position, value``: every cell as cleaned text."""
    texts = df.select(*[clean_cell(F.col(f"`{c}`")).alias(c) for c in df.columns])
    long = texts.unpivot([], list(df.columns), "column", "value")
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    return long.withColumn("position", place[F.col("column")])


def sample_rows(df: DataFrame, key: list[str], rows: int, seed: int = 42) -> DataFrame:
    """A fixed-size sample chosen by a hash of the key: the same rows every time."""
    return df.withColumn("_at", F.xxhash64(F.lit(seed), *key)).orderBy("_at", *key).limit(rows).drop("_at")


def value_counts(long: DataFrame) -> DataFrame:
    return long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def column_profiles(df: DataFrame) -> DataFrame:
    """One row for each column: type, counts, uniqueness, constancy, dominance, identifier-likeness."""
    long = cells(df)
    number = F.col("value").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    token = F.lower(F.trim("value"))
    present = F.col("value").isNotNull()
    flags = long.groupBy("column", "position").agg(
        F.count("*").alias("rows"), F.count("value").alias("non_missing"),
        F.bool_and(F.when(present, token.isin(*TRUE, *FALSE))).alias("all_boolean"),
        F.avg(F.when(present, number.isNotNull().cast("int"))).alias("numeric_rate"),
        F.bool_and(F.when(finite, F.abs(number - F.round(number)) <= 1e-12)).alias("all_integer"),
        F.avg(F.when(present, F.col("value").rlike(DATE_VALUE).cast("int"))).alias("date_rate"),
        F.avg(F.when(present, F.try_to_timestamp("value").isNotNull().cast("int"))).alias("parsed_rate"),
    )
    counts = value_counts(long).groupBy("column").agg(F.count("*").alias("unique_count"), F.max("n").alias("top"))
    own = flags.join(counts, "column", "left").withColumns({"unique_count": F.coalesce("unique_count", F.lit(0)), "missing": F.col("rows") - F.col("non_missing")})
    ratio = F.coalesce(F.try_divide("unique_count", "non_missing"), F.lit(0.0))
    limit = F.greatest(F.lit(20), F.least(F.lit(100), F.floor(F.sqrt(F.greatest("non_missing", F.lit(1))) * 2)))
    is_date = (F.col("column").rlike(DATE_NAME) | (F.col("date_rate") >= 0.8)) & (F.col("date_rate") >= 0.5) & (F.col("parsed_rate") >= 0.9)
    kind = (
        F.when(F.col("non_missing") == 0, "empty").when(F.col("all_boolean"), "boolean")
        .when((F.col("numeric_rate") >= 0.95) & F.coalesce("all_integer", F.lit(False)), "integer").when(F.col("numeric_rate") >= 0.95, "float")
        .when(is_date, "datetime").when((F.col("unique_count") <= limit) | (ratio <= 0.2), "categorical").otherwise("text")
    )
    return own.select(
        "column", "position", kind.alias("inferred_type"), "rows", "non_missing", "missing",
        F.coalesce(F.try_divide("missing", "rows"), F.lit(0.0)).alias("missing_rate"), "unique_count", ratio.alias("cardinality_ratio"),
        ((F.col("non_missing") > 0) & (F.col("unique_count") <= 1)).alias("constant"),
        F.coalesce(F.try_divide("top", "non_missing"), F.lit(0.0)).alias("dominant_rate"),
        ((F.col("non_missing") >= 2) & (ratio >= 0.8) & F.col("column").rlike(ID_NAME)).alias("likely_identifier"),
    )


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent values of each column; of equal counts the smaller value."""
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(cells(df)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def numeric_summary(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """Moments, quartiles, skew, zeros, negatives, and outliers beyond the fences of each numeric column."""
    long = df.select(*[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    long = long.filter("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    n = F.count("*")
    one = long.groupBy("column").agg(
        n.alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
        F.when(n > 2, F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.sum((F.col("value") == 0).cast("long")).alias("zero_count"), F.sum((F.col("value") < 0).cast("long")).alias("negative_count"),
    )
    one = one.join(quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).select("column", "q"), "column")
    one = one.select("*", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), (F.col("zero_count") / F.col("count")).alias("zero_rate")).drop("q")
    low, high = (F.when(F.col("iqr") > 0, F.col(e) + s * multiplier * F.col("iqr")).otherwise(F.col(e)) for e, s in (("q1", -1), ("q3", 1)))
    one = one.withColumns({"outlier_lower_bound": low, "outlier_upper_bound": high})
    outside = (F.col("iqr") > 0) & ((F.col("value") < F.col("outlier_lower_bound")) | (F.col("value") > F.col("outlier_upper_bound")))
    fences = F.broadcast(one.select("column", "iqr", "outlier_lower_bound", "outlier_upper_bound"))  # a row for each column
    found = long.join(fences, "column").groupBy("column").agg(F.sum(outside.cast("long")).alias("outlier_count"))
    return one.join(found, "column").withColumn("outlier_rate", F.col("outlier_count") / F.col("count"))


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lengths of each text column."""
    long = df.select(*[clean_cell(F.col(f"`{c}`")).alias(c) for c in columns]).unpivot([], columns, "column", "value").filter("value IS NOT NULL")
    long = long.select("column", F.length("value").alias("size"))
    sums = long.groupBy("column").agg(F.min("size").alias("min_length"), F.max("size").alias("max_length"), F.avg("size").alias("mean_length"))
    return sums.join(quantiles(long, ["column"], "size", [0.5]).select("column", F.col("q")[0].alias("median_length")), "column")


def datetime_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.select(*[F.try_to_timestamp(F.col(f"`{c}`").cast("string")).alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows, and their share."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("n"))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return sums.select("rows", "duplicates", F.coalesce(F.try_divide("duplicates", "rows"), F.lit(0.0)).alias("duplicate_rate"))


def quality_issues(profiles: DataFrame, numeric: DataFrame | None = None) -> DataFrame:
    """``severity, code, column`` of every rule that a column breaks."""
    own = profiles
    if numeric is not None:
        own = own.join(numeric.select("column", "outlier_rate"), "column", "left")
    else:
        own = own.withColumn("outlier_rate", F.lit(None).cast("double"))
    c = F.col
    rules = [
        ("error", "all_missing", c("inferred_type") == "empty"),
        ("warning", "high_missingness", (c("inferred_type") != "empty") & (c("missing_rate") >= 0.5)),
        ("info", "moderate_missingness", (c("inferred_type") != "empty") & (c("missing_rate") >= 0.2) & (c("missing_rate") < 0.5)),
        ("warning", "constant_column", c("constant")),
        ("info", "likely_identifier", c("likely_identifier")),
        ("warning", "class_imbalance", c("inferred_type").isin("categorical", "boolean") & (c("unique_count") > 1) & (c("dominant_rate") >= 0.9)),
        ("info", "iqr_outliers", c("inferred_type").isin("integer", "float") & (c("outlier_rate") >= 0.05)),
    ]
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, rule in rules]), lambda x: x.isNotNull())
    return own.select("column", F.explode(broken).alias("i")).select("i.severity", "i.code", "column")


# ---------------------------------------------------------------- relationships

def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson and Spearman of each pair of columns over the rows where both are present (three at least).

    Equal pairs of values are counted first; ranks are averages by value counts,
    summed up along ranges; and both correlations are those of the counted values.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    keys = ["left", "right"]
    both = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in pairs])
    long = df.select(F.explode(both).alias("p")).select("p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    joint = materialize(long.groupBy(*keys, "x", "y").agg(F.count("*").alias("w")), "joint")

    def ranks(v):
        upto = running_sum(joint.groupBy(*keys, v).agg(F.sum("w").alias("_w")), [*keys, v], F.col("_w"), "_upto")
        first = upto.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_w")).alias("_first"))
        return upto.join(F.broadcast(first), keys).select(*keys, v, (F.col("_upto") - F.col("_first") - (F.col("_w") - 1) / 2).alias(f"r{v}"))

    ranked = joint.join(ranks("x"), [*keys, "x"]).join(ranks("y"), [*keys, "y"])
    w = F.col("w")
    means = joint.groupBy(*keys).agg(F.sum("w").alias("n"), (F.sum(F.col("x") * w) / F.sum("w")).alias("mx"), (F.sum(F.col("y") * w) / F.sum("w")).alias("my"))
    rows = ranked.join(F.broadcast(means), keys)  # a row for each pair of columns
    middle = (F.col("n") + 1) / 2

    def moments(a, b, ma, mb, name):
        x, y = F.col(a) - ma, F.col(b) - mb
        return [F.sum(w * x * y).alias(f"{name}xy"), F.sum(w * x * x).alias(f"{name}xx"), F.sum(w * y * y).alias(f"{name}yy")]

    sums = rows.groupBy(*keys, "n").agg(*moments("x", "y", F.col("mx"), F.col("my"), "p"), *moments("rx", "ry", middle, middle, "s"))
    corr = lambda k: nan_to_null(F.try_divide(F.col(f"{k}xy"), F.sqrt(F.col(f"{k}xx")) * F.sqrt(F.col(f"{k}yy"))))
    return sums.filter("n >= 3").select(*keys, "n", corr("p").alias("pearson"), corr("s").alias("spearman"))


def ranked_relationships(pairs: DataFrame, most: int = 50) -> DataFrame:
    """The strongest pairs (``left, right, nmi, pearson``) with their place: by shared information, then by the size of the correlation, then by name."""
    order = [F.desc_nulls_last("nmi"), F.desc_nulls_last(F.abs("pearson")), F.asc("left"), F.asc("right")]
    top = pairs.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))


def discretise(df: DataFrame, c: str, bins: int = 10) -> Column:
    """Right-closed quantile bins, equal edges merged; the number of bins follows the rows and distinct values."""
    row = df.agg(F.count(f"`{c}`").alias("n"), F.count_distinct(f"`{c}`").alias("u")).first()
    q = min(bins, max(2, int(row["n"] ** 0.5)), max(row["u"], 1))
    edges = column_quantiles(df, {c: F.col(f"`{c}`")}, [i / q for i in range(q + 1)]).get(c, [])
    inner = sorted(set(edges))[1:-1]
    v = F.col(f"`{c}`").cast("double")
    return F.when(v.isNotNull(), reduce(lambda a, e: a + (v > F.lit(e)).cast("int"), inner, F.lit(0)))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information (nats) of two discrete columns, and its share of their mean entropy."""
    joint = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = joint.groupBy("a").agg(F.sum("n").alias("na")), joint.groupBy("b").agg(F.sum("n").alias("nb"))
    total = joint.agg(F.sum("n")).first()[0] or 1
    n = F.lit(float(total))
    entropy = lambda t, c: t.agg(F.coalesce(-F.sum(F.col(c) / n * F.ln(F.col(c) / n)), F.lit(0.0)).alias(f"h{c}"), F.lit(1).alias("one"))
    mi = joint.join(left, "a").join(right, "b").agg(F.coalesce(F.sum(F.col("n") / n * F.ln(F.col("n") * n / (F.col("na") * F.col("nb")))), F.lit(0.0)).alias("mi"), F.lit(1).alias("one"))
    both = mi.join(entropy(left, "na"), "one").join(entropy(right, "nb"), "one")
    return both.select("mi", F.coalesce(F.try_divide("mi", (F.col("hna") + F.col("hnb")) / 2), F.lit(0.0)).alias("nmi"))


def pairwise_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right, n, mi, nmi`` of every two discrete columns, over the rows where both are present.

    All pairs' cells are counted in one pass and one shuffle; a row sends a cell for each
    pair, which are summed up in its task first. Sums by row and column of a pair's cells, of which there
    are as many as pairs of values that occur, follow from these counts.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, n long, mi double, nmi double")
    cells = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")) for a, b in pairs])
    keys = ["left", "right"]
    joint = df.select(F.explode(F.filter(cells, lambda c: c["a"].isNotNull() & c["b"].isNotNull())).alias("c")).select("c.*").groupBy(*keys, "a", "b").agg(F.count("*").alias("c"))
    joint = materialize(joint, "joint")
    na, nb = (joint.groupBy(*keys, x).agg(F.sum("c").alias(f"n{x}")) for x in ("a", "b"))
    total = joint.groupBy(*keys).agg(F.sum("c").alias("n"))  # a row for each pair
    share = F.col("c") / F.col("n")
    mi = joint.join(na, [*keys, "a"]).join(nb, [*keys, "b"]).join(F.broadcast(total), keys).groupBy(*keys, "n").agg(F.sum(share * F.ln(F.col("c") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda t, x: t.join(F.broadcast(total), keys).groupBy(*keys).agg((-F.sum(F.col(f"n{x}") / F.col("n") * F.ln(F.col(f"n{x}") / F.col("n")))).alias(f"h{x}"))
    both = mi.join(entropy(na, "a"), keys).join(entropy(nb, "b"), keys)
    return both.select(*keys, "n", "mi", F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.lit(0.0)).alias("nmi"))


def association_matrix(pairs: DataFrame, metric: str, columns: list[str]) -> DataFrame:
    """Symmetric cells ``left, right, value, strength`` (0 to 4, of the strongest)."""
    own = materialize(pairs.filter(F.col("left").isin(*columns) & F.col("right").isin(*columns)).select("left", "right", F.col(metric).alias("value")), "cells")  # sums in another order differ in their last bits
    both = own.unionByName(own.select(F.col("right").alias("left"), F.col("left").alias("right"), "value"))
    peak = float(own.agg(F.max(F.abs("value"))).first()[0] or 0.0)
    strength = F.when(F.lit(peak) > 0, F.least(F.ceil(4 * F.abs("value") / F.lit(peak or 1.0)), F.lit(4))).otherwise(0)
    return both.withColumn("strength", F.coalesce(strength.cast("int"), F.lit(0)))


# ---------------------------------------------------------------- feature views

def histogram(df: DataFrame, c: str, most: int = 12) -> DataFrame:
    """Equal-width bins, the last one closed."""
    v = F.col(f"`{c}`").cast("double")
    row = df.agg(F.count(v), F.min(v), F.max(v)).first()
    bins, low, high = min(most, max(1, int((row[0] or 0) ** 0.5))), row[1], row[2]
    width = ((high - low) / bins if row[0] else 1.0) or 1.0
    at = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.filter(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("start"), "n")


def top_categories(df: DataFrame, c: str, k: int = 12) -> DataFrame:
    return df.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def contingency(df: DataFrame, a: str, b: str, k: int = 8) -> DataFrame:
    """Counts of the top ``k`` values of either column against each other."""
    keep = [{r["value"] for r in top_categories(df, c, k).collect()} for c in (a, b)]
    left, right = F.col(f"`{a}`").cast("string"), F.col(f"`{b}`").cast("string")
    return df.filter(left.isin(*keep[0]) & right.isin(*keep[1])).groupBy(left.alias("left"), right.alias("right")).agg(F.count("*").alias("n"))


def group_quartiles(df: DataFrame, by: str, c: str, k: int = 8) -> DataFrame:
    keep = [r["value"] for r in top_categories(df, by, k).collect()]
    own = F.col(f"`{by}`").cast("string")
    found = quantiles(df.filter(own.isin(*keep)).select(own.alias("value"), F.col(f"`{c}`").alias("_c")), ["value"], "_c", [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.select("value", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(("min", "q1", "median", "q3", "max"))])


def suggested_roles(profiles: DataFrame) -> DataFrame:
    c = F.col
    role = F.when(c("constant") | (c("inferred_type") == "empty"), "exclude").when(c("likely_identifier"), "identifier").when(c("inferred_type").isin("boolean", "categorical"), "discrete")
    role = role.when((c("inferred_type") == "integer") & (c("unique_count") <= 20), "discrete").when(c("inferred_type").isin("integer", "float"), "continuous").otherwise("exclude")
    return profiles.select("column", "inferred_type", role.alias("role"))


#: Roles that a column can be given; fixed values.
ROLES = ("identifier", "discrete", "continuous", "exclude")


def override_roles(suggested: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """``suggested_roles`` with some roles set by hand; ``overridden`` says which.

    An unknown role, an unknown column, or a continuous role for a column that
    holds no numbers is an error.
    """
    if wrong := sorted({r for r in overrides.values() if r not in ROLES}):
        raise ValueError(f"unknown roles: {', '.join(wrong)}")
    types = {r["column"]: r["inferred_type"] for r in suggested.filter(F.col("column").isin(*overrides)).select("column", "inferred_type").collect()} if overrides else {}
    if wrong := sorted(set(overrides) - set(types)):
        raise ValueError(f"unknown columns: {', '.join(wrong)}")
    if wrong := sorted(c for c, r in overrides.items() if r == "continuous" and types[c] not in ("integer", "float")):
        raise ValueError(f"not numbers: {', '.join(wrong)}")
    own = F.lit(None).cast("string")
    for c, role in overrides.items():
        own = F.when(F.col("column") == c, role).otherwise(own)
    return suggested.withColumn("overridden", F.col("column").isin(*overrides) if overrides else F.lit(False)).withColumn("role", F.coalesce(own, "role"))


def eligible_columns(profiles: DataFrame, most: int = 25) -> DataFrame:
    """Columns that relationships are looked for in: not constant, no identifiers, no free text; the least missing first."""
    return profiles.filter("NOT constant AND NOT likely_identifier AND inferred_type NOT IN ('empty', 'text')").orderBy("missing_rate", "position").limit(most).select("column")


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, bad``: cells of each column that are no finite number; a model takes a column only without any."""
    v = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    bad = [F.count_if(v(c).isNull() | F.isnan(v(c)) | (F.abs(v(c)) == F.lit(float("inf")))).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], columns, "column", "bad")


def boolean_zero_rate(df: DataFrame, c: str) -> DataFrame:
    """Share of a boolean column's present values that say no."""
    v = F.lower(F.trim(F.col(f"`{c}`").cast("string")))
    return df.agg(F.avg(F.when(v.isin(*FALSE), 1.0).when(v.isin(*TRUE), 0.0)).alias("zero_rate"))


def systematic_sample(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``rows`` evenly spaced rows, the first and the last among them."""
    n = df.count()
    if n <= rows:
        return df
    ranked = numbered(df, [order], "_k").withColumn("_k", F.col("_k") - 1)
    places = [(i * (n - 1)) // (rows - 1) for i in range(rows)] if rows > 1 else [0]
    return ranked.filter(F.col("_k").isin(*places)).drop("_k")
