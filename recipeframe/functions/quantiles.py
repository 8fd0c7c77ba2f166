"""Exact quantiles from brackets and value counts, so that no task or buffer holds a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.ranks import running_sum
from recipeframe.functions.shared import materialize

#: A sketch's ranks are off by at most one of so many parts of the rows.
ACCURACY = 10_000


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """``keys, n, q``: for each key the number of rows and their quantiles ``at``, between neighbours in proportion.

    Null values don't count; a key without any has no row. A sketch of each key's
    values first tells two bounds for each quantile, a little below and above its
    place. Then the rows below the bounds are counted, and only the values between
    them are ranked: a few of ACCURACY parts, counted before they are shuffled. If the values between
    some bounds turn out not to hold the place, all values are ranked.
    """
    # keys travel as one struct, in which nulls are equal
    own = rows.filter(F.col(value).isNotNull()).select(F.struct(*(keys or [F.lit(0).alias("_all")])).alias("_k"), F.col(value).cast("double").alias("_value"))
    step = 2.0 / ACCURACY
    places = [min(max(p + side * step, 0.0), 1.0) for p in at for side in (-1, 1)]
    bounds = materialize(own.groupBy("_k").agg(F.count("*").alias("n"), F.percentile_approx("_value", places, ACCURACY).alias("_bounds")), "bounds")
    n = bounds.count()
    few = F.broadcast if n <= 100_000 else lambda df: df  # a checked size
    met = own.join(few(bounds), "_k")
    # a row is below the bounds of some quantiles, and between those of others
    low, high = (lambda i: F.col("_bounds")[2 * i]), (lambda i: F.col("_bounds")[2 * i + 1])
    below = met.groupBy("_k", "n").agg(F.array(*[F.count_if(F.col("_value") < low(i)) for i in range(len(at))]).alias("_below"))
    parts = F.array(*[F.when((F.col("_value") >= low(i)) & (F.col("_value") <= high(i)), F.lit(i)) for i in range(len(at))])
    inside = met.select("_k", "_value", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("_i")).groupBy("_k", "_i", "_value").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_k", "_i").orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    placed = inside.withColumn("_upto", upto).join(few(below), "_k").withColumn("_to", F.element_at("_below", F.col("_i") + 1) + F.col("_upto")).withColumn("_from", F.col("_to") - F.col("_c"))
    share = F.element_at(F.array(*[F.lit(float(p)) for p in at]), F.col("_i") + 1)
    found = materialize(_ends(placed.withColumn("_place", share * (F.col("n") - 1))), "quantiles")
    if found.filter("_a IS NOT NULL AND _b IS NOT NULL").count() < n * len(at):
        found = _ends(_all_placed(own, at))
    out = _listed(found)
    return out.select(*[F.col(f"_k.`{k}`").alias(k) for k in keys], "n", "q")


def _all_placed(own: DataFrame, at: list[float]) -> DataFrame:
    """Every distinct value with its places, for each quantile: sums along ranges of (key, value)."""
    counts = own.groupBy("_k", "_value").agg(F.count("*").alias("_c"))
    ranked = running_sum(counts, ["_k", "_value"], F.col("_c"), "_upto")
    totals = ranked.groupBy("_k").agg(F.sum("_c").alias("n"), F.min(F.col("_upto") - F.col("_c")).alias("_base"))
    joined = ranked.join(totals, "_k").select("_k", "n", "_value", (F.col("_upto") - F.col("_c") - F.col("_base")).alias("_from"), (F.col("_upto") - F.col("_base")).alias("_to"))
    each = joined.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("_i", "_p"))
    return each.withColumn("_place", F.col("_p") * (F.col("n") - 1))


def _ends(placed: DataFrame) -> DataFrame:
    """``_a, _b``: the values at the whole places below and above each quantile's place."""
    holds = lambda x: (F.col("_from") <= x) & (x < F.col("_to"))
    return placed.groupBy("_k", "n", "_i", "_place").agg(F.max(F.when(holds(F.floor("_place")), F.col("_value"))).alias("_a"), F.max(F.when(holds(F.ceil("_place")), F.col("_value"))).alias("_b"))


def _listed(ends: DataFrame) -> DataFrame:
    share = F.col("_place") - F.floor("_place")
    one = ends.withColumn("_q", F.when(share == 0, F.col("_a")).otherwise((1 - share) * F.col("_a") + share * F.col("_b")))
    return one.groupBy("_k", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("q"))


def column_quantiles(df: DataFrame, columns: dict[str, Column], at: list[float]) -> dict[str, list[float]]:
    """Quantiles of a few number columns, by name; columns without a value are missing."""
    names = list(columns)
    long = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())]).unpivot([], [f"c{i}" for i in range(len(names))], "column", "value")
    return {names[int(r["column"][1:])]: list(r["q"]) for r in quantiles(long, ["column"], "value", at).select("column", "q").collect()}
