"""Running sums and row numbers over a whole table, without one task that holds it.

Rows are dealt by ranges of the order and stored once; each range's total is one
number, so the list of totals is as long as there are ranges, whatever the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.shared import materialize


def running_sum(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to and with this one. ``order`` must be total."""
    own = df.withColumn("_v", value)
    ranged = materialize(own.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, starts = 0, {}
    for part, total in ranged.groupBy("_part").agg(F.sum("_v")).orderBy("_part").collect():
        starts[part] = before
        before += total or 0
    start = F.lit(0)
    if starts:
        start = F.try_element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part"))
    inside = F.sum("_v").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, start + inside).drop("_v", "_part")


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """Add ``name``: each row's place from 1 in a total order."""
    return running_sum(df, order, F.lit(1).cast("long"), name)


def running_extreme(df: DataFrame, order: list[Column | str], value: Column, name: str, larger: bool = False) -> DataFrame:
    """Add ``name``: the least (or ``larger``: the largest) ``value`` of all rows up to and with this one."""
    pick, best = (F.max, max) if larger else (F.min, min)
    own = df.withColumn("_v", value)
    ranged = materialize(own.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, carried = None, {}
    for part, extreme in ranged.groupBy("_part").agg(pick("_v")).orderBy("_part").collect():
        carried[part] = before
        before = extreme if before is None else before if extreme is None else best(before, extreme)
    start = F.lit(None)
    if any(v is not None for v in carried.values()):
        start = F.try_element_at(F.create_map(*[F.lit(x) for kv in carried.items() if kv[1] is not None for x in kv]), F.col("_part"))
    inside = pick("_v").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, (F.greatest if larger else F.least)(start, inside)).drop("_v", "_part")
