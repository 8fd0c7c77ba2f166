"""Dataset comparison as bags of rows, fingerprints, and lineage.

Tables are compared through ``(dataset, row hash, count)``: one grouped table of
all datasets joined to itself on the hash gives every pair in one job.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeframe.functions.shared import materialize


def schema_signature(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.array(*[F.lit(c) for c in columns])), 256)


#: From here on a float's text with 17 digits is in scientific notation; fixed value.
_FIXED_UP_TO = 1e17


def cell_text(df: DataFrame, c: str) -> Column:
    """A text for each cell that is equal for two cells exactly where ``canonical_text`` is: whole floats are written like integers, others with the fewest digits that tell them apart."""
    v = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        whole = F.when((v == F.floor(v)) & (F.abs(v) < _FIXED_UP_TO), v.cast("long").cast("string"))
        v = F.when(~F.isnan(v), F.coalesce(whole, v.cast("double").cast("string")))  # a NaN is missing
    return F.coalesce(v.cast("string"), F.lit("<NA>"))


@F.pandas_udf(T.StringType())
def _seventeen_digits(v: pd.Series) -> pd.Series:
    return v.map(lambda x: "<NA>" if pd.isna(x) else format(x, ".17g"))


def canonical_text(df: DataFrame, c: str) -> Column:
    """A cell as it is written in reports: missing ones as ``<NA>``, floats with 17 significant digits."""
    v = F.col(f"`{c}`")
    return _seventeen_digits(v.cast("double")) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.coalesce(v.cast("string"), F.lit("<NA>"))


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """Of the cells and where each ends, so that no two rows of cells run together."""
    parts = [x for c in columns for x in (F.octet_length(cell_text(df, c)).cast("string"), cell_text(df, c))]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def row_bag(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(row_hash(df, columns).alias("row")).groupBy("row").agg(F.count("*").alias("n"))


def row_overlap(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shared row instances, their share of either side, and the bags' Jaccard index, over the shared columns."""
    columns = columns or [c for c in left.columns if c in right.columns]
    a, b = row_bag(left, columns).withColumnRenamed("n", "a"), row_bag(right, columns).withColumnRenamed("n", "b")
    both = a.join(b, "row", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    s = both.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in (("left_rows", F.col("a")), ("right_rows", F.col("b")), ("shared", F.least("a", "b")), ("either", F.greatest("a", "b")))])
    share = lambda d: F.coalesce(F.try_divide("shared", d), F.lit(0.0))
    return s.select("left_rows", "right_rows", "shared", share("left_rows").alias("left_fraction"), share("right_rows").alias("right_fraction"), share("either").alias("row_jaccard"))


def schema_algebra(left: list[str], right: list[str]) -> dict:
    shared = [c for c in left if c in right]
    union = left + [c for c in right if c not in left]
    return {"shared": shared, "left_only": [c for c in left if c not in right], "right_only": [c for c in right if c not in left], "union": union, "jaccard": len(shared) / len(union) if union else 1.0}


def identifier_candidates(df: DataFrame) -> DataFrame:
    """``column, n`` of the columns whose present values are all different, and that are named like ids or have ten values at least."""
    sums = [s for i, c in enumerate(df.columns) for s in (F.count(f"`{c}`").alias(f"n{i}"), F.count_distinct(f"`{c}`").alias(f"u{i}"))]
    row = df.agg(*sums)
    flat = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"u{i}").alias("u")) for i, c in enumerate(df.columns)])
    name = F.lower("column")
    hint = (name == "id") | name.endswith("_id") | name.startswith("id_") | F.contains(name, F.lit("identifier")) | F.contains(name, F.lit("uuid"))
    return row.select(F.explode(flat).alias("x")).select("x.*").filter((F.col("n") > 0) & (F.col("n") == F.col("u")) & (hint | (F.col("n") >= 10))).select("column", "n")


def identifier_overlap(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    x, y = (d.select(F.col(f"`{c}`").cast("string").alias("id")).filter("id IS NOT NULL").distinct() for d, c in ((left, a), (right, b)))
    one = F.lit(1).alias("one")
    counts = [d.agg(F.count("*").alias(n), one) for d, n in ((x, "left_ids"), (y, "right_ids"), (x.join(y, "id", "left_semi"), "shared_ids"))]
    s = reduce(lambda p, q: p.join(q, "one"), counts)
    return s.select("left_ids", "right_ids", "shared_ids", F.coalesce(F.try_divide("shared_ids", "left_ids"), F.lit(0.0)).alias("left_fraction"), F.coalesce(F.try_divide("shared_ids", "right_ids"), F.lit(0.0)).alias("right_fraction"))


#: Words of file names, labels of relationships and their thresholds; fixed values.
ROLES = {"train": ("train", "training"), "test": ("test", "testing", "validation", "valid", "val")}
SPLIT_BELOW, VERSION_FROM, RELATED_FROM = 0.25, 0.70, 0.5


def filename_role(name: Column) -> Column:
    """``train`` or ``test`` if that is a word of the file's name, between ``-`` and ``_``."""
    words = F.split(F.lower(F.regexp_extract(name, r"([^/]*?)(\.[^./]*)?$", 1)), "[-_]")
    has = lambda role: F.arrays_overlap(words, F.array(*[F.lit(x) for x in ROLES[role]]))
    return F.when(has("train"), "train").when(has("test"), "test")


def relationship(pairs: DataFrame) -> DataFrame:
    """Add to a table of pairs' metrics what two datasets are to each other: the flags, ``label`` (the strongest that holds) and ``signals``.

    Equal files are duplicates; equal bags of rows under the same columns are
    equivalent; a bag within the other a subset. A split has a train and a test
    file that share few rows; a version shares most rows or identifiers.
    """
    one = lambda c: F.coalesce(F.col(c) == 1.0, F.lit(False))
    most_ids = F.coalesce(F.greatest("id_left_fraction", "id_right_fraction"), F.lit(0.0))
    same = F.col("same_schema")
    flags = {
        "exact_duplicate": F.coalesce(F.col("left_hash") == F.col("right_hash"), F.lit(False)),
        "content_equivalent": F.col("same_order") & (F.col("left_rows") == F.col("right_rows")) & (F.col("shared") == F.col("left_rows")),
        "left_subset": same & (F.col("left_rows") <= F.col("right_rows")) & one("left_fraction"),
        "right_subset": same & (F.col("right_rows") <= F.col("left_rows")) & one("right_fraction"),
        "likely_split": same & F.col("split_names") & (F.col("row_jaccard") < SPLIT_BELOW),
    }
    out = pairs.withColumns(flags)
    version = same & ~F.col("content_equivalent") & ~F.col("likely_split") & (F.greatest("left_fraction", "right_fraction", most_ids) >= VERSION_FROM)
    label = (
        F.when(F.col("exact_duplicate"), "exact_duplicate").when(F.col("content_equivalent"), "content_equivalent")
        .when(F.col("left_subset") & ~F.col("right_subset"), "left_subset_of_right").when(F.col("right_subset") & ~F.col("left_subset"), "right_subset_of_left")
        .when(F.col("likely_split"), "likely_train_test_split").when(F.col("likely_version"), "likely_version_or_derivative").when(same, "same_schema_distinct_data")
        .when(F.col("schema_jaccard") >= RELATED_FROM, "related_schema").otherwise("weak_or_unknown_relationship")
    )
    signals = F.array_compact(F.array(
        F.when(same, "same column set"), F.when(F.col("same_order"), "same column order"), F.when(F.col("row_jaccard") >= 0.5, "substantial row overlap"),
        F.when(F.col("id_column").isNotNull(), F.concat(F.lit("shared identifier candidate: "), "id_column")), F.when(F.col("split_names"), "train/test filename roles"),
    ))
    return out.withColumn("likely_version", version).withColumn("label", label).withColumn("signals", signals)


def _shared_rows(datasets: dict[str, DataFrame], pairs: list[tuple]) -> DataFrame:
    """``left, right, shared``: row instances that two datasets share over their shared columns; one self-join for all pairs."""
    wanted: dict[tuple, set] = {}
    for a, b, columns in pairs:
        if columns:
            wanted.setdefault(tuple(sorted(columns)), set()).update((a, b))
    spark = next(iter(datasets.values())).sparkSession
    bags = None
    for i, (columns, members) in enumerate(wanted.items()):
        for name in sorted(members):
            bag = row_bag(datasets[name], list(columns)).select(F.lit(i).alias("over"), F.lit(name).alias("dataset"), "row", "n")
            bags = bag if bags is None else bags.unionByName(bag)
    if bags is None:
        return spark.createDataFrame([], "left string, right string, shared long")
    over = {columns: i for i, columns in enumerate(wanted)}
    asked = spark.createDataFrame([(a, b, over[tuple(sorted(c))]) for a, b, c in pairs if c], "left string, right string, over int")
    bags = materialize(bags, "bags")
    met = bags.alias("a").join(bags.alias("b"), (F.col("a.over") == F.col("b.over")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.dataset") < F.col("b.dataset")))
    met = met.groupBy(F.col("a.over").alias("over"), F.col("a.dataset").alias("left"), F.col("b.dataset").alias("right")).agg(F.sum(F.least("a.n", "b.n")).alias("shared"))
    return asked.join(met, ["over", "left", "right"]).select("left", "right", "shared")


def _shared_ids(datasets: dict[str, DataFrame], pairs: list[tuple]) -> DataFrame:
    """``left, right, id_column, id_left_fraction, id_right_fraction`` for pairs with an identifier candidate in common (the left's first)."""
    spark = next(iter(datasets.values())).sparkSession
    found = {n: [r["column"] for r in identifier_candidates(d).collect()] for n, d in datasets.items()}
    asked = [(a, b, next((c for c in found[a] if c in found[b]), None)) for a, b, _ in pairs]
    asked = [x for x in asked if x[2] is not None]
    ids = None
    for name, column in sorted({(n, c) for a, b, c in asked for n in (a, b)}):
        own = datasets[name].select(F.lit(name).alias("dataset"), F.lit(column).alias("id_column"), cell_text(datasets[name], column).alias("id")).filter(F.col("id") != "<NA>").distinct()
        ids = own if ids is None else ids.unionByName(own)
    schema = "left string, right string, id_column string"
    if ids is None:
        return spark.createDataFrame([], schema + ", id_left_fraction double, id_right_fraction double")
    ids = materialize(ids, "identifiers")
    size = ids.groupBy("dataset", "id_column").agg(F.count("*").alias("n"))
    both = ids.alias("a").join(ids.alias("b"), (F.col("a.id_column") == F.col("b.id_column")) & (F.col("a.id") == F.col("b.id")) & (F.col("a.dataset") < F.col("b.dataset")))
    both = both.groupBy(F.col("a.dataset").alias("left"), F.col("b.dataset").alias("right"), F.col("a.id_column").alias("id_column")).agg(F.count("*").alias("s"))
    out = spark.createDataFrame(asked, schema).join(both, ["left", "right", "id_column"], "left")
    for side in ("left", "right"):
        out = out.join(size.select(F.col("dataset").alias(side), "id_column", F.col("n").alias(f"{side}_n")), [side, "id_column"], "left")
    share = lambda d: F.coalesce(F.try_divide(F.coalesce("s", F.lit(0)), d), F.lit(0.0))
    return out.select("left", "right", "id_column", share("left_n").alias("id_left_fraction"), share("right_n").alias("id_right_fraction"))


def compare_collection(datasets: dict[str, DataFrame], most_pairs: int | None = None, hashes: dict[str, str] | None = None) -> DataFrame:
    """All pairs of datasets with their schema, row and identifier overlap, label and signals.

    ``hashes`` are those of the datasets' files, where they have one: only equal
    files are exact duplicates. ``most_pairs`` stops after so many pairs in the
    order of names; ``collection_summary`` then says that the rest is missing.
    """
    names = sorted(datasets)
    spark = datasets[names[0]].sparkSession
    pairs = [(a, b, [c for c in datasets[a].columns if c in datasets[b].columns]) for i, a in enumerate(names) for b in names[i + 1 :]][:most_pairs]
    rows = []
    for a, b, _ in pairs:
        x, y = datasets[a].columns, datasets[b].columns
        rows.append((a, b, float(schema_algebra(x, y)["jaccard"]), set(x) == set(y), x == y, (hashes or {}).get(a), (hashes or {}).get(b)))
    base = spark.createDataFrame(rows, "left string, right string, schema_jaccard double, same_schema boolean, same_order boolean, left_hash string, right_hash string")
    sizes = reduce(lambda p, q: p.unionByName(q), [datasets[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n in names])
    for side in ("left", "right"):
        base = base.join(sizes.select(F.col("dataset").alias(side), F.col("rows").alias(f"{side}_rows")), side)
    base = base.join(_shared_rows(datasets, pairs), ["left", "right"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
    share = lambda a, b: F.coalesce(F.try_divide("shared", f"{a}_rows"), F.when(F.col(f"{b}_rows") == 0, 1.0).otherwise(0.0))
    either = F.col("left_rows") + F.col("right_rows") - F.col("shared")
    base = base.withColumns({"left_fraction": share("left", "right"), "right_fraction": share("right", "left"), "row_jaccard": F.coalesce(F.try_divide("shared", either), F.lit(1.0))})
    base = base.join(_shared_ids(datasets, pairs), ["left", "right"], "left")
    roles = F.array_sort(F.array(F.coalesce(filename_role(F.col("left")), F.lit("")), F.coalesce(filename_role(F.col("right")), F.lit(""))))
    return relationship(base.withColumn("split_names", roles == F.array(F.lit("test"), F.lit("train")))).drop("left_hash", "right_hash")


def collection_summary(compared: DataFrame, datasets: int) -> DataFrame:
    """``label, pairs`` of the compared pairs, with ``compared, possible, truncated`` of the whole collection."""
    possible = datasets * (datasets - 1) // 2
    by = compared.groupBy("label").agg(F.count("*").alias("pairs"))
    total = by.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared"))
    every = by.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k")
    return every.select("label", "pairs", "compared", F.lit(possible).cast("long").alias("possible"), (F.col("compared") < possible).alias("truncated"))


# ---------------------------------------------------------------- fingerprints and lineage

def table_fingerprint(df: DataFrame, order: str | None = None) -> DataFrame:
    """``fingerprint`` of column names, types and cells: of the bag of rows, or with their order.

    Row hashes are added up as numbers, so no task sees more than its own rows.
    """
    sums, head = fingerprint_sums(df, order)
    return df.agg(*sums).select("rows", F.sha2(F.concat_ws("|", F.lit(head), F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(5)]), 256).alias("fingerprint"))


def fingerprint_sums(df: DataFrame, order: str | None = None) -> tuple[list[Column], str]:
    """The aggregates of a fingerprint (``rows, s0`` to ``s4``), which a write can observe, and the text of names and types before them."""
    columns = [c for c in df.columns if c != order]
    cells = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns] + ([F.col(order)] if order else [])), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(cells, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"s{i}") for i in range(5)]
    return [F.count("*").alias("rows"), *parts], "|".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields if f.name != order)


def fingerprint_of(sums: dict, head: str) -> str:
    """The fingerprint of the values of ``fingerprint_sums``."""
    return hashlib.sha256("|".join([head, str(sums["rows"]), *[str(sums[f"s{i}"]) for i in range(5)]]).encode()).hexdigest()


def event_id(*columns: str) -> Column:
    """Content-addressed id of an event: a hash of its fields."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def link_parents(events: DataFrame) -> DataFrame:
    """Events with ``parent``: the event whose derived hash is their source hash (the smaller id, if several are)."""
    made = events.groupBy(F.col("derived_sha").alias("source_sha")).agg(F.min("event").alias("parent"))
    return events.join(made, "source_sha", "left").select("event", "source_sha", "derived_sha", F.when(F.col("parent") != F.col("event"), F.col("parent")).alias("parent"))


def trace_lineage(events: DataFrame, leaves: DataFrame, depth: int = 32) -> DataFrame:
    """``leaf, step, event, cycle``: the chain of parents of each leaf event, at most ``depth`` of them."""
    linked = link_parents(events).select("event", "parent")
    at = leaves.select(F.col("event").alias("leaf"), "event").join(linked, "event").select("leaf", "event", "parent", F.array("event").alias("path"))
    out = at.select("leaf", F.lit(0).alias("step"), "event", F.lit(False).alias("cycle"))
    for step in range(1, depth + 1):
        at = at.filter("parent IS NOT NULL").select("leaf", F.col("parent").alias("event"), "path").join(linked, "event")
        at = at.withColumn("cycle", F.array_contains("path", F.col("event")))
        if at.isEmpty():
            break
        out = out.unionByName(at.select("leaf", F.lit(step).alias("step"), "event", "cycle"))
        at = at.filter("NOT cycle").select("leaf", "event", "parent", F.array_append("path", F.col("event")).alias("path"))
    return out


def verify_hashes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``name, status``: available, missing or modified, of recorded ``name, sha`` against current ones."""
    both = recorded.join(current.withColumnRenamed("sha", "now"), "name", "left")
    return both.select("name", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha"), "available").otherwise("modified").alias("status"))
