"""Tables that outlive a run: profiles, verified exports, collection events, artifacts, catalogs.

A store is a Parquet folder that is appended to; each run or artifact is a
partition value or a row, and looking one up is a filter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeframe.functions.shared import materialize, shuffles_dropped
from recipeframe.operators import compare as C
from recipeframe.operators import profile as P
from recipeframe.operators.xml_tables import decode_null, encode_null
from recipeframe.sources.delimited import write_derived


# ---------------------------------------------------------------- profiles

def whole_profile(df: DataFrame) -> DataFrame:
    """Column profiles with the numeric summary beside them: a row for each column."""
    profiles = P.column_profiles(df)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return profiles
    summary = P.numeric_summary(df, numeric)
    return profiles.join(summary.select("column", *[F.col(c).alias(f"numeric_{c}") for c in summary.columns if c != "column"]), "column", "left")


def profile_tables(tables: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The profiles of many tables, by name, and why the others failed. A table that can't be read doesn't stop its siblings."""
    out, failed = None, {}
    for name, read in tables.items():
        try:
            own = materialize(P.column_profiles(read()).select(F.lit(name).alias("table"), "*"), "profile")
        except Exception as e:  # noqa: BLE001  the caller sees it
            failed[name] = type(e).__name__
            continue
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out, failed


def profiled_counts(tables: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """``table, columns, failed``: how many columns each table's profile has, or why there is none; all of them may fail."""
    out, failed = profile_tables(tables)
    lost = spark.createDataFrame([(n, 0, why) for n, why in failed.items()], "table string, columns long, failed string")
    if out is None:
        return lost
    return out.groupBy("table").agg(F.count("*").alias("columns")).withColumn("failed", F.lit(None).cast("string")).unionByName(lost)


def settings_key(fingerprint: str, settings: dict) -> str:
    return hashlib.sha256(json.dumps([fingerprint, settings], sort_keys=True).encode()).hexdigest()


def save_run(df: DataFrame, store: str, run: str, **facts: str) -> None:
    """Append a run's rows to a store, with the time and facts of the run on each."""
    own = df.withColumns({"created_at": F.current_timestamp(), **{k: F.lit(v) for k, v in facts.items()}, "run_id": F.lit(run)})
    own.write.mode("append").partitionBy("run_id").parquet(store)


def recent_runs(spark: SparkSession, store: str, most: int = 20) -> DataFrame:
    runs = spark.read.parquet(store).groupBy("run_id").agg(F.max("created_at").alias("created_at"), F.count("*").alias("rows"))
    return runs.orderBy(F.desc("created_at"), "run_id").limit(most)


def load_run(spark: SparkSession, store: str, run: str) -> DataFrame:
    return spark.read.parquet(store).filter(F.col("run_id") == run)


def reused_profile(df: DataFrame, store: str, settings: dict, views: dict[str, Callable[[DataFrame], DataFrame]], refresh: tuple = ()) -> tuple[dict[str, DataFrame], list[str]]:
    """Each view (a name and how to compute it), from the store if the table's contents and the settings are the same; returns what was computed, too."""
    spark, key, out, made = df.sparkSession, settings_key(C.table_fingerprint(df).first()["fingerprint"], settings), {}, []
    for name, compute in views.items():
        path = f"{store}/{key}/{name}"
        try:
            found = None if name in refresh else spark.read.parquet(path)
        except Exception:  # noqa: BLE001  not there yet
            found = None
        if found is None:
            compute(df).write.mode("overwrite").parquet(path)
            made.append(name)
            found = spark.read.parquet(path)
        out[name] = found
    return out, made


# ---------------------------------------------------------------- verified exports

EXPORT_SCHEMA = 1


def encoded(df: DataFrame, exempt: tuple = ("Comments",)) -> DataFrame:
    """All columns as text that tells missing from empty; nested values as JSON."""
    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name in exempt:
            return c.cast("string").alias(f.name)
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return encode_null(F.to_json(c) if nested else c.cast("string")).alias(f.name)

    return df.select(*[text(f) for f in df.schema.fields])


def export_encoded(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write ``df`` as encoded CSV with a manifest beside it, and return the manifest's row."""
    spark, mode = df.sparkSession, "overwrite" if overwrite else "errorifexists"
    text = materialize(encoded(df), "encoded")
    text.write.mode(mode).csv(f"{path}/data", header=True, quoteAll=True, escape='"', nullValue="\u0001", emptyValue="")
    manifest = C.table_fingerprint(text).select(F.lit(EXPORT_SCHEMA).alias("schema_version"), F.lit(",".join(text.columns)).alias("columns"), "rows", "fingerprint")
    manifest.coalesce(1).write.mode(mode).json(f"{path}/manifest")
    return spark.read.schema("schema_version int, columns string, rows long, fingerprint string").json(f"{path}/manifest")


def import_verified(spark: SparkSession, path: str, exempt: tuple = ("Comments",)) -> tuple[DataFrame, list[str]]:
    """The exported table, decoded, and what differs from its manifest (nothing, if it is whole).

    A column becomes a number only if all its present values are numbers and none is empty.
    """
    m = spark.read.schema("schema_version int, columns string, rows long, fingerprint string").json(f"{path}/manifest").first()
    names = m["columns"].split(",")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = spark.read.schema(schema).csv(f"{path}/data", header=True, quote='"', escape='"', multiLine=True, nullValue="\u0001", emptyValue="", enforceSchema=False)
    now = C.table_fingerprint(text).first()
    wrong = [k for k, ok in (("schema_version", m["schema_version"] == EXPORT_SCHEMA), ("rows", m["rows"] == now["rows"]), ("fingerprint", m["fingerprint"] == now["fingerprint"])) if not ok]
    decoded = text.select(*[F.col(f"`{n}`") if n in exempt else decode_null(F.col(f"`{n}`")).alias(n) for n in names])
    own = [n for n in names if n not in exempt]
    # missing values are left out of the test; a column of missing values only stays text
    present = decoded.agg(*[F.bool_and(F.when(F.col(f"`{n}`").isNotNull(), F.col(f"`{n}`").try_cast("double").isNotNull())).alias(n) for n in own]).first().asDict() if own else {}
    return decoded.select(*[F.col(f"`{n}`").cast("double").alias(n) if present.get(n) else F.col(f"`{n}`") for n in names]), wrong


def write_json_lines(df: DataFrame, path: str, compression: str = "gzip") -> dict:
    """Write rows as JSON lines; count and hash of what is read back (``table``) must be those of what was written.

    The hash is observed by the write itself, so the rows are neither stored beside their export nor made twice.
    """
    sums, head = C.fingerprint_sums(df)
    seen = Observation()
    with shuffles_dropped(df.sparkSession):
        df.observe(seen, *sums).write.mode("errorifexists").json(path, ignoreNullFields=False, compression=compression)
    back = df.sparkSession.read.schema(df.schema).json(path)
    written, b = seen.get, C.table_fingerprint(back).first()
    return {"rows": b["rows"], "verified": written["rows"] == b["rows"] and C.fingerprint_of(written, head) == b["fingerprint"], "table": back}


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_bytes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, size, sha256, bytes`` of files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("content").alias("bytes"))


# ---------------------------------------------------------------- collection events

def collection_events(members: DataFrame, recipe: str = "recipe") -> DataFrame:
    """``event, recipe, output, members, membership`` of ``output, name, sha, recipe``: an export and its many sources.

    Members are hashed as a bag (sums of their hashes), so no event's list is gathered in a row.
    """
    h = F.sha2(F.to_json(F.struct("name", "sha")), 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    by = members.groupBy("output", recipe).agg(F.count("*").alias("members"), F.sha2(F.concat_ws("|", *sums), 256).alias("membership"))
    return by.select(C.event_id("output", recipe, "members", "membership").alias("event"), F.col(recipe).alias("recipe"), "output", "members", "membership")


def verify_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """``output, status``: verified, or which of recipe and membership changed, or members_missing."""
    now = collection_events(members).select("output", F.col("recipe").alias("r"), F.col("members").alias("n"), F.col("membership").alias("m"), F.col("event").alias("e"))
    both = events.join(now, "output", "left")
    status = F.when(F.col("e").isNull(), "missing").when(F.col("e") == F.col("event"), "verified").when(F.col("r") != F.col("recipe"), "recipe_changed").when(F.col("n") < F.col("members"), "members_missing").otherwise("membership_changed")
    return both.select("output", status.alias("status"))


def regenerated(recorded: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``same, rows``: whether a recipe that is run again gives the recorded fingerprint."""
    return C.table_fingerprint(make()).select((F.col("fingerprint") == recorded).alias("same"), "rows")


# ---------------------------------------------------------------- artifacts and catalogs

def artifacts(table: DataFrame, kind: Column, name: Column, source: Column) -> tuple[DataFrame, DataFrame]:
    """``artifact, kind, name`` rows and ``artifact, source`` edges; an id is a hash of kind and name."""
    own = table.select(kind.alias("kind"), name.cast("string").alias("name"), source.cast("string").alias("source"))
    own = own.withColumn("artifact", C.event_id("kind", "name"))
    return own.select("artifact", "kind", "name").distinct(), own.filter("source IS NOT NULL").select("artifact", "source").distinct()


def extraction_history(events: DataFrame, current: DataFrame, source: str | None = None) -> DataFrame:
    """``event, name, status`` of recorded extractions (``event, source, name, sha``): available, missing or modified now."""
    own = events if source is None else events.filter(F.col("source") == source)
    return own.select("event", "name", "sha").join(current.withColumnRenamed("sha", "now"), "name", "left").select("event", "name", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha"), "available").otherwise("modified").alias("status"))


def browse(catalog: DataFrame, filters: dict[str, str] | None = None, order: tuple = ("name",), page: int = 1, size: int = 50) -> DataFrame:
    """A page of a catalog's rows; a filter is a part of a column's text, in any case."""
    own = catalog
    for c, part in (filters or {}).items():
        own = own.filter(F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(part.lower())))
    return own.orderBy(*order).offset((page - 1) * size).limit(size)


def handoff(manifest: DataFrame) -> DataFrame:
    """The datasets of a verified export: ``dataset, kind, rows, path``, main tables first."""
    kind = F.when(F.col("dataset") == "main", "main").otherwise("child")
    return manifest.filter("verified").select("dataset", kind.alias("kind"), "rows", "path").orderBy(F.desc("kind"), "dataset")


def publish_derived(df: DataFrame, output: str, source: str, recipe: list[dict], overwrite: bool = False) -> DataFrame:
    """Write a derived table with its recipe and fingerprint beside it, and return the manifest's row; never over its source."""
    write_derived(df, f"{output}/data", f"{source}/data" if output.rstrip("/") == source.rstrip("/") else source, overwrite)
    spark, mode = df.sparkSession, "overwrite" if overwrite else "errorifexists"
    manifest = C.table_fingerprint(spark.read.parquet(f"{output}/data")).select(F.lit(source).alias("source"), F.lit(json.dumps(recipe, sort_keys=True)).alias("recipe"), "rows", "fingerprint")
    manifest.coalesce(1).write.mode(mode).json(f"{output}/manifest")
    return spark.read.schema("source string, recipe string, rows long, fingerprint string").json(f"{output}/manifest")
