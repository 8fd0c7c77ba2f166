"""Delimited files: discovery, inspection, and reading as text columns with a row id."""

from __future__ import annotations

import csv
import io
from collections import Counter, namedtuple
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeframe.operators.recipe import ROW

Malformed = namedtuple("Malformed", "row observed expected")
HEAD_BYTES = 128 * 1024
#: Names of exported row numbers, and the delimiters that are tried; fixed values.
INDEX_NAMES = ("index", "row", "row_index", "row_number", "rownum", "__index_level_0__")
DELIMITERS = ",\t;|"
_SCHEMA = "path string, size long, sha256 string, encoding string, delimiter string, quote string, escape string, has_header boolean, columns array<string>, modal_width int, status string, error string"


def discover(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple = ("csv", "tsv", "txt", "xml"), hidden: bool = False) -> DataFrame:
    """``path, size, sha256, content`` of the allowed files, each once; without ``hidden``, none that is hidden or in a hidden folder below ``path`` (Spark itself lists none whose name begins with a dot or an underscore)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    base = path.rstrip("/").split("://", 1)[-1]
    below = F.substring(F.col("path"), F.locate(base, F.col("path")) + len(base), F.length("path"))
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes)
    if not hidden:
        wanted = wanted & ~F.contains(below, F.lit("/."))
    # a folder is listed once, so a path stands once: contents aren't moved to look for repeats
    return files.filter(wanted).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def detect_encoding(head: bytes, cut: bool = False) -> str | None:
    """By byte order mark, else the first of UTF-8, cp1252 and Latin-1 that reads the bytes; None for binary data."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    if b"\0" in head:
        return None
    for name in ("utf-8", "cp1252"):
        try:
            head.decode(name)
            return name
        except UnicodeDecodeError as e:
            if cut and name == "utf-8" and e.start >= len(head) - 3:
                return name  # the head ends inside a character
    return "latin-1"


def sniff(text: str, suffix: str) -> dict:
    """Delimiter, quote and escape characters, whether there is a header, its names, and the modal width of the sample's rows."""
    try:
        found = csv.Sniffer().sniff(text, DELIMITERS)
        form = {"delimiter": found.delimiter, "quotechar": found.quotechar or '"', "doublequote": found.doublequote or not found.escapechar, "skipinitialspace": found.skipinitialspace, "escapechar": found.escapechar}
    except csv.Error:  # one column, or no pattern: by the file's name
        form = {"delimiter": "\t" if suffix == "tsv" else ",", "quotechar": '"', "doublequote": True, "skipinitialspace": False, "escapechar": None}
    rows = [r for r in csv.reader(io.StringIO(text), **form) if r]
    width = Counter(len(r) for r in rows).most_common(1)[0][0] if rows else 1
    regular = [r for r in rows if len(r) == width][:25]
    out = io.StringIO()
    csv.writer(out, delimiter=form["delimiter"], lineterminator="\n").writerows(regular)
    try:
        header = csv.Sniffer().has_header(out.getvalue()) if len(regular) > 1 else True
    except csv.Error:
        header = True
    names = display_columns(regular[0] if header and regular else [f"column_{i + 1}" for i in range(width)])
    return {"delimiter": form["delimiter"], "quote": form["quotechar"], "escape": form["escapechar"], "has_header": header, "columns": names, "modal_width": width}


def display_columns(raw: list[str]) -> list[str]:
    """Names for a table: blank ones numbered, repeated ones told apart."""
    out, seen = [], Counter()
    for i, name in enumerate(raw):
        name = name.strip() or f"column_{i + 1}"
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return out


def _inspect(batches):
    for b in batches:
        rows = []
        for path, size, sha, head in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            encoding = detect_encoding(head or b"", size > len(head or b""))
            if encoding is None:
                rows.append((path, size, sha, *[None] * 7, "failed", "binary data"))
                continue
            text = head.decode(encoding, "ignore")
            if size > len(head):
                text = text.rsplit("\n", 1)[0]
            rows.append((path, size, sha, encoding, *sniff(text, path.rsplit(".", 1)[-1].lower()).values(), "parsed", None))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        names = [x.strip().split(" ")[0] for x in _SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def inspect_files(files: DataFrame) -> DataFrame:
    """Encoding, dialect, header and status of each file, from its first bytes; a file that can't be read stays as a failed row."""
    return files.select("path", "size", "sha256", F.substring("content", 1, HEAD_BYTES).alias("head")).mapInArrow(_inspect, _SCHEMA)


def inventory_summary(inspected: DataFrame) -> DataFrame:
    return inspected.groupBy("status").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def read_delimited(spark: SparkSession, path: str | list[str], columns: list[str], delimiter: str = ",", header: bool = True, encoding: str = "utf-8", quote: str = '"', escape: str | None = None) -> DataFrame:
    """All columns as text, with ``_row_id`` in file order and ``_malformed`` (the raw line of a row that is too wide or too narrow)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_malformed", T.StringType())])
    # a reader that leaves columns out doesn't see how wide a row is
    options = {"sep": delimiter, "header": header, "encoding": encoding, "quote": quote, "escape": escape or quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "nullValue": "", "enforceSchema": True}
    return spark.read.schema(schema).option("columnPruning", False).csv(path, **options).withColumn(ROW, F.monotonically_increasing_id())


def malformed_rows(df: DataFrame, width: int, delimiter: str = ",", keep: int = 20, quote: str = '"') -> tuple[int, list]:
    """How many rows have a wrong width, and the first of them as ``(row, observed, expected)``; quoted delimiters don't count."""
    bad = df.select(ROW, "_malformed", F.col(f"`{df.columns[0]}`").alias("_first")).filter("_malformed IS NOT NULL")  # a scan for the malformed column alone isn't allowed
    n = bad.agg(F.count("_malformed"), F.count("_first")).first()[0]
    first = bad.orderBy(ROW).limit(keep).collect() if n else []
    observed = [len(next(csv.reader([r["_malformed"]], delimiter=delimiter, quotechar=quote), [])) for r in first]
    return n, [Malformed(r[ROW], o, width) for r, o in zip(first, observed, strict=True)]


def regular_rows(df: DataFrame, width: int, delimiter: str = ",", allow_malformed: bool = False) -> DataFrame:
    """The rows of the right width. Others are refused, unless they are allowed: then they are left out."""
    n, first = malformed_rows(df, width, delimiter)
    if n and not allow_malformed:
        raise ValueError(f"{n} rows don't have {width} fields; the first: {first[:3]}")
    kept = df.filter("_malformed IS NULL") if n else df
    return kept.drop("_malformed")


def load_features(frames: list[DataFrame], targets: list[str], features: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """One table of several files' features and targets, and the features' names.

    Files may order their columns as they like but must have the same; a missing
    cell, or a name that isn't there, is an error.
    """
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("the files have different columns")
    names = features or [c for c in frames[0].columns if c not in targets and not c.startswith("_")]
    if wrong := [c for c in [*names, *targets] if c not in frames[0].columns] + [c for c in names if c in targets]:
        raise ValueError(f"unknown, or both feature and target: {', '.join(wrong)}")
    every = reduce(DataFrame.unionByName, [f.select(*[F.col(f"`{c}`") for c in [*names, *targets]]) for f in frames])
    missing = every.agg(*[F.count_if(F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == "")).alias(c) for c in every.columns]).first().asDict()
    if any(missing.values()):
        raise ValueError(f"missing cells: { {c: n for c, n in missing.items() if n} }")
    return every, names


#: A column of remarks that is no feature unless it is named; fixed value.
RESERVED = ("Comments",)


def column_roles(columns: list[str], features: list[str] | None, targets: list[str]) -> dict[str, list[str]]:
    """``features``, ``targets`` and ``ignored`` of a table: unique, known, and never both; without a choice all others are features, but for reserved ones."""
    chosen = features if features is not None else [c for c in columns if c not in targets and c not in RESERVED]
    for what, names in (("features", chosen), ("targets", targets)):
        if len(set(names)) < len(names):
            raise ValueError(f"{what} are named twice")
        if unknown := [c for c in names if c not in columns]:
            raise ValueError(f"unknown {what}: {', '.join(unknown)}")
    if both := [c for c in chosen if c in targets]:
        raise ValueError(f"both feature and target: {', '.join(both)}")
    if not chosen:
        raise ValueError("no feature is left")
    return {"features": chosen, "targets": list(targets), "ignored": [c for c in columns if c not in chosen and c not in targets]}


def exported_index(df: DataFrame, c: str, raw: str | None = None, first: bool = False) -> DataFrame:
    """``column, exported_index``: whether a column holds consecutive integers from zero or one and is named like an index; ``raw`` is its name in the file, where a blank one counts in the ``first`` column."""
    name = (c if raw is None else raw).strip().lower()
    v = F.col(f"`{c}`").cast("string").try_cast("double")
    s = df.agg(F.count("*").alias("rows"), F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_distinct(v).alias("u"), F.count_if(v != F.floor(v)).alias("parts"))
    named = F.lit(name in INDEX_NAMES or name.startswith("unnamed:") or (first and not name))
    ints = (F.col("rows") > 1) & (F.col("n") == F.col("rows")) & (F.col("parts") == 0) & F.col("low").isin(0.0, 1.0) & (F.col("high") - F.col("low") + 1 == F.col("n")) & (F.col("u") == F.col("n"))
    return s.select(F.lit(c).alias("column"), (named & ints).alias("exported_index"))


def table_page(df: DataFrame, page: int = 1, size: int = 50, search: str = "", filters: dict[str, str] | None = None, sort: str | None = None, descending: bool = False, order: str = ROW) -> DataFrame:
    """A page of rows: global and column searches, then a sort with numbers first, text by lower case, and missing last."""
    own, text = df, [c for c in df.columns if c != order]
    if search:
        own = own.filter(F.contains(F.lower(F.concat_ws("\u0001", *[F.col(f"`{c}`").cast("string") for c in text])), F.lit(search.lower())))
    for c, part in (filters or {}).items():
        own = own.filter(F.contains(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(part.lower())))
    keys: list[Column] = []
    if sort:
        keys = sort_keys(sort, descending)
    return own.orderBy(*keys, order).offset((page - 1) * size).limit(size)


def sort_keys(c: str, descending: bool = False) -> list[Column]:
    v = F.col(f"`{c}`").cast("string")
    number = v.try_cast("double")
    rank = F.when(v.isNull() | (v == ""), 2).when(number.isNotNull(), 0).otherwise(1)
    keys = [rank, number, F.lower(v)]
    return [k.desc() for k in keys] if descending else [k.asc() for k in keys]


def write_derived(df: DataFrame, output: str, source: str, overwrite: bool = False) -> None:
    """Write a derived table; never over its source."""
    if output.rstrip("/") == source.rstrip("/"):
        raise ValueError("a derived table can't replace its source")
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(output)
