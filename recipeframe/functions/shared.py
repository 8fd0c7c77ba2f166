"""Shared storage and skew helpers used by every operator.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
the driver and all executors can reach, so a lost executor never loses them.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate files: the cluster's ``spark.checkpoint.dir``.

    Only when that is unset and the session runs in one process (tests, a laptop)
    a local folder is made, which also becomes the session's checkpoint folder; on
    a cluster its absence is an error, as executors share no local folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _UNSET:
        _UNSET[app] = tempfile.mkdtemp(prefix="recipeframe-")
        spark.sparkContext.setCheckpointDir(_UNSET[app])
    return _UNSET[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/recipeframe/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: later readers scan the files, and executors that are
    lost take nothing with them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: nothing reads them once the result is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """The intermediate tables of one job, each of which can be dropped as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self._spark, self._stored = spark, []

    def store(self, df: DataFrame, tag: str = "step") -> DataFrame:
        """As ``materialize``."""
        path = fresh_path(self._spark, tag)
        with shuffles_dropped(self._spark):
            df.write.parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._stored.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that ``store`` returned; None and all else is ignored."""
        for t in tables:
            for at, (own, path) in enumerate(self._stored):
                if own is t:
                    discard(self._spark, path)
                    del self._stored[at]
                    break

    def drop_all(self) -> None:
        """Remove all tables that are still stored."""
        self.drop(*[t for t, _ in self._stored])


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let at most about ``most`` bytes of rows go to a Python task at once, from now on in this session.

    By default a batch has 10,000 rows or 64 MB, and each task holds several
    copies of it: while it is filled, sent, handled and returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def truncate(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small loop state (never the local variant)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(counts: DataFrame, key: str, n: str, most: int = 1000) -> list:
    """Keys that hold more than one ``most``-th of all rows: at most ``most`` of them.

    ``counts`` has one row per key and its row count. The bound does not depend
    on the data, so the returned list can always be broadcast.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    if not total:
        return []
    return [r[0] for r in counts.filter(F.col(n) > F.lit(total / most)).select(key).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """Join to ``right`` (unique per ``key``) when a few keys of ``left`` are very frequent.

    Rows of hot keys meet a broadcast slice of at most ``len(hot)`` rows and stay
    where they are; all other rows are joined by a shuffle on ``key``.
    """
    if not hot:
        return left.join(right, key, how)
    inside = F.col(key).isin(hot)
    common = left.filter(inside).join(F.broadcast(right.filter(inside)), key, how)
    rest = left.filter(~F.coalesce(inside, F.lit(False))).join(right.filter(~inside), key, how)
    return rest.unionByName(common)


MARKS, _SLOT = 1 << 25, 1 << 15  # bits of a filter (4 MB), and of each of its rows


def _mark(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), *on), F.lit(MARKS))


def key_filter(keys: DataFrame, on: list[str]) -> DataFrame:
    """A table of at most 4 MB for ``with_marks``: one bit is set for each key of ``keys``. It can always be broadcast."""
    own = keys.select(_mark(on).alias("_at"))
    return own.groupBy(F.floor(F.col("_at") / _SLOT).alias("_slot")).agg(F.bitmap_construct_agg(F.col("_at") % _SLOT).alias("_bits"))


def with_marks(rows: DataFrame, marks: DataFrame, on: list[str], name: str = "_marked") -> DataFrame:
    """Add whether the key may be among those of a ``key_filter``: true for all of these, and by chance for others.

    What isn't marked needs no shuffle to be told from the keys; what is has to be
    joined still. With as many keys as bits about 0.63 of the others are marked.
    The columns ``on`` must have the types that they have in the filter.
    """
    at = rows.withColumn("_at", _mark(on)).withColumn("_slot", F.floor(F.col("_at") / _SLOT))
    byte = "CAST(conv(hex(substring(_bits, CAST(_at % 32768 DIV 8 AS int) + 1, 1)), 16, 10) AS int)"
    hit = F.expr(f"coalesce(getbit({byte}, CAST(_at % 8 AS int)) = 1, false)")
    return at.join(F.broadcast(marks), "_slot", "left").withColumn(name, hit).drop("_at", "_slot", "_bits")


def keep_in_memory(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one that no later step reads."""
    if not path.startswith(f"{shared_dir(spark)}/recipeframe/"):
        raise ValueError(f"{path} is not an intermediate table")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
