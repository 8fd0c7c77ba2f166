"""Resumable export of XML collections: a stream over files that runs until all are done.

The checkpoint remembers finished files, so a second run with the same checkpoint
skips them, and one that was interrupted goes on where it stopped. Beside it a
ledger keeps each finished file's length, time and SHA-256, written with the batch
that exported it. A source that has changed since then would be skipped by the
checkpoint with its old records in the output, so a run first looks for changed
sources and refuses to go on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeframe.operators.xml_tables import extract
from recipeframe.sources.xml import shred_documents

_FILES = "path string, modificationTime timestamp, length long, content binary"
_LEDGER = "path string, length long, modified timestamp, sha256 string"


class SourceChanged(RuntimeError):
    """Sources that were exported before have other bytes now."""


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``path, length, modified, sha256`` of all files exported with this checkpoint."""
    try:
        return spark.read.schema(f"{_LEDGER}, batch long").parquet(f"{checkpoint}-ledger").drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def source_states(spark: SparkSession, source: str, checkpoint: str, pattern: str = "*.xml") -> DataFrame:
    """``path, state`` of every file below ``source`` or in the ledger: ``new, done, changed, gone``.

    Only files whose length or time differs from the ledger are read and hashed; one
    that was touched but holds the same bytes is done.
    """
    files = spark.read.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source)
    known = ledger(spark, checkpoint).select("path", F.col("length").alias("_length"), "modified", "sha256")
    both = files.select("path", "length", "modificationTime").join(known, "path", "full")
    touched = both.filter("sha256 IS NOT NULL AND length IS NOT NULL AND (length <> _length OR modificationTime <> modified)").select("path")
    hashed = files.join(touched, "path", "left_semi").select("path", F.sha2("content", 256).alias("now"))
    state = F.when(F.col("length").isNull(), "gone").when(F.col("sha256").isNull(), "new").when(F.col("now").isNotNull() & (F.col("now") != F.col("sha256")), "changed").otherwise("done")
    return both.join(hashed, "path", "left").select("path", state.alias("state"))


def export_collection(spark: SparkSession, source: str, output: str, checkpoint: str, root: str, fields: dict[str, str], rules: dict | None = None, pattern: str = "*.xml", files_per_batch: int = 1000) -> None:
    """Append the records of every new file below ``source`` to the Parquet table ``output``.

    Raises ``SourceChanged``, before anything is written, if a file that was exported
    has other bytes now; start again with a new checkpoint and output to take it in.
    """
    changed = source_states(spark, source, checkpoint, pattern).filter("state = 'changed'").orderBy("path").limit(6).collect()
    if changed:
        raise SourceChanged("changed since they were exported: " + ", ".join(r["path"] for r in changed[:5]) + (" and more" if len(changed) > 5 else ""))
    files = (
        spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(source)
    )

    def write(batch, number: int) -> None:
        nodes = shred_documents(batch.select(F.col("path").alias("source_file"), "content"))
        # a batch that is tried again replaces its own part, in the output and then in the ledger
        extract(nodes, root, fields, rules).write.mode("overwrite").parquet(f"{output}/batch={number}")
        done = batch.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
        done.write.mode("overwrite").parquet(f"{checkpoint}-ledger/batch={number}")

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
