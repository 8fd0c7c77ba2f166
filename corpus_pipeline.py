"""The corpus pipeline: toxic texts go, one of each group of near copies stays,
texts with benchmark passages go, personal data is replaced, and what is left is
mixed to target weights. Each stage calls one operator and works on all that the
stage before has kept. Whole texts pass through Python tasks in each of the first
three, so their batches are kept small there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recipeframe.functions.shared import fresh_path, small_batches
from recipeframe.llm.decontamination import drop_contaminated
from recipeframe.llm.mixing import TARGET_WEIGHTS, MixParameters, cut_text, mix, with_domain
from recipeframe.llm.pii import sanitise
from recipeframe.llm.simhash import drop_near_copies
from recipeframe.llm.toxicity import drop_toxic, fit, training_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows among ``docs``, and drop what scores as toxic.

    Null, empty and repeated texts are scored like any other; all columns stay.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit(training_rows(docs, labels)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with all its columns; null and blank texts are copies of each other."""
    small_batches(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a test item; null and empty texts hold none, repeated rows go or stay together."""
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that give it away; no row goes, null texts stay null."""
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of all tokens, by the target weights; a text that a leaf's budget ends in is cut after its last token taken.

    All columns of ``docs`` stay, ``n_chars`` (if there) is counted anew for a cut
    text; ``domain, n_tokens, epoch, place, take_tokens`` are added. Columns of
    ``docs`` with these names come back as they were, in place of the added ones.
    Null and blank texts hold no token and are never taken.
    """
    own = docs.select("doc_id", "text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    taken = mix(with_domain(own), MixParameters(weights=TARGET_WEIGHTS), keep=["text", "row"])
    short = F.col("take_tokens") < F.col("n_tokens")
    text = F.when(short, cut_text(F.col("text"), F.col("take_tokens"))).otherwise(F.col("text"))
    kept = {c: text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(short, F.length(text)).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    added = [c for c in ("domain", "n_tokens", "epoch", "place", "take_tokens") if c not in kept]
    return taken.select(*[v.alias(c) for c, v in kept.items()], *added)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: No SQL: the stages' methods aren't expressible in it. The tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{i}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
