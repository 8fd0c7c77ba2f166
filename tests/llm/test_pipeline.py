"""Each stage's decisions on real rows, against the operators' own brute-force twins."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_near_copies import by_hand, components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_copies", "decontamination", "pii", "mixing"]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) <= set(kept)
        if name == "near_copies":
            ids = sorted(kept)
            label = components([by_hand(kept[i].text) for i in ids])  # five-word shingles, similarity of 0.8
            assert set(rows) == {min(i for i, x in zip(ids, label) if x == c) for c in set(label)}
        if name == "decontamination":
            plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
            items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaked = {i for i, r in kept.items() if any(f" {x} " in f" {plain(r.text)} " for x in items)}
            assert set(rows) == set(kept) - leaked
        if name == "pii":
            assert set(rows) == set(kept) and not any("@" in r.text and re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in rows.values())
        docs, kept = out, rows
    mixed = P.STAGES[-1][1](spark, docs, SF).collect()
    total = sum(len(r.text.split()) for r in kept.values())
    assert sum(r.take_tokens for r in mixed) == total // 2
    assert all(len(r.text.split()) >= r.take_tokens for r in mixed) and np.all([r.doc_id in kept for r in mixed])


def test_run_and_empty_tables(spark, tmp_path):
    assert P.run(spark, SF).count() > 0 and P.ORACLE_SQL is None
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_stay(spark):
    own = [F.lit(7).alias(c) for c in ("_hash", "_id", "hash", "id", "row", "fp", "node", "place", "epoch", "take_tokens")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *own).withColumn("n_chars", F.length("text"))
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns[: len(columns)] == columns and docs.filter(" OR ".join(f"{c} <> 7" for c in columns[5:])).count() == 0
        assert docs.filter("n_chars <> length(text)").count() == 0 and docs.count() > 0
    assert set(docs.columns[len(columns) :]) == {"domain", "n_tokens"}


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id"), F.lpad(F.lit(""), 6000, " some words")).alias("text"))
    rows.write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(1, "one test item of a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents").coalesce(1)
    assert P.decontamination(spark, docs, str(tmp_path)).count() == 4000
    sizes = docs.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in it), "n long").collect()
    assert sum(r.n for r in sizes) > 20e6 and max(r.n for r in sizes) < 6e6


def test_cut_texts_are_beginnings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    cut = [r for r in P.mixing(spark, docs, SF).collect() if r.take_tokens < r.n_tokens]
    assert cut and all(whole[r.doc_id].startswith(r.text) and len(r.text.split()) == r.take_tokens and r.n_chars == len(r.text) for r in cut)
