"""What the pipeline's stages shuffle and leave behind: texts that need not move or be stored do neither."""

import os
import random
import time

from pyspark.sql import functions as F

from recipeframe.functions.shared import key_filter, shared_dir, with_marks
from recipeframe.llm.mixing import MixParameters, mix
from recipeframe.llm.pii import sanitise
from recipeframe.llm.simhash import drop_near_copies
from recipeframe.llm.toxicity import fit


def _texts(spark, tmp_path, n, words):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(40):010x}" for _ in range(words)), "en", "src1", "web") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string").repartition(4).write.parquet(f"{tmp_path}/texts")
    return spark.read.parquet(f"{tmp_path}/texts"), sum(len(r[1]) for r in rows)


def _stored(spark):
    top = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{top}/recipeframe") for f in names)


def _moved(spark, run):
    """Bytes shuffled and left in the shared folder by ``run``, and its rows."""
    shuffled = lambda: time.sleep(0.5) or spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, stored = shuffled(), _stored(spark)
    n = run()
    return shuffled() - before, _stored(spark) - stored, n


def test_filters_mark_each_key_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("m"))
    every = spark.range(40_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("m"), "id")
    marked = with_marks(every, key_filter(keys, ["k", "m"]), ["k", "m"])
    assert marked.columns == ["k", "m", "id", "_marked"] and marked.count() == 40_000
    assert marked.filter("id % 2 = 0 AND NOT _marked").count() == 0 and marked.filter("id % 2 = 1 AND _marked").count() < 200
    nulls = spark.createDataFrame([(None, 1)], "k string, m long")
    assert with_marks(nulls, key_filter(nulls, ["k", "m"]), ["k", "m"]).filter("_marked").count() == 1
    assert with_marks(nulls, key_filter(nulls.limit(0), ["k", "m"]), ["k", "m"]).filter("NOT _marked").count() == 1


def test_texts_without_near_copies_stay_where_they_are(spark, tmp_path):
    docs, size = _texts(spark, tmp_path, 1500, 800)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        copies = docs.filter("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 5000)
        shuffled, left, n = _moved(spark, lambda: len(drop_near_copies(docs.unionByName(copies)).select(F.length("text")).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert n == 1500 and shuffled < size / 4 and left < size / 20


def test_mixing_stores_no_text_and_moves_only_the_last_ranges(spark, tmp_path):
    docs, size = _texts(spark, tmp_path, 4000, 100)
    taken = mix(docs, MixParameters(range_rows=64), keep=["text"])
    shuffled, left, n = _moved(spark, lambda: sum(r.take_tokens for r in taken.select("take_tokens", F.length("text")).collect()))
    assert n == 4000 * 100 // 2 and shuffled < size / 8
    _, left, _ = _moved(spark, lambda: mix(docs, MixParameters(range_rows=64), keep=["text"]))
    assert left < size / 8


def test_what_is_read_no_more_goes(spark, tmp_path):
    docs, size = _texts(spark, tmp_path, 1000, 100)
    _, left, _ = _moved(spark, lambda: fit(docs.select("doc_id", "text", (F.col("doc_id") % 2).alias("toxic"))))
    assert left == 0
    letters = F.concat(F.translate("text", "0123456789", "ghijklmnop"), F.when(F.col("doc_id") < 3, " a@b.com").otherwise(""))
    _, left, n = _moved(spark, lambda: sanitise(docs.withColumn("text", letters)).count())
    assert n == 1000 and left < size / 8
