import numpy as np
from pyspark.sql import functions as F

from recipeframe.llm.additive_quantisation import Index, QuantisationParameters, encode, fit_codebooks, nearest


def brute(rows, every=100, k=10):
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    out = {}
    for q, a in rows:
        if q % every == 0:
            d = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in rows if i != q)
            out[q] = d[:k]
    return out


def test_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in sorted(nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {(q, i): s for q in want for s, i in want[q]}
    assert all(abs(exact.get((q, i), s) - s) < 1e-9 for q in got for s, i in got[q])
    assert all(got[q] == sorted(got[q]) for q in got)


def test_beam_search_beats_greedy():
    x = np.random.default_rng(1).normal(size=(2000, 16)).astype(np.float32)
    p = QuantisationParameters(books=4, words=32, rounds=4)
    books = fit_codebooks(x, p)
    error = [((x - sum(books[m][c[:, m]] for m in range(4))) ** 2).sum() for c in (encode(books, x, 1), encode(books, x, 8))]
    assert error[1] < error[0] < (x**2).sum() * 0.6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0]), (100, [0.0, 2.0]), (100, [0.0, 2.0]), (50, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, codes string, rank int")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(df).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)] and len([g for g in got if g[0] == 0]) == 5
    assert [g[1:3] for g in got if g[0] == 100] == [(r, i) for r, i in enumerate([100, 0, 1, 2, 50], 1) for _ in range(2)]  # both rows ask
    assert nearest(df.filter("vec_id in (3, 4, 5)")).count() == 0 and nearest(df.limit(0)).count() == 0


def test_each_length_is_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=size).tolist()) for size, ids in ((8, range(300)), (5, range(300, 420)), (3, [500, 501]), (2, [600])) for i in ids]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    size = {i: len(v) for i, v in rows}
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    want = {q: [i for _, i in brute([r for r in rows if size[r[0]] == size[q]], 100)[q]] for q in (0, 100, 200, 300, 400, 500)}
    assert got == want  # so few rows are all reranked


def found_by(df, p=None):
    out = {}
    for r in nearest(df, p=p).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_codes_choose_among_50_000_rows(spark):
    """Vectors without any structure, the hardest case: one per cent of the rows is reranked, whatever the partitions."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(1, 50_001)
    ids[:400] = np.arange(1, 401) * 1000  # 400 queries
    ids[400:] = np.setdiff1d(np.arange(1, 200_000), np.arange(0, 500_000, 100))[: 49_600]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(x)}))
    one, many = found_by(df.coalesce(1)), found_by(df.repartition(64))
    assert one == many and len(one) == 400
    hits, at = 0, {int(i): k for k, i in enumerate(ids)}
    for q, own in one.items():
        d = np.sqrt(((x - x[at[q]]) ** 2).sum(1))
        d[at[q]] = np.inf
        hits += len({int(ids[i]) for i in np.argsort(d, kind="stable")[:10]} & {v for v, _ in own})
        assert all(abs(s - d[at[v]]) < 1e-12 for v, s in own)
    assert hits >= 0.95 * 4000
    own = df.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding").toDF("row", "vec_id", "vector")
    index = Index(own, QuantisationParameters())
    reranked = index.search(10, own.filter("vec_id % 100 = 0")).groupBy("query_row").count().agg(F.max("count"), F.count("*")).first()
    assert index.quota <= 500 and tuple(reranked) == (index.quota, 400)


def test_blocks_of_queries_and_few_pilots_change_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    p = QuantisationParameters(rerank=64, rerank_roots=0, block_bytes=6 * 8 * 7, pilot_rows=200, slab_rows=100, task_lookups=1 << 14)
    got = found_by(df, p)
    assert got == found_by(df, QuantisationParameters(rerank=64, rerank_roots=0)) and len(got) == 30 and all(len(v) == 10 for v in got.values())


def test_queries_that_a_bound_leaves_short_are_asked_again(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 4)))]
    own = spark.createDataFrame(rows, "vec_id long, vector array<double>").select(F.col("vec_id").alias("row"), "vec_id", "vector")
    index = Index(own, QuantisationParameters(rerank=20, rerank_roots=0))
    index.bounded = lambda asked: asked.withColumn("bound", F.lit(float("-inf")).cast("float"))
    found = index.search(10, own.filter("vec_id % 100 = 0")).groupBy("query_row").count().collect()
    assert [r["count"] for r in found] == [20] * 6
