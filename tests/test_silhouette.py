import numpy as np

from recipeframe.operators.metrics import silhouette
from recipeframe.plans import registry


def by_hand(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        same = (k == k[i]) & (np.arange(len(x)) != i)
        a, b = d[i][same].mean() if same.any() else None, min(d[i][k == o].mean() for o in set(k.tolist()) - {k[i]})
        out.append(0.0 if a is None or not max(a, b) else (b - a) / max(a, b))
    return float(np.mean(out))


def test_all_rows_count(spark):
    rng = np.random.default_rng(4)
    k = np.array([0] * 1300 + [1] * 190 + [2] * 9 + [3] + [-1] * 50)  # 3 is alone, -1 is noise
    x = rng.normal(size=(len(k), 3)) + k[:, None] * 1.5
    rows = [(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(k, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, k int, v array<double>")
    want = by_hand(x[k >= 0], k[k >= 0])
    for block in (4096, 400):
        assert abs(silhouette(df, "v", "k", "id", block).first()[0] - want) < 1e-6
    assert silhouette(df.filter("k = 0"), "v", "k", "id").first()[0] is None
    assert silhouette(df.limit(0), "v", "k", "id").first()[0] is None


def test_query_is_that_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = by_hand(np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows]))
    assert abs(registry.queries()["m37_silhouette"](spark, sf).first()[0] - want) < 2e-6
