"""What the third review found, each with a case that failed before."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as E
from recipeframe.operators import clusterings as K
from recipeframe.operators import representations as R
from recipeframe.operators import vector_clusters as V
from recipeframe.operators import xml_tables as X
from recipeframe.sources.xml import shred, shred_documents


def _embeddings(tmp_path, vectors):
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([i % 2 for i in range(len(vectors))], pa.int32())}), f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_tokens_keep_the_sign_of_rounded_zeros(spark, tmp_path):
    d = _embeddings(tmp_path, [[-1e-9, 1e-9, 0.0000005, -0.0000015, 0.1234565, -0.5, None, 3e30], [math.nan, math.inf, -math.inf, -0.0, 0.0, 1.0, -4e-7], [0.25]])
    got = {(r.vec_id, r.token): ([repr(x) for x in r["values"]], r["mask"]) for r in E.queries()["r08_tokens"](spark, d).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = {(i, t): ([repr(x) for x in v], m) for i, t, v, m in con.execute(E.oracle_sql()["r08_tokens"]).fetchall()}
    assert got == want and got[0, 0][0][0] == "-0.0"


def test_block_pairs_grow_as_the_table(spark, monkeypatch):
    """No more block pairs for more vectors, and vectors that one range holds aren't copied into its neighbours."""
    monkeypatch.setattr(V, "BLOCK", 10)
    x = np.random.default_rng(2).random((1500, 3)) - 0.5
    for n in (300, 1500):
        points = spark.createDataFrame([(i, v) for i, v in enumerate(x[:n].tolist())], "p long, v array<double>")
        pairs = V._paired(points, 1.2).groupBy("pair").count().collect()
        assert len(pairs) <= V.PARTS * (V.PARTS + 1) // 2 and sum(r["count"] for r in pairs) <= V.PARTS * n


def test_tiles_of_two_blocks(monkeypatch):
    """Tiles of a few distances give the same forest, counts and links as all at once."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, (60, 3)).astype(np.float64)  # many equal distances
    p = rng.permutation(60).astype(np.int64)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    monkeypatch.setattr(V, "_each_pair", lambda batches, columns: batches)
    home, core = np.ones(60, dtype=bool), np.arange(60) % 3 > 0
    found = []
    for tile in (7, 1 << 22):
        monkeypatch.setattr(V, "TILE", tile)
        cut = lambda s, *more: [x[s], home[s], p[s], *[m[s] for m in more]]
        forest = [pa.Table.from_batches(V._forests([(cut(slice(0, 60)), None)], r)).to_pydict() for r in (None, 1.0)]
        two = pa.Table.from_batches(V._forests([(cut(slice(0, 25)), cut(slice(25, 60)))], None)).to_pydict()
        counts = pa.Table.from_batches(V._counts([(cut(slice(0, 25), np.ones(60), ~home), cut(slice(25, 60), np.ones(60), ~home))], 1.0)).to_pydict()
        links = pa.Table.from_batches(V._links([(cut(slice(0, 60), core), None)], 1.0)).to_pylist()
        found.append((forest, two, {*zip(counts["p"], counts["n"], strict=True)}, {(r["a"], r["b"]) for r in links if not r["core"]}))
        assert len(forest[0]["a"]) == 59 and len(two["a"]) == 59
        assert found[-1][2] == {(int(p[i]), int(n)) for i in range(60) if (n := (d[i, 25:] if i < 25 else d[i, :25]).__le__(1).sum())}
        assert found[-1][3] == {(int(p[i]), int(p[j])) for i in range(60) for j in range(60) if d[i, j] <= 1 and not core[i] and core[j]}
    same = lambda f: sorted(zip(f["a"], f["b"], f["w"], strict=True))
    for one, other in zip((*found[0][0], found[0][1]), (*found[1][0], found[1][1]), strict=True):
        assert same(one) == same(other)
    assert found[0][2:] == found[1][2:]


def test_affinity_sums_and_no_stored_affinities(spark, monkeypatch):
    """Sums over a plane's close points by blocks and tiles, and no table of affinities: 3,000 points have 3.5 million of them."""
    rng = np.random.default_rng(6)
    x = rng.random((40, 2))
    p, home = np.arange(40), np.ones(40, dtype=bool)
    monkeypatch.setattr(K, "TILE", 50)
    value = rng.random(40)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = np.where((d <= 0.09) & (d > 0), np.exp(-d / 0.09), 0) @ value
    with monkeypatch.context() as m:
        m.setattr(K, "_each_pair", lambda batches, columns: batches)
        cut = lambda s: [x[s], home[s], p[s], value[s]]
        for pairs in ([(cut(slice(0, 40)), None)], [(cut(slice(0, 15)), None), (cut(slice(15, 40)), None), (cut(slice(0, 15)), cut(slice(15, 40)))]):
            got = pa.Table.from_batches(K._affinities(pairs, 0.3)).group_by("p").aggregate([("s", "sum")]).sort_by("p")
            assert np.allclose(got.column("s_sum").to_numpy(), want, rtol=1e-12)
    monkeypatch.setattr(K, "TILE", V.TILE)
    written = []
    real = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, tag="step": written.append((out := real(df, tag)).count()) or out)
    groups = np.concatenate([rng.normal(c, 0.1, (1000, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate([*groups, (50.0, 50.0)])], "id long, x double, y double")
    found = {r["id"]: r["cluster"] for r in K.spectral(df, "x", "y", "id", 0.6, 3).collect()}
    assert max(written) <= 4 * 3001 and found[3000] == -1 and set(found.values()) <= {-1, 0, 1, 2} and all(found[i] >= 0 for i in range(3000))


def test_profiles_of_paths_need_no_group_for_each_parent(spark):
    """Numbers among equal siblings give the cardinalities; what is aggregated has no parents in it."""
    docs = [("s1", b"<r><a><b/><c>t</c><b/></a><a/><d>x<e/></d></r>"), ("s2", b"<r><a><b/></a><a><b/><b/><b/></a></r>"), ("s3", b"<r"), ("s4", b"<q/>")]
    nodes = spark.createDataFrame(docs, "source_file string, content binary")
    nodes = shred_documents(nodes).cache()
    assert [(r[4], r[-1]) for r in shred(*docs[0])] == [("/r", 0), ("/r/a", 0), ("/r/a/b", 0), ("/r/a/c", 0), ("/r/a/b", 1), ("/r/a", 1), ("/r/d", 0), ("/r/d/e", 0)]
    got = {r["path"]: tuple(r)[2:] for r in X.path_profile(nodes).collect()}
    #                  occurrences, parents with, min, max, mean, repeated, optional, with text, leaf
    assert got["/r/a/b"] == (6, 3, 0, 3, 2.0, True, True, 0, True) and got["/r/a"] == (4, 2, 2, 2, 2.0, True, False, 0, False)
    assert got["/r"] == (2, 0, 1, 1, 1.0, False, False, 0, False) and got["/r/d"] == (1, 1, 0, 1, 1.0, False, True, 1, False) and got["/q"][:2] == (1, 0)
    shapes = {(r["source_file"], r["path"]): (r["repeated"], r["optional"], r["mixed"]) for r in X.source_shapes(nodes).collect()}
    assert shapes["s1", "/r/a/b"] == (True, True, False) and shapes["s2", "/r/a/b"] == (True, False, False) and shapes["s1", "/r/d"] == (False, False, True)
    rows = X.extract(nodes, "/r/a", {"c": "text:/r/a/c"}, {"c": {"strategy": "count"}}).collect()
    assert sorted((r["source_file"], r["c"]) for r in rows) == [("s1", 0), ("s1", 1), ("s2", 0), ("s2", 0)]


def test_pairs_of_sources_meet_by_shapes(spark, monkeypatch):
    """The same rows as comparing all sources, in blocks of two, with one comparison for each two shapes."""
    monkeypatch.setattr(X, "PAIR_BLOCK", 2)
    kinds = [b"<r><a i='1'/><a i='2'/></r>", b"<r><a/><a/>x</r>", b"<q/>", b"<r><b/></r>", b"<r><a i='3'/><a i='4'/></r>"]
    nodes = shred_documents(spark.createDataFrame([(f"s{i}", kinds[i % 5]) for i in range(11)], "source_file string, content binary")).cache()
    want = X.shape_similarity(X.source_shapes(nodes).cache()).collect()
    met = []
    real = X.shape_similarity
    monkeypatch.setattr(X, "shape_similarity", lambda shapes: met.append(shapes.select("source_file").distinct().count()) or real(shapes))
    assert sorted(map(tuple, X.pair_similarity(nodes).collect())) == sorted(map(tuple, want)) and len(want) == 55 and met == [4]


def test_distances_by_tiles(spark, monkeypatch):
    """Ranks with ties, copies and missing vectors, in tiles of a few rows and queries, as by hand; pairs never leave the tasks."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (60, 6)).astype(np.float64)
    rows = [(i, v, v[:2]) for i, v in enumerate(x.tolist())] + [(60, None, None), (61, [1.0] * 5 + [None], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>, low array<double>")
    monkeypatch.setattr(R, "QUERY_TILE", 3)
    monkeypatch.setattr(R, "ROW_TILE", 7)
    over, n, m = 0, 62, 12
    for q in range(0, 60, 5):
        d = [sorted((sum((x[i, c] - x[q, c]) ** 2 for c in range(w)), i) for i in range(60) if i != q) for w in (6, 2)]
        rank = {i: r + 1 for r, (_, i) in enumerate(d[0])}
        over += sum(max(rank[i] - 5, 0) for _, i in d[1][:5])
    got = R.trustworthiness(df, df.filter("id % 5 = 0 AND id < 60"), "id", "v", "low").first()[0]
    assert math.isclose(got, 1 - 2.0 / (m * 5 * (2 * n - 16)) * over, rel_tol=1e-12)
    assert R.trustworthiness(df.limit(0), df.limit(0), "id", "v", "low").first()[0] is None and R.rank_agreement(df, df.limit(0), "id", "v", "low").first()[0] is None


def test_links_of_a_plane_leave_as_forests(spark, monkeypatch):
    """Two neighbouring crowds have a million close pairs; what is stored of them is a forest."""
    stored, real = {}, V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, tag="step": stored.update({tag: (out := real(df, tag))}) or out)
    x = np.random.default_rng(9).random((2000, 2)) * [0.09, 0.03]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate([*x, (9.0, 9.0)])], "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in K.single_linkage(df, "x", "y", "id", 0.05).collect()}
    assert stored["links"].count() < 4000 * 4 and set(got.values()) == {0, 2000} and got[2000] == 2000
