"""Steps that must stay bounded in disk: what is stored, and the same results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from recipeframe.operators import representations as R


def _rows(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def test_distance_ranks_in_bands_store_no_distance(spark, monkeypatch):
    """Above FEW pairs the distances are ranked band by band, within bounds that decide the digits."""
    x = np.random.default_rng(11).normal(size=(400, 6))
    df = _rows(spark, x).withColumn("low", F.slice("v", 1, 3))
    asked = df.filter("id % 4 = 0")
    whole = R.rank_agreement(df, asked, "id", "v", "low").first()[0]
    monkeypatch.setattr(R, "FEW", 0)
    monkeypatch.setattr(R, "STORED", 30_000)  # of 79,800 records: three bands
    monkeypatch.setattr(R, "SENT", 1000)
    monkeypatch.setattr(R, "fresh_path", lambda *a: 1 / 0)  # no distances are stored
    assert abs(R.rank_agreement(df, asked, "id", "v", "low").first()[0] - whole) < 1e-8


def test_distance_ranks_of_few_different_distances(spark, monkeypatch):
    """Bounds don't decide them; equal pairs of distances are counted, then ranked as they are."""
    x = np.random.default_rng(12).integers(0, 2, size=(90, 5))
    df = _rows(spark, x).withColumn("low", F.slice("v", 1, 2))
    asked = df.filter("id % 3 = 0")
    whole = R.rank_agreement(df, asked, "id", "v", "low").first()[0]
    monkeypatch.setattr(R, "FEW", 0)
    assert abs(R.rank_agreement(df, asked, "id", "v", "low").first()[0] - whole) < 1e-12


def test_typed_records_are_made_where_documents_are_parsed(spark, tmp_path, monkeypatch):
    """As from the node table, also of nested, mixed, broken and large documents; the export stores nothing beside its file."""
    import pytest
    from recipeframe.operators import stores as S
    from recipeframe.operators import xml_selection as Z
    from recipeframe.sources.xml import shred_documents

    docs = [
        ("a", b"<r>x<e k='1'> one  two<f>3</f>tail<f/></e><g><e/></g><e>\tfour\n</e></r>"), ("b", b"<r><e><f><h>deep</h></f></e></r>"),
        ("c", b"<r><e>"), ("d", b"<r/>"), ("e", b"<q><e/></q>"), ("f", b"<!-- c --><r><e><![CDATA[ a b ]]>\xc3\xa9\xc2\xa0z</e></r>"), ("g", b"<r>" + b"<e>w<f>v</f></e>" * 30 + b"</r>"),
    ]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in docs], "source_file string, content binary")
    rows = lambda x: sorted(map(str, x.select("source_file", "record", "content_tokens", "path_tokens", "children", "id").collect()))
    sha = F.sha2("source_file", 256)
    by_nodes = rows(Z.record_ids(Z.typed_records(shred_documents(df), "/r/e"), sha, "/r/e"))
    assert len(by_nodes) == 34 and rows(Z.identified_records(df, "/r/e", sha)) == by_nodes
    monkeypatch.setattr(Z, "MOST_AT_ONCE", 100)
    assert rows(Z.identified_records(df, "/r/e", sha)) == by_nodes
    monkeypatch.setattr(S, "materialize", lambda *a: 1 / 0)
    out = S.write_json_lines(Z.identified_records(df, "/r/e", sha), str(tmp_path / "out"))
    assert out["rows"] == 34 and out["verified"] and rows(out["table"]) == by_nodes
    with pytest.raises(Exception):
        S.write_json_lines(df, str(tmp_path / "out"))


def test_pairs_of_sources_are_never_shuffled(spark):
    """Also where no table is small enough for Spark to broadcast it by itself."""
    from recipeframe.operators import xml_tables as X
    from recipeframe.sources.xml import shred_documents

    kinds = [b"<r><a i='1'/><a i='2'/></r>", b"<r><a/><a/>x</r>", b"<q/>"]
    nodes = shred_documents(spark.createDataFrame([(f"s{i}", bytearray(kinds[i % 3])) for i in range(12)], "source_file string, content binary")).cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = X.pair_similarity(nodes)
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1, plan  # that of blocks, and that to the shapes
        assert made.count() == 66
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_trees_of_equal_features_are_fitted_from_groups(spark):
    """A tree and boosting predict from groups what they predict from all rows; a forest's draws are those of rows."""
    from recipeframe.operators import model_selection as Y
    from recipeframe.operators import models as M

    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(640, 2))
    y = x[:, 0] * 2.0 - (x[:, 1] > 1) * x[:, 0] + rng.normal(size=640)
    df = M.assemble(spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "row long, a double, b double, label double"), ["a", "b"], "label").select("row", "features", "label").cache()
    one = lambda k, **g: M.Spec(M.REGRESSORS[k].make, {n: v[:1] for n, v in (M.REGRESSORS[k].grid | g).items()}, grouped=M.REGRESSORS[k].grouped)
    train, _ = Y.prepare(df, "row", "regression", folds=2)
    groups = Y.label_groups(train)
    assert groups.count() == 32 and Y.label_groups(train.filter("row < 300")) is None
    for kind in ("decision_tree", "boosting"):
        plain = Y.cross_validate(train, M.Spec(M.REGRESSORS[kind].make, one(kind).grid), "fold", "regression")
        assert abs(plain[0]["mean"] - Y.cross_validate(train, one(kind), "fold", "regression", groups=groups)[0]["mean"]) < 1e-9
    drawn = Y.drawn_groups(train, "row", 4)
    n = [r[1] for r in drawn.groupBy("tree").agg(F.sum("weight")).orderBy("tree").collect()]
    assert len(n) == 4 and len(set(n)) > 1 and all(abs(w - train.count()) < 100 for w in n), (n, train.count())
    assert drawn.filter("weight <> floor(weight)").count() == 0
    forest = Y.select_model(df, one("random_forest", numTrees=[4]), "row", "regression", folds=2)
    assert isinstance(forest.model, M.MeanOf) and abs(forest.score - 1.0) < 0.4 and forest.predictions.count() == 160


def test_density_clusters_of_a_plane_store_no_pairs(spark, monkeypatch):
    """As by all pairs, with noise, borders and rows without a point; two dense crowds have 700,000 close pairs, of which forests are stored."""
    from recipeframe.operators import models as M
    from recipeframe.operators import vector_clusters as V

    stored, real = {}, V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, tag="step": stored.update({tag: (out := real(df, tag))}) or out)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.random((700, 2)) * 0.03, rng.random((700, 2)) * 0.03 + 0.1, rng.random((60, 2))))
    table = [(i, *map(float, v)) for i, v in enumerate(x)] + [(5000, None, 1.0), (5001, float("nan"), 1.0), (5002, 0.5, float("inf"))]
    got = {r["id"]: r["cluster"] for r in M.dbscan(spark.createDataFrame(table, "id long, x double, y double"), "x", "y", "id", 0.02, 4).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.02 * 0.02
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        new = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
        if (new == label).all():
            break
        label = new
    want = np.where(core, label, np.where(near & core[None], label[None], len(x)).min(1))
    assert [got[i] for i in range(len(x))] == np.where(want == len(x), -1, want).tolist() and {got[i] for i in (5000, 5001, 5002)} == {-1}
    assert near.sum() > 600_000 and stored["links"].count() < 20 * len(x)


def test_single_precision_vectors_travel_as_such(spark):
    from recipeframe.operators import vector_clusters as V

    df = _rows(spark, np.random.default_rng(2).normal(size=(60, 3)).astype(np.float32)).withColumn("w", F.col("v").cast("array<float>"))
    by = [sorted(map(tuple, V.density_clusters(df, c, "id", 0.9, 3).collect())) for c in ("v", "w")]
    assert by[0] == by[1] and len({c for _, c in by[0]}) > 1
    kinds = [V._paired(df.select(F.col("id").alias("p"), "v"), 0.9, None, False, narrow).schema["v"].dataType.simpleString() for narrow in (False, True)]
    assert kinds == ["array<double>", "array<float>"]
