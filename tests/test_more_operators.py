"""Quantiles, components, cliques, intake rules, XML comparison, consensus and model selection, against plain Python."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from recipeframe.functions.graph import connected_components
from recipeframe.functions.quantiles import quantiles
from recipeframe.functions.ranks import running_extreme
from recipeframe.operators import graphs as G
from recipeframe.operators import metrics as M
from recipeframe.operators import model_selection as Y
from recipeframe.operators import models as O
from recipeframe.operators import profile as P
from recipeframe.operators import runs as N
from recipeframe.operators import xml_selection as Z
from recipeframe.operators import xml_tables as X
from recipeframe.operators.recipe import ordered_fill, run_recipe
from recipeframe.sources import delimited as D
from recipeframe.sources import xml as S


def test_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[float(rng.randint(0, 30)) for _ in range(9)]])) for _ in range(3000)] + [("c", 2.5), ("d", None)]
    at = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = {r.k: (r.n, r.q) for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", at).collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, (n, q) in got.items():
        own = [v for key, v in rows if key == k and v is not None]
        assert n == len(own) and np.allclose(q, np.quantile(own, at))
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", at).count() == 0


def test_running_extreme(spark):
    rows = [(i, (i * 37) % 101 if i % 4 else None) for i in range(300)]
    got = {r.k: r.m for r in running_extreme(spark.createDataFrame(rows, "k int, v int").repartition(3), ["k"], F.col("v"), "m").collect()}
    assert got == {i: min((v for _, v in rows[: i + 1] if v is not None), default=None) for i in range(300)}


def test_components_are_never_half_merged(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.label for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, most_rounds=2)


def test_greedy_clique(spark):
    rng = random.Random(8)
    links = {frozenset(e) for e in itertools.combinations(range(40), 2) if rng.random() < 0.4}
    edges = [(a, b) for e in links for a, b in itertools.permutations(e)] + [(3, 3), (1, None)]
    near = {n: {b for e in links if n in e for b in e if b != n} for n in range(40)}
    df = spark.createDataFrame(edges, "src long, dst long")
    for start in (None, 5):
        want = [max(near, key=lambda n: (len(near[n]), -n)) if start is None else start]
        while left := set.intersection(*(near[m] for m in want)):
            want.append(max(left, key=lambda n: (len(near[n]), -n)))
        got = [r.node for r in G.greedy_clique(df, start).orderBy("place").collect()]
        assert got == want and G.is_clique(df, got).first()[0] and G.valid_additions(df, got).count() == 0
    assert not G.is_clique(df, [got[0], got[0]]).first()[0]
    assert G.greedy_clique(df.limit(0)).count() == 0


def test_ordered_fill_over_ranges_of_ranges(spark):
    rows = [(i * i, float(i) if i % 7 == 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "at long, v double").repartition(4)
    for forward in (True, False):
        order, last, want = rows if forward else rows[::-1], None, {}
        for at, v in order:
            last = v if v is not None else last
            want[at] = last
        assert {r["at"]: r.v for r in ordered_fill(df, ["v"], "at", forward, block=5).collect()} == want


def test_drop_duplicates(spark):
    rows = [(i, i, i % 5, None if i % 5 == 2 else "x") for i in range(50)] + [(50, 50, 9, "y")]
    df = spark.createDataFrame(rows, "_row_id long, w long, k long, v string")
    got = lambda keep: sorted(r["w"] for r in run_recipe(df, [{"type": "drop_duplicates", "columns": ["k", "v"], "keep": keep}]).collect())
    assert got("first") == [0, 1, 2, 3, 4, 50] and got("last") == [45, 46, 47, 48, 49, 50] and got("none") == [50]


def test_splits_by_class(spark):
    rows = [(i, "abc"[i % 3] if i < 90 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label string")
    split = M.stratified_split(df, "label", "id", 0.3).collect()
    assert Counter(r.label for r in split if r.is_test) == {"a": 9, "b": 9, "c": 9, None: 3} and len(split) == 100
    folds = Counter((r.label, r.fold) for r in M.stratified_folds(df, "label", "id", 5).collect())
    assert set(folds.values()) == {6, 2}
    assert sum(r.is_test for r in M.plain_split(df.limit(3), "id", 0.01).collect()) == 1
    ranked = [(r.id, r["_k"]) for r in M._placed_in_class(df.withColumn("label", F.lit(1)), "label", "id", 1, range_rows=7).collect()]
    assert sorted(k for _, k in ranked) == list(range(1, 101))


def test_coassignment_of_all_pairs(spark):
    rng = random.Random(2)
    label = {(r, i): rng.choice([-1, 0, 0, 1]) for r in range(3) for i in range(30)}
    members, pairs = M.coassignment(spark.createDataFrame([(r, i, v) for (r, i), v in label.items()], "run int, row int, label int"))
    of, found = {r.row: r["class"] for r in members.collect()}, {(r.a, r.b): r for r in pairs.collect()}
    sure, n = 0.0, Counter()
    for i, j in itertools.combinations(range(30), 2):
        runs = [r for r in range(3) if label[r, i] != -1 and label[r, j] != -1]
        key = tuple(sorted((of[i], of[j])))
        if runs:
            share = sum(label[r, i] == label[r, j] for r in runs) / len(runs)
            assert found[key].eligible == len(runs) and abs(found[key].consensus - share) < 1e-9
            sure, n[key] = sure + max(share, 1 - share), n[key] + 1
        else:
            assert key not in found
    assert {k: r.pairs for k, r in found.items()} == dict(n)
    assert abs(M.consensus_consistency(pairs).first()[0] - sure / sum(n.values())) < 1e-9


def test_intake_rules(spark, tmp_path):
    (tmp_path / ".secret").mkdir()
    (tmp_path / ".secret" / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "q.csv").write_text('a,b\n"1,5",2\n"x, y",3,4\n5\n')
    assert [r.path.rsplit("/", 1)[1] for r in D.discover(spark, str(tmp_path)).collect()] == ["q.csv"]
    df = D.read_delimited(spark, str(tmp_path / "q.csv"), ["a", "b"])
    n, first = D.malformed_rows(df, 2)
    assert n == 2 and [(m.observed, m.expected) for m in first] == [(3, 2), (1, 2)]
    with pytest.raises(ValueError):
        D.regular_rows(df, 2)
    assert [r.a for r in D.regular_rows(df, 2, allow_malformed=True).collect()] == ["1,5"]
    one, two = spark.createDataFrame([("1", "x")], "f string, t string"), spark.createDataFrame([("y", "2")], "t string, f string")
    every, names = D.load_features([one, two], ["t"])
    assert names == ["f"] and sorted(map(tuple, every.collect())) == [("1", "x"), ("2", "y")]
    for bad in ([one, one.drop("f")], [one, spark.createDataFrame([("", "z")], "f string, t string")]):
        with pytest.raises(ValueError):
            D.load_features(bad, ["t"])
    assert D.column_roles(["a", "b", "Comments"], None, ["b"]) == {"features": ["a"], "targets": ["b"], "ignored": ["Comments"]}
    for features, targets in ((["a", "a"], []), (["z"], []), (["b"], ["b"]), ([], [])):
        with pytest.raises(ValueError):
            D.column_roles(["a", "b"], features, targets)


def test_role_overrides_are_checked(spark):
    roles = spark.createDataFrame([("a", "text", "exclude"), ("b", "float", "continuous")], "column string, inferred_type string, role string")
    assert {r.column: (r.role, r.overridden) for r in P.override_roles(roles, {"b": "discrete"}).collect()} == {"a": ("exclude", False), "b": ("discrete", True)}
    for wrong in ({"z": "discrete"}, {"a": "continuous"}, {"a": "other"}):
        with pytest.raises(ValueError):
            P.override_roles(roles, wrong)


def nodes_of(spark, docs):
    return S.shred_documents(spark.createDataFrame([(k, bytearray(v.encode())) for k, v in docs.items()], "source_file string, content binary"))


def test_pairs_of_sources(spark):
    rec = "<rec id='{0}'><v>{0}</v></rec>"
    many = "".join(rec.format(i) for i in range(3))
    docs = {"a": f"<r>{many}</r>", "b": f"<r>{many}</r>", "c": f"<r>{many.replace('<v>1</v>', '<v>1</v><v>9</v>')}</r>", "d": f"<r>{many.replace('<v>1</v>', '')}</r>", "e": f"<r>{many}text</r>", "f": f"<q xmlns='u'>{many}</q>", "g": "<r><one/></r>"}
    got = {(r.left, r.right): (r.classification, r.reason) for r in X.pair_similarity(nodes_of(spark, docs)).collect()}
    assert len(got) == 21
    assert got["a", "b"] == ("exact", "identical_structural_fingerprint") and got["a", "c"] == ("review_required", "observed_cardinality_differs")
    assert got["a", "d"] == ("compatible_variant_candidate", "null_tolerant_shared_record_root") and got["a", "e"] == ("review_required", "mixed_content_shape_differs")
    assert got["a", "f"] == ("incompatible", "different_expanded_root_qname") and got["a", "g"] == ("review_required", "no_shared_record_root_evidence")
    groups = {r.source_file: r.group for r in Z.complete_link_groups(nodes_of(spark, docs)).collect()}
    assert groups == {"a": 1, "b": 1, "d": 1, "g": 1, "c": 2, "e": 3, "f": 4}


def test_reasons_need_all_occurrences(spark):
    x = "<r xmlns:xsi='http://www.w3.org/2001/XMLSchema-instance'><p><v xsi:nil='true'/><v xsi:nil='true'/></p><p><v xsi:nil='true'/><v>1</v></p><p><v/><v/></p><p/><p><v>2</v></p></r>"
    got = [r.status for r in X.null_reasons(nodes_of(spark, {"s": x}), "/r/p", {"v": "text:/r/p/v"}).orderBy("record").collect()]
    assert got == ["explicit_xsi_nil", "multiple", "empty_element", "path_absent", "value"]


def test_single_records_are_no_roots(spark):
    assert X.record_candidates(nodes_of(spark, {"s": "<r><only id='1'><a/></only></r>"})).count() == 0


def test_large_documents_leave_in_batches():
    content = ("<r>" + "".join(f"<i n='{k}'>t{k}<b/>x</i>" for k in range(70_000)) + "</r>").encode()
    batches = list(S.shred_batches("s", content))
    assert len(batches) > 2 and max(b.num_rows for b in batches) < 80_000
    rows = S.shred("s", content)
    assert [r[1] for r in rows] == list(range(140_001)) and rows[1][8] == "t0" and rows[2][9] == "x" and rows[0][12] is False and rows[139_999][10] == [("n", "69999")]
    assert "too many" in S.shred("s", b"<a>" * 600 + b"</a>" * 600)[0][13]


def test_preview_must_be_of_the_same(spark):
    seen = Z.signature("s", "/r", {"a": "text:/r/a"})
    Z.check_signature(seen, "s", "/r", {"a": "text:/r/a"})
    with pytest.raises(ValueError):
        Z.check_signature(seen, "s", "/r", {"b": "text:/r/b"})


def test_plans():
    fine = {"metric": "rmse", "direction": "minimize", "trials": 5, "space": {"x": {"type": "log", "low": 0.1, "high": 1}, "k": {"type": "categorical", "values": [1]}}}
    assert N.plan_errors(fine) == []
    for change in ({"metric": "luck"}, {"direction": "maximize"}, {"trials": 0}, {"trials": True}, {"space": {}}, {"space": {"x": {"type": "log", "low": 0, "high": 1}}}, {"space": {"x": {"type": "integer", "low": 3, "high": 1}}}):
        assert N.plan_errors(fine | change)


def test_synthetic_plans():
    fine = {"method": "student_t", "rows": 10, "seed": 1, "df": 3}
    assert O.synthetic_plan_errors(fine) == [] and O.synthetic_plan_errors({"method": "bootstrap", "rows": 1}) == []
    for change in ({"method": "luck"}, {"rows": 0}, {"rows": 1.5}, {"seed": -1}, {"df": 2}):
        assert O.synthetic_plan_errors(fine | change)


def test_selection(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 2), Vectors.dense((rng.normal(size=2) + 3 * (i % 2)).tolist())) for i in range(120)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    broken = O.Spec(lambda **o: O.C.DecisionTreeClassifier(maxDepth=-1))
    table, found = Y.run_suite(df, {"dt": O.Spec(O.C.DecisionTreeClassifier, {"maxDepth": [1, 3]}), "bnb": O.CLASSIFIERS["bnb"], "broken": broken}, "id", folds=2)
    places = {r.estimator: (r.place, r.failed) for r in table.collect()}
    assert places["broken"][0] == 3 and places["broken"][1] and found["dt"].candidates.count() == 2
    p = found["dt"].predictions.collect()
    accuracy = {r.metric: r.value for r in found["dt"].metrics.collect()}["accuracy"]
    assert len(p) == 30 and abs(accuracy - np.mean([r.actual == r.prediction for r in p])) < 1e-9 and accuracy > 0.8
    targets = df.withColumn("u", F.col("label") * 2).withColumn("w", F.col("label") - 1)
    metrics, predicted = Y.multi_output(targets, O.REGRESSORS["linear"], "id", ["u", "w"], folds=2)
    by = {(r.target, r.metric): r.value for r in metrics.collect()}
    assert abs(by[None, "rmse"] - (by["u", "rmse"] + by["w", "rmse"]) / 2) < 1e-9 and predicted.count() == 60


def test_closed_forms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 1)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, k int")
    n, s, p = O.moments(df, ["a", "b"])[None]
    assert n == 200 and np.allclose(s, x[:, :2].sum(0)) and np.allclose(p, x[:, :2].T @ x[:, :2])
    for predicted in (O.ridge_classifier(df, ["a", "b", "c"], "k"), O.discriminant(df, ["a", "b", "c"], "k"), O.discriminant(df, ["a", "b", "c"], "k", quadratic=True)):
        got = df.select("k", predicted.alias("p")).collect()
        assert np.mean([r.k == r.p for r in got]) > 0.7
    near = O.neighbours(df.withColumn("v", F.array("a", "b", "c")), df.filter("id < 9").withColumn("v", F.array("a", "b", "c")), "v", "k", "id", 4, "canberra", block=4).collect()
    for q in range(9):
        d = (np.abs(x - x[q]) / (np.abs(x) + np.abs(x[q]))).sum(1)
        d[q] = np.inf
        assert [r.id for r in sorted((r for r in near if r.query == q), key=lambda r: r.r)] == np.argsort(d, kind="stable")[:4].tolist()


def test_profiles_when_every_table_fails(spark):
    from recipeframe.operators import stores as S

    def lost():
        raise OSError("gone")

    got = S.profiled_counts({"a": lost, "b": lost}, spark).collect()
    assert sorted((r["table"], r["columns"], r["failed"]) for r in got) == [("a", 0, "OSError"), ("b", 0, "OSError")]
