import random
import re

from pyspark.sql import functions as F

from recipeframe.llm.mixing import TARGET_WEIGHTS, MixParameters, budgets, cut_text, mix, pour, with_domain

SCHEMA = "doc_id long, text string, lang string, source string, place string, n_tokens string"


def test_pour():
    assert pour(10, [(1, 100), (1, 100)]) == [5, 5]
    assert pour(10, [(1, 2), (1, 100)]) == [2, 8]
    assert pour(100, [(1, 2), (3, 5)]) == [2, 5]
    assert pour(0, [(1, 5)]) == [0] and pour(7, [(0, 9), (1, 9)]) == [0, 7] and pour(3, []) == []
    rng = random.Random(1)
    for _ in range(500):
        kids = [(rng.choice([0.5, 1, 2, 3]), rng.randint(0, 50)) for _ in range(rng.randint(1, 8))]
        got = pour(n := rng.randint(0, 200), kids)
        assert sum(got) == min(n, sum(m for _, m in kids)) and all(0 <= g <= m for g, (_, m) in zip(got, kids))


def test_shortage_stays_among_siblings_first():
    p = MixParameters(levels=("d", "s"), budget=100, most_epochs=1)
    supply = {("a", "x"): 10, ("a", "y"): 60, ("b", "z"): 200}
    assert budgets(supply, p) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    supply[("a", "y")] = 20  # now all of a is short: its parent's sibling takes over
    assert budgets(supply, p) == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70}


def test_selection_is_a_prefix_of_seeded_epochs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["src1", "src22"]), "q", "q") for i in range(600)]
    docs = with_domain(spark.createDataFrame(rows, SCHEMA))
    for p in (MixParameters(), MixParameters(budget=30_000, range_rows=7, weights={("web",): 3.0, ("web", "fr"): 0.2})):
        got = mix(docs, p, keep=["text"]).collect()
        size = {r[0]: len(r[1].split()) for r in rows}
        supply, leaf = {}, {}
        for r in rows:
            leaf[r[0]] = ("web" if r[3] == "src1" else "curated", r[2] or "", r[3])
            supply[leaf[r[0]]] = supply.get(leaf[r[0]], 0) + size[r[0]]
        want = budgets(supply, p)
        assert all(r.n_tokens == size[r.doc_id] and (r.domain, r.lang, r.source) == leaf[r.doc_id] for r in got)
        for k, budget in want.items():
            own = [r for r in got if leaf[r.doc_id] == k]
            assert sum(r.take_tokens for r in own) == budget
            epochs = {}
            for r in own:
                epochs.setdefault(r.epoch, []).append(r)
            full, rest = divmod(budget, supply[k])
            for e, part in epochs.items():
                part.sort(key=lambda r: r.place)
                assert len({r.doc_id for r in part}) == len(part)
                assert all(r.take_tokens == r.n_tokens for r in part[: -1 if e == full else None])
                assert sum(r.take_tokens for r in part) == (rest if e == full else supply[k])
    assert mix(docs.limit(0)).count() == 0


def test_odd_rows(spark):
    docs = with_domain(spark.createDataFrame([(None, "a b", None, None, "", ""), (1, None, "en", "src1", "", ""), (2, " \n", "en", "src1", "", ""), (3, "x " * 100_000, "en", "src1", "", ""), (3, "y z", "en", "src1", "", ""), (3, "y z", "en", "src1", "", "")], SCHEMA))
    got = mix(docs, MixParameters(share=1.0)).collect()
    assert sum(r.take_tokens for r in got) == 100_006 and {r.doc_id for r in got} == {None, 3}


def test_texts_are_cut_after_a_token(spark):
    texts = ["a  b\n\nc", " \t a b ", "one", "", "  ", "é\x0b😀 z", "w " * 50_000]
    rows = [(t, n) for t in texts for n in (1, 2, 3, 40_000)]
    got = spark.createDataFrame(rows, "t string, n long").select("t", "n", cut_text(F.col("t"), F.col("n")).alias("c")).collect()
    for t, n, c in got:
        m = [x.end() for x in re.finditer("[^\\x20\\x09-\\x0D]+", t)]
        assert c == (t[: m[n - 1]] if n <= len(m) else t)


def test_target_weights_over_the_table(spark):
    """The query's unequal weights over sf0.01, against budgets worked out from plain Python counts."""
    docs = with_domain(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    p = MixParameters(weights=TARGET_WEIGHTS)
    supply = {}
    for r in docs.collect():
        n = len([w for w in re.split("[\\x20\\x09-\\x0D]+", r.text or "") if w])
        if n:
            leaf = (r.domain, r.lang or "", r.source or "")
            supply[leaf] = supply.get(leaf, 0) + n
    taken = {tuple(r[:3]): r[3] for r in mix(docs, p).groupBy("domain", "lang", "source").agg(F.sum("take_tokens")).collect()}
    total = int(sum(supply.values()) * p.share)
    assert sum(taken.values()) == total

    def shares(level, within, amount):
        """What the children of a node get by their weights alone, if none of them is short."""
        names = sorted({leaf[: level + 1] for leaf in supply if leaf[:level] == within})
        weight = {n: TARGET_WEIGHTS.get(n, 1.0) for n in names}
        room = {n: p.most_epochs * sum(v for k, v in supply.items() if k[: level + 1] == n) for n in names}
        want = {n: amount * w / sum(weight.values()) for n, w in weight.items()}
        return want if all(want[n] <= room[n] for n in names) else None

    met = 0
    for level, within in [(0, ()), *[(1, (d,)) for d in ("web", "curated")], *sorted({(2, k[:2]) for k in supply})]:
        got = lambda n: sum(v for k, v in taken.items() if k[: len(n)] == n)
        want = shares(level, within, got(within) if within else total)
        if want:
            met += 1
            assert all(abs(got(n) - w) <= len(want) for n, w in want.items()), (within, want)
    assert met >= 4 and len({TARGET_WEIGHTS.get(k, 1.0) for k in supply}) > 1
    assert budgets(supply, p) == {k: taken.get(k, 0) for k in supply}
