import re

import numpy as np

from recipeframe.llm.decontamination import DecontaminationParameters, align, drop_contaminated, find_contamination, words_of

DOCS = "doc_id long, text string, item_id string, score string"


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] >= 0 else -1), h[i - 1, j] - 2, h[i, j - 1] - 2)
    return int(h.max())


def test_alignment_against_plain_table():
    rng = np.random.default_rng(2)
    pairs = [(rng.integers(0, 5, rng.integers(1, 20)), rng.integers(-1, 5, rng.integers(0, 30))) for _ in range(300)]
    got = align(pairs)
    assert [g[0] for g in got] == [smith_waterman(a, b) for a, b in pairs]
    assert all(0 <= s <= e <= len(b) for (_, s, e), (_, b) in zip(got, pairs))


def test_exact_passages_of_real_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: f" {' '.join(words_of(t))} "
    rows, tests = docs.collect(), items.collect()
    want = {(d.doc_id, i.item_id) for d in rows for i in tests if plain(i.text) in plain(d.text)}
    found = find_contamination(docs, items).collect()
    assert want and want == {(r.doc_id, r.item_id) for r in found if r.score == 1.0}
    clean = {r.doc_id for r in drop_contaminated(docs, items).collect()}
    assert clean == {d.doc_id for d in rows} - {r.doc_id for r in found}
    assert {r.doc_id for r in found} == {d for d, _ in want}  # and nothing else


def test_edited_copies_and_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    edited = re.sub("delta", "other", item).replace("mu nu", "nu").replace("rho", "rho new word")
    pad = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, f"{pad} {item.upper()} {pad}"), (2, f"{pad} {edited}"), (3, pad), (4, None), (5, ""), (None, item), (6, item), (6, item), (7, " ".join(item.split()[::-1])), (8, "alpha beta gamma " + pad)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)
    items = spark.createDataFrame([(10, item), (10, item), (11, None), (12, "..."), (13, "mu")], "item_id long, text string")
    for block in (20_000, 1):
        p = DecontaminationParameters(block_items=block)
        got = find_contamination(docs, items.filter("item_id < 13"), p).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 10), (1, 10), (2, 10), (6, 10), (6, 10)]
        assert {r.doc_id: (r.start_word, r.end_word) for r in got}[1] == (3000, 3020)
        kept = drop_contaminated(docs, items.filter("item_id < 13"), p)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7, 8]
    assert {r.doc_id for r in find_contamination(docs, items.filter("item_id = 13")).collect()} >= {1, 6}  # a one-word item
    assert find_contamination(docs.limit(0), items).count() == 0
    assert find_contamination(docs, items.limit(0)).count() == 0 and drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_recall_of_edited_copies_of_real_items(spark):
    sf, rng = "/root/testdata/sf0.01", np.random.default_rng(6)
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    pool = [w for r in docs.limit(50).collect() for w in words_of(r.text)]
    fill = lambda n: " ".join(rng.choice(pool, n))

    def edit(words, how):
        for i in range(len(words) - 1, -1, -1):
            if how == "third" and i % 3 == 2 or how == "fourth" and i % 4 == 3:
                words[i] = rng.choice(pool)
            if how == "dropped" and i % 8 == 7:
                del words[i]
            if how == "added" and i % 6 == 5:
                words.insert(i, rng.choice(pool))
        return " ".join(words)

    kinds = ("third", "fourth", "dropped", "added")
    planted = [(100_000 + len(kinds) * n + k, f"{fill(200)} {edit(words_of(r.text), how)} {fill(200)}", r.item_id, how) for n, r in enumerate(items) for k, how in enumerate(kinds)]
    own = spark.createDataFrame([(i, t) for i, t, _, _ in planted], "doc_id long, text string")
    corpus = docs.select("doc_id", "text").unionByName(own)
    score = {i: smith_waterman(*two) / (2 * len(two[0])) for i, two in ((i, _coded(t, next(r.text for r in items if r.item_id == item))) for i, t, item, _ in planted)}
    found = {(r.doc_id, r.item_id) for r in find_contamination(corpus, spark.createDataFrame(items)).collect()}
    for how in kinds:
        due = [(i, item) for i, t, item, h in planted if h == how and score[i] >= 0.5]
        if how != "third":
            assert len(due) > 30
        assert sum(x in found for x in due) >= 0.9 * len(due), how


def _coded(text, item):
    """Words of an item and of a text as numbers."""
    a, b = words_of(item), words_of(text)
    ids = {w: i for i, w in enumerate(a)}
    return [ids[w] for w in a], [ids.get(w, -1) for w in b]
