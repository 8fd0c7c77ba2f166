import random

import numpy as np

import corpus_pipeline as P
from recipeframe.llm.simhash import drop_near_copies


def by_hand(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def edited(words, share, rng):
    """Words are replaced until the similarity to the original is just above ``share``."""
    now, own = list(words), by_hand(" ".join(words))
    while True:
        new = list(now)
        new[rng.randrange(len(new))] = f"new{rng.randrange(10**9)}"
        if similarity(own, by_hand(" ".join(new))) < share:
            return now
        now = new


def test_planted_copies_go(spark):
    rng, rows = random.Random(5), []
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([100, 300, 1000]))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(words, rng.choice([0.8, 0.85, 0.9, 0.95]), rng)))]
    kept = P.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [2 * i for i in range(120)]


def test_chains_and_less_similar_texts_against_brute_force(spark):
    rng, texts = random.Random(6), []
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(12):  # each is a copy of one before; the ends of a chain aren't similar
            texts.append(" ".join(words))
            words = edited(words, rng.choice([0.6, 0.75, 0.8, 0.9]), rng)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = components([by_hand(t) for t in texts])
    assert 6 < len(set(label)) < len(texts)
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == {label.index(c) for c in set(label)}


def test_given_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    sets = [by_hand(r.text) for r in rows]
    sizes = np.array([len(s) for s in sets])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero((np.minimum(sizes, sizes[i]) >= 0.8 * np.maximum(sizes, sizes[i])) & (np.arange(len(rows)) < i)):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert {r.doc_id for r in drop_near_copies(docs).collect()} == {rows[label.index(c)].doc_id for c in set(label)}
