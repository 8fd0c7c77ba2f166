import numpy as np
import xxhash
from pyspark.sql import functions as F

from recipeframe.llm.simhash import drop_near_copies, link_fingerprints, simhash_components

SCHEMA = "doc_id long, text string, extra string, root string"


def by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    values, label = np.array(values, dtype=np.uint64), list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [by_hand(r.text) for r in rows]
    label = components(fps)
    least = {}
    for r, x in zip(rows, label):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{f:016x}", least[x]) for r, f, x in zip(rows, fps, label)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs).collect()}
    assert got == want


def test_dense_and_sparse_blocks_give_all_components(spark):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, dtype=np.uint64)
    near = [center]
    for _ in range(400):  # a chain and a cloud around one fingerprint
        near.append(near[rng.integers(0, len(near))] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, 3))))
    values = np.unique(np.concatenate([np.array(near, dtype=np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for most in (50_000, 60):
        links = link_fingerprints(nodes, most).distinct().collect()
        index = {int(v): i for i, v in enumerate(values.view(np.int64))}
        label = list(range(len(values)))
        for a, b in links:
            assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 4
            x, y = sorted((label[index[a]], label[index[b]]))
            label = [x if z == y else z for z in label]
        want = components(values)
        assert len(set(zip(label, want))) == len(set(want)) == len(set(label))


def test_odd_rows(spark):
    rows = [(5, None, "a", "r"), (3, "", None, None), (4, " \n", "", "x"), (None, "one two three four five", "q", "q"), (9, "one two three four five", "q", "q"), (9, "one two three four five", "q", "q"), (2, "x" * 200_000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect()}
    zero = "0" * 16
    assert {(5, zero, 3), (3, zero, 3), (4, zero, 3)} <= got and len(got) == 6
    assert {r[2] for r in got if r[0] in (None, 9)} == {9}
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 9]
    assert simhash_components(docs.limit(0)).count() == 0 and drop_near_copies(docs.limit(0)).count() == 0


def test_matches_sql_hash(spark):
    row = spark.createDataFrame([("a b c d",)], "text string").select(F.xxhash64("text")).first()[0]
    assert row & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)
