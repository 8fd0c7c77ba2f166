"""The steps of near copies by themselves: fingerprints and pivots, blocks and components in parts, groups that don't link."""

import random

import numpy as np
from pyspark.sql import functions as F

from recipeframe.functions.shared import Scratch
from recipeframe.llm import near_copies as N
from tests.llm.test_near_copies import by_hand, components, edited


def _copies(rng, texts, least):
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    return [" ".join(words)] + [" ".join(edited(words, rng.choice(least), rng)) for _ in range(texts - 1)]


def _sketched(spark, texts):
    sets = {N.node(s): s for s in (N.shingles(t.encode()) for t in texts)}
    rows = [(n, len(s), [int(x) for x in N.bands(s)], bytearray(N.fingerprint(s)), [int(x) for x in s.view(np.int64)]) for n, s in sets.items()]
    return sets, spark.createDataFrame(rows, "node long, size int, bands array<long>, fp binary, hashes array<long>")


def test_fingerprints_of_copies_are_within_the_radius():
    rng, far = random.Random(8), []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 12, 30, 90, 150, 600]))]
        a, b = (N.shingles(" ".join(x).encode()) for x in (words, edited(words, 0.8, rng)))
        x, y = (np.frombuffer(N.fingerprint(s), dtype=np.uint64) for s in (a, b))
        radius = N.RADIUS if max(len(a), len(b)) >= N.SMALL_SET and min(len(a), len(b)) >= N.SMALL_SET else N.SMALL_RADIUS
        assert N.distances(x, y) <= radius
        far.append(int(N.distances(x, np.frombuffer(N.fingerprint(N.shingles(f"other {words[::-1]}".encode())), dtype=np.uint64))))
    assert np.mean(np.array(far) > N.SMALL_RADIUS) > 0.95


def test_candidates_and_parts_lose_no_link(spark):
    rng = random.Random(9)
    texts = [t for _ in range(3) for t in _copies(rng, 60, [0.6, 0.7, 0.8, 0.9])]
    sets, table = _sketched(spark, texts)
    order = list(sets)
    want = components([by_hand(t) for t in texts])
    of = {N.node(N.shingles(t.encode())): x for t, x in zip(texts, want)}
    met = table.select(F.explode("bands").alias("bucket"), "node", "size", "fp")
    for block, part in ((N.MOST_BLOCK, N.PART), (20, 2000)):
        scratch = Scratch(spark)
        near = N.connected_components(N.candidate_links(met, scratch, block)).join(table.select("node", "size"), "node")
        links = N.verified_links(table.select("node", "hashes"), near, scratch, part).collect()
        label = {n: n for n in order}
        for a, b in links:
            x, y = sets[a], sets[b]
            both = len(np.intersect1d(x, y))
            assert both >= 0.8 * (len(x) + len(y) - both)
            p, q = sorted((label[a], label[b]))
            label = {n: p if v == q else v for n, v in label.items()}
        assert len({(label[n], of[n]) for n in order}) == len(set(label.values())) == len(set(of.values()))


def test_a_group_that_does_not_link_makes_no_row_for_its_pairs(spark):
    rng = random.Random(10)
    texts = _copies(rng, 200, [0.62, 0.7])
    _, table = _sketched(spark, texts)
    met = table.select(F.explode("bands").alias("bucket"), "node", "size", "fp")
    scratch = Scratch(spark)
    candidates = N.candidate_links(met, scratch)
    shared = met.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    assert candidates.count() < min(shared, 200 * 199 / 2) / 4
    near = N.connected_components(candidates).join(table.select("node", "size"), "node")
    assert N.verified_links(table.select("node", "hashes"), near, scratch).count() < 200
