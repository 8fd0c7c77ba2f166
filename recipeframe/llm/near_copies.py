"""Components of near copies: word shingles whose Jaccard similarity is at least LEAST.

A text is the set of the hashes of its runs of WIDTH words; texts with equal sets
are one node. A node has a SimHash fingerprint of BITS bits and its distances to a
few reference fingerprints (pivots, drawn from the nodes), which go along wherever it
goes. Nodes meet in blocks, one for each band of minimum hashes (a radius wide enough
for LEAST leaves no equal bit segments to meet by): a pair at similarity s misses
all of them with probability (1 - s**ROWS)**BANDS, 3e-6 at 0.8 and 4e-13 at 0.9. In a
block, a pair is discarded as soon as the distances to one pivot differ by more than the
radius, then by its own bits; a pair at 0.8 differs in 0.15 of the bits, so it passes the
radius with about five standard deviations to spare. What is left is a spanning forest of candidates, not all
pairs. Each component of these goes, with whole sets, into one task, or if it is
large into one for each two of its parts, and is verified there on the whole sets, so no
pair below LEAST is linked and no row is made for a pair that fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.graph import connected_components
from recipeframe.functions.shared import Scratch, hot_keys, key_filter, lookup_join, with_marks

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
BITS, RADIUS, SMALL_RADIUS, SMALL_SET = 512, 125, 150, 100  # votes of small sets are often close: a wider radius
PIVOTS = 12
MOST_BLOCK = 20_000  # rows of a block that are compared in one task
PART = 1 << 17  # shingles of a component's part
_RNG = np.random.default_rng(23)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT_XOR = _RNG.integers(0, 1 << 64, BITS // 64, dtype=np.uint64)
_BIT_TIMES = _RNG.integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 12
_SMALL = 48  # blocks up to this size are compared shift by shift, many at once


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; all words, if there are fewer."""
    words = text.lower().split()  # of bytes, as in simhash
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, ends = (ends - size)[:n].tolist(), ends[-n:].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n))


def node(own: np.ndarray) -> int:
    """A signed number for a set; equal sets have the same."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def bands(own: np.ndarray) -> np.ndarray:
    """The buckets of a set; an empty one has none."""
    if not len(own):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), _STEP):
        np.minimum(least, ((own[i : i + _STEP, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def fingerprint(own: np.ndarray) -> bytes:
    """SimHash of a set of shingles: a bit is 1 if set in over half of their hashes."""
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(own), _STEP):
        h = (own[i : i + _STEP, None] ^ _BIT_XOR) * _BIT_TIMES
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):  # sums that a byte can hold
            votes += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(own)).tobytes()


def _sketches(batches):
    for b in batches:
        sets = [shingles(t or b"") for t in b.column(0).to_pylist()]
        added = [pa.array([node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([bands(x) for x in sets], pa.list_(pa.int64())), pa.array([fingerprint(x) for x in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *added], names=[*b.schema.names[1:], "node", "size", "bands", "fp"])


def _sets(batches):
    for b in batches:
        texts = b.column(0).to_pylist()
        for i in range(0, len(texts), 256):
            sets = [shingles(t or b"") for t in texts[i : i + 256]]
            yield pa.RecordBatch.from_arrays([pa.array([node(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "hashes"])


def _in_groups(batches, keys: int):
    """Tables of whole groups from batches sorted by their first ``keys`` columns: several small groups at once."""
    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], axis=1)
        if held and (held[-1][0][-1] != key[0]).any():
            yield np.concatenate([k for k, _ in held]), pa.Table.from_batches([x for _, x in held])
            held = []
        same = (key == key[-1]).all(axis=1)
        cut = 0 if same.all() else len(key) - int(same[::-1].argmin())  # the last group may go on in the next batch
        if cut:
            held.append((key[:cut], b.slice(0, cut)))
            yield np.concatenate([k for k, _ in held]), pa.Table.from_batches([x for _, x in held])
            held = []
        held.append((key[cut:], b.slice(cut)))
    if held:
        yield np.concatenate([k for k, _ in held]), pa.Table.from_batches([x for _, x in held])


def _starts(key: np.ndarray) -> np.ndarray:
    change = np.ones(len(key), dtype=bool)
    change[1:] = (key[1:] != key[:-1]).any(axis=1)
    return change


def distances(fp: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many bits differ, of fingerprints as rows of words."""
    return np.bitwise_count(fp ^ others).sum(axis=-1, dtype=np.int16)


def _may_link(i, j, fp, size, radius, table):
    """Of the pairs ``i, j`` those that size, each pivot and the bits allow; one of ``i`` and ``j`` may be a single row."""
    pick = lambda x, keep: x[keep] if np.ndim(x) else x
    keep = np.minimum(size[i], size[j]) >= LEAST * np.maximum(size[i], size[j])
    i, j = pick(i, keep), pick(j, keep)
    for p in range(table.shape[1]):
        keep = np.abs(table[i, p] - table[j, p]) <= np.maximum(radius[i], radius[j])
        i, j = pick(i, keep), pick(j, keep)
    keep = distances(fp[i], fp[j]) <= np.maximum(radius[i], radius[j])
    return pick(i, keep), pick(j, keep)


def _candidates(batches, pivots: np.ndarray):
    """Forests of the pairs that may link, from blocks sorted by ``bucket, part``."""
    for key, t in _in_groups(batches, 2):
        nodes, size = t.column("node").to_numpy(), t.column("size").to_numpy()
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), dtype=np.uint64).reshape(len(nodes), -1)
        table = np.stack([distances(fp, p) for p in pivots], axis=1)
        radius = np.where(size >= SMALL_SET, RADIUS, SMALL_RADIUS).astype(np.int16)
        change = _starts(key)
        group = np.cumsum(change) - 1
        sizes, starts = np.bincount(group), np.flatnonzero(change)
        small, pairs = np.flatnonzero(sizes[group] <= _SMALL), []
        for d in range(1, int(sizes[sizes <= _SMALL].max(initial=1))):
            at = np.flatnonzero(group[small[:-d]] == group[small[d:]])
            pairs.append(_may_link(small[at], small[at + d], fp, size, radius, table))
        for g in np.flatnonzero(sizes > _SMALL):
            left, waiting = np.arange(starts[g] + 1, starts[g] + sizes[g]), [int(starts[g])]
            while waiting:
                s = waiting.pop()
                near, _ = _may_link(left, s, fp, size, radius, table)
                if len(near):
                    pairs.append((near, np.full(len(near), s)))
                    left = np.setdiff1d(left, near, assume_unique=True)
                    waiting += near.tolist()
                if not waiting and len(left):
                    waiting, left = [int(left[0])], left[1:]
        if pairs:
            a, b = (np.concatenate(x).astype(np.int64) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])


def _forest(ids: np.ndarray, size: np.ndarray, words: int):
    """A spanning forest of the sets (their ``size`` members in turn, as numbers below ``words``) that are similar enough."""
    ends = np.cumsum(size)
    own = [ids[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    here, flat, starts = np.arange(len(size)), ids, ends - size  # rows whose members are in flat
    open_, mask = np.ones(len(size), dtype=bool), np.zeros(words, dtype=np.int32)
    open_[0], count, waiting = False, len(size) - 1, [0]
    while waiting:
        s = waiting.pop()
        if count:
            if 2 * count < len(here):
                here = here[open_[here]]
                flat = np.concatenate([own[i] for i in here.tolist()])
                starts = np.cumsum(size[here]) - size[here]
            mask[own[s]] = 1
            both = np.add.reduceat(mask[flat], starts)
            mask[own[s]] = 0
            near = here[open_[here] & (both >= LEAST * (size[here] + size[s] - both))]
            if len(near):
                yield np.full(len(near), s), near
                open_[near] = False
                count -= len(near)
                waiting += near.tolist()
        if not waiting and count:
            first = int(here[open_[here]][0])
            open_[first], count, waiting = False, count - 1, [first]


def _verified(batches):
    """Forests of the links, from components or pairs of their parts, sorted by ``label, part``, with whole sets."""
    for key, t in _in_groups(batches, 2):
        nodes, starts = t.column("node").to_numpy(), np.flatnonzero(_starts(key))
        hashes = t.column("hashes").combine_chunks()
        a, b = [], []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)], strict=True):
            own = hashes.slice(i, j - i)
            words, ids = np.unique(own.flatten().to_numpy(), return_inverse=True)
            for x, y in _forest(ids, own.value_lengths().to_numpy().astype(np.int64), len(words)):
                a.append(nodes[i + x])
                b.append(nodes[i + y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _in_parts(rows: DataFrame, sizes: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``key, part`` and ``keep``: groups with ``parts`` above one in ``sizes`` are dealt to each two of their parts."""
    mine = F.pmod(F.xxhash64("node"), F.col("parts").cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    dealt = rows.join(sizes.select(key, "parts"), key).withColumn("_mine", mine).withColumn("_other", other)
    part = F.least("_mine", "_other") * 1_000_000 + F.greatest("_mine", "_other")
    return dealt.select(key, part.alias("part"), *keep)


def candidate_links(met: DataFrame, scratch: Scratch, most_block: int = MOST_BLOCK) -> DataFrame:
    """``a, b``: forests of the pairs that fingerprints allow, of ``bucket, node, size, fp``."""
    drawn = met.select("node", "fp").distinct().orderBy(F.xxhash64("node"), "node").limit(PIVOTS).collect()
    pivots = np.frombuffer(b"".join(bytes(r["fp"]) for r in drawn), dtype=np.uint64).reshape(-1, BITS // 64)
    keep = ["node", "size", "fp"]
    large = scratch.store(met.groupBy("bucket").agg(F.ceil(F.count("*") / (most_block / 2)).cast("int").alias("parts")).filter("parts > 2"), "large")
    whole = met.join(F.broadcast(large), "bucket", "left_anti") if not large.isEmpty() else met
    dealt = whole.select("bucket", F.lit(0).cast("long").alias("part"), *keep)
    if whole is not met:
        dealt = dealt.unionByName(_in_parts(met, F.broadcast(large), "bucket", keep))
    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "node").mapInArrow(lambda it: _candidates(it, pivots), "a long, b long").distinct()


def verified_links(sets: DataFrame, members: DataFrame, scratch: Scratch, part: int = PART) -> DataFrame:
    """``a, b``: forests of the links inside components (``node, label, size``), by the whole ``hashes`` of ``sets``."""
    parts = scratch.store(members.groupBy("label").agg(F.ceil(F.sum("size") / part).cast("int").alias("parts")), "parts")
    dealt = _in_parts(members, parts, "label", ["node"])
    return dealt.join(sets, "node").select("label", "part", "node", "hashes").repartition("label", "part").sortWithinPartitions("label", "part", "node").mapInArrow(_verified, "a long, b long").distinct()


def near_copy_components(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``node``, ``root`` (the smallest node of the component) and ``alone`` (no other row is in it) of each row of ``docs``.

    Only what may have a copy is shuffled with its buckets or text: small filters of
    the keys asked for tell most other rows before they move. Of the tables stored
    on the way only the result is left.
    """
    own = docs.select(F.col(text).cast("binary").alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_of"), *keep)
    fields = ", ".join(f"`{n}` {t}" for n, t in own.dtypes[1:])
    scratch = Scratch(docs.sparkSession)
    store = scratch.store
    rows = store(own.mapInArrow(_sketches, f"{fields}, node long, size int, bands array<bigint>, fp binary"), "sketches")
    nodes = store(rows.groupBy("node").agg(F.min("_of").alias("_of"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.count("*").alias("n")), "nodes")
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node", "size")
    shared = store(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    marks = store(key_filter(shared, ["bucket"]), "marks")
    meeting = with_marks(buckets, marks, ["bucket"]).filter("_marked").drop("_marked")
    met = lookup_join(meeting, shared, "bucket", hot_keys(shared, "bucket", "n"), "inner").select("bucket", "node", "size")
    met = store(met.join(nodes.select("node", "fp"), "node"), "buckets")
    scratch.drop(shared, marks)
    near = store(connected_components(candidate_links(met, scratch)).join(nodes.select("node", "size", "_of"), "node"), "candidates")
    scratch.drop(met)
    asked = near.select("_of")
    marks = store(key_filter(asked, ["_of"]), "marks")
    # each task's copies are one row before they are shuffled
    texts = with_marks(own.select("_text", "_of"), marks, ["_of"]).filter("_marked").dropDuplicates(["_of"]).join(asked, "_of", "left_semi")
    sets = store(texts.select("_text").mapInArrow(_sets, "node long, hashes array<bigint>"), "sets")
    labels = store(connected_components(verified_links(sets, near.select("node", "label", "size"), scratch)), "labels")
    scratch.drop(sets, near, marks)
    alone = F.col("label").isNull() & (F.col("n") == 1)
    rooted = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("root"), alone.alias("alone"))
    found = store(lookup_join(rows.select("node", *keep), rooted, "node", hot_keys(nodes, "node", "n")), "found")
    scratch.drop(rows, nodes, labels)
    return found
