"""SimHash fingerprints, their links by pivot distance tables, and components.

A fingerprint's distances to a few reference fingerprints (pivots) are computed
once and go along wherever it goes. By the triangle inequality two fingerprints within ``radius`` bits differ
by at most ``radius`` in each of these distances, so a pair is discarded as soon
as one coordinate differs by more, and the few survivors are verified bit by
bit. Pairs meet in blocks: of six bit segments, two fingerprints that differ in
at most four bits share two, so each fingerprint joins the block of each pair
of segments, and no link is lost. A block with a dense group of near copies
isn't compared pair by pair: a fingerprint absorbs all that link to it, those
leave the block, and only what they themselves reach is looked at further, so
each block gives a spanning forest of its links, not all of them. Blocks above
``most_block`` are cut into pairs of parts, all of which are compared.

Equal fingerprints are one node from the start; copies are never paired.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.graph import connected_components
from recipeframe.functions.shared import hot_keys, key_filter, lookup_join, materialize, with_marks
from recipeframe.llm.near_copies import near_copy_components

RADIUS = 4
#: (first bit, bits) of six segments: any four bits leave two of them untouched.
SEGMENTS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS = np.random.default_rng(11).integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SMALL = 48  # blocks up to this size are compared shift by shift, many at once


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of the word shingles of a text, as an unsigned integer; no word: zero."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - width + 1)
    starts, ends, votes = starts[:n].tolist(), ends[-n:].tolist(), np.zeros(64, dtype=np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        values = np.array([fingerprint(t or b"") for t in b.column(0).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(values.view(np.int64))], names=[*b.schema.names[1:], "fp"])


def add_fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``fp long`` for each row; a null text counts as empty."""
    own = docs.select(F.col(text).cast("binary").alias("_text"), *keep)
    fields = ", ".join(f"`{n}` {t}" for n, t in own.dtypes[1:])
    return own.mapInArrow(_fingerprints, f"{fields}, fp long")


# ---------------------------------------------------------------- links

def pivot_table(values: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each of PIVOTS."""
    return np.bitwise_count(values[:, None] ^ PIVOTS[None]).astype(np.int8)


def _add_distances(batches):
    for b in batches:
        table = pivot_table(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in table], pa.binary())], names=["fp", "distances"])


def _small_blocks(values, group, table):
    """Links inside many small sorted blocks, by comparing each row with the one d places on."""
    size = np.bincount(group)
    for d in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(group[:-d] == group[d:])
        for p in range(table.shape[1]):
            i = i[np.abs(table[i, p] - table[i + d, p]) <= RADIUS]
            if not len(i):
                break
        i = i[np.bitwise_count(values[i] ^ values[i + d]) <= RADIUS]
        if len(i):
            yield values[i], values[i + d]


def _large_block(values, table):
    """A spanning forest of a block's links: each row reached takes along all that link to it."""
    left = np.arange(1, len(values))
    waiting = [0] if len(values) else []
    while waiting:
        s = waiting.pop()
        near = left
        for p in range(table.shape[1]):
            near = near[np.abs(table[near, p] - table[s, p]) <= RADIUS]
        near = near[np.bitwise_count(values[near] ^ values[s]) <= RADIUS]
        if len(near):
            yield np.full(len(near), values[s]), values[near]
            left = np.setdiff1d(left, near, assume_unique=True)
            waiting += near.tolist()
        if not waiting and len(left):
            waiting, left = [int(left[0])], left[1:]


def _links(batches):
    """Links inside the blocks of a partition sorted by block."""
    held: list[tuple] = []

    def compare(keys, values, table):
        change = np.ones(len(keys), dtype=bool)
        change[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        group = np.cumsum(change) - 1
        size = np.bincount(group)
        small = size[group] <= _SMALL
        pairs = list(_small_blocks(values[small], np.cumsum(change[small]) - 1, table[small])) if small.any() else []
        starts = np.flatnonzero(change)
        for g in np.flatnonzero(size > _SMALL):
            at = slice(starts[g], starts[g] + size[g])
            pairs += _large_block(values[at], table[at])
        if pairs:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def columns(b):
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)], axis=1)
        table = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.int8).reshape(b.num_rows, len(PIVOTS))
        return keys, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), table

    for b in batches:
        if not b.num_rows:
            continue
        keys, values, table = columns(b)
        same = (keys == keys[-1]).all(axis=1)
        cut = len(keys) - int(same[::-1].argmin()) if not same.all() else 0  # the last block may go on in the next batch
        if held and not (held[0][0][0] == keys[0]).all():
            yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        if cut:
            held.append((keys[:cut], values[:cut], table[:cut]))
            yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        held.append((keys[cut:], values[cut:], table[cut:]))
    if held:
        yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))


def link_fingerprints(nodes: DataFrame, most_block: int = 50_000) -> DataFrame:
    """``a, b``: links that connect all fingerprints within RADIUS bits; ``nodes`` has distinct ``fp long``."""
    nodes = materialize(nodes.select("fp").mapInArrow(_add_distances, "fp long, distances binary"), "distances")
    fp = F.col("fp")
    keys = []
    for k, (s, t) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (i, m), (j, n) = SEGMENTS[s], SEGMENTS[t]
        low = F.shiftrightunsigned(fp, i).bitwiseAND(F.lit((1 << m) - 1))
        high = F.shiftrightunsigned(fp, j).bitwiseAND(F.lit((1 << n) - 1))
        keys.append(F.lit(k << 32).cast("long") + F.shiftleft(high, 11) + low)
    blocks = nodes.select(F.explode(F.array(*keys)).alias("block"), "fp", "distances")
    large = blocks.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > most_block)
    large = materialize(large.select("block", F.ceil(F.col("n") / (most_block // 2)).cast("int").alias("parts")), "blocks")
    if large.isEmpty():
        dealt = blocks.select("block", F.lit(0).cast("long").alias("part"), "fp", "distances")
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long"))
        other = F.explode(F.expr("sequence(0, parts - 1)")).alias("other")
        split = blocks.join(large, "block").select("block", mine.mine.alias("mine"), other, "fp", "distances")
        pair = F.least("mine", F.col("other").cast("long")) * 100_000 + F.greatest("mine", F.col("other").cast("long"))
        dealt = blocks.join(large, "block", "left_anti").select("block", F.lit(0).cast("long").alias("part"), "fp", "distances").unionByName(split.select("block", pair.alias("part"), "fp", "distances"))
    parts = dealt.repartition("block", "part").sortWithinPartitions("block", "part", "fp")
    return parts.mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fingerprint and component of each row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, the ``keep`` columns, ``fp``, ``fingerprint`` (16 hex
    digits), ``root`` (the component's smallest fingerprint) and ``component_id``
    (its smallest id). Null and blank texts have the fingerprint zero, which links
    like any other. A null id never names a component; if a component has no other,
    its ``component_id`` is null. Repeated rows are kept. An empty table gives an
    empty result.
    """
    keep = [c for c in keep or [] if c != "doc_id"]
    fps = materialize(add_fingerprints(docs, ["doc_id", *keep]), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(link_fingerprints(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    rooted = materialize(rooted.select("fp", "root", "least", "n"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root")
    found = lookup_join(fps, of, "fp", hot_keys(nodes, "fp", "n"))
    return found.select("doc_id", *keep, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Keep one row of each component of near copies: that of the smallest id (null last), then of the smallest text hash.

    Near copies are those of ``near_copies`` (five-word fingerprints with their pivots, then whole sets), not the
    links of ``simhash_components``.
    Rows that repeat both id and text count as one. Null and blank texts have no
    shingle; they are copies of each other. All columns of ``docs`` stay as they
    are, whatever their names. An empty table gives an empty result. Ids and hashes are
    shuffled to choose, and the texts that may have a near copy; rows that have none stay
    where they are, the others move once, to meet the choice.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col("text"), F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    found = near_copy_components(own, ["doc_id", "hash", "id"])
    key, crowd = ["id", "hash"], found.filter("NOT alone")
    kept = crowd.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "id")).alias("first")).select("first.id", "first.hash")
    marks = materialize(key_filter(crowd, key), "marks")
    there = with_marks(own.select("row", *key), marks, key)
    # rows that are marked by chance stay, too
    kept = kept.unionByName(with_marks(found.filter("alone").select(*key), marks, key).filter("_marked").select(*key))
    once = there.filter("_marked").select("row", *key).dropDuplicates(key).join(kept, key, "left_semi")
    every = there.filter("NOT _marked").select("row").unionByName(once.select("row"))
    return every.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
