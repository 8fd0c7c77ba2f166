"""A z-fast trie over conversations: sequences of turns that share prefixes.

Compacted trie. Only the ends of conversations and the places where they part
are stored, as nodes: how deep the node is (its extent), the extent's hash, and
one conversation that goes through it. A prefix of d turns is known by d and the
exclusive or of 128 random bits for each (place, role, text), so the hashes of
all prefixes are running sums over the turns, whatever a conversation's length.

Z-fast. Each node is entered in a table under its handle: of the depths on its
edge the one that is divisible by the largest power of two. ``locate`` finds the
deepest node whose handle is a prefix of a conversation by fat binary search:
it asks the table for the depth divisible by the largest power of two between
what is known to match and what is known not to, so a conversation of n turns
asks log2(n) times. A further step down the edge gives the exit node, and comparing
prefix hashes along this edge the exact place where the conversation leaves.

Batches. Conversations are inserted in batches that grow. All of a batch are
located at once, against the trie of those before; those that leave at the same
place with the same next turn follow a leader, picked at random: leaders become
leaves, the others leave somewhere along their leader's edge, and so on. The
number of such rounds grows with the logarithm of the batch.

Expansion. Each edge gives the nodes of all depths along it from the turns of
the one conversation that its node knows.
"""

from __future__ import annotations

from dataclasses import dataclass

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.ranks import numbered
from recipeframe.functions.shared import materialize

_KEY = ("d", "p1", "p2")


@dataclass(frozen=True)
class TrieParameters:
    batches: tuple[float, ...] = (0.02, 0.2)  #: shares of the conversations that are in by the end of each batch but the last
    chunk_bytes: int = 1 << 20  #: ids that are joined before they meet to be hashed


# ---------------------------------------------------------------- turns

def turns_of(rows: DataFrame) -> DataFrame:
    """``conv, place, t1, t2, words``: hashed turns numbered from 1 in each conversation.

    Order: ``turn`` (null first); turns with equal numbers by role, then by the
    hash of their text. Null roles and texts are empty. Repeated rows are turns of
    their own; rows without a ``conv_id`` belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(text, role, F.lit(2)).alias("t2"), words.alias("words"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "t1", "t2"]
    ranked = numbered(own, order, "number")
    first = ranked.groupBy("conv").agg(F.min("number").alias("first"))
    return ranked.join(first, "conv").select("conv", (F.col("number") - F.col("first") + 1).alias("place"), "t1", "t2", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, n`` and ``conv, d, t1, t2, words``: each conversation with the head of that of the next lower multiple of 20.

    ``n`` counts its turns and may be 0. The head is short: up to three turns of at
    most 39 conversations each, so its key isn't frequent.
    """
    c = F.col("conv")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    sizes = materialize(sizes.withColumn("h", F.crc32(c.cast("string")) % 4).withColumn("base", c - c % 20), "sizes")
    base = sizes.select(c.alias("base"), F.col("own").alias("base_own"))
    heads = sizes.join(base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0)))).withColumn("n", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    heads = materialize(heads.select("conv", "base", "h", "head", "n"), "heads")
    lent = turns.filter("place <= 3").select(F.col("conv").alias("base"), F.col("place").alias("d"), "t1", "t2", "words")
    taken = heads.filter("head > 0").join(lent, "base").filter("d <= head").select("conv", "d", "t1", "t2", "words")
    rest = turns.join(heads, "conv").filter("place > h").select("conv", (F.col("head") + F.col("place") - F.col("h")).alias("d"), "t1", "t2", "words")
    return heads.select("conv", "n"), taken.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, d, p1, p2, w, upto``: hashes of the first d turns, words of the d-th and of all up to it.

    Running sums go over ranges of (conversation, place), so a conversation of any length is spread over tasks.
    """
    own = turns.withColumn("x1", F.xxhash64("d", "t1", "t2")).withColumn("x2", F.xxhash64(F.lit(3), "t2", "d", "t1")).select("conv", "d", "x1", "x2", "words")
    ranged = materialize(own.repartitionByRange("conv", "d").withColumn("_part", F.spark_partition_id()), "ranges")
    # what a conversation that starts in one range and goes on in later ones brings along: only the first of each range needs it
    totals = ranged.groupBy("_part", "conv").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("words").alias("words"))
    spread = ranged.groupBy("conv").agg(F.min("_part").alias("a"), F.max("_part").alias("b")).filter("a < b").select("conv")
    parts = totals.join(spread, "conv")
    before = W.partitionBy("conv").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("conv", "_part", *[F.bit_xor(x).over(before).alias(f"b{x}") for x in ("x1", "x2")], F.sum("words").over(before).alias("bw"))
    inside = W.partitionBy("_part", "conv").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    sums = ranged.select("conv", "_part", "d", F.bit_xor("x1").over(inside).alias("p1"), F.bit_xor("x2").over(inside).alias("p2"), F.col("words").alias("w"), F.sum("words").over(inside).alias("upto"))
    joined = sums.join(carried, ["conv", "_part"], "left")
    zero = F.lit(0).cast("long")
    return joined.select("conv", "d", *[F.col(p).bitwiseXOR(F.coalesce(F.col(b), zero)).alias(p) for p, b in (("p1", "bx1"), ("p2", "bx2"))], "w", (F.col("upto") + F.coalesce("bw", zero)).alias("upto"))


# ---------------------------------------------------------------- trie

def fattest(low: Column, high: Column) -> Column:
    """Of the numbers above ``low`` up to ``high`` the one divisible by the largest power of two."""
    differ = low.bitwiseXOR(high)
    bits = F.length(F.regexp_replace(F.bin(differ), "^0+", "")) - 1  # the highest bit in which they differ
    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), bits)
    return high.bitwiseAND(mask)


def with_handles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Add to ``d, p1, p2, rep`` each node's parent extent ``a``, its handle ``f, f1, f2`` and the hash ``c1, c2`` one turn below ``a``.

    A node's ancestors are what the prefixes of its conversation meet among the nodes.
    """
    own = nodes.filter("d > 0")
    marks = nodes.select(*_KEY, F.lit(True).alias("is_node"))
    up = own.select(F.col("rep").alias("conv"), F.col("d").alias("e")).join(paths, "conv").filter("d < e").join(marks, [*_KEY])
    parents = up.groupBy("conv", "e").agg(F.max("d").alias("a"))
    placed = own.select(F.col("rep").alias("conv"), F.col("d").alias("e"), F.col("p1").alias("e1"), F.col("p2").alias("e2")).join(parents, ["conv", "e"], "left").withColumn("a", F.coalesce("a", F.lit(0).cast("long")))
    placed = placed.withColumn("f", fattest(F.col("a"), F.col("e")))
    at = paths.select("conv", F.col("d").alias("_d"), "p1", "p2")
    handles = placed.join(at, "conv").filter("_d = f or _d = a + 1").groupBy("conv", "e", "e1", "e2", "a", "f").agg(
        *[F.max(F.when(F.col("_d") == F.col(k), F.col(p))).alias(n) for k, p, n in (("f", "p1", "f1"), ("f", "p2", "f2"))],
        *[F.max(F.when(F.col("_d") == F.col("a") + 1, F.col(p))).alias(n) for p, n in (("p1", "c1"), ("p2", "c2"))],
    )
    return handles.withColumnRenamed("conv", "rep")


def locate(batch: DataFrame, trie: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """``conv, n, l, rep``: where each of ``conv, n`` leaves the trie: ``l`` turns match, at most; ``rep`` goes on along the edge it leaves (null: none).

    ``l`` is a lower bound from the search; ``matched`` makes it exact along ``rep``'s edge.
    """
    at = paths.select("conv", *_KEY)
    handles = trie.select(F.col("f").alias("q"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("e"), F.col("e1"), F.col("e2"), F.col("rep").alias("met"))
    found = batch.select("conv", "n", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"), F.lit(None).cast("long").alias("rep"), *[F.lit(None).cast("long").alias(x) for x in ("e", "e1", "e2")])
    for i in range(max(1, longest.bit_length())):
        asked = found.withColumn("q", F.when(F.col("low") < F.col("high"), fattest(F.col("low"), F.col("high")))).select("conv", "n", "low", "high", F.col("rep").alias("_rep"), *[F.col(x).alias(f"_{x}") for x in ("e", "e1", "e2")], "q")
        keyed = asked.join(at.withColumnRenamed("d", "q"), ["conv", "q"], "left")
        hit = keyed.join(handles, ["q", "p1", "p2"], "left")
        met, asking = F.col("met").isNotNull(), F.col("q").isNotNull()
        found = hit.select(
            "conv", "n", F.when(met, F.col("e")).otherwise(F.col("low")).alias("low"), F.when(asking & ~met, F.col("q") - 1).otherwise(F.col("high")).alias("high"),
            F.coalesce("met", "_rep").alias("rep"), *[F.coalesce(x, f"_{x}").alias(x) for x in ("e", "e1", "e2")],
        )
        if i % 3 == 2:
            found = materialize(found, "search")
    # is the whole extent of the node that was found a prefix? then the exit node is its child with the same next turn
    found = found.withColumn("e", F.coalesce("e", F.lit(0).cast("long")))
    full = at.select("conv", F.col("d").alias("e"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    asked = found.join(full, ["conv", "e"], "left").withColumn("whole", (F.col("e") == 0) | F.coalesce((F.col("x1") == F.col("e1")) & (F.col("x2") == F.col("e2")), F.lit(False)))
    asked = asked.select("conv", "n", "rep", "e", "whole", (F.col("e") + 1).alias("d"))
    below = trie.select((F.col("a") + 1).alias("d"), F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("rep").alias("child"))
    down = asked.join(at, ["conv", "d"], "left").join(below, [*_KEY], "left")
    return down.select("conv", "n", F.when(F.col("whole"), F.col("e")).otherwise(F.lit(0).cast("long")).alias("l"), F.when(F.col("whole"), F.col("child")).otherwise(F.col("rep")).alias("rep"))


def matched(waiting: DataFrame, paths: DataFrame) -> DataFrame:
    """``conv, n, l, rep`` with the exact ``l``: the most turns that ``conv`` and ``rep`` share, where there is a ``rep``."""
    at = paths.select("conv", *_KEY)
    mine = waiting.filter("rep is not null").select("conv", "rep", "l").join(at, "conv").filter("d > l")
    theirs = at.withColumnRenamed("conv", "rep").join(waiting.select("rep").distinct(), "rep", "left_semi")
    shared = mine.join(theirs, ["rep", *_KEY]).groupBy("conv").agg(F.max("d").alias("m"))
    return waiting.join(shared, "conv", "left").select("conv", "n", F.coalesce("m", "l").alias("l"), "rep")


def insert(waiting: DataFrame, paths: DataFrame) -> list[DataFrame]:
    """New nodes ``d, p1, p2, rep`` for a batch of located ``conv, n, l``: where each leaves, and where it ends."""
    at, made = paths.select("conv", *_KEY), []
    while True:
        # a conversation that leaves parts from the others or ends there: either way there is a node
        left = waiting.filter("l > 0").select("conv", F.col("l").alias("d")).join(at, ["conv", "d"])
        going = waiting.filter("l < n").select("conv", "n", "l", (F.col("l") + 1).alias("d")).join(at, ["conv", "d"])
        lead = F.min_by(F.struct("conv", "n"), F.struct(F.xxhash64(F.lit(len(made)), "conv"), "conv"))
        leaders = going.groupBy(*_KEY).agg(lead.alias("lead"))
        going = materialize(going.join(leaders, [*_KEY]).select("conv", "n", "l", F.col("lead.conv").alias("rep"), F.col("lead.n").alias("rep_n")), "going")
        ends = going.filter("conv = rep").select("conv", F.col("n").alias("d")).join(at, ["conv", "d"])
        made.append(materialize(left.unionByName(ends).groupBy(*_KEY).agg(F.min("conv").alias("rep")), "nodes"))
        rest = going.filter("conv <> rep").select("conv", "n", "l", "rep")
        if rest.isEmpty():
            return made
        waiting = materialize(matched(rest, paths), "waiting")


def build(strings: DataFrame, paths: DataFrame, p: TrieParameters = TrieParameters()) -> DataFrame:
    """The compacted nodes of distinct ``conv, n`` (n > 0): ``rep, e, e1, e2, a, f, f1, f2, c1, c2``."""
    longest = strings.agg(F.max("n")).first()[0] or 0
    place = F.pmod(F.xxhash64(F.lit(7), "conv"), F.lit(1 << 20)) / F.lit(1 << 20)
    nodes = trie = None
    for low, high in zip((0.0, *p.batches), (*p.batches, 1.0), strict=True):
        batch = strings.filter((place >= low) & (place < high))
        own = paths.join(batch.select("conv"), "conv", "left_semi")
        if trie is None:
            waiting = batch.select("conv", "n", F.lit(0).cast("long").alias("l"), F.lit(None).cast("long").alias("rep"))
        else:
            waiting = matched(materialize(locate(batch, trie, own, longest), "located"), paths)
        made = insert(materialize(waiting, "waiting"), own)
        for x in made:
            nodes = x if nodes is None else nodes.unionByName(x)
        nodes = materialize(nodes.groupBy(*_KEY).agg(F.min("rep").alias("rep")), "nodes")
        trie = materialize(with_handles(nodes, paths), "trie")
    return trie


# ---------------------------------------------------------------- nodes

def _joined(batches, most):
    """Ids of a partition sorted by node and id, joined by commas into chunks."""
    key, first, held, size = None, None, [], 0

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["d", "p1", "p2", "first", "ids"])

    for b in batches:
        for d, p1, p2, conv in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if held and (key != (d, p1, p2) or size >= most):
                yield chunk()
                held, size = [], 0
            if not held:
                key, first = (d, p1, p2), conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield chunk()


def _digests(batches):
    """SHA-256 over the chunks of each node, in the order they come."""
    key = state = None

    def digest():
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([state.hexdigest()])], names=["d", "p1", "p2", "ends_sha256"])

    for b in batches:
        for d, p1, p2, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if key != (d, p1, p2):
                if key:
                    yield digest()
                key, state = (d, p1, p2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key:
        yield digest()


def ends_digests(ends: DataFrame, chunk_bytes: int) -> DataFrame:
    """``d, p1, p2, ends_sha256`` of ``conv, d, p1, p2``: of the ids in order, comma-joined.

    Ids are sorted and joined by ranges, so however many conversations end at one
    node, the task that hashes it streams a few long strings and holds one.
    """
    sorted_ids = ends.select(*_KEY, "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    chunks = sorted_ids.mapInArrow(lambda it: _joined(it, chunk_bytes), "d long, p1 long, p2 long, first long, ids string")
    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "d long, p1 long, p2 long, ends_sha256 string")


def conversation_trie(rows: DataFrame, p: TrieParameters = TrieParameters()) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations of ``conv_id, turn, role, text``.

    One row for each distinct sequence of first turns: ``conv_id`` (its smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. An empty table gives no row; a table without
    any turn that counts (only conversations that lose all theirs) gives the root.
    """
    convs, turns = rebuilt(materialize(turns_of(rows), "turns"))
    convs, paths = materialize(convs, "convs"), materialize(prefixes(turns), "paths")
    zero = F.lit(0).cast("long")
    last = paths.select("conv", F.col("d").alias("n"), "p1", "p2")
    ends = convs.join(last, ["conv", "n"], "left").select("conv", F.col("n").alias("d"), F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"))
    ends = materialize(ends, "ends")
    stops = materialize(ends.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("m")), "stops")
    strings = materialize(stops.filter("d > 0").select("conv", F.col("d").alias("n")), "strings")
    own = materialize(paths.join(strings.select("conv"), "conv", "left_semi"), "strings")  # equal conversations go on as one
    trie = build(strings, own, p)
    words = own.select("conv", "d", "upto")

    def up_to(df: DataFrame, rep: str, d: Column, name: str) -> DataFrame:
        """Add the words of ``rep``'s first ``d`` turns."""
        of = words.select(F.col("conv").alias("_c"), F.col("d").alias("_d"), F.col("upto").alias(name))
        return df.join(of, (F.col(rep) == F.col("_c")) & (d == F.col("_d")), "left").drop("_c", "_d").withColumn(name, F.coalesce(name, zero))

    root = stops.agg(F.count("*").alias("_n")).filter("_n > 0").select(*[F.lit(None).cast("long").alias("rep") if x == "rep" else zero.alias(x) for x in ("rep", "e", "e1", "e2", "a")])
    nodes = trie.select("rep", "e", "e1", "e2", "a").unionByName(root)
    nodes = up_to(up_to(nodes, "rep", F.col("e"), "we"), "rep", F.col("a"), "wa")
    mine = stops.select(F.col("d").alias("e"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), F.col("conv").alias("least"), "m")
    nodes = nodes.join(mine, ["e", "e1", "e2"], "left").withColumn("m", F.coalesce("m", zero))
    nodes = materialize(nodes, "nodes")
    # every node tells all its ancestors: those that its conversation's prefixes meet, the root, and itself
    keys = nodes.select(F.col("e").alias("d"), F.col("e1").alias("p1"), F.col("e2").alias("p2"))
    told = nodes.filter("e > 0").select(F.col("rep").alias("conv"), "e", "a", "we", "wa", "m", "least").join(own.select("conv", *_KEY), "conv").filter("d <= e").join(keys, [*_KEY])
    told = told.select(*_KEY, "e", "a", "we", "wa", "m", "least")
    above = nodes.select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"), "e", "a", "we", "wa", "m", "least")
    sums = told.unionByName(above).groupBy(*_KEY).agg(
        F.sum("m").alias("n_convs"), F.min("least").alias("conv_id"), F.sum(F.col("m") * F.col("we")).alias("all_words"),
        F.sum(F.when(F.col("e") > F.col("d"), F.col("we") - F.col("wa")).otherwise(zero)).alias("below_words"),
        F.sum(F.when((F.col("a") == F.col("d")) & (F.col("e") > F.col("d")), 1).otherwise(zero)).alias("children"), F.count("*").alias("nodes"),
    )
    named = materialize(nodes.join(sums.select(F.col("d").alias("e"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), "n_convs", "conv_id", "all_words", "below_words", "children"), ["e", "e1", "e2"]), "named")
    childless = named.filter("children = 0").select(F.col("rep").alias("conv"), F.col("e"))
    leaves = childless.filter("e > 0").join(own.select("conv", *_KEY), "conv").filter("d <= e").join(keys, [*_KEY]).select(*_KEY)
    leaves = leaves.unionByName(childless.select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"))).groupBy(*_KEY).agg(F.count("*").alias("n_leaves"))
    named = named.join(leaves.select(F.col("d").alias("e"), F.col("p1").alias("e1"), F.col("p2").alias("e2"), "n_leaves"), ["e", "e1", "e2"])
    # the parent of an edge's first node: the node at depth a of the same conversation
    named = materialize(named, "named")
    tops = named.select(F.col("e").alias("a"), F.col("e1").alias("a1"), F.col("e2").alias("a2"), F.col("conv_id").alias("top_conv_id"))
    joint = own.select(F.col("conv").alias("rep"), F.col("d").alias("a"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    edges = named.filter("e > 0").join(joint, ["rep", "a"], "left").withColumn("a1", F.coalesce("a1", zero)).withColumn("a2", F.coalesce("a2", zero)).join(tops, ["a", "a1", "a2"])
    edges = materialize(edges, "edges")
    along = edges.join(own.select(F.col("conv").alias("rep"), "d", "w", "upto"), "rep").filter("d > a and d <= e")
    end, first = F.col("d") == F.col("e"), F.col("d") == F.col("a") + 1
    before = F.col("upto") - F.col("w")
    saved = F.col("all_words") - F.col("n_convs") * before - F.col("below_words") - F.col("we") + before
    expanded = along.select(
        "conv_id", F.col("d").alias("depth"), F.when(first, F.col("top_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        *[F.when(end & (F.col("m") > 0), F.col(x)).alias(y) for x, y in (("e1", "p1"), ("e2", "p2"))],
    )
    top = named.filter("e = 0").select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), "n_leaves", (F.col("all_words") - F.col("below_words")).alias("saved_tokens"), *[F.when(F.col("m") > 0, zero).alias(x) for x in ("p1", "p2")])
    digests = ends_digests(ends, p.chunk_bytes).withColumnRenamed("d", "depth")
    empty = hashlib.sha256(b"").hexdigest()
    every = expanded.unionByName(top).join(digests, ["depth", "p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same by grouping all prefixes, for DuckDB. CRC-32 is computed bit by bit.
SQL = r"""
    WITH t AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS k, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS x,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
        FROM conversations WHERE conv_id IS NOT NULL
    ), s AS (
        SELECT c, count(*) AS own, c - c % 20 AS base, xor(list_reduce(
            list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)
        ), 4294967295) % 4 AS h
        FROM t GROUP BY c
    ), z AS (SELECT s.*, least(s.h, coalesce(o.own, 0)) AS head FROM s LEFT JOIN s AS o ON o.c = s.base),
    r AS (
        SELECT z.c, k AS d, x, w FROM z JOIN t ON t.c = z.base WHERE k <= head
        UNION ALL SELECT z.c, head + k - h, x, w FROM z JOIN t USING (c) WHERE k > h
    ), p AS (SELECT c, d, w, md5(string_agg(x, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM z),
    q AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
    n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, min(up) AS up, min(w) AS w, string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ids FROM q GROUP BY d, key),
    k AS (SELECT d - 1 AS d, up AS key, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
    m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (d, key)),
    a AS (
        SELECT p.d, p.key, sum((m.n_convs - 1) * m.w) AS saved, count(*) FILTER (m.children = 0) AS leaves
        FROM m JOIN p ON p.c = m.conv_id AND p.d <= m.d GROUP BY p.d, p.key
    )
    SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.children AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
    FROM m JOIN a USING (d, key) LEFT JOIN m AS o ON o.d = m.d - 1 AND o.key = m.up
"""
