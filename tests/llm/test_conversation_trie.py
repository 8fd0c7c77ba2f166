import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from recipeframe.llm import conversation_trie as T


def brute(rows):
    """The contract, over plain dictionaries of whole prefixes; turns with equal numbers must not occur."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    nodes, children = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                children.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
    words = lambda node: len(re.findall("[^ \t-\r]+", node[-1][1])) if node else 0
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(nodes[node]) - 1) * words(node) + sum(saved[x] for x in below)
    out = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, d string, n long")


def test_equals_brute_force(spark):
    """Prefixes, whole copies, a comb of conversations that end at every depth, and one long conversation."""
    r = random.Random(1)
    rows, scripts = [], [[(r.choice(["user", "bot"]), f"{r.choice('ab')} w{i}") for i in range(r.randrange(1, 12))] for _ in range(5)]
    for c in range(60):
        script = list(r.choice(scripts))[: r.randrange(1, 13)]
        if r.random() < 0.4:
            script += [("user", f"own {r.randrange(3)}\n more")]
        rows += [(c, i, *t) for i, t in enumerate(script)]
    comb = [("user", f"turn {i}") for i in range(40)]
    rows += [(20 * (100 + k), i, *t) for k in range(10) for i, t in enumerate(comb[: 4 * k + 1])]
    rows += [(-45, 1, "user", "a"), (-40, 1, "user", "b"), (-40, 2, "bot", "c"), (9_999_999_999, 0, None, None), (9_999_999_999, 5, "bot", "x y z")]
    assert found(T.conversation_trie(table(spark, rows).repartition(7), T.TrieParameters((0.2, 0.5), 8))) == brute(rows)


def test_equals_sql_on_the_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got = con.execute(T.SQL)
    names = [d[0] for d in got.description]
    want = sorted((tuple(r[names.index(c)] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got.fetchall()), key=repr)
    assert found(T.conversation_trie(spark.read.parquet(f"{sf}/conversations.parquet"))) == want


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 3, "", "b"), (2, 1, "", "é  x" + " w" * 3000), (None, 1, "user", "lost"), (7, 2, "bot", ""), (7, 1, "user", "q")]
    assert found(T.conversation_trie(table(spark, rows))) == brute(rows)
    # repeated rows are turns of their own, whichever comes first
    twice = T.conversation_trie(table(spark, [(40, 1, "user", "a b")] * 3)).collect()
    assert sorted((r.depth, r.n_convs) for r in twice) == [(d, 1) for d in range(max(r.depth for r in twice) + 1)]
    lost = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)  # all its turns go, and there is no base
    assert found(T.conversation_trie(table(spark, [(lost, 1, "u", "t")]))) == brute([(lost, 1, "u", "t")]) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
    assert T.conversation_trie(table(spark, rows).filter("n > 1")).count() == 0


@pytest.mark.parametrize("n", [1, 7, 64, 1000])
def test_two_fattest_numbers(spark, n):
    pairs = [(low, high) for low in range(0, n, max(1, n // 40)) for high in range(low + 1, n + 1, max(1, n // 40))]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", T.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def test_search_finds_the_exit_of_each_conversation(spark):
    """Fat binary search against the longest prefix that any conversation of the trie shares."""
    r = random.Random(4)
    make = lambda: [("u", r.choice("ab")) for _ in range(r.randrange(1, 20))]
    old, new = {i: make() for i in range(40)}, {100 + i: make() for i in range(40)}
    rows = [(c, i + 1, t) for c, turns in {**old, **new}.items() for i, t in enumerate(turns)]
    turns = spark.createDataFrame([(c, d, hash_of(t), hash_of(t) + 1, 1) for c, d, t in rows], "conv long, d long, t1 long, t2 long, words long")
    paths = T.materialize(T.prefixes(turns))
    last = paths.groupBy("conv").agg(F.max(F.struct("d", "p1", "p2")).alias("x")).select("conv", "x.*")
    strings = lambda part: last.filter(part).groupBy("d", "p1", "p2").agg(F.min("conv").alias("conv")).select("conv", F.col("d").alias("n"))
    trie = T.build(strings("conv < 100"), paths, T.TrieParameters((0.1, 0.5)))
    asked = strings("conv >= 100")
    got = {x.conv: x.l for x in T.matched(T.locate(asked, trie, paths, 20), paths).collect()}
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert got and all(n == max(common(new[c], o) for o in old.values()) for c, n in got.items())


def hash_of(turn):
    return int.from_bytes(hashlib.md5(repr(turn).encode()).digest()[:7])


def test_ids_of_one_end_are_hashed_in_chunks(spark):
    ids = [*range(-20, 3000, 7), 10**15]
    ends = spark.createDataFrame([(i, 3, 5, 6) for i in ids] + [(4, 0, 0, 0)], "conv long, d long, p1 long, p2 long").repartition(9)
    got = {r.d: r.ends_sha256 for r in T.ends_digests(ends, 50).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 0: hashlib.sha256(b"4").hexdigest()}
