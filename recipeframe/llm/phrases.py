"""Collocations: phrases of two and three words, counted by dynamic itemset counting.

The texts are dealt into ``shards``, which are scanned over and over in the same
order. Words are counted from the first scan on. As soon as both words of a pair
have been met ``least`` times, or both pairs of a triple, the longer phrase is
active, and it is counted from the next scan on until each shard has been
scanned once: a full cycle from wherever it began. Phrases of all lengths are
thus counted in the same scans, and no phrase is counted in a shard twice. A
phrase is at most as frequent as what it is made of, so all that reach ``least``
are counted in full.

What is active is told to the tasks by two tables of ``slots`` bytes, whatever
the corpus: a slot holds the scan from which the words (or pairs) that hash to it
are of use. Phrases that share a slot start together, which costs rows but
changes no count.

Counts travel packed: a task sends each bucket of phrases (by hash) one compressed
block of all that it has counted for it, and a bucket's blocks are merged, with
what earlier scans have left there, in one task at a time. There are as many
buckets as keep one of them within a few million phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.shared import discard, fresh_path, materialize
from recipeframe.llm._text import LOWER
from recipeframe.llm._words import byte_kinds, cut_text, cut_words

_GAPS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KINDS = byte_kinds(_GAPS, _BREAKS)
_NEVER = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PhraseParameters:
    least: int = 10  #: occurrences from which a phrase is a candidate
    absorbed: int = 50  #: per cent of a phrase's occurrences inside one longer candidate that drop it
    first: int = 2000  #: rows of each language in the report
    shards: int = 4  #: parts of a scan cycle; at most 80
    slots: int = 1 << 22  #: bytes of each of the two tables of what is active, a power of two
    piece_bytes: int = 16 << 20  #: text that a task counts at once
    bucket_bytes: int = 8 << 20  #: text for each bucket of phrases


# ---------------------------------------------------------------- in tasks

def _word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def _pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _ODD) ^ (right + (left >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def _due(start: np.ndarray, step: int, cycle: int) -> np.ndarray:
    """Whether phrases active since ``start`` are still to be counted in scan ``step``."""
    return (start <= step) & (start.astype(np.int16) > step - cycle)


def count_piece(lang: bytes, blob: bytes, carried: int, step: int, cycle: int, since: list[np.ndarray]):
    """``size, phrases, hashes, n`` of what is due in ``blob``; phrases that end in the first ``carried`` words count elsewhere."""
    words, piece = cut_words(blob.translate(LOWER), _KINDS)
    if not len(words):
        return
    coded = words.dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    size = len(vocabulary)
    own = _word_hashes(lang, vocabulary.to_pylist())
    if step < cycle:
        n = np.bincount(code[carried:], minlength=size)
        at = np.flatnonzero(n)
        yield 1, vocabulary.take(pa.array(at)), own[at], n[at]
    if step == 0 or len(code) < 2:
        return
    start = since[0][_slot(own, len(since[0]))][code]
    joined = piece[1:] == piece[:-1]
    ends_here = np.arange(1, len(code)) >= carried
    both = np.maximum(start[:-1], start[1:])
    pair = code[:-1] * size + code[1:]
    at = np.flatnonzero(joined & ends_here & _due(both, step, cycle))
    if len(at):
        met, n = np.unique(pair[at], return_counts=True)
        left, right = met // size, met % size
        yield 2, pc.binary_join_element_wise(vocabulary.take(pa.array(left)), vocabulary.take(pa.array(right)), b" "), _pair_hashes(own[left], own[right]), n
    active = joined & (both <= step)  # a triple's words are all frequent
    at = np.flatnonzero(active[:-1] & active[1:] & ends_here[1:])
    if len(at):
        pairs = np.full(len(pair), _NEVER, dtype=np.uint8)
        asked = np.unique(np.concatenate((at, at + 1)))
        hashed = _pair_hashes(own[code[asked]], own[code[asked + 1]])
        pairs[asked] = since[1][_slot(hashed, len(since[1]))]
        parts = np.maximum(both[at], both[at + 1])  # a slot may be in use for another pair before
        at = at[_due(np.maximum(parts, np.maximum(pairs[at], pairs[at + 1])), step, cycle)]
    if len(at):
        distinct, of = np.unique(pair[at], return_inverse=True)
        met, n = np.unique(of * size + code[at + 2], return_counts=True)
        first, third = distinct[met // size], met % size
        left, right = first // size, first % size
        parts = [vocabulary.take(pa.array(x)) for x in (left, right, third)]
        yield 3, pc.binary_join_element_wise(*parts, b" "), _pair_hashes(_pair_hashes(own[left], own[right]), own[third]), n


def pack(phrases: pa.Array, n: np.ndarray) -> bytes:
    """A block of phrases and their counts."""
    rows = len(phrases)
    offsets = np.frombuffer(phrases.buffers()[1], dtype=np.int32)[phrases.offset : phrases.offset + rows + 1]
    data = phrases.buffers()[2]
    own = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join((n.astype("<i8").tobytes(), np.diff(offsets).astype("<u4").tobytes(), own, np.uint32(rows).tobytes())))


def unpack(block: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    rows = int(np.frombuffer(raw, dtype="<u4", offset=len(raw) - 4)[0])
    offsets = np.zeros(rows + 1, dtype=np.int32)
    np.cumsum(np.frombuffer(raw, dtype="<u4", count=rows, offset=8 * rows), out=offsets[1:])
    n = np.frombuffer(raw, dtype="<i8", count=rows)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw).slice(12 * rows, int(offsets[-1]))]), n


_BLOCK = "size int, bucket long, lang binary, block binary, slots binary"


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["size", "bucket", "lang", "block", "slots"])


def _counts(batches, step, cycle, since, p, buckets):
    """Blocks of a shard's ``lang, text``, piece by piece."""
    tables = [np.frombuffer(x.value, dtype=np.uint8) for x in since]
    held: dict[bytes, list[bytes]] = {}

    def counted(lang, blob, carried):
        for size, phrases, hashes, n in count_piece(lang, blob, carried, step, cycle, tables):
            bucket = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            phrases, n, edges = phrases.take(pa.array(order)), n[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(size, k, lang, pack(phrases.slice(a, b - a), n[a:b]), None) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            for i in range(0, len(rows), 1024):
                yield _blocks(rows[i : i + 1024])

    def flush():
        for lang, texts in held.items():
            yield from counted(lang, b"\n".join(texts), 0)
        held.clear()

    waiting = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(text) > p.piece_bytes:
                for part, carried in cut_text(text, p.piece_bytes, _GAPS + _BREAKS, 2):
                    yield from counted(lang, part, carried)
                continue
            held.setdefault(lang, []).append(text)
            waiting += len(text)
            if waiting >= p.piece_bytes:
                yield from flush()
                waiting = 0
    yield from flush()


def _summed(phrases: list[pa.Array], n: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    table = pa.table({"phrase": pa.chunked_array(phrases), "n": pa.chunked_array([pa.array(x) for x in n])})
    total = table.group_by("phrase").aggregate([("n", "sum")]).combine_chunks()
    return total.column("phrase").combine_chunks(), total.column("n_sum").to_numpy()


def _merged(batches, since, least):
    """One block for each ``size, bucket, lang`` of a sorted partition, and the slots of its frequent phrases that aren't in use yet."""
    tables = [np.frombuffer(x.value, dtype=np.uint8) for x in since]
    key, phrases, n = None, [], []

    def block():
        size, bucket, lang = key
        own, count = _summed(phrases, n)
        slots = None
        if size < 3:
            split = [x.split(b" ") for x in own.filter(pa.array(count >= least)).to_pylist()]
            hashed = [_word_hashes(lang, [x[i] for x in split]) for i in range(size)]
            at = np.unique(_slot(hashed[0] if size == 1 else _pair_hashes(*hashed), len(tables[0])))
            slots = at[tables[size - 1][at] == _NEVER].astype("<i4").tobytes()
        return _blocks([(size, bucket, lang, pack(own, count), slots)])

    rows = 0
    for b in batches:
        for *now, packed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if key and key != tuple(now):
                yield block()
                phrases, n, rows = [], [], 0
            key = tuple(now)
            added = unpack(packed)
            phrases.append(added[0])
            n.append(added[1])
            rows += len(added[1])
            if rows > 4_000_000 and len(n) > 1:  # most are the same phrases
                (one, two), rows = _summed(phrases, n), 0
                phrases, n = [one], [two]
    if key:
        yield block()


def _slot_rows(batches):
    for b in batches:
        slots = [np.frombuffer(x, dtype="<i4") for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots)) if slots else np.zeros(0, dtype=np.int32), pa.int32())], names=["slot"])


def _phrase_rows(batches, least):
    for b in batches:
        for size, lang, packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            phrases, n = unpack(packed)
            at = np.flatnonzero((n >= least) | (size == 1))
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                rows = len(part)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang.decode(), rows), phrases.take(pa.array(part)).cast(pa.string()), pa.array(np.full(rows, size, dtype=np.int32)), pa.array(n[part])], names=["lang", "phrase", "size", "n"])


# ---------------------------------------------------------------- counting

def count_phrases(docs: DataFrame, p: PhraseParameters = PhraseParameters(), text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, n`` of all words, and of the phrases of two and three words met ``least`` times or more.

    Null texts are empty, null languages ``und``; repeated rows count each time.
    Returns a pair of stored tables: words, and longer phrases. Empty texts and
    tables give no rows.
    """
    if not 1 <= p.shards <= 80:
        raise ValueError("shards must be between 1 and 80")
    spark = docs.sparkSession
    kept, base = fresh_path(spark, "shards"), fresh_path(spark, "phrases")
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.col(text).cast("binary").alias("text"))
    dealt = own.filter("length(text) > 0").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(p.shards)))
    dealt.write.partitionBy("shard").parquet(kept)
    texts = spark.read.schema("lang binary, text binary, shard int").parquet(kept)
    buckets = max(1, -(-(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // p.bucket_bytes))
    since = [np.full(p.slots, _NEVER, dtype=np.uint8) for _ in range(2)]
    state: dict[int, str] = {}  # the folder with the blocks of each size
    for step in range(3 * p.shards):
        due = {1: step < p.shards} | {k + 2: bool(((x != _NEVER) & (x.astype(np.int16) > step - p.shards)).any()) for k, x in enumerate(since)}
        if not any(due.values()):
            break
        sent = [spark.sparkContext.broadcast(x.tobytes()) for x in since]
        shard = texts.filter(F.col("shard") == step % p.shards).select("lang", "text")
        blocks = shard.mapInArrow(lambda it, s=step, t=sent: _counts(it, s, p.shards, t, p, buckets), _BLOCK)
        for size, path in state.items():
            if due[size]:
                blocks = blocks.unionByName(spark.read.schema(_BLOCK).parquet(path))
        ordered = blocks.select("size", "bucket", "lang", "block").repartition("bucket").sortWithinPartitions("size", "bucket", "lang")
        merged = ordered.mapInArrow(lambda it, t=sent: _merged(it, t, p.least), _BLOCK)
        path = f"{base}/{step}"
        merged.withColumn("part", F.col("size")).write.partitionBy("part").parquet(path)
        done = spark.read.schema(f"{_BLOCK}, part int").parquet(path)
        met = done.filter("slots is not null").select("part", "slots")
        for size in (1, 2):
            if due[size]:
                slots = met.filter(F.col("part") == size).select("slots").mapInArrow(_slot_rows, "slot int").distinct()
                since[size - 1][slots.toArrow().column(0).to_numpy()] = step + 1  # at most one row a slot
        for size in (1, 2, 3):
            if due[size] and not done.filter(F.col("part") == size).isEmpty():
                if size in state:
                    discard(spark, state[size])
                state[size] = f"{path}/part={size}"
        for x in sent:
            x.destroy()
    discard(spark, kept)
    blocks = spark.createDataFrame([], _BLOCK)
    for path in state.values():
        blocks = blocks.unionByName(spark.read.schema(_BLOCK).parquet(path))
    total = materialize(blocks.select("size", "lang", "block").mapInArrow(lambda it: _phrase_rows(it, p.least), "lang string, phrase string, size int, n long"), "counts")
    discard(spark, base)
    return total.filter("size = 1").select("lang", "phrase", "n"), total.filter("size > 1")


# ---------------------------------------------------------------- scores

def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (l r)), exact up to 10^15 occurrences: at most 10^6, as a is neither above l nor r."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, p: PhraseParameters = PhraseParameters(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``first`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``n`` all words of the language, ``l`` and ``r`` the two
    parts at the cut with the lowest score (the first of several). A phrase inside a
    longer candidate that holds ``absorbed`` per cent of its occurrences is left
    out. Ties go by ``a``, then by the phrase. Null, empty and repeated rows: see
    ``count_phrases``.
    """
    words, longer = count_phrases(docs, p, text, lang)
    n = words.groupBy("lang").agg(F.sum("n").alias("_n"))
    by_word = materialize(words.filter(F.col("n") >= p.least).select("lang", "phrase", "n"), "frequent")
    parts = F.split("phrase", " ")
    pairs, triples = (longer.filter(F.col("size") == k).select("lang", "phrase", F.col("n").alias("a"), parts.alias("w")) for k in (2, 3))

    def counted(rows: DataFrame, part: Column, counts: DataFrame, name: str) -> DataFrame:
        """Look up one part of each phrase; a part that very many phrases share is split by Spark's skew join."""
        of = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias(name))
        return rows.join(of, (F.col("lang") == F.col("_lang")) & (part == F.col("_part"))).drop("_lang", "_part")

    two_words = F.concat_ws(" ", F.col("w")[0], F.col("w")[1])
    last_two = F.concat_ws(" ", F.col("w")[1], F.col("w")[2])
    by_pair = pairs.select("lang", "phrase", F.col("a").alias("n"))
    pairs = counted(counted(pairs, F.col("w")[0], by_word, "l"), F.col("w")[1], by_word, "r")
    pairs = pairs.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    triples = materialize(triples, "triples")
    cuts = counted(counted(triples, F.col("w")[0], by_word, "l1"), last_two, by_pair, "r1")
    cuts = counted(counted(cuts, two_words, by_pair, "l2"), F.col("w")[2], by_word, "r2")
    cuts = cuts.withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1"))).withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2")))
    first = F.col("s1") <= F.col("s2")
    triples_scored = cuts.select("lang", "phrase", "a", *(F.when(first, F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score"))))
    inside = triples.select("lang", F.explode(F.array(two_words, last_two)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longest"))
    pairs = pairs.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_longest") < p.absorbed * F.col("a"), F.lit(True))).drop("_longest")
    scored = pairs.unionByName(triples_scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each of many parts of a language, then of these
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = scored.withColumn("_part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= p.first)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= p.first)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("_n").alias("n"), "score")


#: The same by plain counting, for DuckDB.
SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p WHERE piece <> ''),
    g AS (
        SELECT lang, unnest(w) AS phrase, 1 AS size FROM w
        UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w WHERE len(w) > 1
        UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w WHERE len(w) > 2
    ), f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
    k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
    s AS (
        SELECT k.lang, k.phrase, k.size, a, k, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
        FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[:k.k], ' ') JOIN f AS y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')
    ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3),
    longest AS (SELECT lang, phrase, max(a) AS longest FROM i GROUP BY ALL)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
    FROM b JOIN total USING (lang) LEFT JOIN longest ON longest.lang = b.lang AND longest.phrase = b.phrase
    WHERE longest IS NULL OR 100 * longest < 50 * a
    QUALIFY rank <= 2000
"""
