"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A pattern of words of a test item is a seed if, from the corpus counts of its
words alone, it is expected less than ``expected`` times in the whole corpus; for
each place in the item the first such of ``patterns`` is taken of those without a
gap, and the first of those with one, which a changed word doesn't break. The
test doesn't look at how often the sequence itself occurs, so a passage that was
copied a million times is found like one that was copied once. Passages that
share a seed with an item are aligned with it word by word (Smith-Waterman), and
the score over that of a perfect copy tells exact, edited and unrelated apart.

The test items are the query set: they are taken in blocks of ``block_items``, or
``block_bytes`` of text, each broadcast by itself, against all whole texts. Nothing of the corpus is
shuffled but the counts of the items' words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_IN_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_MIX = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISS, GAP = 2, -1, -2


@dataclass
class DecontaminationParameters:
    expected: float = 0.5
    #: Places of a seed's words, from its first; tried in turn.
    patterns: tuple = ((0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 3, 4), (0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 4, 5, 6, 7), (0, 2), (0, 1, 3), (0, 2, 3), (0, 1, 3, 4))
    least_score: float = 0.5  # of a perfect copy's
    slack: int = 12  # words around a seed's diagonal
    block_items: int = 20_000
    block_bytes: int = 16 << 20


@dataclass
class Block:
    """Some test items with their seeds: size bounded by ``block_items`` and ``block_bytes`` (or one larger item)."""

    parameters: DecontaminationParameters
    words: pa.Array  # distinct words; a word's id is its place
    items: list  # (item id, word ids)
    seeds: dict | None = None  # pattern: (sorted keys, starts into places, places of (item, position))


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-case words of texts as one binary array, the text of each, and each text's first word.

    A word is a run of ASCII letters, digits and underscores and of characters
    beyond ASCII, but for signs: those of Latin-1, general and CJK punctuation.
    """
    lower = pc.utf8_lower(texts.cast(pa.string()).fill_null(""))
    offsets = np.frombuffer(lower.buffers()[1], dtype=np.int32)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    data = np.frombuffer(lower.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _IN_WORD[data]
    for lead, first, last, size in ((0xE2, 0x80, 0x81, 3), (0xE3, 0x80, 0x80, 3), (0xC2, 0x80, 0xBF, 2), (0xC3, 0x97, 0x97, 2), (0xC3, 0xB7, 0xB7, 2)):
        at = np.flatnonzero(data[:-1] == lead)
        at = at[(data[at + 1] >= first) & (data[at + 1] <= last)]
        for k in range(size):
            inside[at + k] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]  # a text's first byte begins a word though the text before ended in one
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int32)
    ends = np.append(kept[starts[1:] - 1], kept[-1] if len(kept) else 0) if len(starts) else np.zeros(0, np.int64)
    places = np.zeros(len(starts) + 1, dtype=np.int32)
    places[1:] = ends
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    first = np.searchsorted(starts, offsets)
    return words, np.repeat(np.arange(len(lower)), np.diff(first)), first


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in _cut(pa.array([text], pa.string()))[0].to_pylist()]


def _ids(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Places of words among ``known``; -1 for others."""
    return pc.index_in(words, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _keys(ids: np.ndarray, at: np.ndarray, pattern: tuple) -> np.ndarray:
    """A 64-bit key of the pattern's words at each place."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in pattern:
        out = (out + ids[at + k].astype(np.uint64) + np.uint64(1)) * _MIX
        out ^= out >> np.uint64(31)
    return out


def _pieces(batches, text: int, most: int = 1 << 20):
    """Slices of batches of about ``most`` bytes of text (or one longer text), so that working arrays stay small."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        part = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield b.slice(i, j - i)


def _count_words(batches, words: pa.Array):
    seen, total = np.zeros(len(words), dtype=np.int64), 0
    for b in _pieces(batches, 0):
        if b.num_rows:
            ids = _ids(_cut(b.column(0))[0], words)
            total += len(ids)
            seen += np.bincount(ids[ids >= 0], minlength=len(words))
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], names=["word", "n"])


def _plant_seeds(block: Block, counts: np.ndarray, total: int) -> None:
    p = block.parameters
    share, least = np.log(np.maximum(counts, 1) / max(total, 1)), np.log(p.expected) - np.log(max(total, 1))
    found: dict = {}
    for i, (_, ids) in enumerate(block.items):
        open_ = {False: np.ones(len(ids), dtype=bool), True: np.ones(len(ids), dtype=bool)}  # places without a seed, by whether it has a gap
        taken = []
        for pattern in p.patterns:
            gap, n = len(pattern) <= pattern[-1], len(ids) - pattern[-1]
            if n > 0:
                at = np.flatnonzero((sum(share[ids[k : k + n]] for k in pattern) <= least) & open_[gap][:n])
                open_[gap][at] = False
                taken += [(pattern, at)] * (len(at) > 0)
        if not taken and len(ids):  # too short or too plain: its longest sequences, however frequent
            pattern = tuple(range(min(len(ids), max(len(x) for x in p.patterns))))
            taken = [(pattern, np.arange(len(ids) - pattern[-1]))]
        for pattern, at in taken:
            found.setdefault(pattern, []).extend(zip(_keys(ids, at, pattern).tolist(), [i] * len(at), at.tolist(), strict=True))
    block.seeds = {}
    for pattern, rows in found.items():
        rows.sort()
        keys = np.array([r[0] for r in rows], dtype=np.uint64)
        distinct, first = np.unique(keys, return_index=True)
        block.seeds[pattern] = (distinct, np.append(first, len(rows)), np.array([r[1:] for r in rows], dtype=np.int64))


def _windows(block: Block, ids: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(text, item, from, to)``: stretches of texts, in places among all words, that share a seed with an item."""
    hits, known = [], np.flatnonzero(ids >= 0)
    for pattern, (keys, start, places) in block.seeds.items():
        at = known[known + pattern[-1] < len(ids)]
        for k in pattern[1:]:  # known words of one text only
            at = at[ids[at + k] >= 0]
        at = at[owner[at + pattern[-1]] == owner[at]]
        own = _keys(ids, at, pattern)
        k = np.searchsorted(keys, own)
        same = k < len(keys)
        same[same] = keys[k[same]] == own[same]
        where, k = at[same], k[same]
        size = start[k + 1] - start[k]
        which = np.repeat(start[k] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        where = np.repeat(where, size)
        hits.append(np.stack([owner[where], places[which, 0], where - places[which, 1]], axis=1))
    if not hits:
        return []
    hits = np.concatenate(hits)
    hits = hits[np.lexsort(hits.T[::-1])]
    out, slack = [], block.parameters.slack
    for text, item, diagonal in hits.tolist():
        size = len(block.items[item][1])
        start, end = diagonal - slack, diagonal + size + slack
        if out and out[-1][:2] == (text, item) and start <= out[-1][2] + 2 * slack and out[-1][3] - out[-1][2] < 2 * size + 4 * slack:
            out[-1] = (text, item, out[-1][2], max(end, out[-1][3]))
        else:
            out.append((text, item, start, end))
    return [(t, i, max(int(first[t]), a), min(int(first[t + 1]), b)) for t, i, a, b in out]


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Smith-Waterman of several ``(item words, passage words)`` at once: best score, and where it starts and ends in the passage."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    for i in range(0, len(order), 256):
        part = order[i : i + 256]
        m, n = (max(len(pairs[k][s]) for k in part) for s in (0, 1))
        a, b = np.full((len(part), m), -2, dtype=np.int64), np.full((len(part), n), -3, dtype=np.int64)
        for row, k in enumerate(part):
            a[row, : len(pairs[k][0])], b[row, : len(pairs[k][1])] = pairs[k]
        above, origin = np.zeros((n + 1, len(part)), dtype=np.int32), np.tile(np.arange(n + 1, dtype=np.int32)[:, None], (1, len(part)))
        best, begin, end = (np.zeros(len(part), dtype=np.int32) for _ in range(3))
        for x in range(m):
            gain = np.where((a[:, x : x + 1] == b) & (a[:, x : x + 1] >= 0), MATCH, MISS).T
            row, start = np.zeros_like(above), origin.copy()
            start[0] = 0
            for y in range(1, n + 1):
                corner, up, left = above[y - 1] + gain[y - 1], above[y] + GAP, row[y - 1] + GAP
                top = np.maximum(np.maximum(corner, up), np.maximum(left, 0))
                row[y] = top
                start[y] = np.where(top == 0, y, np.where(top == corner, origin[y - 1], np.where(top == up, origin[y], start[y - 1])))
                better = top > best
                if better.any():
                    best, begin, end = np.where(better, top, best), np.where(better, start[y], begin), np.where(better, y, end)
            above, origin = row, start
        for r, k in enumerate(part):
            out[k] = (int(best[r]), int(begin[r]), int(end[r]))
    return out


def _matches(texts: pa.Array, block: Block) -> list[list[tuple]]:
    """For each text its ``(item id, score, from word, to word)``, the best for each item."""
    best: list[dict] = [{} for _ in range(len(texts))]
    if len(texts):
        words, owner, first = _cut(texts)
        ids = _ids(words, block.words)
        places = _windows(block, ids, owner, first)
        pairs = [(block.items[i][1], ids[a:b]) for _, i, a, b in places]
        for (text, item, a, _), (score, begin, end) in zip(places, align(pairs), strict=True):
            name, own = block.items[item]
            share, a = score / (MATCH * len(own)), a - int(first[text])
            if share >= block.parameters.least_score and share > best[text].get(item, (None, 0))[1]:
                best[text][item] = (name, share, a + begin, a + end)
    return [sorted(x.values(), key=lambda r: (r[0] is None, r[0], r[1:])) for x in best]


def _report(batches, block: Block):
    for b in _pieces(batches, 1):
        ids, found = b.column(0).to_pylist(), _matches(b.column(1), block)
        rows = [(i, *m) for i, own in zip(ids, found, strict=True) for m in own]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word"])


def _keep_clean(batches, block: Block, text: int):
    for b in _pieces(batches, text):
        clean = [not m for m in _matches(b.column(text), block)]
        yield b.filter(pa.array(clean))


def blocks_of(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParameters):
    """The test items as prepared blocks, one after another; each is broadcast by its user."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null")
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-rows // p.block_items), -(-size // p.block_bytes))
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).distinct().orderBy("item_id", "text").collect()
        cut, _, first = _cut(pa.array([r.text for r in rows], pa.string()))
        words = pc.unique(cut)
        ids = _ids(cut, words)
        block = Block(p, words, [(r.item_id, ids[first[i] : first[i + 1]]) for i, r in enumerate(rows) if first[i] < first[i + 1]])
        if not block.items:
            continue
        sent = spark.sparkContext.broadcast(words)
        counted = docs.select("text").mapInArrow(lambda it, sent=sent: _count_words(it, sent.value), "word long, n long")
        counts, total = np.zeros(len(words)), 0
        for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect():
            if r.word < 0:
                total = r.n
            else:
                counts[r.word] = r.n
        _plant_seeds(block, counts, total)
        yield spark.sparkContext.broadcast(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, parameters: DecontaminationParameters | None = None) -> DataFrame:
    """Every test item that a text holds, exactly or edited.

    ``docs`` has ``doc_id, text``, ``benchmark`` ``item_id, text``; other columns
    are ignored. Returns ``doc_id, item_id, score`` (1 for a perfect copy)``,
    start_word, end_word`` of the best alignment of each item in each text.
    Words are lower-case runs of letters, digits and underscores. Null or
    empty texts and items match nothing; null ids are returned as they are;
    repeated rows each give their own matches; an item that repeats counts once.
    Empty tables give an empty result. Texts are read whole, whatever their length.
    """
    p = parameters or DecontaminationParameters()
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    for sent in blocks_of(docs, benchmark, p):
        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it, sent=sent: _report(it, sent.value), out.schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, parameters: DecontaminationParameters | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no test item; all columns stay as they are.

    Null and empty texts hold none and stay; repeated rows stay or go together.
    """
    p, out = parameters or DecontaminationParameters(), docs
    at = docs.columns.index("text")
    for sent in blocks_of(docs, benchmark, p):
        out = out.mapInArrow(lambda it, sent=sent: _keep_clean(it, sent.value, at), docs.schema)
    return out
