"""Nearest neighbours by additive quantisation with exact reranking.

A vector is stored as one codeword from each of several full-dimensional
codebooks, whose sum approximates it, and the squared norm of that sum. Each
codebook is fitted on the residuals of those before, then all are refined in
turn, each on what the others leave; vectors are encoded by beam search. For a
query, one table of its inner products with all codewords makes every row's
approximate distance a few table lookups. The codes alone choose ``rerank`` rows
of the whole table for each query; only these are fetched, and ranked by their
original vectors in double precision.

What a task sends for a query is bounded from above beforehand: a few thousand
pilot rows tell the approximate distance within which a little more than
``rerank`` rows of the table are expected. A query that gets fewer rows than it
has to return is asked again without this bound.

The codebooks come from a bounded sample (``sample_rows``); every row is indexed
and searched. Queries come in blocks of about ``block_bytes`` of vectors, each
broadcast by itself to a job over all codes, and released after it. Vectors of
different lengths have no distance; each length has an index of its own, and is
searched by its own queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.shared import fresh_path, materialize


@dataclass
class QuantisationParameters:
    books: int = 16
    words: int = 256
    sample_rows: int = 16384
    rounds: int = 5  # of each codebook on residuals
    passes: int = 1  # of refining all codebooks
    beam: int = 4
    rerank: int = 256  # rows of the whole table that are reranked for each query, at least
    rerank_roots: float = 2.0  # the same in square roots of the table's rows: the larger counts
    pilot_rows: int = 4096
    slab_rows: int = 8192  # rows that a task scores at once
    task_lookups: int = 1 << 30  # table lookups of a search task, at about 2 ns each
    block_bytes: int = 32 << 20  # vectors of queries that are broadcast at once


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with an id whose vector is there, not all zero, and finite in every component."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0))


# ---------------------------------------------------------------- codebooks

def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1)[None] - 2 * (x @ book.T), axis=1)


def fit_codebooks(x: np.ndarray, p: QuantisationParameters) -> np.ndarray:
    """``books x words x dims`` from a sample of float32 rows."""
    rng = np.random.default_rng(5)
    words = min(p.words, len(x))
    books, rest = [], x.copy()
    for _ in range(p.books):
        book = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(p.rounds):
            code = _nearest(rest, book)
            n = np.bincount(code, minlength=words)
            for d in range(x.shape[1]):
                book[:, d] = np.where(n > 0, np.bincount(code, weights=rest[:, d], minlength=words) / np.maximum(n, 1), book[:, d])
        books.append(book)
        rest = rest - book[_nearest(rest, book)]
    books = np.stack(books).astype(np.float32)
    for _ in range(p.passes):
        codes = encode(books, x, p.beam)
        rest = x - decode(books, codes)
        for _ in range(4):
            for m, book in enumerate(books):
                code = codes[:, m]
                own = rest + book[code]
                n = np.bincount(code, minlength=words)
                new = np.stack([np.bincount(code, weights=own[:, d], minlength=words) for d in range(x.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
                books[m] = np.where(n[:, None] > 0, new, book)
                rest = own - books[m][code]
    return books


def decode(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def encode(books: np.ndarray, x: np.ndarray, beam: int) -> np.ndarray:
    """Codes of float32 rows, by beam search over the codebooks in turn."""
    out = np.empty((len(x), len(books)), dtype=np.uint8 if books.shape[1] <= 256 else np.uint16)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        n = len(part)
        rest, codes = part[:, None, :], np.zeros((n, 1, 0), dtype=np.int64)
        for book in books:
            cost = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(1)[None, None]
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            path, word = best // book.shape[0], best % book.shape[0]
            rest = np.take_along_axis(rest, path[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None]], axis=2)
        out[i : i + n] = codes[:, 0]
    return out


# ---------------------------------------------------------------- index and search

def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _index(row: pa.Array, vec_id: pa.Array, x: np.ndarray, books: np.ndarray, beam: int) -> pa.RecordBatch:
    codes = encode(books, x.astype(np.float32), beam)
    norm = (decode(books, codes) ** 2).sum(1)
    return pa.RecordBatch.from_arrays([row, vec_id, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm.astype(np.float32))], names=["row", "vec_id", "codes", "norm"])


def _encode(batches, books, beam):
    for b in batches:
        if b.num_rows:
            yield _index(b.column(0), b.column(1), _rows(b.column(2)), books, beam)


def _scorer(books: np.ndarray, queries: np.ndarray):
    """A function of codes and norms: squared approximate distances to the queries, less the queries' own norms."""
    tables = (queries.astype(np.float32) @ books.reshape(-1, books.shape[2]).T).reshape(-1, *books.shape[:2])

    def score(codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tables), len(norm)), dtype=np.float32)
        for m in range(tables.shape[1]):
            out += np.take(tables[:, m], codes[:, m], axis=1)
        return norm[None] - 2 * out

    return score


def _codes(column: pa.Array, books: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8 if books.shape[1] <= 256 else np.uint16).reshape(len(column), -1)


def _bounds(batches, books, pilot, place):
    """Add to ``row, vec_id, vector`` the score of the pilot row at ``place``, from 0."""
    codes, norm = pilot
    for b in batches:
        bound = np.full(b.num_rows, np.inf, dtype=np.float32)
        if place < len(norm):
            x = _rows(b.column(2)) if b.num_rows else np.zeros((0, books.shape[2]))
            for i in range(0, len(x), 256):
                bound[i : i + 256] = np.partition(_scorer(books, x[i : i + 256])(codes, norm), place, axis=1)[:, place]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bound)], names=[*b.schema.names, "bound"])


def _candidates(batches, books, rows, queries, bounds, quota, slab_rows):
    """``query_row, row, near`` of up to ``quota`` nearest codes of some batches to each query, within its bound."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def trimmed():
        q, r, s = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.lexsort((r, s, q))
        q, r, s = q[at], r[at], s[at]
        top = np.arange(len(q)) - np.searchsorted(q, q) < quota
        held[:] = [(q[top], r[top], s[top])]

    waiting = 0
    for b in batches:
        codes = _codes(b.column(1), books) if b.num_rows else None
        own, norm = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        for a in range(0, b.num_rows, slab_rows):
            slab = slice(a, a + slab_rows)
            for i in range(0, len(rows), 256):
                part = slice(i, i + 256)
                near = _scorer(books, queries[part])(codes[slab], norm[slab])
                near[rows[part][:, None] == own[slab][None]] = np.inf
                # a slab's own quota tells as well what can't be among the nearest
                limit = bounds[part][:, None]
                if near.shape[1] > quota:
                    limit = np.minimum(limit, np.partition(near, quota - 1, axis=1)[:, quota - 1 : quota])
                q, r = np.nonzero((near <= limit) & np.isfinite(near))
                held.append((q + i, own[slab][r], near[q, r]))
                waiting += len(q)
            if waiting > 2_000_000:
                trimmed()
                waiting = len(held[0][0])
    if held:
        trimmed()
        q, r, s = held[0]
        for i in range(0, len(q), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(rows[q[part]]), pa.array(r[part]), pa.array(s[part])], names=["query_row", "row", "near"])


def _exact(batches):
    for b in batches:
        if b.num_rows:
            x, q = _rows(b.column(3)), _rows(b.column(4))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.sqrt(((q - x) ** 2).sum(1)))], names=[*b.schema.names[:3], "score"])


class Index:
    """Codes of all of ``own``: ``row, vec_id, vector``, of one length."""

    def __init__(self, own: DataFrame, p: QuantisationParameters):
        self.own, self.p = own, p
        # by content, so that the codebooks don't depend on how rows are dealt to tasks
        order = F.struct(F.xxhash64("vec_id", "vector"), "row")
        sample = own.select("vector", order.alias("at")).orderBy("at").limit(p.sample_rows).select("vector").toArrow()
        self.books = fit_codebooks(_rows(sample.column("vector").combine_chunks()).astype(np.float32), p)
        self.shared, beam = own.sparkSession.sparkContext.broadcast(self.books), p.beam
        self.codes = materialize(own.mapInArrow(lambda it, books=self.shared: _encode(it, books.value, beam), "row long, vec_id long, codes binary, norm float"), "index")
        self.rows = self.codes.count()
        self.quota = max(p.rerank, int(p.rerank_roots * self.rows**0.5))

    def bounded(self, asked: DataFrame) -> DataFrame:
        """Add ``bound`` to queries ``row, vec_id, vector``."""
        p = self.p
        pilot = self.codes.orderBy(F.xxhash64(F.lit(3), "vec_id", "codes"), "row").limit(p.pilot_rows).select("codes", "norm").toArrow().combine_chunks()
        expected = self.quota * pilot.num_rows / max(self.rows, 1)
        place = int(expected + 4 * expected**0.5 + 5) if self.rows > pilot.num_rows else pilot.num_rows
        own = (_codes(pilot.column(0), self.books), pilot.column(1).to_numpy())
        return asked.mapInArrow(lambda it, books=self.shared: _bounds(it, books.value, own, place), "row long, vec_id long, vector array<double>, bound float")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """``query_row, row``: for each of ``row, vector, bound`` the ``quota`` rows of the whole table whose codes are nearest."""
        p, spark, n, quota = self.p, self.own.sparkSession, asked.count(), self.quota
        blocks = max(1, -(-n * self.books.shape[2] * 8 // p.block_bytes))
        parts = max(1, -(-self.rows * min(n, -(-n // blocks)) * len(self.books) // p.task_lookups))
        index, path = self.codes.select("row", "codes", "norm").repartition(parts), fresh_path(spark, "candidates")
        for i in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("row", F.lit(9)), F.lit(blocks)) == i).select("row", "vector", "bound").toArrow().combine_chunks()
            if not block.num_rows:
                continue
            sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), _rows(block.column(1).combine_chunks()), block.column(2).to_numpy()))
            found = index.mapInArrow(lambda it, books=self.shared, sent=sent: _candidates(it, books.value, *sent.value, quota, p.slab_rows), "query_row long, row long, near float")
            found.write.mode("append").parquet(path)
            sent.destroy()
        near = W.partitionBy("query_row").orderBy("near", "row")
        every = spark.read.schema("query_row long, row long, near float").parquet(path)
        return every.withColumn("_place", F.row_number().over(near)).filter(F.col("_place") <= quota).select("query_row", "row")

    def search(self, k: int, asked: DataFrame) -> DataFrame:
        """``query_row, query_id, vec_id, score`` of the rows reranked for each of ``row, vec_id, vector``."""
        bounded = materialize(self.bounded(asked), "queries")
        found = materialize(self.candidates(bounded), "candidates")
        enough = found.groupBy("query_row").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, self.rows - 1))
        short = materialize(bounded.join(enough.select(F.col("query_row").alias("row")), "row", "left_anti").withColumn("bound", F.lit(float("inf")).cast("float")), "short")
        if not short.isEmpty():
            again = short.select(F.col("row").alias("query_row"))
            found = found.join(again, "query_row", "left_anti").unionByName(self.candidates(short))
        of = bounded.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
        both = found.join(self.own, "row").join(of, "query_row").select("query_row", "query_id", "vec_id", "vector", "query")
        return both.mapInArrow(_exact, "query_row long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, p: QuantisationParameters | None = None, vector: str = "embedding") -> DataFrame:
    """Nearest rows of each row whose ``vec_id`` is divisible by ``every``.

    Returns ``query_id, rank`` (from 1)``, vec_id, score`` (Euclidean distance of
    the original vectors, in double precision), ties to the smaller id. Rows with
    a null id, or with a vector that is null, zero or not finite, take no part. A
    row is never its own neighbour, but rows that repeat its id are, and each of
    them asks for itself, so that a repeated id has ``k`` rows for each. Only
    vectors of one length are neighbours. No usable row gives an empty result;
    with fewer than ``k`` other rows all are returned.
    """
    p = p or QuantisationParameters()
    own = usable(vectors.select("vec_id", F.col(vector).cast("array<double>").alias("vector")), "vector")
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "vector"), "vectors")
    found = None
    for length in sorted(r[0] for r in own.select(F.size("vector")).distinct().collect()):
        rows = own.filter(F.size("vector") == length)
        asked = materialize(rows.filter(F.col("vec_id") % every == 0), "asked")
        if asked.isEmpty():
            continue
        part = Index(rows, p).search(k, asked)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = W.partitionBy("query_row").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
