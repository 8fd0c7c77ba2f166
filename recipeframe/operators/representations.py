"""Low-dimensional representations, how well they keep a table, and rows drawn from a table's distribution."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.ranks import numbered, running_sum
from recipeframe.functions.shared import fresh_path, materialize
from recipeframe.operators.models import moments, project as _project, vector_moments

MOST_QUERIES = 10_000
QUERY_TILE, ROW_TILE = 32, 4096


def _doubles(c: str) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def gram(df: DataFrame, vector: str) -> np.ndarray:
    """Sum of the outer products of a vector column; features squared in size."""
    return vector_moments(df, vector, centred=False)[2]


def truncated_svd(df: DataFrame, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """Projections on the first ``k`` right singular vectors, uncentred (largest weight positive), and the singular values."""
    values, vectors = np.linalg.eigh(gram(df, vector))
    at = np.argsort(-values)[:k]
    v = vectors[:, at]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return df.withColumn("components", _project(_doubles(vector), v)).withColumn("restored", _project(F.col("components"), v.T)), [float(x) for x in np.sqrt(np.maximum(values[at], 0))]


def pca_restored(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``components`` and ``restored``: the rows built again from ``k`` centred components."""
    _, mean, scatter = vector_moments(df, vector)
    values, vectors = np.linalg.eigh(scatter)
    v = vectors[:, np.argsort(-values)[:k]]
    centre = F.array(*[F.lit(float(m)) for m in mean])
    own = df.withColumn("components", _project(F.zip_with(_doubles(vector), centre, lambda a, b: a - b), v))
    return own.withColumn("restored", F.zip_with(_project(F.col("components"), v.T), centre, lambda a, b: a + b))


def _row_factors(x: np.ndarray, parts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The factors of at least zero that restore each row best from ``parts`` (features by components), one component after another."""
    own, right = parts.T @ parts, x @ parts
    out = np.full(right.shape, 1e-3)
    for _ in range(rounds):
        for j in range(out.shape[1]):
            if own[j, j] > 0:
                out[:, j] = np.maximum(out[:, j] + (right[:, j] - out @ own[:, j]) / own[j, j], 0.0)
    return out


def _factor_sums(batches, parts):
    """Sums over rows of the products of their factors with each other and with their cells, and the smallest cell."""
    k, total, least = parts.shape[1], np.zeros((parts.shape[1], parts.shape[0] + parts.shape[1])), 0.0
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            w = _row_factors(x, parts)
            total += w.T @ np.hstack([w, x])
            least = min(least, float(x.min()))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), least))], names=["at", "value"])


def _factors(batches, parts):
    for b in batches:
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, parts.shape[0]))
        w = _row_factors(x, parts)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(list(w), pa.list_(pa.float64())), pa.array(list(w @ parts.T), pa.list_(pa.float64()))], names=[*b.schema.names[1:], "components", "restored"])


def factorise_nonnegative(df: DataFrame, vector: str, key: str, k: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """``df`` with ``components, restored``: factors of at least zero; negative cells are an error.

    Each round finds all rows' factors for the features' parts as they are, in the
    tasks, and sums up their products; from these small sums the parts are moved,
    one component after another. No factors are kept between rounds, and keys are
    only carried along. Rows without a vector are left out.
    """
    own = df.filter(F.col(vector).isNotNull())
    n, mean, _ = vector_moments(own, vector)
    size = len(mean)
    parts = np.random.default_rng(seed).random((size, k)) * np.sqrt(np.maximum(mean, 1e-12) / k)[:, None] * 2
    cells = materialize(own.select(_doubles(vector).alias("_x")), "cells") if n else own
    for _ in range(rounds if n else 0):
        sums = np.zeros(k * (k + size))
        sums_of = cells.mapInArrow(lambda it, p=parts: _factor_sums(it, p), "at long, value double").groupBy("at").agg(F.sum("value").alias("value"), F.min("value").alias("least"))
        for r in sums_of.collect():
            if r["at"] == len(sums):
                if r["least"] < 0:
                    raise ValueError("negative cells can't be factorised")
            else:
                sums[r["at"]] = r["value"]
        both = sums.reshape(k, k + size)
        gram_w, right = both[:, :k], both[:, k:]
        for _ in range(10):
            for j in range(k):
                if gram_w[j, j] > 0:
                    parts[:, j] = np.maximum(parts[:, j] + (right[j] - parts @ gram_w[:, j]) / gram_w[j, j], 0.0)
        scale = np.sqrt((parts**2).sum(0))
        parts = parts / np.where(scale > 0, scale, 1.0)
    names = own.columns
    fields = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)
    return own.select(_doubles(vector).alias("_x"), *[F.col(f"`{c}`") for c in names]).mapInArrow(lambda it: _factors(it, parts), f"{fields}, components array<double>, restored array<double>")


def restoration_error(df: DataFrame, vector: str, restored: str = "restored") -> DataFrame:
    """Mean squared, root mean squared and mean absolute error over all cells."""
    e = df.select(F.explode(F.zip_with(_doubles(vector), restored, lambda a, b: a - b)).alias("e"))
    return e.agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"))


def compare_representations(df: DataFrame, vector: str, key: str, k: int, methods: tuple = ("pca", "svd", "nmf")) -> DataFrame:
    """Errors of two to five methods on the same rows; a method that fails is a row with its error."""
    make = {"pca": lambda: pca_restored(df, vector, k), "svd": lambda: truncated_svd(df, vector, k)[0], "nmf": lambda: factorise_nonnegative(df, vector, key, k)}
    out = []
    for name in methods:
        try:
            out.append((name, *restoration_error(make[name](), vector).first(), None))
        except Exception as e:  # noqa: BLE001  shown in the result
            out.append((name, None, None, None, type(e).__name__))
    return df.sparkSession.createDataFrame(out, "method string, mse double, rmse double, mae double, error string")


def _vectors(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``id, a, b`` of the rows whose vectors have no missing component."""
    own = df.select(F.col(key).cast("long").alias("id"), _doubles(a).alias("a"), _doubles(b).alias("b"))
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    return own.filter(whole("a") & whole("b"))


def _blocks(queries: DataFrame):
    """The queries in blocks of about MOST_QUERIES, each small enough to be sent to all tasks: ``ids, a, b`` as arrays."""
    stored = materialize(queries, "queries")
    blocks = max(1, -(-stored.count() // MOST_QUERIES))
    for i in range(blocks):
        rows = (stored.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else stored).collect()
        if rows:
            yield np.array([r["id"] for r in rows]), np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).T)


def _distances(x: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances of queries to rows (a column each), summed up one component after another, as SQL does; ``own`` places are NaN."""
    d = np.zeros((len(q), x.shape[1]))
    for c in range(len(x)):
        t = x[c] - q[:, c, None]
        t *= t
        d += t
    d[own] = np.nan
    return d


def _tiles(batches, asked):
    """``s, ids, rows in a, rows in b, own`` for some rows and the queries from ``s`` on, QUERY_TILE at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROW_TILE):
            b = batch.slice(start, ROW_TILE)
            ids, a, c = b.column(0).to_numpy(), _matrix(b.column(1)), _matrix(b.column(2))
            for s in range(0, len(asked), QUERY_TILE):
                yield s, ids, a, c, asked[s : s + QUERY_TILE, None] == ids[None]


def _all_distances(batches, asked, qa, qb):
    for s, _, a, b, own in _tiles(batches, asked):
        da, db = (_distances(x, q[s : s + QUERY_TILE], own)[~own] for x, q in ((a, qa), (b, qb)))
        yield pa.RecordBatch.from_arrays([pa.array(da), pa.array(db)], names=["da", "db"])


def _nearest_rows(batches, asked, qa, qb, k):
    """``q, id, da, db``: for each query the ``k`` nearest in ``b`` of some rows, ties by id."""
    for s, ids, a, b, own in _tiles(batches, asked):
        db = _distances(b, qb[s : s + QUERY_TILE], own)
        far = np.partition(db, min(k, db.shape[1]) - 1, axis=1)[:, min(k, db.shape[1]) - 1]
        i, j = np.nonzero(db <= np.where(np.isnan(far), np.inf, far)[:, None])
        order = np.lexsort((ids[j], db[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        da = np.zeros(len(i))
        for c in range(len(a)):
            da += (a[c, j] - qa[s + i, c]) ** 2
        yield pa.RecordBatch.from_arrays([pa.array(asked[s + i]), pa.array(ids[j]), pa.array(da), pa.array(db[i, j])], names=["q", "id", "da", "db"])


def _nearer_rows(batches, asked, qa, near, far):
    """``at, n``: how many rows come before each of the queries' neighbours (``near``: ids, ``far``: distances) in ``a``."""
    n = np.zeros(near.shape, dtype=np.int64)
    for s, ids, a, _, own in _tiles(batches, asked):
        da = _distances(a, qa[s : s + QUERY_TILE], own)
        for t in range(near.shape[1]):
            limit = far[s : s + QUERY_TILE, t, None]
            n[s : s + QUERY_TILE, t] += (da < limit).sum(1) + ((da == limit) & (ids[None] < near[s : s + QUERY_TILE, t, None])).sum(1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], names=["at", "n"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as there are cores, some for each: the work isn't in the bytes."""
    return materialize(rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism), "rows")


#: Distances up to so many are stored and ranked as they are; more are ranked in bands, of which STORED are held at a time.
FEW, STORED = 1 << 24, 1 << 30
#: A double's first bits that tell its cell; slots of a distance, of which BIN make a bin; pairs a task sends at once.
CELL, SLOTS, BIN, SENT = 41, 1 << 32, 1 << 16, 1 << 20


def rank_agreement(df: DataFrame, queries: DataFrame, key: str, a: str, b: str, digits: int = 6) -> DataFrame:
    """Spearman's correlation of the distances of the queries to all rows, in the spaces ``a`` and ``b``.

    The queries are the stated set; blocks of them meet all rows one after another.
    Many distances are never stored at once, see ``_banded``. Its bounds nearly always decide the
    result's first ``digits``; where they don't, as with very few different distances, all are stored.
    """
    rows, blocks = _dealt(_vectors(df, key, a, b)), list(_blocks(_vectors(queries, key, a, b)))
    n = rows.count() * sum(len(asked) for asked, _, _ in blocks)
    if n > FEW:
        low, high = _banded(rows, blocks, n)
        if high - low < 10.0**-digits and round(low, digits) == round(high, digits):
            return df.sparkSession.createDataFrame([((low + high) / 2,)], "spearman double")
    path = fresh_path(df.sparkSession, "distances")
    for asked, qa, qb in blocks:
        rows.mapInArrow(lambda it, x=(asked, qa, qb): _all_distances(it, *x), "da double, db double").write.mode("append").parquet(path)
    df.sparkSession.createDataFrame([], "da double, db double").write.mode("append").parquet(path)  # also where nothing is asked
    pairs = df.sparkSession.read.schema("da double, db double").parquet(path)
    pairs = pairs.groupBy("da", "db").agg(F.count("*").alias("n")) if n > FEW else pairs.withColumn("n", F.lit(1))
    pairs = materialize(pairs, "pairs") if n > FEW else pairs

    def ranks(c):
        n = pairs.groupBy(c).agg(F.sum("n").cast("long").alias("n"))
        return running_sum(n, [c], F.col("n"), "upto").select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    met = pairs.join(ranks("da"), "da").join(ranks("db"), "db")
    if n <= FEW:
        return met.agg(F.corr("rda", "rdb").alias("spearman"))
    total = pairs.agg(F.sum("n")).first()[0]
    u, v = ((F.col(c) - (total + 1) / 2) / total for c in ("rda", "rdb"))
    return met.agg((F.sum(F.col("n") * u * v) / F.sqrt(F.sum(F.col("n") * u * u) * F.sum(F.col("n") * v * v))).alias("spearman"))


def _others(x: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances of queries to all rows but themselves."""
    d = _distances(x, q, own)
    return d[~own] if own.any() else d.ravel()


def _cells(batches, asked, qa, qb):
    """``axis, cell, n``: how many distances have the same first bits."""
    found = ({}, {})
    for s, _, a, b, own in _tiles(batches, asked):
        for axis, (x, q) in enumerate(((a, qa), (b, qb))):
            cell = _others(x, q[s : s + QUERY_TILE], own).view(np.int64) >> CELL
            if len(cell):
                low = int(cell.min())
                n = np.bincount(cell - low) if cell.max() - low < len(cell) else None
                at, n = (np.flatnonzero(n) + low, n[n > 0]) if n is not None else np.unique(cell, return_counts=True)
                for c, k in zip(at.tolist(), n.tolist(), strict=True):
                    found[axis][c] = found[axis].get(c, 0) + k
    for axis in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[axis]), axis)), pa.array(np.array(list(found[axis]), dtype=np.int64)), pa.array(np.array(list(found[axis].values()), dtype=np.int64))], names=["axis", "cell", "n"])


def _slots(d: np.ndarray, shape) -> np.ndarray:
    """Places from zero to SLOTS in the order of the distances, about as many distances at each: shares of the cells, and inside these in proportion."""
    low, start, width = shape
    bits = d.view(np.int64)
    cell = (bits >> CELL) - low
    w = width[cell]
    inside = ((bits & ((1 << CELL) - 1)) * 2.0**-CELL * w).astype(np.int64)
    return start[cell] + np.minimum(inside, np.maximum(w - 1, 0))


def _ends(shape, low: int, high: int) -> tuple[int, int]:
    """Bits of distances between which all slots from ``low`` to below ``high`` lie."""
    first, start, width = shape
    here = np.flatnonzero((start < high) & (start + width >= low))
    return ((first + int(here[0])) << CELL, (first + int(here[-1]) + 1) << CELL) if len(here) else (0, 0)


def _shape(cells: list) -> tuple:
    """Of cells with their counts: the first cell, and each one's first slot and number of slots."""
    at, n = np.array([c for c, _ in cells]), [k for _, k in cells]
    upto = np.cumsum(np.array(n, dtype=object))
    ends = np.array([int(u) * SLOTS // int(upto[-1]) for u in upto], dtype=np.int64)
    start, width = np.zeros(at[-1] - at[0] + 1, dtype=np.int64), np.zeros(at[-1] - at[0] + 1, dtype=np.int64)
    width[at - at[0]] = np.diff(ends, prepend=0)
    start[at - at[0]] = ends - width[at - at[0]]
    return int(at[0]), np.minimum(start, SLOTS - 1), width


def _band(batches, asked, qa, qb, shapes, first, bins, groups):
    """``k, data``: of distances whose bin in ``a`` (even ``k``) or ``b`` (odd) is among ``bins`` from ``first`` on the place in it and the other bin, in chunks of some bins."""
    each, held, size = -(-bins // groups), ([], []), [0, 0]

    def sent(axis):
        bin_, place, other = (np.concatenate(x) for x in zip(*held[axis], strict=True))
        held[axis].clear()
        size[axis] = 0
        order = np.argsort(bin_, kind="stable")
        bin_, both = bin_[order], np.stack((place[order], other[order]))
        cuts = np.searchsorted(bin_, np.arange(0, bins + each, each))
        k = [g for g in range(groups) if g < len(cuts) - 1 and cuts[g] < cuts[g + 1]]
        data = [np.bincount(bin_[cuts[g] : cuts[g + 1]] - g * each, minlength=each).astype(np.uint32).tobytes() + both[:, cuts[g] : cuts[g + 1]].tobytes() for g in k]
        return pa.RecordBatch.from_arrays([pa.array(np.array(k, dtype=np.int64) * 2 + axis), pa.array(data, pa.binary())], names=["k", "data"])

    ends = [_ends(shape, first * BIN, (first + bins) * BIN) for shape in shapes]
    for s, _, a, b, own in _tiles(batches, asked):
        d = [_others(x, q[s : s + QUERY_TILE], own) for x, q in ((a, qa), (b, qb))]
        for axis in (0, 1):
            bits = d[axis].view(np.int64)
            i = np.flatnonzero((bits >= ends[axis][0]) & (bits < ends[axis][1]))
            slots, other = _slots(d[axis][i], shapes[axis]), _slots(d[1 - axis][i], shapes[1 - axis])
            bin_ = slots // BIN - first
            i = np.flatnonzero((bin_ >= 0) & (bin_ < bins))
            if len(i):
                held[axis].append((bin_[i].astype(np.uint16), (slots[i] % BIN).astype(np.uint16), (other[i] // BIN).astype(np.uint16)))
                size[axis] += len(i)
                if size[axis] >= SENT:
                    yield sent(axis)
    for axis in (0, 1):
        if size[axis]:
            yield sent(axis)


#: Of a bin: pairs, sums of the other axis' scores, of places in the bin, of their squares, of both's products, and what the order inside slots may add to that and to the squares.
_SUMS = ["n", "other", "place", "place2", "product", "doubt", "tied"]


def _bin_sums(batches, first, bins, groups, total):
    """``axis, bin`` and _SUMS; places are midranks in the bin over ``total``, as if all in a slot were tied."""
    each, held = -(-bins // groups), {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            data = data.as_buffer()
            n = np.frombuffer(data, np.uint32, each)
            held.setdefault(k, []).append((np.concatenate(([0], np.cumsum(n.astype(np.int64)))), np.frombuffer(data, np.uint16, offset=4 * each).reshape(2, -1)))
    for k, chunks in held.items():
        rows, step = [], max(1, BIN * each // max(1, sum(x.shape[1] for _, x in chunks)))  # so many bins at once that calls are few
        for i in range(0, each, step):
            end = min(each, i + step)
            place, other = np.concatenate([x[:, at[i] : at[end]] for at, x in chunks], axis=1)
            if not len(place):
                continue
            bin_ = np.zeros(1, dtype=np.int64)
            if step > 1:
                own = np.concatenate([np.repeat(np.arange(end - i), np.diff(at[i : end + 1])) for at, _ in chunks])
                bin_, place = np.unique(own * BIN + place, return_inverse=True)
                bin_ //= BIN
            score = (other + 0.5) / BIN - 0.5
            n = np.bincount(place).astype(np.float64)
            sums, squares = np.bincount(place, score), np.bincount(place, score * score)
            cuts = np.flatnonzero(np.diff(bin_, prepend=-1))
            before = np.cumsum(n) - n
            before -= np.repeat(before[cuts], np.diff(cuts, append=len(n))) if step > 1 else 0.0
            at, tied = (before + (n + 1) / 2) / total, (n**3 - n) / 12 / total**2
            apart = np.maximum(squares - sums * sums / np.maximum(n, 1), 0.0) * (n > 1)
            rows.append(np.stack((np.full(len(cuts), k % 2), first + (k // 2) * each + i + bin_[cuts], *[np.add.reduceat(c, cuts) for c in (n, sums, n * at, n * at * at, at * sums, np.sqrt(apart * tied), tied)])))
        found = np.concatenate(rows, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64) if i < 2 else c) for i, c in enumerate(found)], names=["axis", "bin", *_SUMS])


def _banded(rows: DataFrame, blocks: list, most: int) -> tuple[float, float]:
    """Bounds of the correlation of ranks, from all pairs, of which no more than about STORED are held at a time.

    A first pass counts distances in cells; from the counts follow SLOTS places of about
    as many distances each, in order, and BIN bins of them. Then all distances are made
    again for each band of bins; those in the band are sorted by place inside tasks, each
    with the other space's bin. With ra = A + x and rb = B + y, where A and B follow from
    the bins, the sums of A*rb and of x*B are exact up to the order inside slots, which is
    bounded, and that of x*y is bounded by those of x^2 and y^2, below one part of BIN^2.
    """
    spark, parts = rows.sparkSession, 4 * rows.sparkSession.sparkContext.defaultParallelism
    found = [rows.mapInArrow(lambda it, x=x: _cells(it, *x), "axis long, cell long, n long") for x in blocks]
    cells = [[], []]
    for r in reduce(DataFrame.unionByName, found).groupBy("axis", "cell").agg(F.sum("n").alias("n")).orderBy("axis", "cell").collect():  # of fixed number
        cells[r["axis"]].append((r["cell"], r["n"]))
    shapes, total = [_shape(c) for c in cells], sum(n for _, n in cells[0])
    bands = max(1, -(-2 * total // STORED))
    bins = -(-BIN // bands)
    groups = max(1, min(bins, max(parts // 2, -(-total // bands // (4 * SENT)))))
    sums = [[], []]
    for first in range(0, BIN, bins):
        sent = reduce(DataFrame.unionByName, [rows.mapInArrow(lambda it, x=x: _band(it, *x, shapes, first, bins, groups), "k long, data binary") for x in blocks])
        made = sent.repartition(2 * groups, "k").mapInArrow(lambda it: _bin_sums(it, first, bins, groups, total), "axis long, bin long, " + ", ".join(f"{c} double" for c in _SUMS))
        for r in materialize(made, "band").collect():  # a row for each bin
            sums[r["axis"]].append(tuple(r)[1:])
    whole, rest, low, high = 0.0, [], [], []
    doubt = 0.0
    for axis in (0, 1):
        bin_, n, other, place, place2, product, unsure, tied = np.array(sorted(sums[axis])).T
        base, score = (np.cumsum(n) - n) / total - (total + 1) / (2 * total), (bin_ + 0.5) / BIN - 0.5  # ranks over the total, from their mean
        whole += (base * other + product).sum() - (0.0 if axis else (score * other).sum())
        doubt += unsure.sum()
        gap = base - score
        rest.append((place2 + 2 * gap * place + n * gap * gap).sum() + tied.sum())
        low.append((place2 + 2 * base * place + n * base * base).sum())
        high.append(low[-1] + tied.sum())
    doubt += (rest[0] * rest[1]) ** 0.5
    if not low[0] or not low[1]:
        return float("-inf"), float("inf")
    ends = [(whole + e) / (x * y) ** 0.5 for e in (-doubt, doubt) for x, y in ((low[0], low[1]), (high[0], high[1]))]
    return float(min(ends)), float(max(ends))


def trustworthiness(df: DataFrame, queries: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """How far the queries' neighbours in ``b`` are neighbours in ``a`` too (one: all are), with k = min(5, (n - 1) // 2).

    Ranks in ``a`` are counts of nearer rows, so no list of rows is ever sorted, and
    no pair leaves a task; queries come in blocks, of each only its sum is kept.
    """
    n, m, over = df.count(), queries.count(), 0
    k = min(5, (n - 1) // 2)
    rows = _dealt(_vectors(df, key, a, b))
    for asked, qa, qb in _blocks(_vectors(queries, key, a, b)) if k > 0 else ():
        near = rows.mapInArrow(lambda it, x=(asked, qa, qb): _nearest_rows(it, *x, k), "q long, id long, da double, db double")
        near = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("db", "id"))).filter(F.col("r") <= k)
        place, found, far = {q: i for i, q in enumerate(asked.tolist())}, np.zeros((len(asked), k), dtype=np.int64), np.full((len(asked), k), -1.0)
        for r in near.collect():  # k rows a query of the block
            found[place[r["q"]], r["r"] - 1], far[place[r["q"]], r["r"] - 1] = r["id"], r["da"]
        nearer = rows.mapInArrow(lambda it, x=(asked, qa, found, far): _nearer_rows(it, *x), "at long, n long").groupBy("at").agg((F.sum("n") + 1).alias("rank"))
        over += nearer.agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0)))).first()[0] or 0
    return df.sparkSession.createDataFrame([(1 - 2.0 / (m * k * (2 * n - 3 * k - 1)) * over,)] if m and k else [(None,)], "trustworthiness double")


def tokens(df: DataFrame, vector: str, key: str, width: int) -> DataFrame:
    """``key, token, values, mask``: pieces of ``width`` features, the last filled up with zeros; the mask is one where a feature is."""
    n, filled = F.size(vector), F.concat(_doubles(vector), F.array_repeat(F.lit(0.0), width))
    own = df.filter(n > 0).select(F.col(key), filled.alias("f"), n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).alias("token"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i + F.col("token") * width < F.col("n")).cast("int"))
    return own.select(key, "token", F.slice("f", F.col("token") * width + 1, F.lit(width)).alias("values"), mask.alias("mask"))


def from_tokens(pieces: DataFrame, key: str) -> DataFrame:
    """The vectors again: a vector's tokens are as many as its features need."""
    real = F.transform(F.filter(F.arrays_zip("values", "mask"), lambda z: z["mask"] == 1), lambda z: z["values"])
    return pieces.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("token", real.alias("v")))), lambda s: s["v"])).alias("vector"))


# ---------------------------------------------------------------- synthetic rows

def bootstrap(df: DataFrame, order: list[str], rows: int, seed: int = 42) -> DataFrame:
    """``rows`` rows drawn with replacement: random places, joined to row numbers."""
    placed = numbered(df, order, "_place")
    n = placed.count()
    drawn = df.sparkSession.range(rows if n else 0).select(F.col("id").alias("draw"), (F.floor(F.rand(seed) * n) + 1).alias("_place"))
    return drawn.join(placed, "_place").drop("_place")


def student_rows(df: DataFrame, columns: list[str], rows: int, freedom: int = 5, seed: int = 42) -> DataFrame:
    """Rows of a multivariate t distribution with the columns' means and covariances (``freedom`` above two)."""
    k = len(columns)
    n, s, p = moments(df, columns)[None]
    cov = (p - np.outer(s, s) / n) / max(n - 1, 1) * (freedom - 2) / freedom
    values, vectors = np.linalg.eigh(cov)
    root = vectors * np.sqrt(np.maximum(values, 0.0))
    chi = sum((F.pow(F.randn(seed + 1000 + i), 2) for i in range(freedom)), F.lit(0.0))
    base = df.sparkSession.range(rows).select("id", *[F.randn(seed + i).alias(f"z{i}") for i in range(k)], F.sqrt(F.lit(float(freedom)) / chi).alias("t"))
    return base.select("id", *[(F.lit(float(s[i] / n)) + F.col("t") * sum((F.col(f"z{j}") * float(root[i, j]) for j in range(k)), F.lit(0.0))).alias(c) for i, c in enumerate(columns)])
