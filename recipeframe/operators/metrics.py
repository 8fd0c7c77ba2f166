"""Classification, regression, ranking and clustering metrics as plain aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.quantiles import quantiles
from recipeframe.functions.ranks import running_sum
from recipeframe.functions.shared import materialize


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``label, pred, n``: at most the square of the number of classes, whatever the rows."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").cast("double").alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1, F2, MCC, kappa, Jaccard, Hamming and zero-one loss.

    With two classes the larger is the positive one; with more the scores are
    averages weighted by class size. Undefined scores are zero. One row.
    """
    c = confusion(df, label, pred)
    rows = c.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("actual"))
    cols = c.groupBy(F.col("pred").alias("k")).agg(F.sum("n").alias("predicted"))
    hits = c.filter("label = pred").select(F.col("label").alias("k"), F.col("n").alias("hit"))
    by = rows.join(cols, "k", "full").join(hits, "k", "left").select("k", *[_zero(F.col(x)).alias(x) for x in ("actual", "predicted", "hit")])
    p, r = _zero(F.try_divide("hit", "predicted")), _zero(F.try_divide("hit", "actual"))
    by = by.withColumns({"p": p, "r": r}).withColumns(
        {"f1": _zero(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))), "f2": _zero(F.try_divide(5 * F.col("p") * F.col("r"), 4 * F.col("p") + F.col("r"))), "j": _zero(F.try_divide("hit", F.col("actual") + F.col("predicted") - F.col("hit")))}
    )
    last = lambda x: F.max_by(x, "k")
    mean = lambda x: _zero(F.try_divide(F.sum(F.col(x) * F.col("actual")), F.sum("actual")))
    score = lambda x: F.when(F.count("*") == 2, last(x)).otherwise(mean(x))
    s = by.agg(
        F.sum("actual").alias("n"), F.sum("hit").alias("hit"), _zero(F.avg(F.when(F.col("actual") > 0, F.col("r")))).alias("balanced_accuracy"),
        score("p").alias("precision"), score("r").alias("recall"), score("f1").alias("f1"), score("f2").alias("f2"), score("j").alias("jaccard"),
        F.sum(F.col("actual") * F.col("predicted")).alias("cross"), F.sum(F.col("actual") * F.col("actual")).alias("aa"), F.sum(F.col("predicted") * F.col("predicted")).alias("pp"),
    )
    accuracy, n = F.col("hit") / F.col("n"), F.col("n")
    chance = F.col("cross") / (n * n)
    mcc = _zero(F.try_divide(F.col("hit") * n - F.col("cross"), F.sqrt((n * n - F.col("pp")) * (n * n - F.col("aa")))))
    return s.select(
        accuracy.alias("accuracy"), "balanced_accuracy", "precision", "recall", "f1", "f2", mcc.alias("mcc"), _zero(F.try_divide(accuracy - chance, 1 - chance)).alias("kappa"), "jaccard", (1 - accuracy).alias("hamming"), (1 - accuracy).alias("zero_one"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of a 0/1 label, by average ranks of distinct scores; NULL with one class."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))
    ranked = running_sum(by, ["s"], F.col("n"), "upto").withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    t = ranked.agg(F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    return t.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def regression_metrics(df: DataFrame, target: str, pred: str) -> DataFrame:
    e, y = F.col(target) - F.col(pred), F.col(target)
    s = df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("see"), F.var_pop(e).alias("ve"), F.var_pop(y).alias("vy"), F.count("*").alias("n"))
    middle = quantiles(df.select(F.lit(1).alias("one"), F.abs(e).alias("e")), ["one"], "e", [0.5]).select("one", F.col("q")[0].alias("median_ae"))
    s = s.withColumn("one", F.lit(1)).join(middle, "one", "left")
    return s.select("rmse", "mae", (1 - F.try_divide("see", F.col("vy") * F.col("n"))).alias("r2"), "median_ae", (1 - F.try_divide("ve", "vy")).alias("explained_variance"))


# ---------------------------------------------------------------- clusterings

def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def external_metrics(df: DataFrame, a: str, b: str) -> DataFrame:
    """ARI, NMI, homogeneity, completeness and V-measure of two labelings."""
    c = contingency(df, a, b)
    left, right = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    pairs = lambda x: F.sum(x * (x - 1) / 2)
    plogp = lambda x: F.sum(x * F.ln(x))
    one = F.lit(1).alias("one")
    s = reduce(
        lambda p, q: p.join(q, "one"),
        [c.agg(F.sum("n").alias("n"), pairs(F.col("n")).alias("pij"), plogp(F.col("n")).alias("lij"), one), left.agg(pairs(F.col("na")).alias("pa"), plogp(F.col("na")).alias("la"), one), right.agg(pairs(F.col("nb")).alias("pb"), plogp(F.col("nb")).alias("lb"), one)],
    )
    n = F.col("n")
    expected, most = F.col("pa") * F.col("pb") / (n * (n - 1) / 2), (F.col("pa") + F.col("pb")) / 2
    ha, hb, mi = F.ln(n) - F.col("la") / n, F.ln(n) - F.col("lb") / n, F.ln(n) + (F.col("lij") - F.col("la") - F.col("lb")) / n
    s = s.select(F.coalesce(F.try_divide(F.col("pij") - expected, most - expected), F.lit(1.0)).alias("ari"), ha.alias("ha"), hb.alias("hb"), mi.alias("mi"))
    s = s.withColumns({"homogeneity": F.when(F.col("ha") > 1e-12, F.col("mi") / F.col("ha")).otherwise(1.0), "completeness": F.when(F.col("hb") > 1e-12, F.col("mi") / F.col("hb")).otherwise(1.0)})
    return s.select("ari", F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"), "homogeneity", "completeness", _zero(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness"))).alias("v_measure"))


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Number of clusters, share of noise (-1), entropy of sizes, smallest and largest."""
    by = df.groupBy(F.col(label).alias("k")).agg(F.count("*").cast("double").alias("n"))
    real = F.when(F.col("k") != -1, F.col("n"))
    s = by.agg(F.count(real).alias("clusters"), _zero(F.sum(F.when(F.col("k") == -1, F.col("n")))).alias("noise"), F.sum("n").alias("all"), F.sum(real).alias("m"), F.sum(real * F.ln(real)).alias("l"), F.min(real).alias("smallest"), F.max(real).alias("largest"))
    return s.select("clusters", (F.col("noise") / F.col("all")).alias("noise_fraction"), (F.ln("m") - F.col("l") / F.col("m")).alias("size_entropy"), F.col("smallest").cast("long").alias("smallest"), F.col("largest").cast("long").alias("largest"))


def _coordinates(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.select(F.col(label).alias("k"), F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def dispersion_metrics(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin: sums by coordinate, then centroids (one row for each cluster) against each other."""
    df = df.filter(F.col(label) != -1)
    x = _coordinates(df, vector, label)
    sums = x.groupBy("k", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    total = sums.groupBy("i").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"))
    own = sums.join(total, "i")
    sse = own.agg(F.sum(F.col("xx") - F.col("n") * F.col("m") * F.col("m")).alias("within"), F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.lit(1).alias("one"))
    sizes = df.agg(F.count("*").alias("rows"), F.count_distinct(label).alias("clusters"), F.lit(1).alias("one"))
    centers = sums.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select("k", F.transform("c", lambda s: s["m"]).alias("c"))
    distance = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
    rows = df.select(F.col(label).alias("k"), F.transform(vector, lambda v: v.cast("double")).alias("v")).join(centers, "k")
    scatter = rows.groupBy("k").agg(F.avg(distance(F.col("v"), F.col("c"))).alias("s"))
    full = centers.join(scatter, "k")
    a, b = full.alias("a"), full.alias("b")
    pair = a.join(b, F.col("a.k") != F.col("b.k")).select(F.col("a.k").alias("k"), ((F.col("a.s") + F.col("b.s")) / distance(F.col("a.c"), F.col("b.c"))).alias("r"))
    db = pair.groupBy("k").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"), F.lit(1).alias("one"))
    ch = (F.col("between") / (F.col("clusters") - 1)) / (F.col("within") / (F.col("rows") - F.col("clusters")))
    return sse.join(sizes, "one").join(db, "one").select(ch.alias("calinski_harabasz"), "davies_bouldin")


def _distance_sums(block: list, labels: list):
    """For each row, the sum of its distances to the rows of a block and their number, by their label."""
    other = np.array([r.v for r in block])
    hot = np.array([[r.k == k for k in labels] for r in block], dtype=float)
    squares, sizes = (other**2).sum(axis=1), hot.sum(axis=0).astype(np.int64)

    def build(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                own = np.array(part.column("v").to_pylist(), dtype=float).reshape(part.num_rows, -1)
                d = np.sqrt(np.maximum((own**2).sum(axis=1)[:, None] - 2 * (own @ other.T) + squares, 0.0)) @ hot
                at = np.repeat(np.arange(part.num_rows), len(labels))
                own_rows = part.select(["id", "k"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own_rows.columns, pa.array(labels * part.num_rows, own_rows.column(1).type), pa.array(d.ravel()), pa.array(np.tile(sizes, part.num_rows))], names=["id", "k", "o", "d", "n"])

    return build


def silhouette(df: DataFrame, vector: str, label: str, key: str, block_rows: int = 4096) -> DataFrame:
    """Exact Euclidean silhouette of all rows; noise is left out, NULL with fewer than two clusters.

    All distances count, so the time grows with the square of the rows: rows come
    in blocks of about ``block_rows``, each sent by itself to all rows, and leave
    a sum for each row and cluster, never a pair. ``key`` must be unique.
    """
    own = df.filter(F.col(label) != -1).select(F.col(key).alias("id"), F.col(label).alias("k"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    own = materialize(own, "rows")
    blocks = -(-own.count() // block_rows)
    sums = []
    for i in range(blocks):
        block = own.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select("k", "v").collect()
        if block:
            kinds = dict(own.dtypes)
            labels = sorted({r.k for r in block})
            sums.append(materialize(own.mapInArrow(_distance_sums(block, labels), f"id {kinds['id']}, k {kinds['k']}, o {kinds['k']}, d double, n long"), "sums"))
    if not sums:
        return own.agg(F.lit(None).cast("double").alias("silhouette"))
    by = reduce(DataFrame.unionByName, sums).groupBy("id", "k", "o").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    inside = F.when(F.col("k") == F.col("o"), F.try_divide(F.col("d"), F.col("n") - 1))
    near = by.groupBy("id", "k").agg(F.max(inside).alias("a"), F.min(F.when(F.col("k") != F.col("o"), F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(_zero(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))))
    return near.agg(F.when(F.count("b") == F.count("*"), F.avg(s)).alias("silhouette"))


def label_agreement(runs: DataFrame) -> DataFrame:
    """``left, right, n, coverage, ari``: agreement of each pair of runs over rows that neither calls noise.

    ``runs`` is ``run, row, label``.
    """
    own = runs.filter("label <> -1")
    rows = runs.select("row").distinct().count()
    both = own.alias("a").join(own.alias("b"), (F.col("a.row") == F.col("b.row")) & (F.col("a.run") < F.col("b.run")))
    c = both.groupBy(F.col("a.run").alias("left"), F.col("b.run").alias("right"), F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    keys = ["left", "right"]
    pij = c.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("pij"))
    pa = c.groupBy(*keys, "a").agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(pairs(F.col("m"))).alias("pa"))
    pb = c.groupBy(*keys, "b").agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(pairs(F.col("m"))).alias("pb"))
    s = pij.join(pa, keys).join(pb, keys)
    expected, most = F.col("pa") * F.col("pb") / pairs(F.col("n")), (F.col("pa") + F.col("pb")) / 2
    return s.select(*keys, F.col("n").cast("long").alias("n"), (F.col("n") / rows).alias("coverage"), F.coalesce(F.try_divide(F.col("pij") - expected, most - expected), F.lit(1.0)).alias("ari"))


def label_classes(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the same labels in all runs as one class: membership ``row, class`` (its smallest row), and ``class, size, labels`` (run to label, noise left out)."""
    by = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("label") != -1, F.struct("run", "label")))).alias("labels"))
    by = materialize(by, "label-vectors")
    classes = by.groupBy("labels").agg(F.min("row").alias("class"), F.count("*").alias("size"))
    return by.join(classes, "labels").select("row", "class"), classes.select("class", "size", "labels")


def coassignment(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership of all rows in classes, and ``a, b, pairs, eligible, consensus`` of each two classes (and of a class with itself).

    ``eligible`` are the runs where neither is noise, ``consensus`` the share of
    them in which they are in one cluster; both are the same for all ``pairs`` of
    rows of the two classes. Pairs that are never eligible are left out.
    """
    members, classes = label_classes(runs)
    each = materialize(classes.select("class", "size", F.explode("labels").alias("l")).select("class", "size", "l.run", "l.label"), "classes")
    met = each.alias("x").join(each.alias("y"), (F.col("x.run") == F.col("y.run")) & (F.col("x.class") <= F.col("y.class")))
    by = met.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.size").alias("m"), F.col("y.size").alias("n")).agg(F.count("*").alias("eligible"), F.avg((F.col("x.label") == F.col("y.label")).cast("double")).alias("consensus"))
    pairs = F.when(F.col("a") == F.col("b"), F.col("m") * (F.col("m") - 1) / 2).otherwise(F.col("m") * F.col("n")).cast("long")
    return members, by.select("a", "b", pairs.alias("pairs"), "eligible", "consensus").filter("pairs > 0")


def consensus_consistency(pairs: DataFrame) -> DataFrame:
    """Mean over all pairs of rows of how sure their consensus is; ``pairs`` as of ``coassignment``."""
    sure = F.greatest("consensus", 1 - F.col("consensus"))
    return pairs.agg((F.sum(sure * F.col("pairs")) / F.sum("pairs")).alias("consistency"))


def stability_report(runs: DataFrame) -> DataFrame:
    """Mean, spread, least and most of the runs' pairwise ARI, and their coverage."""
    return label_agreement(runs).agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.min("ari").alias("min_ari"), F.max("ari").alias("max_ari"), F.avg("coverage").alias("coverage"))


# ---------------------------------------------------------------- splits and distributions

def _placed_in_class(df: DataFrame, label: str, key: str, seed: int, range_rows: int = 100_000) -> DataFrame:
    """Add ``_k``, each row's place in the seeded hash order of its class, and ``_n``, the class's rows.

    A class is cut into ranges of the hash, of about ``range_rows`` rows; only
    their counts are summed up in one place, rows are ranked within a range.
    """
    own = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1))
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    own = own.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    ranges = F.ceil(F.col("_n") / range_rows)
    own = own.withColumn("_range", F.least(F.floor(F.col("_h") / F.lit(float(1 << 63)) * ranges), ranges - 1))
    counts = own.groupBy("_label", "_range").agg(F.count("*").alias("_c"))
    counts = counts.select(F.col("_label").alias("_l"), F.col("_range").alias("_r"), (F.sum("_c").over(W.partitionBy("_label").orderBy("_range")) - F.col("_c")).alias("_before"))
    placed = own.join(counts, F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_range") == F.col("_r")))
    inside = F.row_number().over(W.partitionBy("_label", "_range").orderBy("_h", key))
    return placed.withColumn("_k", F.col("_before") + inside).drop("_h", "_label", "_range", "_l", "_r", "_before")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``is_test``: of each class the first rows in a seeded hash order."""
    return _placed_in_class(df, label, key, seed).withColumn("is_test", F.col("_k") <= F.round(F.col("_n") * test)).drop("_k", "_n")


def plain_split(df: DataFrame, key: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the first rows in a seeded hash order, at least one and never all."""
    ranked = _placed_in_class(df.withColumn("_one", F.lit(1)), "_one", key, seed).drop("_one")
    most = F.greatest(F.least(F.round(F.col("_n") * test), F.col("_n") - 1), F.lit(1))
    return ranked.withColumn("is_test", F.col("_k") <= most).drop("_k", "_n")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``; there are no more folds than rows of the smallest class."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or folds
    k = max(2, min(folds, least))
    return _placed_in_class(df, label, key, seed).withColumn("fold", ((F.col("_k") - 1) % k).cast("int")).drop("_k", "_n")


def wasserstein(left: DataFrame, right: DataFrame, columns: list[str], points: int = 100) -> DataFrame:
    """First Wasserstein distance of each column, by quantiles at the midpoints of ``points`` steps."""
    at = [(i + 0.5) / points for i in range(points)]
    long = lambda d: d.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    q = lambda d, n: quantiles(long(d), ["column"], "value", at).select("column", F.col("q").alias(n))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, t: s + t) / points
    return q(left, "a").join(q(right, "b"), "column").select("column", gap.alias("distance"))


def moment_shift(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    m = lambda d, n: d.select(*columns).unpivot([], columns, "column", "v").groupBy("column").agg(F.avg("v").alias(f"m{n}"), F.stddev_pop("v").alias(f"s{n}"))
    return m(left, 0).join(m(right, 1), "column").select("column", (F.col("m1") - F.col("m0")).alias("mean_shift"), (F.col("s1") - F.col("s0")).alias("std_shift"))
