"""Mixing sources to target weights: hierarchical budgets, then seeded token prefixes.

The tree's inner nodes are values of the level columns (domain, language), its
leaves the sources below them. A budget of tokens flows down by weight. A child
can take no more than its leaves hold in ``most_epochs`` passes; what it can't
take goes to its siblings in proportion to their weights, and only what a whole
subtree can't take goes back to the level above. Each leaf then reads its texts
in a new seeded order for every epoch and takes its budget as a prefix of these
tokens: whole epochs, then the first texts of one more, the last of them cut.

Only the leaves' totals come to the driver (``most_leaves`` at most). A prefix
needs running sums in seeded order; a leaf is cut into hash ranges of about a
thousand texts, whose sums are added up first, so a leaf that holds a third of
the corpus is spread over as many tasks as its texts ask for. Ranges that end before
their leaf's budget are taken whole, without a shuffle of their texts: only the one
range of each leaf that the budget ends in is put in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.ranks import running_sum
from recipeframe.functions.shared import materialize


@dataclass
class MixParameters:
    levels: tuple = ("domain", "lang", "source")
    weights: dict = field(default_factory=dict)  # path of values: weight among its siblings (others: 1)
    share: float = 0.5  # of all tokens, if ``budget`` is None
    budget: int | None = None
    most_epochs: int = 4
    seed: int = 17
    range_rows: int = 1024  # texts in a hash range
    most_leaves: int = 1_000_000


#: Targets of the query and the pipeline, at each of the three levels: two web tokens for each curated one, half of all English,
#: and in the English web twice as many tokens of the first sources as of others. Other siblings weigh 1.
TARGET_WEIGHTS = {
    ("web",): 2.0, ("curated",): 1.0,
    ("web", "en"): 3.0, ("curated", "en"): 3.0,
    ("web", "en", "src0"): 2.0, ("web", "en", "src1"): 2.0, ("web", "en", "src2"): 2.0,
}

_SPACES, _TOKEN = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"


def count_tokens(text: str = "text") -> Column:
    """Maximal runs without ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _SPACES), lambda x: x != "")).cast("long")


def pour(amount: int, children: list[tuple[float, int]]) -> list[int]:
    """Split ``amount`` by weight among ``(weight, most it can take)``; the excess of full ones goes to the others."""
    given, open_, left = [0] * len(children), [i for i, (w, most) in enumerate(children) if w > 0 and most > 0], amount
    while left > 0 and open_:
        total, dealt, still = sum(children[i][0] for i in open_), 0, []
        for i in open_:
            part = min(int(left * children[i][0] / total), children[i][1] - given[i])
            given[i] += part
            dealt += part
            if given[i] < children[i][1]:
                still.append(i)
        left -= dealt
        if not dealt:  # less than a token each: one by one
            for i in still[:left]:
                given[i] += 1
            left -= min(left, len(still))
        open_ = [i for i in still if given[i] < children[i][1]]
    return given


def budgets(supply: dict[tuple, int], p: MixParameters) -> dict[tuple, int]:
    """Tokens of each leaf, from the tokens that each leaf holds."""
    total = sum(supply.values())
    amount = min(p.budget if p.budget is not None else int(total * p.share), total * p.most_epochs)
    capacity: dict = {}
    for leaf, n in supply.items():
        for k in range(len(leaf) + 1):
            capacity[leaf[:k]] = capacity.get(leaf[:k], 0) + n * p.most_epochs
    below: dict = {}
    for node in sorted(capacity, key=len):
        if node:
            below.setdefault(node[:-1], []).append(node)
    given = {(): amount}
    for node in sorted(capacity, key=len):
        children = sorted(below.get(node, []))
        for child, part in zip(children, pour(given[node], [(p.weights.get(c, 1.0), capacity[c]) for c in children]), strict=True):
            given[child] = part
    return {leaf: given[leaf] for leaf in supply}


def _leaves(rows: DataFrame, p: MixParameters) -> DataFrame:
    """``leaf columns, supply, n, epochs, rest``: whole passes and what is left for a prefix."""
    totals = rows.groupBy(*p.levels).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n"))
    found = totals.limit(p.most_leaves + 1).collect()
    if len(found) > p.most_leaves:
        raise ValueError(f"more than {p.most_leaves} leaves; use coarser levels")
    given = budgets({tuple(r[c] for c in p.levels): r.supply for r in found}, p)
    out = []
    for r in found:
        leaf = tuple(r[c] for c in p.levels)
        epochs, rest = divmod(given[leaf], r.supply) if r.supply else (0, 0)
        out.append((*leaf, r.supply, r.n, epochs, rest))
    schema = ", ".join(f"`{c}` string" for c in p.levels) + ", supply long, n long, epochs long, rest long"
    return rows.sparkSession.createDataFrame(out, schema)


def _small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to join to, marked for broadcast if it is few enough rows (a checked size)."""
    return F.broadcast(table) if table.count() <= most else table


def mix(docs: DataFrame, p: MixParameters | None = None, keep: list[str] | None = None) -> DataFrame:
    """Choose what each leaf gives: one row for each text and epoch that is taken.

    ``docs`` needs ``doc_id``, ``text`` and the level columns. Returns ``doc_id``,
    the levels, the ``keep`` columns, ``n_tokens, epoch`` (from 0)``, place`` (order
    in the leaf's epoch) and ``take_tokens``, less than ``n_tokens`` only for the
    text that a leaf's prefix ends in. Texts without a token are never taken. A
    null level counts as the empty string. Order follows a hash of seed, epoch,
    id and text, so repeated rows are taken side by side; null ids are allowed.
    An empty table gives an empty result.
    """
    p = p or MixParameters()
    keep = [c for c in keep or [] if c not in ("doc_id", *p.levels)]
    levels = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in p.levels]
    rows = docs.filter(F.col("text").rlike(_TOKEN)).select("doc_id", *levels, *keep, F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    slim = materialize(rows.select("doc_id", *p.levels, "_hash", count_tokens("_text").alias("n_tokens")), "counted")
    leaves = _small(_leaves(slim, p))
    place = lambda epoch: F.shiftrightunsigned(F.xxhash64(F.lit(p.seed), epoch, "doc_id", "_hash"), 1)
    ranges = F.ceil(F.col("n") / p.range_rows)
    ranged = lambda own: own.join(leaves, list(p.levels)).withColumn("_range", F.floor(place(F.col("epochs")) / F.lit(float(1 << 63)) * ranges).cast("long"))
    sums = ranged(slim).filter("rest > 0").groupBy(*p.levels, "_range").agg(F.sum("n_tokens").alias("_sum"), F.first("rest").alias("_rest"))
    # over all ranges of all leaves at once, by ranges of their own: a leaf may have any number of them
    every = running_sum(sums, [*p.levels, "_range"], F.col("_sum"), "_upto")
    first = every.groupBy(*p.levels).agg(F.min(F.col("_upto") - F.col("_sum")).alias("_first"))
    offsets = every.join(first, list(p.levels)).withColumn("_before", F.col("_upto") - F.col("_sum") - F.col("_first"))
    offsets = offsets.filter("_before < _rest").select(*p.levels, "_range", "_before", (F.col("_before") + F.col("_sum") <= F.col("_rest")).alias("_inside"))
    offsets = _small(materialize(offsets, "offsets"))
    # texts are read again, so that none is stored; where none is asked for, the counted rows do
    own = ranged(rows if keep else slim).filter("epochs > 0 OR rest > 0")
    counted = lambda found: found.withColumn("n_tokens", count_tokens("_text")) if keep else found
    inside = offsets.filter("_inside").select(*p.levels, "_range", F.lit(1).alias("_last"))
    whole = counted(own.join(inside, [*p.levels, "_range"], "left").withColumn("_times", F.col("epochs") + F.coalesce("_last", F.lit(0))).filter("_times > 0"))
    whole = whole.withColumn("epoch", F.explode(F.expr("sequence(0L, _times - 1)"))).withColumn("place", place(F.col("epoch"))).withColumn("take_tokens", F.col("n_tokens"))
    edge = own.join(offsets.filter("NOT _inside").drop("_inside"), [*p.levels, "_range"])
    edge = counted(edge.withColumn("epoch", F.col("epochs")).withColumn("place", place(F.col("epoch"))))
    order = W.partitionBy(*p.levels, "_range").orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = edge.withColumn("_start", F.col("_before") + F.sum("n_tokens").over(order) - F.col("n_tokens"))
    part = part.filter("_start < rest").withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("_start")))
    columns = ["doc_id", *p.levels, *keep, "n_tokens", "epoch", "place", "take_tokens"]
    return whole.select(*columns).unionByName(part.select(*columns))


def cut_text(text: Column, tokens: Column) -> Column:
    """A text up to the end of its ``tokens``-th token, white space and all; the whole text, if it has no more."""
    words, gaps = F.split(text, _SPACES), F.regexp_extract_all(text, F.lit(f"({_SPACES})"), F.lit(1))
    upto = tokens.cast("int") + F.when(F.element_at(words, 1) == "", 1).otherwise(0)  # a leading gap follows an empty word
    return F.array_join(F.zip_with(F.slice(words, F.lit(1), upto), F.slice(gaps, F.lit(1), F.greatest(upto - 1, F.lit(0))), lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")


def with_domain(docs: DataFrame) -> DataFrame:
    """Add the top level of the tree: sources named by one digit are ``web``, all others ``curated``."""
    return docs.withColumn("domain", F.when(F.coalesce(F.col("source"), F.lit("")).rlike("^src[0-9]$"), "web").otherwise("curated"))
