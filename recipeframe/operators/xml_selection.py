"""Selections, recipes and groups over XML collections, from the node table.

What is known of paths is joined to paths below them by their prefixes, so a
field knows the repeated and optional branches above it without any tree walk.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.graph import connected_components
from recipeframe.functions.ranks import numbered
from recipeframe.functions.shared import materialize
from recipeframe.operators import xml_tables as X
from recipeframe.sources.xml import MOST_AT_ONCE, dealt, shred_batches, shred_documents

#: Strategies for a repeated branch and the options each needs; fixed values.
STRATEGIES = {
    "keep_nested": (), "first": (), "last": (), "count": (), "join": ("delimiter",), "aggregate": ("function",), "pivot": ("key", "value"), "explode_rows": (), "separate_table": (),
}
FUNCTIONS = ("sum", "mean", "min", "max")


def _prefixes(path: str, least: int = 1) -> Column:
    """A path and all above it that have ``least`` steps or more."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(least), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def selectable_fields(nodes: DataFrame, root: str) -> DataFrame:
    """``field, path, kind, repeated, optional``: attributes and texts below a record root, and the root's own.

    A branch that repeats or is optional makes all below it so. Elements that hold
    both children and text are no text fields; leaves are, even where all are empty.
    """
    paths = X.path_profile(nodes).filter((F.col("path") == root) | F.col("path").startswith(root + "/"))
    up = paths.select("path", F.explode(_prefixes("path", X.depth_of(root) + 1)).alias("above"))
    # the root itself repeats by nature
    flags = paths.select(F.col("path").alias("above"), ((F.col("path") != root) & F.col("repeated")).alias("r"), ((F.col("path") != root) & F.col("optional")).alias("o"))
    inherited = up.join(flags, "above").groupBy("path").agg(F.bool_or("r").alias("repeated"), F.bool_or("o").alias("optional"))
    texts = paths.filter("leaf").select("path", F.concat(F.lit("text:"), "path").alias("field"), F.lit("text").alias("kind"), F.lit(False).alias("sometimes"))
    names = X.attribute_profile(nodes).join(paths.select("path"), "path", "left_semi")
    attributes = names.select("path", F.concat(F.lit("attribute:"), "path", F.lit("@"), "name").alias("field"), F.lit("attribute").alias("kind"), (F.col("presence") < 1).alias("sometimes"))
    return texts.unionByName(attributes).join(inherited, "path").select("field", "path", "kind", "repeated", (F.col("optional") | F.col("sometimes")).alias("optional"))


def collection_plan(nodes: DataFrame, root: str, fields: list[str], rules: dict[str, dict] | None = None) -> DataFrame:
    """``branch, parent, fields, resolved``: the repeated branches that chosen fields lie in, the branch each is nested in, and whether a rule resolves it."""
    chosen = nodes.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    path = F.when(F.col("field").startswith("attribute:"), F.regexp_extract("field", r"^attribute:(.*)@[^@]*$", 1)).otherwise(F.substring("field", F.lit(6), F.length("field")))
    own = chosen.withColumn("path", path)
    paths = X.path_profile(nodes)
    branches = paths.filter(F.col("repeated") & F.col("path").startswith(root + "/")).select(F.col("path").alias("branch"))
    touched = own.select("field", F.explode(_prefixes("path")).alias("branch")).join(branches, "branch").groupBy("branch").agg(F.count("*").alias("fields"))
    above = touched.select("branch", F.explode(_prefixes("branch")).alias("outer")).filter("outer <> branch")
    parents = above.join(branches.withColumnRenamed("branch", "outer"), "outer").groupBy("branch").agg(F.max_by("outer", F.length("outer")).alias("parent"))
    nested = touched.join(parents, "branch", "left")
    known = [b for b, r in (rules or {}).items() if not rule_errors(r)]
    return nested.select("branch", "parent", "fields", F.col("branch").isin(known).alias("resolved"))


def rule_errors(rule: dict) -> list[str]:
    """What is wrong with the rule of a branch: none, if it can be used."""
    kind = rule.get("strategy")
    if kind not in STRATEGIES:
        return [f"unknown strategy {kind}"]
    out = [f"{kind} needs {o}" for o in STRATEGIES[kind] if not rule.get(o)]
    out += [f"{kind} has no option {o}" for o in rule if o != "strategy" and o not in STRATEGIES[kind]]
    if kind == "aggregate" and rule.get("function") and rule["function"] not in FUNCTIONS:
        out.append(f"unknown function {rule['function']}")
    return out


def unique_names(names: list[str]) -> list[str]:
    """Names in their order, a repeated one as ``name__2``, ``name__3`` and so on."""
    out: list[str] = []
    taken = set()
    for name in names:
        new, i = name, 1
        while new in taken:
            i += 1
            new = f"{name}__{i}"
        taken.add(new)
        out.append(new)
    return out


def check_signature(seen: str, source: str, root: str, fields: dict[str, str], rules: dict | None = None) -> None:
    """Refuse to write a table for anything but what was previewed."""
    if seen != signature(source, root, fields, rules):
        raise ValueError("the preview is of another source, root, selection or rule; look at it again")


def signature(source: str, root: str, fields: dict[str, str], rules: dict | None = None) -> str:
    """A hash of all that a preview depends on; a table is written only for the signature that was looked at."""
    import hashlib

    return hashlib.sha256(json.dumps([source, root, sorted(fields.items()), rules or {}], sort_keys=True).encode()).hexdigest()


def preview(df: DataFrame, most: int = 200) -> tuple[list, bool]:
    """The first rows, and whether there are more."""
    rows = df.limit(most + 1).collect()
    return rows[:most], len(rows) > most


# ---------------------------------------------------------------- groups of sources

def shape_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (``source_file, representative``) and the similarity of representatives: sources of one shape are compared once."""
    members, shapes = X.shape_members(nodes)
    return members, X.shape_similarity(shapes)


def _fill_groups(component: pd.DataFrame) -> pd.DataFrame:
    """``representative, lead`` of one component's ``left, right``; a row without ``right`` names a shape."""
    links: dict[str, set] = {}
    for left, right in component[["left", "right"]].itertuples(index=False):
        links.setdefault(left, set())
        if right is not None:
            links.setdefault(right, set()).add(left)
    groups: list[list[str]] = []
    for head in sorted(links):
        own = links[head]
        group = next((g for g in groups if len(g) <= len(own) and all(h in own for h in g)), None)
        if group is None:
            groups.append([head])
        else:
            group.append(head)
    return pd.DataFrame([(h, g[0]) for g in groups for h in g], columns=["representative", "lead"])


def complete_link_groups(nodes: DataFrame) -> DataFrame:
    """``source_file, group``: in path order, a source joins the first group whose sources are all compatible with its own.

    Pairs that lack nothing but a shared record root may stand together. Sources
    of one shape share a group. Groups never reach beyond a connected component of
    compatible shapes, so each component is filled by itself in a task; a task holds
    the links of one component's shapes, whatever the number of sources.
    """
    members, pairs = shape_pairs(nodes)
    alike = materialize(pairs.filter(F.col("classification").isin("exact", "compatible_variant_candidate") | (F.col("reason") == "no_shared_record_root_evidence")).select("left", "right"), "alike")
    shapes = members.select(F.col("representative").alias("left")).distinct()
    parts = connected_components(alike.select(F.col("left").alias("a"), F.col("right").alias("b"))).withColumnRenamed("node", "left")
    rows = alike.unionByName(shapes.withColumn("right", F.lit(None).cast("string"))).join(parts, "left", "left")
    groups = rows.withColumn("component", F.coalesce("label", "left")).groupBy("component").applyInPandas(_fill_groups, "representative string, lead string")
    groups = materialize(groups, "groups")
    places = numbered(groups.select("lead").distinct(), ["lead"], "place")
    return members.join(groups, "representative").join(places, "lead").select("source_file", F.col("place").cast("int").alias("group"))


def review(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """``classification, reason, pairs, blocking`` of the shapes of the selected sources (``source_file``)."""
    _, pairs = shape_pairs(nodes.join(selected, "source_file", "left_semi"))
    return pairs.groupBy("classification", "reason").agg(F.count("*").alias("pairs")).withColumn("blocking", F.col("classification").isin("review_required", "incompatible"))


# ---------------------------------------------------------------- recipes of collections

def shared_roots(nodes: DataFrame) -> DataFrame:
    """``path, sources, min_records, score`` of the record candidates that every source has."""
    own = nodes.filter("error IS NULL")
    total = own.agg(F.count_distinct("source_file").alias("total"))
    per = own.groupBy("source_file", "path").agg(F.count("*").alias("n")).groupBy("path").agg(F.count("*").alias("sources"), F.min("n").alias("min_records"))
    every = per.join(F.broadcast(total), F.col("sources") == F.col("total")).drop("total")
    return every.join(X.record_candidates(nodes).select("path", "score"), "path").select("path", "sources", "min_records", "score")


def field_catalog(nodes: DataFrame, root: str) -> DataFrame:
    """``path, present, missing, repeated_in``: of each path below a root, how many sources have it, lack it, and repeat it within a parent."""
    own = nodes.filter(F.col("error").isNull() & F.col("path").startswith(root + "/"))
    total = nodes.filter("error IS NULL").agg(F.count_distinct("source_file")).first()[0]
    per = own.groupBy("source_file", "path").agg((F.max("occurrence") + 1).alias("n"))
    return per.groupBy("path").agg(F.count("*").alias("present"), F.count_if(F.col("n") > 1).alias("repeated_in")).select("path", "present", (F.lit(total) - F.col("present")).alias("missing"), "repeated_in")


def align_recipe(nodes: DataFrame, root: str, fields: dict[str, str]) -> DataFrame:
    """``source_file, field, status`` of every source and field: ``aligned``, ``root_absent``, ``path_absent`` or ``attribute_absent``; what is absent becomes NULL."""
    own = nodes.filter("error IS NULL")
    flags = [F.max((F.col("path") == root).cast("int")).alias("root")]
    for i, field in enumerate(fields.values()):
        path, _ = X.field_value(field)
        here = F.col("path") == path
        has = here if field.startswith("text:") else here & F.map_contains_key("attributes", F.lit(field.rpartition("@")[2]))
        flags += [F.max(here.cast("int")).alias(f"p{i}"), F.max(has.cast("int")).alias(f"h{i}")]
    by = own.groupBy("source_file").agg(*flags)
    status = lambda i: F.when(F.col("root") == 0, "root_absent").when(F.col(f"p{i}") == 0, "path_absent").when(F.col(f"h{i}") == 0, "attribute_absent").otherwise("aligned")
    every = F.array(*[F.struct(F.lit(n).alias("field"), status(i).alias("status")) for i, n in enumerate(fields)])
    return by.select("source_file", F.explode(every).alias("s")).select("source_file", "s.*")


def full_recipe(nodes: DataFrame) -> DataFrame:
    """``root, field, strategy``: all fields below the best shared root (score, then records, then the shallower, then the name); repeated ones stay nested."""
    best = shared_roots(nodes).orderBy(F.desc("score"), F.desc("min_records"), F.size(F.split("path", "/")), "path").first()
    if best is None:
        raise ValueError("the sources share no record root")
    return selectable_fields(nodes, best["path"]).select(F.lit(best["path"]).alias("root"), "field", F.when(F.col("repeated"), "keep_nested").otherwise("first").alias("strategy"))


def align_columns(frames: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """One table of all frames: columns of one identity come together under the name the first frame gives it.

    ``frames`` map columns to identities. Two identities under one name, or two
    columns of a frame with one identity, are an error.
    """
    names: dict[str, str] = {}
    out = None
    for df, identities in frames:
        if len(set(identities.values())) < len(identities):
            raise ValueError("two columns of a frame have one identity")
        for column, identity in identities.items():
            if identity not in names:
                if column in names.values():
                    raise ValueError(f"{column} names two identities")
                names[identity] = column
        own = df.select(*[F.col(f"`{c}`").alias(names[i]) for c, i in identities.items()])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def null_catalog(nodes: DataFrame, root: str, fields: dict[str, str]) -> DataFrame:
    """``field, present_sources, missing_sources, records, values, nulls`` over a collection."""
    reasons = X.null_reasons(nodes, root, fields)
    absent = F.col("status").isin("path_absent", "attribute_absent")
    per = reasons.groupBy("field", "source_file").agg(F.count("*").alias("n"), F.count_if(~absent).alias("some"), F.count_if(F.col("status").isin("value", "multiple")).alias("v"))
    return per.groupBy("field").agg(F.count_if(F.col("some") > 0).alias("present_sources"), F.count_if(F.col("some") == 0).alias("missing_sources"), F.sum("n").alias("records"), F.sum("v").alias("values"), F.sum(F.col("n") - F.col("v")).alias("nulls"))


# ---------------------------------------------------------------- consolidated and typed records

def consolidated(nodes: DataFrame, root: str, fields: dict[str, str], rules: dict | None = None, comments: bool = True) -> DataFrame:
    """All sources' records in one table, with ``__source_file``, ``__source_row`` (from 1 in each source) and the reasons of missing values."""
    main = X.extract(nodes, root, fields, rules)
    if comments:
        main = main.join(X.comments(X.null_reasons(nodes, root, fields)), ["source_file", "record"], "left")
    place = F.row_number().over(W.partitionBy("source_file").orderBy("record")).cast("long")
    return main.withColumn("__source_row", place).withColumnRenamed("source_file", "__source_file").drop("record")


def source_preview(consolidated_rows: DataFrame, most: int = 25) -> DataFrame:
    return consolidated_rows.filter(F.col("__source_row") <= most)


def representations(nodes: DataFrame) -> DataFrame:
    """``path, kinds``: how elements of a path can be shown."""
    when = lambda c, k: F.when(c, F.lit(k))
    attributes = X.attribute_profile(nodes).select("path").distinct().withColumn("a", F.lit(True))
    p = X.path_profile(nodes).join(attributes, "path", "left").withColumn("a", F.coalesce("a", F.lit(False)))
    kinds = F.array(when(F.col("leaf"), "scalar"), when(~F.col("leaf") | F.col("a"), "object"), when(F.col("repeated"), "list"), F.lit("content_tokens"), F.lit("path_tokens"), when(~F.col("leaf"), "linked_children"))
    return p.select("path", F.array_compact(kinds).alias("kinds"))


def typed_records(nodes: DataFrame, root: str) -> DataFrame:
    """``source_file, record, content_tokens, path_tokens, children``: a record's words in document order, the paths of its elements, and the addresses of its direct children."""
    below = X._below(nodes, root)
    words = F.filter(F.split(F.concat_ws(" ", "text"), r"\s+"), lambda w: w != "")
    depth = X.depth_of(root)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["v"])
    return below.groupBy("source_file", "record").agg(
        F.flatten(ordered(F.struct("node_id", words.alias("v")))).alias("content_tokens"),
        ordered(F.struct("node_id", F.col("path").alias("v"))).alias("path_tokens"),
        ordered(F.when(F.col("depth") == depth + 1, F.struct("node_id", F.concat_ws("#", "path", "node_id").alias("v")))).alias("children"),
    )


def record_ids(records: DataFrame, sha: Column, root: str) -> DataFrame:
    """Add ``id``: ``sha:root:ordinal`` of a record in its source."""
    place = F.row_number().over(W.partitionBy("source_file").orderBy("record")) - 1
    return records.withColumn("id", F.concat_ws(":", sha, F.lit(root), place))


_RECORDS = "source_file string, record long, content_tokens array<string>, path_tokens array<string>, children array<string>, place int"


def _typed_rows(nodes: pa.Table, root: str) -> pa.RecordBatch | None:
    """The rows of ``typed_records`` of one document's nodes, with each record's ``place``."""
    path = nodes.column("path")
    inside = pc.fill_null(pc.and_(pc.is_null(nodes.column("error")), pc.or_(pc.equal(path, root), pc.starts_with(path, root + "/"))), False)
    own = nodes.filter(inside)
    own = own.take(pc.sort_indices(own.column("node_id"))).combine_chunks()
    if not own.num_rows:
        return None
    source, path, node, ancestors, text = (own.column(c).chunk(0) for c in ("source_file", "path", "node_id", "ancestors", "text"))
    at = ancestors.offsets.to_numpy()[:-1] + X.depth_of(root)
    record = ancestors.values.to_numpy()[at]
    starts = np.flatnonzero(np.diff(record, prepend=-1))
    lists = lambda each, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.add.reduceat(each, starts).cumsum()).astype(np.int32)), values)
    words = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    of, words = pc.list_parent_indices(words).to_numpy(), words.flatten()
    full = pc.not_equal(words, "")
    child = own.column("depth").chunk(0).to_numpy() == X.depth_of(root) + 1
    address = pc.binary_join_element_wise(path, node.cast(pa.string()), "#").filter(pa.array(child))
    counts = np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(record))
    columns = [source.take(pa.array(starts)), pa.array(record[starts]), lists(counts, words.filter(full)), lists(np.ones(len(record), dtype=np.int64), path), lists(child.astype(np.int64), address), pa.array(np.arange(len(starts)), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["source_file", "record", "content_tokens", "path_tokens", "children", "place"])


def _typed_documents(batches, root):
    for b in batches:
        for source, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = _typed_rows(pa.Table.from_batches(shred_batches(source, content.as_py() or b"")), root)
            if rows is not None:
                yield rows


def identified_records(documents: DataFrame, root: str, sha: Column) -> DataFrame:
    """``typed_records`` with their ``record_ids`` of ``source_file, content``: a document's in the task that parses it, so no nodes are stored or shuffled.

    Documents of more than MOST_AT_ONCE bytes are parsed piece by piece, and their nodes grouped.
    """
    large = F.length("content") > MOST_AT_ONCE
    made = dealt(documents.filter(~F.coalesce(large, F.lit(False)))).mapInArrow(lambda it: _typed_documents(it, root), _RECORDS)
    own = made.withColumn("id", F.concat_ws(":", sha, F.lit(root), "place")).drop("place")
    if documents.filter(large).isEmpty():
        return own
    return own.unionByName(record_ids(typed_records(shred_documents(documents.filter(large)), root), sha, root))


def recipe_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``field, change``: added, removed, rule_changed or unchanged, of two recipes (``root, field, strategy``)."""
    both = old.alias("o").join(new.alias("n"), "field", "full")
    change = F.when(F.col("o.root").isNull(), "added").when(F.col("n.root").isNull(), "removed").when(~F.col("o.strategy").eqNullSafe(F.col("n.strategy")), "rule_changed").when(F.col("o.root") != F.col("n.root"), "root_changed").otherwise("unchanged")
    return both.select("field", change.alias("change"))


def collection_inventory(nodes: DataFrame) -> DataFrame:
    """``source_file, status, elements, error``: a source that can't be read is a failed row, beside the others."""
    by = nodes.groupBy("source_file").agg(F.count("node_id").alias("elements"), F.max("error").alias("error"))
    return by.select("source_file", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status"), "elements", "error")
