"""Tables from XML nodes: structure profiles, record fields, one-to-many strategies, null reasons.

Paths are canonical (expanded names). A field is ``text:<path>`` or
``attribute:<path>@<name>``; all fields of a record are gathered by one grouped
aggregate over (source, record).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.ranks import numbered
from recipeframe.functions.shared import materialize

#: Names of identifiers (any that ends in ``_id`` is one too) and the weights of record roots and similarity; fixed values.
ID_NAMES = ("id", "identifier", "uuid", "guid", "key", "uid")
ROOT_WEIGHTS = {"several": 0.25, "repeated": 0.35, "children": 0.15, "identifier": 0.2, "below_the_root": 0.05}
LEAST_ROOT_SCORE = 0.4
PATH_WEIGHT, ATTRIBUTE_WEIGHT = 0.8, 0.2
PAIR_BLOCK = 1000


def depth_of(path: str) -> int:
    return path.count("/") - 1


def named_like_id(name: Column) -> Column:
    """Whether an expanded name's local part is an identifier's."""
    local = F.replace(F.lower(F.trim(F.regexp_replace(name, r"^\{[^}]*\}", ""))), F.lit("-"), F.lit("_"))
    return local.isin(*ID_NAMES) | local.endswith("_id")


# ---------------------------------------------------------------- structure

def path_profile(nodes: DataFrame) -> DataFrame:
    """Each path's occurrences, cardinality below its parents, text, and whether it repeats, is optional or a leaf."""
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    # nodes by their number among equal siblings: of the parents with a k-th, those without a next one have just k
    at = nodes.filter("error IS NULL").groupBy("path", "occurrence").agg(F.count("*").alias("c"), F.count_if(F.col("parent_id").isNotNull()).alias("below"), F.count_if(has).alias("t"), F.max((~F.col("leaf")).cast("int")).alias("inner"))
    at = at.withColumn("next", F.coalesce(F.lead("c").over(W.partitionBy("path").orderBy("occurrence")), F.lit(0)))
    number, first = (F.col("occurrence") + 1).cast("long"), F.col("occurrence") == 0
    by = at.groupBy("path").agg(
        F.sum("c").alias("occurrences"), F.sum(F.when(first, F.col("below")).otherwise(0)).alias("parents_with"), F.min(F.when(F.col("c") > F.col("next"), number)).alias("least"), F.max(number).alias("most"),
        (F.sum("c") / F.sum(F.when(first, F.col("c")))).alias("mean"), F.sum("t").alias("with_text"), F.max("inner").alias("inner"),
    ).withColumn("parent_path", F.regexp_replace("path", "/[^/]*$", ""))
    by = materialize(by, "paths")
    total = by.select(F.col("path").alias("parent_path"), F.col("occurrences").alias("parents"))
    full = by.join(total, "parent_path", "left")
    optional = F.coalesce(F.col("parents_with") < F.col("parents"), F.lit(False))
    return full.select(
        "path", "parent_path", "occurrences", "parents_with", F.when(optional, 0).otherwise(F.col("least")).alias("min_per_parent"), F.col("most").alias("max_per_parent"), F.col("mean").alias("mean_per_parent"),
        (F.col("most") > 1).alias("repeated"), optional.alias("optional"), "with_text", (F.col("inner") == 0).alias("leaf"),
    )


def attribute_profile(nodes: DataFrame) -> DataFrame:
    own = nodes.filter("error IS NULL")
    total = own.groupBy("path").agg(F.count("*").alias("elements"))
    each = own.select("path", F.explode("attributes").alias("name", "value")).groupBy("path", "name").agg(F.count("*").alias("present"), F.count_distinct("value").alias("distinct_values"))
    full = each.join(total, "path").withColumn("presence", F.col("present") / F.col("elements"))
    return full.withColumn("likely_id", named_like_id(F.col("name")) & (F.col("presence") >= 0.8) & (F.col("distinct_values") / F.col("present") >= 0.95))


def text_identifiers(nodes: DataFrame) -> DataFrame:
    """``path, presence, distinct_rate, likely_id``: elements whose own text may identify them, by name, presence and distinct values."""
    own = nodes.filter("error IS NULL").select("path", "tag", F.trim(F.coalesce("text", F.lit(""))).alias("t"))
    by = own.groupBy("path", "tag").agg(F.count("*").alias("n"), F.count_if(F.col("t") != "").alias("some"), F.count_distinct(F.when(F.col("t") != "", F.col("t"))).alias("u"))
    presence, distinct = F.col("some") / F.col("n"), F.coalesce(F.try_divide("u", "some"), F.lit(0.0))
    return by.select("path", presence.alias("presence"), distinct.alias("distinct_rate"), (named_like_id(F.col("tag")) & (presence >= 0.8) & (distinct >= 0.95)).alias("likely_id"))


def namespace_inventory(declared: DataFrame) -> DataFrame:
    """``uri, prefix, sources``: each namespace with its preferred prefix (the one of most sources, then the smallest), from ``source_file, prefix, uri``."""
    by = declared.filter("uri <> ''").groupBy("uri", "prefix").agg(F.count_distinct("source_file").alias("sources"))
    return by.groupBy("uri").agg(F.min_by("prefix", F.struct(-F.col("sources"), "prefix")).alias("prefix"), F.max("sources").alias("sources"))


def display_paths(paths: DataFrame, spaces: DataFrame) -> DataFrame:
    """Add ``display`` to rows with a canonical ``path``: each step by its preferred prefix, or its local name alone."""
    steps = paths.select("path").distinct().select("path", F.posexplode(F.slice(F.split("path", "/"), 2, 1_000)).alias("at", "step"))
    plain = F.replace(F.replace(F.col("step"), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    steps = steps.withColumn("uri", F.regexp_extract(plain, r"^\{([^}]*)\}", 1)).withColumn("local", F.regexp_replace(plain, r"^\{[^}]*\}", ""))
    named = steps.join(spaces.select("uri", "prefix"), "uri", "left")
    shown = F.when(F.coalesce("prefix", F.lit("")) != "", F.concat_ws(":", "prefix", "local")).otherwise(F.col("local"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("s")))), lambda x: x["s"])
    return paths.join(named.groupBy("path").agg(F.concat(F.lit("/"), F.array_join(ordered, "/")).alias("display")), "path")


def record_candidates(nodes: DataFrame) -> DataFrame:
    """Paths scored as record roots, from LEAST_ROOT_SCORE: they occur several times below the document root, and may repeat, have children, or have an id (an attribute, or a child's text)."""
    paths = path_profile(nodes)
    kids = paths.groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("kids"))
    named = attribute_profile(nodes).filter("likely_id").select("path")
    by_child = text_identifiers(nodes).filter("likely_id").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    ids = named.unionByName(by_child).distinct().withColumn("has_id", F.lit(True))
    full = paths.filter((F.col("parent_path") != "") & (F.col("occurrences") >= 2)).join(kids, "path", "left").join(ids, "path", "left")
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), ROOT_WEIGHTS[w]).otherwise(0.0)
    score = ROOT_WEIGHTS["several"] + ROOT_WEIGHTS["below_the_root"] + yes(F.col("repeated"), "repeated") + yes(F.col("kids") > 0, "children") + yes(F.col("has_id"), "identifier")
    return full.select("path", "occurrences", F.round(score, 3).alias("score")).filter(F.col("score") >= LEAST_ROOT_SCORE)


def structure_summary(nodes: DataFrame) -> DataFrame:
    p = path_profile(nodes)
    flag = lambda c: F.sum(F.col(c).cast("long"))
    return p.agg(F.sum("occurrences").alias("elements"), F.count("*").alias("paths"), F.max(F.size(F.split("path", "/")) - 1).alias("depth"), flag("leaf").alias("leaf_paths"), flag("repeated").alias("repeated_paths"), flag("optional").alias("optional_paths"))


def hierarchy(nodes: DataFrame) -> DataFrame:
    return path_profile(nodes).select("path", F.nullif("parent_path", F.lit("")).alias("parent_path"), F.regexp_extract("path", "([^/]*)$", 1).alias("label"))


def source_shapes(nodes: DataFrame) -> DataFrame:
    """``source_file, path, attributes, repeated, optional, has_text, mixed, root_candidate`` of each path of each source by itself."""
    own = nodes.filter("error IS NULL")
    keys = ["source_file", "path"]
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    names = own.select(*keys, F.explode(F.map_keys("attributes")).alias("name")).groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("attributes"))
    by = own.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.count_if((F.col("occurrence") == 0) & F.col("parent_id").isNotNull()).alias("parents_with"), (F.max("occurrence") + 1).cast("long").alias("most"),
        F.bool_or(filled("text")).alias("has_text"), F.bool_or(filled("text") & ~F.col("leaf")).alias("m"), F.bool_or(~F.col("leaf")).alias("inner"),
    ).withColumn("parent_path", F.regexp_replace("path", "/[^/]*$", ""))
    by = materialize(by, "paths")
    above = by.select("source_file", F.col("path").alias("parent_path"), F.col("occurrences").alias("parents"))
    # text between children makes their parent mixed
    tails = own.filter(filled("tail")).select("source_file", F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().withColumn("tail", F.lit(True))
    ids = own.select(*keys, F.explode("attributes").alias("name", "value")).filter(named_like_id(F.col("name"))).groupBy(*keys, "name").agg(F.count("*").alias("present"), F.count_distinct("value").alias("u"))
    ids = ids.filter(F.col("u") / F.col("present") >= 0.95).groupBy(*keys).agg(F.max("present").alias("id_present"))
    texts = own.filter(filled("text") & named_like_id(F.col("tag"))).groupBy(*keys).agg(F.count("*").alias("some"), F.count_distinct(F.trim("text")).alias("u"))
    texts = texts.join(by.select(*keys, "occurrences"), keys).filter((F.col("some") / F.col("occurrences") >= 0.8) & (F.col("u") / F.col("some") >= 0.95))
    texts = texts.select("source_file", F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().withColumn("child_id", F.lit(True))
    full = by.join(above, ["source_file", "parent_path"], "left").join(names, keys, "left").join(tails, keys, "left").join(ids, keys, "left").join(texts, keys, "left")
    has_id = F.coalesce(F.col("id_present") / F.col("occurrences") >= 0.8, F.lit(False)) | F.coalesce("child_id", F.lit(False))
    score = ROOT_WEIGHTS["several"] + ROOT_WEIGHTS["below_the_root"] + F.when(F.col("most") > 1, ROOT_WEIGHTS["repeated"]).otherwise(0) + F.when(F.col("inner"), ROOT_WEIGHTS["children"]).otherwise(0) + F.when(has_id, ROOT_WEIGHTS["identifier"]).otherwise(0)
    candidate = (F.col("parent_path") != "") & (F.col("occurrences") >= 2) & (F.round(score, 3) >= LEAST_ROOT_SCORE)
    return full.select(
        *keys, "parent_path", F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"), (F.col("parents_with") > 0).__and__(F.col("most") > 1).alias("repeated"),
        F.coalesce(F.col("parents_with") < F.col("parents"), F.lit(False)).alias("optional"), "has_text", (F.col("m") | F.coalesce("tail", F.lit(False))).alias("mixed"), candidate.alias("root_candidate"),
    )


def _fingerprints(shapes: DataFrame) -> DataFrame:
    """``source_file, shape, root``: a hash of all that the similarity of two sources depends on, and the document root."""
    features = F.array_sort(F.collect_list(F.struct("path", "attributes", "repeated", "optional", "has_text", "mixed", "root_candidate")))
    return shapes.groupBy("source_file").agg(F.sha2(F.to_json(features), 256).alias("shape"), F.max(F.when(F.col("parent_path") == "", F.col("path"))).alias("root"))


def shape_fingerprint(nodes: DataFrame) -> DataFrame:
    """``source_file, shape``: sources of one structure share a hash of their paths, attributes, cardinalities, texts and mixed content."""
    return _fingerprints(source_shapes(nodes)).select("source_file", "shape")


def shape_members(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (``source_file, representative``) and the rows of ``source_shapes`` of the representatives: the first source of each shape."""
    shapes = materialize(source_shapes(nodes), "shapes")
    prints = materialize(_fingerprints(shapes), "fingerprints")
    heads = prints.groupBy("shape").agg(F.min("source_file").alias("representative"))
    return prints.join(heads, "shape").select("source_file", "representative"), shapes.join(heads.select(F.col("representative").alias("source_file")), "source_file", "left_semi")


def all_pairs(sources: DataFrame, carried: tuple = ()) -> DataFrame:
    """``left, right`` for each two of ``source_file``, in order, with both sides' ``carried`` columns: the matrix that is asked for, by an equi join on two blocks of PAIR_BLOCK sources, so no pair is shuffled."""
    placed = numbered(sources.select("source_file", *carried).distinct(), ["source_file"], "place")
    placed = materialize(placed.withColumn("block", F.floor((F.col("place") - 1) / PAIR_BLOCK)), "placed")
    last = placed.agg(F.max("block")).first()[0] or 0
    side = lambda s: [F.col("source_file").alias(s), F.col("place").alias(f"_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in carried]]
    left = placed.select(*side("left"), F.col("block").alias("lb"), F.explode(F.sequence("block", F.lit(last).cast("long"))).alias("rb"))
    right = placed.select(*side("right"), F.col("block").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("lb"))
    tasks = min(1024, (last + 1) * (last + 2) // 2)  # by number: the work isn't in the bytes
    left, right = left.repartition(tasks, "lb", "rb"), right.repartition(tasks, "lb", "rb")
    return left.join(right, ["lb", "rb"]).filter(F.col("_left") < F.col("_right")).select("left", "right", *[f"{s}_{c}" for c in carried for s in ("left", "right")])


def shape_similarity(shapes: DataFrame) -> DataFrame:
    """``left, right, path_jaccard, attribute_jaccard, similarity, classification, reason`` of each two sources of ``source_shapes``.

    Similarity only describes. What decides, in this order: different document
    roots are ``incompatible``; equal shapes are ``exact``; shared paths of which
    one side has mixed content, then shared paths that repeat on one side only, or
    no shared record root, ask for ``review_required``; all else is a
    ``compatible_variant_candidate``, as absent paths and attributes become nulls.
    """
    prints = _fingerprints(shapes)
    a, b = shapes.alias("a"), shapes.alias("b")
    met = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.source_file") < F.col("b.source_file")))
    differ = lambda c: F.sum((F.col(f"a.{c}") != F.col(f"b.{c}")).cast("long"))
    shared = met.groupBy(F.col("a.source_file").alias("left"), F.col("b.source_file").alias("right")).agg(
        F.count("*").alias("paths"), F.sum(F.size(F.array_intersect("a.attributes", "b.attributes"))).alias("names"), differ("mixed").alias("mixed"), differ("repeated").alias("cardinality"),
        F.sum((F.col("a.root_candidate") & F.col("b.root_candidate")).cast("long")).alias("roots"),
    )
    sizes = shapes.groupBy("source_file").agg(F.count("*").alias("paths"), F.sum(F.size("attributes")).alias("names")).join(prints, "source_file")
    side = lambda s: sizes.select(F.col("source_file").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("paths", "names", "shape", "root")])
    full = all_pairs(shapes).join(side("left"), "left").join(side("right"), "right").join(shared, ["left", "right"], "left").fillna(0, ["paths", "names", "mixed", "cardinality", "roots"])
    jaccard = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"left_{c}") + F.col(f"right_{c}") - F.col(c)), F.lit(1.0))
    full = full.withColumn("path_jaccard", jaccard("paths")).withColumn("attribute_jaccard", jaccard("names"))
    reason = (
        F.when(F.col("left_root") != F.col("right_root"), "different_expanded_root_qname").when(F.col("left_shape") == F.col("right_shape"), "identical_structural_fingerprint")
        .when(F.col("mixed") > 0, "mixed_content_shape_differs").when(F.col("cardinality") > 0, "observed_cardinality_differs")
        .when(F.col("roots") == 0, "no_shared_record_root_evidence").otherwise("null_tolerant_shared_record_root")
    )
    kind = F.when(F.col("reason") == "different_expanded_root_qname", "incompatible").when(F.col("reason") == "identical_structural_fingerprint", "exact").when(F.col("reason") == "null_tolerant_shared_record_root", "compatible_variant_candidate").otherwise("review_required")
    similarity = F.round(PATH_WEIGHT * F.col("path_jaccard") + ATTRIBUTE_WEIGHT * F.col("attribute_jaccard"), 6)
    return full.withColumn("reason", reason).select("left", "right", "path_jaccard", "attribute_jaccard", similarity.alias("similarity"), kind.alias("classification"), "reason")


def pair_similarity(nodes: DataFrame) -> DataFrame:
    """``shape_similarity`` of each two sources of a collection: found for each two shapes, and given to all pairs of their sources."""
    members, shapes = shape_members(nodes)
    members, own = materialize(members, "members"), shape_similarity(shapes)
    turned = own.select(F.col("right").alias("left"), F.col("left").alias("right"), *own.columns[2:])
    same = members.select(F.col("representative").alias("left")).distinct().select("left", F.col("left").alias("right"), *[F.lit(1.0).alias(c) for c in own.columns[2:5]], F.lit("exact").alias("classification"), F.lit("identical_structural_fingerprint").alias("reason"))
    heads = materialize(numbered(members.select("representative").distinct(), ["representative"], "shape"), "heads")
    shapes = heads.count()
    both = F.col("left_shape") * F.lit(shapes + 1) + F.col("right_shape")
    head = lambda s: heads.select(F.col("representative").alias(s), F.col("shape").alias(f"{s}_shape"))
    known = own.unionByName(turned).unionByName(same).join(head("left"), "left").join(head("right"), "right")
    known = materialize(known.select(both.alias("_shapes"), *own.columns[2:]), "similarities")
    known = F.broadcast(known) if shapes * shapes <= 100_000 else known  # a checked size, else as many pairs of shapes as of sources
    pairs = all_pairs(members.join(heads, "representative"), ("shape",))
    return pairs.withColumn("_shapes", both).join(known, "_shapes").select("left", "right", *own.columns[2:])


def observed_union(nodes: DataFrame) -> DataFrame:
    """Each path's sources and occurrences over a collection, and whether some source lacks it."""
    own = nodes.filter("error IS NULL")
    total = own.agg(F.count_distinct("source_file")).first()[0]
    return own.groupBy("path").agg(F.count_distinct("source_file").alias("present_sources"), F.count("*").alias("occurrences")).select("path", "present_sources", (F.lit(total) - F.col("present_sources")).alias("missing_sources"), "occurrences", (F.col("present_sources") < total).alias("optional"))


# ---------------------------------------------------------------- records

def field_value(field: str) -> tuple[str, Column]:
    """A field's path and its value on a node there; nil is missing, and an element's empty text stays empty."""
    kind, _, rest = field.partition(":")
    if kind == "text":
        return rest, F.when(~F.col("nil"), F.coalesce("text", F.lit("")))
    path, _, name = rest.rpartition("@")
    return path, F.try_element_at("attributes", F.lit(name))


def _below(nodes: DataFrame, root: str, paths: list[str] | None = None) -> DataFrame:
    """The nodes of all records with their ``record``; with ``paths`` only the records' roots and what lies there."""
    own = nodes.filter(F.col("error").isNull() & ((F.col("path") == root) | F.col("path").startswith(root + "/")))
    if paths is not None:
        own = own.filter(F.col("path").isin(root, *paths))
    return own.withColumn("record", F.try_element_at("ancestors", F.lit(depth_of(root) + 1)))


def records(nodes: DataFrame, root: str) -> DataFrame:
    return nodes.filter(F.col("error").isNull() & (F.col("path") == root)).select("source_file", F.col("node_id").alias("record"))


def extract(nodes: DataFrame, root: str, fields: dict[str, str], rules: dict[str, dict] | None = None) -> DataFrame:
    """One row for each record: ``source_file, record`` and a column for each of ``fields`` (name: field id).

    ``rules`` give a column's strategy where its branch repeats: ``first`` (also
    the rule for direct fields), ``last``, ``count`` (of the elements), ``join``
    (with ``delimiter``), ``aggregate`` (``sum mean min max``; other than numbers
    are ignored) or ``nested`` (all values in order). The strategies that change
    rows have functions of their own.
    """
    rules, aggregates = rules or {}, []
    for name, field in fields.items():
        rule = rules.get(name, {"strategy": "first"})
        path, value = field_value(field)
        here = F.col("path") == path
        v = F.when(here, value)
        at = F.when(v.isNotNull(), F.col("node_id"))
        every = F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("node_id", v.alias("v"))))), lambda x: x["v"])
        kind = rule["strategy"]
        if kind in ("first", "last"):
            out = (F.min_by if kind == "first" else F.max_by)(v, at)
        elif kind == "count":
            out = F.sum(here.cast("long"))
        elif kind == "join":
            out = F.array_join(every, rule.get("delimiter", "; "))
        elif kind == "aggregate":
            out = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[rule["function"]](v.try_cast("double"))
        elif kind == "nested":
            out = every
        else:
            raise ValueError(f"unknown strategy {kind}")
        aggregates.append(out.alias(name))
    return _below(nodes, root, [field_value(f)[0] for f in fields.values()]).groupBy("source_file", "record").agg(*aggregates)


def branch_rows(nodes: DataFrame, root: str, branch: str, fields: dict[str, str]) -> DataFrame:
    """A child table: one row for each occurrence of a repeated branch, with its record and the first value of each field."""
    below = _below(nodes, root, [branch, *[field_value(f)[0] for f in fields.values()]]).filter((F.col("path") == branch) | F.col("path").startswith(branch + "/"))
    below = below.withColumn("occurrence", F.try_element_at("ancestors", F.lit(depth_of(branch) + 1)))
    picks = []
    for name, field in fields.items():
        path, value = field_value(field)
        v = F.when(F.col("path") == path, value)
        picks.append(F.min_by(v, F.when(v.isNotNull(), F.col("node_id"))).alias(name))
    return below.groupBy("source_file", "record", "occurrence").agg(*picks)


def explode_rows(nodes: DataFrame, root: str, fields: dict[str, str], branch: str, branch_fields: dict[str, str]) -> DataFrame:
    """One row for each occurrence of the branch; records without any keep one row."""
    return extract(nodes, root, fields).join(branch_rows(nodes, root, branch, branch_fields), ["source_file", "record"], "left")


def pivot_branch(nodes: DataFrame, root: str, branch: str, key: str, value: str, keys: list[str]) -> DataFrame:
    """A column for each key of the branch; of equal keys in a record the last value stays."""
    rows = branch_rows(nodes, root, branch, {"_k": key, "_v": value}).filter("_k IS NOT NULL")
    wide = rows.groupBy("source_file", "record").pivot("_k", keys).agg(F.max_by("_v", "occurrence"))
    return records(nodes, root).join(wide, ["source_file", "record"], "left")


def null_reasons(nodes: DataFrame, root: str, fields: dict[str, str]) -> DataFrame:
    """``source_file, record, field, status``: value, empty_element, explicit_xsi_nil, path_absent, attribute_absent or multiple.

    Where a field occurs several times in a record, a reason holds only if it is
    that of all occurrences; ``multiple`` are those that disagree or have values.
    """
    parts, below = [], _below(nodes, root, [field_value(f)[0] for f in fields.values()])
    for name, field in fields.items():
        path, _ = field_value(field)
        here = F.col("path") == path
        n = F.count_if(here)
        if field.startswith("attribute:"):
            without = F.count_if(here & ~F.map_contains_key("attributes", F.lit(field.rpartition("@")[2])))
            status = F.when(n == 0, "path_absent").when(without == n, "attribute_absent")
        else:
            blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
            status = F.when(n == 0, "path_absent").when(F.count_if(here & F.col("nil")) == n, "explicit_xsi_nil").when(F.count_if(here & ~F.col("nil") & blank) == n, "empty_element")
        parts.append(F.struct(F.lit(name).alias("field"), status.when(n > 1, "multiple").otherwise("value").alias("status")))
    found = below.groupBy("source_file", "record").agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)])
    return found.select("source_file", "record", F.explode(F.array(*[f"s{i}" for i in range(len(parts))])).alias("s")).select("source_file", "record", "s.*")


def comments(reasons: DataFrame) -> DataFrame:
    """``Comments``: a JSON object of the missing fields' reasons for each record, or NULL."""
    missing = reasons.filter(~F.col("status").isin("value", "multiple"))
    return missing.groupBy("source_file", "record").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "status"))))).alias("Comments"))


def encode_null(c: Column) -> Column:
    r"""NULL as ``\N``, empty text as ``\E``, and a leading backslash doubled."""
    return F.when(c.isNull(), "\\N").when(c == "", "\\E").when(c.startswith("\\"), F.concat(F.lit("\\"), c)).otherwise(c)


def decode_null(c: Column) -> Column:
    return F.when(c == "\\N", F.lit(None).cast("string")).when(c == "\\E", "").when(c.startswith("\\\\"), F.substring(c, F.lit(2), F.length(c))).otherwise(c)


def occurrences(nodes: DataFrame) -> DataFrame:
    """Each node's number among its siblings of the same name."""
    return nodes.filter("error IS NULL").withColumn("occurrence", F.row_number().over(W.partitionBy("source_file", "parent_id", "tag").orderBy("node_id")))
