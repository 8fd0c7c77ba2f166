"""Personal data by patterns, and the terms that give it away.

Patterns find protected entities: e-mail and IP addresses, card and phone
numbers. A term that stands in the same texts may name one as surely as its own
text, so the corpus is asked how much each term tells, about each entity and
about the groups it belongs to: the domain and the local part of an address, an
IP network, a card's issuer, a phone number's country and area. With ``M`` texts,
``n_t`` that hold the term, ``n_e`` that hold the entity and ``n_te`` that hold
both, whoever reads the term expects the entity with probability
(n_te + prior n_e / M) / (n_t + prior): what was counted, drawn towards what is
expected of any text, so that a word met once tells less than one met often. The
information that the term gives, log2 of this over n_e / M, is set against
what there is to know, log2(M / n_e). From ``generalise_at`` of it a term is
replaced by a general word, from ``remove_at`` it is removed, wherever it stands.

Counts are over whole texts. Only terms are paired with entities that stand
mostly in texts with some entity: a term's expectation of one entity is never
above that of any, so no pair that passes is lost. Exact copies are paired once,
and count as often as they occur.

Only DataFrame expressions are used. A pattern's matches are found by marking
them with two private-use characters and splitting at these, which gives their
places in code points. Counts are combined before each shuffle. No text is
shuffled, unless the texts with telling terms are too many to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.shared import Scratch

OPEN, CLOSE = "\ue000", "\ue001"
KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the patterns: they match the same, without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": "[REMOVED]"}
_SPAN = "struct<start:int,end:int,text:string>"


@dataclass
class DisclosureParameters:
    least_length: int = 4  # letters and digits of a term
    prior: float = 1.0  # texts that count as if they held a term, and entities as any text does
    least_expected: float = 0.6  # probability of an entity, given a term, from which the term tells of it
    generalise_at: float = 0.8
    remove_at: float = 0.9
    broadcast_rows: int = 100_000  # of terms, or of texts that hold some: beyond, they are joined by shuffles


def _quoted(pattern: str) -> str:
    """A pattern as an SQL literal."""
    pattern = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{pattern}'"


def _matches(text: str, pattern: str) -> str:
    """SQL for an array of ``start, end, text`` of the matches in a text that holds neither mark; ``pattern`` is SQL, too.

    Matches are handled a thousand at a time, so that the time for a text grows
    with its matches and not with their square.
    """
    marked = f"split(regexp_replace({text}, {pattern}, '{OPEN}$0{CLOSE}'), '{OPEN}')"
    found = f"struct(a.pos AS start, a.pos + length(substring_index(m, '{CLOSE}', 1)) AS end, substring_index(m, '{CLOSE}', 1) AS text)"
    chunk = f"aggregate(z.parts, struct(z.at AS pos, CAST(array() AS array<{_SPAN}>) AS found), (a, m) -> struct(a.pos + length(m) - 1 AS pos, concat(a.found, array({found})) AS found), a -> a.found)"
    parts = "transform(sequence(1, greatest(size(p), 1), 1000), i -> slice(p, i + 1, 1000))"
    sizes = "transform(parts, c -> aggregate(c, 0, (a, m) -> a + length(m) - 1))"
    starts = "slice(aggregate(sizes, array(length(p[0])), (a, n) -> concat(a, array(element_at(a, -1) + n))), 1, size(sizes))"
    # each transform(array(x), y -> ...)[0] names x as y
    body = f"flatten(transform(arrays_zip(parts, at), z -> {chunk}))"
    named = f"transform(array({parts}), parts -> transform(array({sizes}), sizes -> transform(array({starts}), at -> {body})[0])[0])[0]"
    return f"transform(array({marked}), p -> {named})[0]"


def _luhn(digits: str) -> str:
    digit = f"CAST(substring({digits}, length({digits}) - i + 1, 1) AS int)"
    double = f"(2 * {digit} - IF({digit} > 4, 9, 0))"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + IF(i % 2 = 0, {double}, {digit})) % 10 = 0"


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return f"{m} RLIKE '^{_BYTE}(?:[.]{_BYTE}){{3}}$'"
    if kind == "card":
        digits = f"regexp_replace({m}, '[ -]', '')"
        return f"length({digits}) BETWEEN 16 AND 19 AND {_luhn(digits)}"
    if kind == "phone":
        return f"length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 8 AND 15"
    return "true"


def plain(text: Column) -> Column:
    """A text that is never null and holds no mark; each code point keeps its place."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, "\ufffd\ufffd")).otherwise(text)


def may_hold(text: str) -> Column:
    """Whether a text has a match of any pattern, before digits are checked."""
    c = F.col(text)
    return (F.contains(c, F.lit("@")) & c.rlike(PATTERNS["email"])) | (F.contains(c, F.lit("+")) & c.rlike(PATTERNS["phone"])) | c.rlike(PATTERNS["ip"]) | c.rlike(PATTERNS["card"])


def find_entities(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Add one array of ``start, end, text`` for each of KINDS; ``text`` must be ``plain``."""
    out = docs
    for kind in KINDS:
        array = F.expr(f"filter({_matches(text, _quoted(PATTERNS[kind]))}, x -> {_valid(kind, 'x.text')})")
        sign = {"email": "@", "phone": "+"}.get(kind)
        empty = F.expr(f"CAST(array() AS array<{_SPAN}>)")
        out = out.withColumn(kind, F.when(F.contains(F.col(text), F.lit(sign)) if sign else F.col(text).rlike(PATTERNS[kind]), array).otherwise(empty))
    return out


_EDGE = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])")


#: Keys of an entity, by kind: SQL of its text x.text; a group's key is null where it has none.
GROUPS = {
    "email": ("concat('local:', substring_index(lower(x.text), '@', 1))", "concat('domain:', substring_index(lower(x.text), '@', -1))"),
    "ip": ("concat('net:', substring_index(x.text, '.', 3))",),
    "card": ("concat('issuer:', left(regexp_replace(x.text, '[ -]', ''), 6))",),
    "phone": ("concat('country:', regexp_extract(x.text, '^[+][0-9]{1,3}', 0))", "concat('area:', left(regexp_replace(x.text, '[^0-9]', ''), 5))"),
}


def _keys(kind: str) -> str:
    own = ", ".join((f"concat('{kind}:', lower(x.text))", *GROUPS[kind]))
    return f"flatten(transform({kind}, x -> array({own})))"


def _terms(text: Column, p: DisclosureParameters) -> Column:
    """The distinct runs of letters and digits of a text, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda x: F.length(x) >= p.least_length)


def _masked(text: str) -> Column:
    """A text with a blank line in place of each entity; where they overlap, of all that they cover."""
    spans = ", ".join(f"transform({k}, x -> struct(x.start AS start, x.end AS end))" for k in KINDS)
    fold = f"aggregate(array_sort(concat({spans})), struct(0 AS pos, '' AS out), (a, s) -> struct(greatest(a.pos, s.end) AS pos, IF(s.start > a.pos, concat(a.out, substring({text}, a.pos + 1, s.start - a.pos), '\n'), concat(a.out, '\n')) AS out), a -> concat(a.out, substring({text}, a.pos + 1)))"
    return F.expr(fold)


def _small(table: DataFrame, p: DisclosureParameters) -> DataFrame:
    """A table to join to, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(table) if table.count() <= p.broadcast_rows else table


def _disclosing(found: DataFrame, clear: DataFrame, p: DisclosureParameters, scratch: Scratch) -> DataFrame:
    """``entity, term, action``: the pairs whose information passes a threshold; reads tables of ``scratch``.

    ``found``: ``of, words, keys`` of the texts with entities; ``clear``: ``words`` of the others.
    """
    texts = found.groupBy("of").agg(F.count("*").alias("m"), F.any_value("keys").alias("keys"), F.any_value("words").alias("words"))
    texts = scratch.store(texts.select("m", "keys", "words"), "texts")
    total = float((texts.agg(F.sum("m")).first()[0] or 0) + clear.count())
    beside = texts.select(F.explode("words").alias("term"), F.col("m").alias("n_near"), F.col("m").alias("n"))
    alone = clear.select(F.explode("words").alias("term"), F.lit(0).cast("long").alias("n_near"), F.lit(1).cast("long").alias("n"))
    counted = beside.unionByName(alone).groupBy("term").agg(F.sum("n_near").alias("n_near"), F.sum("n").alias("n_t"))
    # no entity is expected more than in as many of the term's texts as hold any, nor more than always
    telling = counted.filter("n_near > 0").filter((F.col("n_near") + p.prior) / (F.col("n_t") + p.prior) >= p.least_expected).select("term", "n_t")
    telling = scratch.store(telling, "terms")
    entities = texts.select(F.explode("keys").alias("entity"), "m").groupBy("entity").agg(F.sum("m").alias("n_e"))
    held = texts.select("keys", "m", F.explode("words").alias("term")).join(_small(telling, p), "term")
    pairs = held.select(F.explode("keys").alias("entity"), "term", "n_t", "m").groupBy("entity", "term").agg(F.sum("m").alias("n_te"), F.max("n_t").alias("n_t"))
    # the same bound for each pair, before entities are looked up
    pairs = pairs.filter((F.col("n_te") + p.prior) / (F.col("n_t") + p.prior) >= p.least_expected)
    among = F.col("n_e") / F.lit(total)
    expected = (F.col("n_te") + p.prior * among) / (F.col("n_t") + p.prior)
    known = -F.log2(among)
    share = F.when(known > 0, F.log2(expected / among) / known)
    action = F.when(share >= p.remove_at, "remove").when(share >= p.generalise_at, "generalise")
    return pairs.join(entities, "entity").filter(expected >= p.least_expected).select("entity", "term", action.alias("action")).filter("action IS NOT NULL")


def inspect_texts(docs: DataFrame, parameters: DisclosureParameters | None = None) -> DataFrame:
    """All rows of ``docs``, with what was found in each text.

    All columns of ``docs`` stay, below ``own``; ``_text`` is the text inspected,
    ``email, ip, card, phone`` are arrays of ``start, end, text``, and ``terms``
    an array of ``start, end, action`` in order.
    """
    p = parameters or DisclosureParameters()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), plain(F.col("text")).alias("_text"), F.xxhash64("text").alias("of"), F.coalesce(may_hold("text"), F.lit(False)).alias("may"))
    keys = F.expr(f"array_distinct(concat({', '.join(_keys(k) for k in KINDS)}))")
    found = find_entities(own.filter("may")).withColumn("keys", keys)
    result, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)  # what the result reads, and what goes again
    found = result.store(found.withColumn("words", _terms(F.when(F.size("keys") > 0, _masked("_text")).otherwise(F.col("_text")), p)), "entities")
    private = F.size("keys") > 0
    rest = scratch.store(own.filter("NOT may").select("of", _terms(F.col("_text"), p).alias("words")), "words")
    clear = found.filter(~private).select("of", "words").unionByName(rest)
    # a term that tells of several entities gets the strongest action: "remove" sorts last
    pairs = _disclosing(found.filter(private).select("of", "words", "keys"), clear, p, scratch)
    telling = scratch.store(pairs.groupBy("term").agg(F.max("action").alias("action")), "telling")
    held = found.select("of", "words").unionByName(rest).select("of", F.explode("words").alias("term")).join(_small(telling, p), "term").groupBy("of").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("told"))
    held = _small(result.store(held, "held"), p)
    scratch.drop_all()
    none = [F.expr(f"CAST(array() AS array<{_SPAN}>)").alias(k) for k in KINDS]
    columns = ["own", "_text", "of", *KINDS]
    every = found.select(*columns).unionByName(own.filter("NOT may").select("own", "_text", "of", *none)).join(held, "of", "left")
    inside = " OR ".join(f"exists({k}, x -> x.start < m.end AND x.end > m.start)" for k in KINDS)
    # only the terms that a text holds are looked for in it
    these = f"concat({_quoted('(?iu)' + _EDGE[0] + '(?:')}, array_join(map_keys(told), '|'), {_quoted(')' + _EDGE[1])})"
    terms = f"transform(filter({_matches('_text', these)}, m -> map_contains_key(told, lower(m.text)) AND NOT ({inside})), m -> struct(m.start AS start, m.end AS end, told[lower(m.text)] AS action))"
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,action:string>>)")
    return every.select("own", "_text", *KINDS, F.when(F.col("told").isNotNull(), F.expr(terms)).otherwise(empty).alias("terms"))


def _listed(kind: str, array: str) -> Column:
    return F.transform(array, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def report(docs: DataFrame, parameters: DisclosureParameters | None = None) -> DataFrame:
    """What each text holds: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) of all patterns'
    matches by kind and place, then of the terms (kind ``term``); the hash covers
    the patterns' part. Null texts count as empty, and hold nothing. Repeated rows
    and null ids give a row each. An empty table gives an empty result. Texts are
    read whole.
    """
    found = inspect_texts(docs, parameters)
    base = F.array_join(F.concat(*[_listed(k, k) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[_listed(k, k) for k in KINDS], _listed("term", "terms")), ",")
    return found.select(F.col("own.doc_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame, parameters: DisclosureParameters | None = None) -> DataFrame:
    """``docs`` with personal data and telling terms replaced by LABELS in ``text``.

    Where spans overlap, the one that starts first (then the longer) is replaced.
    ``n_chars``, if there is such a column, is counted anew for changed texts. Rows
    without personal data and telling terms stay exactly as they are; so do null texts.
    """
    found = inspect_texts(docs, parameters)
    spans = [F.expr(f"transform({k}, x -> struct(x.start AS start, -x.end AS end, '{LABELS[k]}' AS label))") for k in KINDS]
    label = lambda x: F.when(x["action"] == "remove", LABELS["remove"]).otherwise(LABELS["generalise"])
    spans.append(F.transform("terms", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), label(x).alias("label"))))
    ordered = found.withColumn("_spans", F.array_sort(F.concat(*spans)))
    fold = "aggregate(_spans, struct(0 AS pos, '' AS out), (a, s) -> IF(s.start < a.pos, a, struct(-s.end AS pos, concat(a.out, substring(own.text, a.pos + 1, s.start - a.pos), s.label) AS out)), a -> concat(a.out, substring(own.text, a.pos + 1)))"
    changed = ordered.withColumn("_new", F.when(F.size("_spans") > 0, F.expr(fold)).otherwise(F.col("own.text")))
    columns = [F.col("_new").alias(c) if c == "text" else F.when(F.size("_spans") > 0, F.length("_new")).otherwise(F.col("own.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"own.`{c}`").alias(c) for c in docs.columns]
    return changed.select(*columns)
