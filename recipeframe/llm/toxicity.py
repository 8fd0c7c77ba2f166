"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled texts: words, and stems that stand for all
words that begin with them, which are much more frequent in toxic texts than in
clean ones. A word is looked up by running the lexicon's Levenshtein automaton
over it: the states are sets of (trie node, edits so far), made only when a word
leads to them, so a misspelling costs as much as an exact word and no list of
variants is kept. Each hit is then judged by its context window: the words before
and after it, and whether it stands inside quotation marks of its line, each with
a weight. Weights say how much more often a context is that of a clean text's hit
than hits are in general; they start from a short list of reporting words and
are moved by labelled windows. A hit whose weights add up to ``quoted_at`` counts
as quoted, any other as direct. A logistic model over these counts gives the
score. Context weights and logistic model are learned from labelled texts that
the lexicon has not seen, so that words which only happen to be rare there don't
look like evidence.

``fit_rows`` bounds the labelled rows that are used (all, if there are fewer), and
with them all that comes to the driver: the lexicon, context words, and counts of
count vectors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.shared import Scratch

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile('["“”„«»‹›\n]')
QUOTED = '"'  # stands for quotation marks among the context weights
#: Words that report what others said, for a start; fixed values.
REPORTING = frozenset("said says say called calls calling quote quoted quotes wrote writes word term slur insult reported sagte nannte schrieb wort dijo llamó palabra escribió dit appelé mot écrit".split())
FEATURES = ("word", "rare", "stem", "near", "quoted", "quoted_near")


@dataclass
class ToxicityParameters:
    fit_rows: int = 400_000
    least_texts: int = 4  # toxic texts that a word is in
    common_texts: int = 12
    stem_texts: int = 12
    stem_lengths: tuple = (4, 5, 6, 7)
    least_precision: float = 0.9
    near_length: int = 5  # shortest word that may be misspelled, by one edit
    near_two: int = 9  # by two
    window: int = 6  # words before and after a hit
    start_weight: float = 1.5  # of a reporting word and of quotation marks, before any evidence
    context_events: float = 2.0  # clean windows' worth of evidence that the start counts as
    quoted_at: float = 1.0
    l2: float = 1.0


@dataclass
class ToxicityModel:
    parameters: ToxicityParameters
    words: dict = field(default_factory=dict)  # word: toxic texts
    stems: frozenset = frozenset()
    bias: float = 0.0
    weights: tuple = (0.0,) * len(FEATURES)
    context: dict | None = None  # word of a window: weight

    def __post_init__(self):
        if self.context is None:
            self.context = dict.fromkeys([*REPORTING, QUOTED], self.parameters.start_weight)


class Automaton:
    """The Levenshtein automata of all lexicon words at once, along their trie; determinised as words need it."""

    def __init__(self, model: ToxicityModel):
        p = self.p = model.parameters
        self.next, self.accept, self.most = [{}], [""], [0]
        for word, n in sorted(model.words.items()):
            if n < p.common_texts or len(word) < p.near_length:
                continue
            node, edits = 0, self._edits(word)
            for c in word:
                self.most[node] = max(self.most[node], edits)
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.accept.append("")
                    self.most.append(0)
                node = self.next[node][c]
            self.accept[node], self.most[node] = word, max(self.most[node], edits)
        self.reset()

    def _edits(self, word: str) -> int:
        return 2 if len(word) >= self.p.near_two else 1

    def reset(self):
        start = self._close({(0, 0)})
        self.ids, self.sets, self.moves = {start: 0}, [start], [{}]

    def _close(self, states) -> frozenset:
        """Add what lies behind letters that the word leaves out; keep the fewest edits of each node."""
        fewest: dict = {}
        todo = list(states)
        while todo:
            node, edits = todo.pop()
            if edits > self.most[node] or fewest.get(node, 9) <= edits:
                continue
            fewest[node] = edits
            todo += [(k, edits + 1) for k in self.next[node].values()]
        return frozenset(fewest.items())

    def _step(self, at: int, c: str) -> int:
        moved = set()
        for node, edits in self.sets[at]:
            moved.add((node, edits + 1))  # an extra letter
            for letter, k in self.next[node].items():
                moved.add((k, edits + (letter != c)))
        states = self._close(moved)
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
        self.moves[at][c] = self.ids[states]
        return self.ids[states]

    def near(self, word: str) -> bool:
        """Whether a lexicon word is within its number of edits."""
        if len(self.sets) > 200_000:
            self.reset()
        at = 0
        for c in word:
            to = self.moves[at].get(c)
            at = self._step(at, c) if to is None else to
            if not self.sets[at]:
                return False
        return any(self.accept[node] and edits <= self._edits(self.accept[node]) for node, edits in self.sets[at])


class Matcher:
    """Looks words up, keeping what it found for the words of a task."""

    def __init__(self, model: ToxicityModel):
        self.model, self.p = model, model.parameters
        self.automaton = Automaton(model)
        self.known: set = set()  # all words looked up
        self.telling: dict = {}  # of those that hit: their kind
        self.short = min(self.p.stem_lengths, default=0)
        self.heads = {s[: self.short] for s in model.stems}

    def kind(self, word: str) -> str:
        """``word, rare, stem, near`` or an empty string."""
        n = self.model.words.get(word, 0)
        if n:
            return "word" if n >= self.p.common_texts else "rare"
        if word[: self.short] in self.heads and any(word[:k] in self.model.stems for k in self.p.stem_lengths if len(word) >= k):
            return "stem"
        return "near" if len(word) >= self.p.near_length - 1 and self.automaton.near(word) else ""

    def hits(self, text: str | None):
        """Kind and context of each hit: words of its window, and QUOTED if it stands inside quotation marks of its line."""
        lower = (text or "").lower()
        words, known = _WORD.findall(lower), self.telling
        distinct = set(words)
        new = distinct - self.known
        if new:
            if len(self.known) > 400_000:
                self.known, new = set(), distinct
                known.clear()
            self.known |= new
            known.update((w, kind) for w in new if (kind := self.kind(w)))
        if distinct.isdisjoint(known):
            return
        found = [i for i, w in enumerate(words) if w in known]
        starts = [m.start() for m in _WORD.finditer(lower)]
        marks = [m.start() for m in _MARKS.finditer(lower)]
        at, open_, reach = 0, 0, self.p.window
        for i in found:
            while at < len(marks) and marks[at] < starts[i]:
                open_ = 0 if lower[marks[at]] == "\n" else open_ + 1
                at += 1
            inside = open_ % 2 == 1 and at < len(marks) and lower[marks[at]] != "\n"  # and closed on the same line
            yield known[words[i]], words[max(0, i - reach) : i] + words[i + 1 : i + 1 + reach] + [QUOTED] * inside

    def counts(self, text: str | None) -> tuple:
        """How often each of FEATURES is in a text."""
        out, weight = dict.fromkeys(FEATURES, 0), self.model.context
        for kind, window in self.hits(text):
            if sum(weight.get(w, 0.0) for w in window) >= self.p.quoted_at:
                kind = "quoted_near" if kind == "near" else "quoted"
            out[kind] += 1
        return tuple(out[k] for k in FEATURES)


# ---------------------------------------------------------------- fitting

def _terms(batches, p: ToxicityParameters):
    """For each word and stem of a partition's labelled texts: in how many toxic and clean ones it is."""
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            keys = words | {w[:k] + "*" for w in words for k in p.stem_lengths if len(w) > k}
            (toxic if label else clean).update(keys)
            if len(toxic) + len(clean) > 1_000_000:
                yield _term_batch(toxic, clean)
                toxic, clean = Counter(), Counter()
    yield _term_batch(toxic, clean)


def _term_batch(toxic, clean) -> pa.RecordBatch:
    keys = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["term", "toxic", "clean"])


def _contexts(batches, model):
    """For each word of the windows of exact hits: the windows of toxic and of clean texts it is in; an empty word counts all."""
    matcher, toxic, clean = Matcher(model), Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for kind, window in matcher.hits(text):
                if kind == "word":
                    (toxic if label else clean).update({"", *window})
    yield _term_batch(toxic, clean)


def context_weights(counts: dict, p: ToxicityParameters) -> dict:
    """Log of how much likelier than any hit a hit with this context is a clean text's; ``counts`` is word: (toxic, clean)."""
    toxic, clean = counts.get("", (0, 0))
    rate, k = (clean + 1) / (toxic + clean + 2), p.context_events
    out = dict.fromkeys([*REPORTING, QUOTED], p.start_weight)
    for word, (t, c) in counts.items():
        if word:  # clean windows there were, against those expected of as many windows
            out[word] = math.log((c + k * math.exp(out.get(word, 0.0))) / (rate * (t + c) + k))
    return {w: x for w, x in out.items() if abs(x) >= 0.05}


def _vectors(batches, model):
    matcher, seen = Matcher(model), Counter()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[(*matcher.counts(text), int(label))] += 1
    rows = [(list(k[:-1]), k[-1], n) for k, n in seen.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["counts", "label", "n"])


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Newton's method on weighted rows; the bias isn't penalised."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), w[1:]


def _inputs(counts) -> np.ndarray:
    return np.log1p(np.asarray(counts, dtype=np.float64).reshape(-1, len(FEATURES)))


def fit(labelled: DataFrame, parameters: ToxicityParameters | None = None) -> ToxicityModel:
    """Learn from the rows of ``training_rows``: ``doc_id, text, toxic`` (0 or 1; rows with a null label are left out)."""
    p = parameters or ToxicityParameters()
    own = labelled.filter("toxic is not null").select("text", (F.col("toxic") > 0).alias("label"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)).alias("at"))
    scratch = Scratch(labelled.sparkSession)
    own = scratch.store(own, "labelled")  # at most ``fit_rows`` texts, read several times below
    first, second, rest = own.filter(F.col("at") % 6 < 4), own.filter(F.col("at") % 6 == 4), own.filter(F.col("at") % 6 > 3)
    base = first.agg(F.sum(F.col("label").cast("int")).alias("toxic"), F.count("*").alias("n")).first()
    rate = ((base["toxic"] or 0) + 0.5) / (base["n"] + 1)
    terms = first.select("text", "label").mapInArrow(lambda it: _terms(it, p), "term string, toxic long, clean long")
    terms = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    enough = F.when(F.col("term").endswith("*"), p.stem_texts).otherwise(p.least_texts)
    sure = (F.col("toxic") + rate) / (F.col("toxic") + F.col("clean") + 1)  # shrunk to the rate of toxic texts
    fine = terms.filter((F.col("toxic") >= enough) & (sure >= p.least_precision * (1 - 1 / (1 + F.col("toxic")))))
    kept = list(zip(*fine.select("term", "toxic").toArrow().to_pydict().values(), strict=True))
    words = {term: toxic for term, toxic in kept if not term.endswith("*")}
    model = ToxicityModel(p, words, frozenset(term[:-1] for term, _ in kept if term.endswith("*")))
    spark = labelled.sparkSession
    lexicon = spark.sparkContext.broadcast(model)
    seen = second.select("text", "label").mapInArrow(lambda it: _contexts(it, lexicon.value), "term string, toxic long, clean long")
    seen = seen.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow().to_pydict()
    model = replace(model, context=context_weights(dict(zip(seen["term"], zip(seen["toxic"], seen["clean"], strict=True), strict=True)), p))
    sent = spark.sparkContext.broadcast(model)
    vectors = rest.select("text", "label").mapInArrow(lambda it: _vectors(it, sent.value), "counts array<long>, label long, n long")
    table = vectors.groupBy("counts", "label").agg(F.sum("n").alias("n")).collect()
    scratch.drop(own)
    if not table:
        model.bias = float(np.log(rate / (1 - rate))) if base["n"] else -5.0
        return model
    bias, weights = _logistic(_inputs([r.counts for r in table]), np.array([r.label for r in table]), np.array([float(r.n) for r in table]), p.l2)
    model.bias, model.weights = bias, tuple(np.maximum(weights, 0.0))  # a hit never speaks for a text
    return model


# ---------------------------------------------------------------- scoring

def _scores(texts, matcher: Matcher) -> np.ndarray:
    x = _inputs([matcher.counts(t) for t in texts])
    return 1 / (1 + np.exp(-(matcher.model.bias + x @ np.array(matcher.model.weights))))


def _score_batches(batches, model):
    matcher = Matcher(model)
    for b in batches:
        score = _scores(b.column(b.num_columns - 1).to_pylist(), matcher)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*b.schema.names[:-1], "score"])


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``score`` (0 to 1) to ``doc_id`` for each row of ``docs``.

    Only the text counts. Null and empty texts have the score of a text without
    hits. Repeated rows and null ids are scored like any other; an empty table
    gives an empty result; texts are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _score_batches(it, sent.value), "doc_id long, score double")


def _keep_calm(batches, model, text, limit):
    matcher = Matcher(model)
    for b in batches:
        yield b.filter(pa.array(_scores(b.column(text).to_pylist(), matcher) < limit))


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``; all columns stay as they are.

    Null and empty texts have no hit and stay; repeated rows stay or go together.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    return docs.mapInArrow(lambda it: _keep_calm(it, sent.value, at, limit), docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, parameters: ToxicityParameters | None = None) -> DataFrame:
    """Labelled texts to learn from: those whose id's CRC-32 isn't divisible by five.

    If labels of an id repeat, the larger counts; a null id has no label. Of more
    than ``fit_rows`` labels about that many are used, chosen by a hash of the id;
    so many can be broadcast, and no text moves to meet its label.
    """
    p = parameters or ToxicityParameters()
    own = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic is not null")
    rows = own.count()
    if rows > p.fit_rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < int((1 << 20) * p.fit_rows / rows))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
