"""Licence spans by a generalised suffix automaton.

One automaton holds all runs of words of all templates. A text's words stream
through it and give matching statistics: for each place the longest run ending
there that some template holds, and where. Runs of ``least_run`` words or more
that can't go on, and whole templates, are long matches. For each template long
matches that follow each other in the text and in the template, with small gaps
in both, are chained so that the most words are covered; a chain that covers
``least_share`` of its template is a span. Of spans of different licences over
the same words the one that covers more stays.

Phrases are in the same automaton: a phrase stands wherever the run that ends
there is as long as it, and its state is met along the suffix links.

Only words that stand in a pair that some template holds are walked through the
automaton: at any other place no run is longer than one word. Texts don't shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeframe.llm._text import LOWER
from recipeframe.llm._words import BREAK, byte_kinds, cut_text, cut_words
from recipeframe.llm.license_templates import PHRASES, TEMPLATES

#: All of ASCII but digits and small letters; texts are lower-cased before.
_GAPS = bytes(x for x in range(128) if not (0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A))
_END = b"\xff"  # never in UTF-8
_KINDS = byte_kinds(_GAPS)
_KINDS[0xFF] = BREAK


@dataclass(frozen=True)
class LicenseParameters:
    templates: tuple[tuple[str, str, str], ...] = TEMPLATES  #: (label, name, text)
    phrases: tuple[tuple[str, str], ...] = PHRASES  #: (phrase, label)
    least_run: int = 4  #: words of a long match; whole templates may be shorter
    text_gap: int = 12  #: words between two matches of a chain in the text
    template_gap: int = 60  #: the same in the template
    least_share: float = 0.5  #: of a template's words that a span covers
    phrase_score: float = 0.5  #: score of a text with a phrase and no span
    piece_bytes: int = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    return [w.as_py() for w in cut_words(text.translate(LOWER), _KINDS)[0]]


# ---------------------------------------------------------------- automaton

class SuffixAutomaton:
    """All runs of several sequences. State 0 is the empty run."""

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        self._ends: list[list[tuple[int, int]]] = [[]]  # (sequence, place after the last word) of the longest run
        for k, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self._ends[last].append((k, i + 1))
        self._below: list[list[int]] = [[] for _ in self.length]
        for s, up in enumerate(self.link):
            if up >= 0:
                self._below[up].append(s)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, link: int, go: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(go)
        self._ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The part of ``q`` whose runs are at most one word longer than those of ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def places(self, state: int) -> list[tuple[int, int]]:
        """(sequence, place after the last word) of all occurrences of a state's runs."""
        if state not in self._places:
            found, todo = [], [state]
            while todo:
                s = todo.pop()
                found += self._ends[s]
                todo += self._below[s]
            self._places[state] = sorted(found)
        return self._places[state]

    def walk(self, words: list[int]):
        """Matching statistics: for each word the state and length of the longest run that ends with it."""
        state, n = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            yield state, n


class Scanner:
    """The automaton of a set of templates and phrases, with all that a text needs."""

    def __init__(self, p: LicenseParameters):
        self.p = p
        texts = [words_of(t.encode()) for _, _, t in p.templates]
        phrases = [words_of(t.encode()) for t, _ in p.phrases]
        vocabulary = sorted({w for t in [*texts, *phrases] for w in t})
        of = {w: i for i, w in enumerate(vocabulary)}
        sequences = [[of[w] for w in t] for t in [*texts, *phrases]]
        self.automaton, self.sizes, self.templates = SuffixAutomaton(sequences), [len(t) for t in texts], len(texts)
        self.vocabulary = pa.array(vocabulary, pa.binary())
        self.words = len(vocabulary)
        self.pairs = np.unique(np.array([a * len(vocabulary) + b for t in sequences for a, b in zip(t, t[1:], strict=False)] or [-1], dtype=np.int64))
        single = {t[0] for t in sequences if len(t) == 1}
        self.single = np.isin(np.arange(len(vocabulary) + 1), list(single))
        self._phrases: dict[int, list[tuple[int, int]]] = {}
        self.ends = {}
        for k, t in enumerate(sequences[len(texts) :]):
            if t:
                state = 0
                for w in t:
                    state = self.automaton.next[state][w]
                self.ends.setdefault(state, []).append((k, len(t)))

    def phrases(self, state: int) -> list[tuple[int, int]]:
        """(phrase, words) of all phrases that end runs of a state."""
        if state not in self._phrases:
            up = self.automaton.link[state]
            self._phrases[state] = self.ends.get(state, []) + (self.phrases(up) if up > 0 else [])
        return self._phrases[state]

    def ids(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word (of an unknown one: ``words``) and the breaks before it."""
        found, piece = cut_words(buf.translate(LOWER), _KINDS)
        if not len(found):
            return np.zeros(0, dtype=np.int64), piece
        coded = found.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.vocabulary), self.words).to_numpy()
        return known[coded.indices.to_numpy()].astype(np.int64), piece

    def runs(self, ids: np.ndarray, piece: np.ndarray):
        """(first, after the last) of the places that can be in a match: linked by pairs that a template holds."""
        if not len(ids):
            return np.zeros((0, 2), dtype=np.int64)
        linked = np.zeros(len(ids) + 1, dtype=bool)
        known = (ids[:-1] < self.words) & (ids[1:] < self.words) & (piece[:-1] == piece[1:])
        at = np.flatnonzero(known)
        linked[at + 1] = np.isin(ids[at] * self.words + ids[at + 1], self.pairs)
        inside = linked[:-1] | linked[1:] | self.single[ids]
        first = inside & ~linked[:-1]
        last = inside & ~linked[1:]
        return np.stack((np.flatnonzero(first), np.flatnonzero(last) + 1), axis=1)

    def matches(self, words: list[int], at: int):
        """Long matches ``(start, after the end, state)`` of a run that starts at word ``at``, and phrase places ``(start, phrase)``."""
        long, places = [], []
        stats = list(self.automaton.walk(words))
        for i, (state, n) in enumerate(stats):
            for k, size in self.phrases(state):
                if size <= n:
                    places.append((at + i + 1 - size, k))
            if i + 1 < len(stats) and stats[i + 1][1] == n + 1:
                continue
            whole = any(t < self.templates and end == n == self.sizes[t] for t, end in self.automaton.places(state)) if n < self.p.least_run else True
            if n and whole:
                long.append((at + i + 1 - n, at + i + 1, state))
        return long, places

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple]:
        """``(label, template, first word, last word, covered, share)`` of a text's long matches, in their order."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in matches:
            for t, place in self.automaton.places(state):
                if t < self.templates:
                    by.setdefault(t, []).append((start, end, place - (end - start)))
        found = []
        for t, own in by.items():
            for first, last, covered in chain(sorted(own), self.p.text_gap, self.p.template_gap):
                share = covered / self.sizes[t]
                if share >= self.p.least_share:
                    found.append((covered, share, first, last, t))
        found.sort(key=lambda x: (-x[0], -x[1], x[2], x[4]))
        kept, taken = [], {}
        for covered, share, first, last, t in found:  # a span gives way to a better one over any of its words
            cells = range(first // 256, last // 256 + 1)
            if not any(first <= b and a <= last for c in cells for a, b in taken.get(c, ())):
                kept.append((*self.p.templates[t][:2], first, last, covered, share))
                for c in cells:
                    taken.setdefault(c, []).append((first, last))
        return sorted(kept, key=lambda x: (x[2], x[3]))


def chain(matches: list[tuple[int, int, int]], text_gap: int, template_gap: int) -> list[tuple[int, int, int]]:
    """Chains of ``(start, after the end, template place)``, sorted: ``(first word, last word, words covered)`` of each.

    A match follows another if it starts and ends later in both, and the gaps
    aren't too large; words covered twice count once. The best chain is taken
    first, then the best of what is left.
    """
    best: list[int] = []
    before: list[int] = []
    low = 0
    reach: list[int] = []  # the last end up to each match, as a match may hold later ones
    for j, (start, end, place) in enumerate(matches):
        reach.append(max(end, reach[-1] if reach else end))
        while reach[low] < start - text_gap:
            low += 1
        top, of = end - start, -1
        for i in range(low, j):
            a, b, at = matches[i]
            stop = at + b - a
            if b >= end or a >= start or at >= place or stop >= place + end - start or start - b > text_gap or place - stop > template_gap:
                continue
            gain = best[i] + end - start - max(0, b - start, stop - place)
            if gain > top:
                top, of = gain, i
        best.append(top)
        before.append(of)
    used, out = [False] * len(matches), []
    for j in sorted(range(len(matches)), key=lambda j: (-best[j], j)):
        if used[j]:
            continue
        i, first = j, j
        while i >= 0 and not used[i]:
            used[i], first, i = True, i, before[i]
        covered = best[j] - (best[i] if i >= 0 else 0)
        out.append((matches[first][0], matches[j][1] - 1, covered))
    return out


@lru_cache(maxsize=4)
def _scanner(p: LicenseParameters) -> Scanner:
    return Scanner(p)


# ---------------------------------------------------------------- texts

_SPAN = pa.struct([("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())])
_ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,template:string,first_word:bigint,last_word:bigint,covered:bigint,share:double>>"


def scan_texts(texts: list[bytes], p: LicenseParameters) -> list[tuple]:
    """One row of ``_ADDED`` for each text."""
    scanner, out, held, size = _scanner(p), [], [], 0

    def row(n: int, matches, places):
        spans = scanner.spans(matches)
        base = {p.phrases[k][1] for _, k in places}
        starts = [s for s, _ in places]
        score = max([s[5] for s in spans] + [p.phrase_score if places else 0.0])
        return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), score, [dict(zip(_SPAN_FIELDS, s, strict=True)) for s in spans]

    def scanned(ids, piece, count):
        n = np.bincount(piece, minlength=count) if len(piece) else np.zeros(count, dtype=np.int64)
        begins = np.concatenate(([0], np.cumsum(n)))
        found: dict[int, tuple[list, list]] = {}
        for first, last in scanner.runs(ids, piece).tolist():
            k = int(piece[first])
            long, places = scanner.matches(ids[first:last].tolist(), first - int(begins[k]))
            own = found.setdefault(k, ([], []))
            own[0].extend(long)
            own[1].extend(places)
        out.extend(row(int(n[k]), *found.get(k, ([], []))) for k in range(count))

    def flush():
        nonlocal held, size
        if held:
            scanned(*scanner.ids(_END.join(held)), len(held))
        held, size = [], 0

    for text in texts:
        if len(text) > p.piece_bytes:  # streamed in parts: of each only the word numbers stay
            flush()
            ids = np.concatenate([scanner.ids(part)[0] for part, _ in cut_text(text, p.piece_bytes, _DELIMITERS, 0)])
            scanned(ids, np.zeros(len(ids), dtype=np.int64), 1)
            continue
        held.append(text)
        size += len(text)
        if size >= p.piece_bytes:
            flush()
    flush()
    return out


_SPAN_FIELDS = [f.name for f in _SPAN]
_DELIMITERS = bytes(x for x in _GAPS if not 0x41 <= x <= 0x5A)  # before lower-casing, A-Z are in words


def _rows(batches, p):
    for b in batches:
        for i in range(0, max(b.num_rows, 1), 512):
            part = b.slice(i, 512)
            rows = scan_texts([t or b"" for t in part.column(0).to_pylist()], p)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]
            added = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            names = [x.split()[0] for x in _ADDED.split(", ")]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *added], names=[*part.schema.names[1:], *names])


def scan(docs: DataFrame, p: LicenseParameters = LicenseParameters(), keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Licence spans and phrases of each text; one row for each row of ``docs``.

    Returns the ``keep`` columns (``doc_id`` by default) and ``n_words``; ``n_base``,
    ``first_word, last_word`` (places of phrases, the smallest and largest start)
    and ``base_labels``; ``labels`` (those of spans too), ``score`` (the largest share
    of a template that a span covers, at least ``phrase_score`` where a phrase
    stands), and ``spans``. Null texts are empty: no words, no labels, score 0.
    Kept columns named like one of these are an error.
    """
    keep = ["doc_id"] if keep is None else keep
    own = docs.select(F.col(text).cast("binary").alias("_text"), *keep)
    fields = ", ".join(f"`{n}` {t}" for n, t in own.dtypes[1:])
    return own.mapInArrow(lambda it: _rows(it, p), f"{fields}, {_ADDED}" if fields else _ADDED)
