import random
import re

import pytest

from recipeframe.llm.license_templates import PHRASES, TEMPLATES
from recipeframe.llm.licenses import LicenseParameters, Scanner, SuffixAutomaton, chain, scan, scan_texts

P = LicenseParameters()


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    """Words, places and labels of the phrases, by looking at each place."""
    w, starts, labels = words(text), [], set()
    for phrase, label in PHRASES:
        own = phrase.split()
        found = [i for i in range(len(w) - len(own) + 1) if w[i : i + len(own)] == own]
        starts += found
        labels |= {label} if found else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_equal_brute_force(seed):
    r = random.Random(seed)
    letters = range(2 + seed)
    templates = [[r.choice(letters) for _ in range(r.randrange(0, 14))] for _ in range(6)]
    templates[3:3] = [templates[0][2:9], templates[1]]  # inside others, and equal
    a = SuffixAutomaton(templates)
    text = [r.choice([*letters, 99]) for _ in range(400)] + templates[2] + templates[5]
    for i, (state, n) in enumerate(a.walk(text)):
        long = max((k for k in range(min(i + 1, 14) + 1) if any(t[j : j + k] == text[i + 1 - k : i + 1] for t in templates for j in range(len(t) - k + 1))), default=0)
        assert n == long
        if n:
            own = text[i + 1 - n : i + 1]
            assert a.places(state) == sorted((k, j + n) for k, t in enumerate(templates) for j in range(len(t) - n + 1) if t[j : j + n] == own)


@pytest.mark.parametrize("seed", range(4))
def test_chains_cover_as_much_as_the_best_of_all(seed):
    r = random.Random(seed)
    for _ in range(60):
        own = sorted({(s := r.randrange(30), s + r.randrange(4, 8), r.randrange(30)) for _ in range(7)})

        def follows(x, y):
            return y[1] > x[1] and y[0] > x[0] and y[2] > x[2] and y[2] + y[1] - y[0] > x[2] + x[1] - x[0] and y[0] - x[1] <= 5 and y[2] - x[2] - x[1] + x[0] <= 9

        def most(x):
            return x[1] - x[0] + max([most(y) - max(0, x[1] - y[0], x[2] + x[1] - x[0] - y[2]) for y in own if follows(x, y)], default=0)

        # the recursion starts at a chain's first match, the operator's sums end at its last: the best chain is the same
        assert max(c[2] for c in chain(own, 5, 9)) == max(most(x) for x in own)


def test_every_template_is_found_whole():
    for (label, name, text), (n, _, _, _, _, labels, score, spans) in zip(TEMPLATES, scan_texts([f"Before it. {t} And after.".encode() for _, _, t in TEMPLATES], P), strict=True):
        best = max(spans, key=lambda s: s["covered"])
        assert label in labels.split(",") and score == 1.0 and n == len(words(text)) + 4
        assert (best["label"], best["first_word"], best["last_word"], best["covered"]) == (label, 2, n - 3, n - 4), name


def test_edited_text_is_still_a_span():
    mit = words(TEMPLATES[0][2])
    edited = mit[:30] + ["x", "y"] + mit[33:90] + mit[95:]
    [(n, n_base, _, _, _, labels, score, spans)] = scan_texts([" ".join(["w"] * 50 + edited + ["w"] * 20).encode()], P)
    assert labels == "mit" and n_base == 0 and spans[0]["first_word"] == 50 and spans[0]["last_word"] == n - 21 and 0.9 < score < 1
    [(_, _, _, _, _, labels, score, spans)] = scan_texts([" ".join(mit[:30]).encode()], P)
    assert (labels, score, spans) == ("", 0.0, [])  # less than the share


def test_base_equals_brute_force_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = scan(docs).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_odd_rows_and_long_texts(spark):
    line = "Released under the MIT License. "
    texts = [None, "", "mit", "MIT-license mit\x00license mitélicense", "gnu General\tPublic\nlicense" * 3, line * 3000, "x" * 9000 + " cc by " + "apache license", "cc by cc by cc by", "(c) 2020 é 7"]
    docs = spark.createDataFrame([(1, t, "n", "s") for t in texts], "doc_id long, text string, n_words string, spans string")
    rows = scan(docs, LicenseParameters(piece_bytes=1000)).collect()
    assert sorted(map(repr, [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows])) == sorted(repr(base(t)) for t in texts)
    assert max(len(r.spans) for r in rows) == 3000
    assert scan(docs.filter("doc_id > 1")).count() == 0


def test_runs_lose_no_match():
    """Walking only linked words gives the long matches and phrases of a walk over all words."""
    scanner, r = Scanner(P), random.Random(3)
    pool = [w for _, _, t in TEMPLATES for w in words(t)]
    for _ in range(20):
        parts = [(r.randrange(len(pool)), r.randrange(1, 9), r.randrange(2)) for _ in range(30)]
        text = " ".join(w for k, n, more in parts for w in (pool[k : k + n] + ["zz"] * more))
        ids, piece = scanner.ids(text.encode())
        long, places = [], []
        for a, b in scanner.runs(ids, piece).tolist():
            x, y = scanner.matches(ids[a:b].tolist(), a)
            long += x
            places += y
        assert (long, places) == tuple([m for m in part if len(m) < 3 or m[1] - m[0] > 1] for part in scanner.matches(ids.tolist(), 0))
