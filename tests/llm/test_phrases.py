import re
from collections import Counter

import pytest

from recipeframe.llm._words import cut_text
from recipeframe.llm.phrases import PhraseParameters, _score, collocations, count_phrases


def brute(rows, p):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= p.least}
    out = {}
    for (lang, w), a in candidates.items():
        longer = [b for (other, x), b in candidates.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * b >= p.absorbed * a for b in longer):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, w.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, w, left, right) in enumerate(sorted(rows)[: p.first]))


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("p", [
    PhraseParameters(least=3, first=40, shards=3, slots=1 << 12, piece_bytes=1 << 14),
    PhraseParameters(least=2, first=5000, shards=2, slots=4, piece_bytes=300),  # every slot is shared
])
def test_equals_brute_force(spark, p):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(collocations(docs.repartition(5), p)) == brute(rows, p)


def test_odd_rows(spark):
    p = PhraseParameters(least=2, first=3, shards=2, slots=64, piece_bytes=64)
    rows = [(None, None), ("en", ""), (None, "A b a b"), ("xx", "a\tb a b, c é É"), ("xx", "a\vb"), ("xx", "z " * 500), ("en", "x.y!z x y"), ("en", "x y"), ("en", "q" * 1000)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, text string, n int, phrase string")
    assert found(collocations(docs, p)) == brute(rows, p)
    assert collocations(docs.filter("n > 1"), p).count() == 0


def test_long_texts_are_counted_whole(spark):
    text = "one two three four. " * 400 + "five six" + " seven" * 300
    p = PhraseParameters(least=2, first=100, shards=2, slots=1 << 10, piece_bytes=50)
    assert found(collocations(spark.createDataFrame([("en", text)], "lang string, text string"), p)) == brute([("en", text)], p)
    parts = list(cut_text(text.encode(), 50, b" .", 2))
    assert sum(len(re.findall(rb"[^ .]+", t)) - c for t, c in parts) == len(re.findall("[^ .]+", text))


def test_scores_are_exact(spark):
    rows = [(10**12 + 7, 10**14 + 9, 10**12 + 11), (5, 5, 5), (999_999_999_999_999,) * 3, (10, 30, 70)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [r[0] for r in df.select(_score(df.a, df.l, df.r)).collect()] == [1_000_000 * a * a // (left * r) for a, left, r in rows]


def test_every_phrase_is_counted_once_a_shard(spark):
    """A word that becomes frequent in the last shard only still gets its pairs from all shards."""
    rows = [("en", f"rare{i % 7} pair{i % 5} w{i}") for i in range(60)]
    p = PhraseParameters(least=8, shards=5, slots=1 << 12)
    words, longer = count_phrases(spark.createDataFrame(rows, "lang string, text string"), p)
    f = Counter(x for _, t in rows for x in t.split())
    assert {r.phrase: r.n for r in words.collect()} == dict(f)
    assert longer.count() == 0
