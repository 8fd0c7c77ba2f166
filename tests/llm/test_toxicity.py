import random

from recipeframe.llm.toxicity import QUOTED, Automaton, Matcher, ToxicityModel, ToxicityParameters, context_weights, drop_toxic, fit, score_texts, training_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


WORDS = {"idiot": 50, "worthless": 50, "clown": 50, "scum": 50, "rarely": 5, "idiotic": 50}


def test_automaton_against_edit_distance():
    import random

    rng = random.Random(4)
    a = Automaton(ToxicityModel(ToxicityParameters(), WORDS))
    long = {w: 2 if len(w) >= 9 else 1 for w, n in WORDS.items() if n >= 12 and len(w) >= 5}
    for _ in range(6000):
        w = list(rng.choice(sorted(long)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o", "t", "s"])
        w = "".join(w)
        assert a.near(w) == any(distance(w, x) <= e for x, e in long.items()), w


def test_kinds_and_quotation():
    m = Matcher(ToxicityModel(ToxicityParameters(), WORDS, frozenset(["vequ"])))
    assert [m.kind(w) for w in ("idiot", "idiiot", "wrthles", "rarely", "vequille", "scam", "house")] == ["word", "near", "near", "rare", "stem", "", ""]
    assert m.counts("You idiot, you clovn!") == (1, 0, 0, 1, 0, 0)
    assert m.counts('He shouted "you idiot" at them.')[4] == 1 and m.counts("the word idiot is old")[4] == 1
    assert m.counts(None) == m.counts("") == (0,) * 6


def test_context_on_both_sides_and_over_the_whole_line():
    m = Matcher(ToxicityModel(ToxicityParameters(), WORDS))
    quoted = lambda t: m.counts(t)[4:] == (1, 0) and sum(m.counts(t)) == 1
    assert quoted("idiot, he said") and quoted('"' + "word salad " * 700 + 'you idiot" she read') and quoted("„du idiot“")
    assert not quoted("you idiot") and not quoted('one " mark, you idiot') and not quoted('"red" you idiot "blue"') and not quoted('"open\nyou idiot" closed')
    assert m.counts("you id1ot")[3] == 1 and m.counts("idiot " * 50)[0] == 50


def test_evidence_moves_context_weights():
    p = ToxicityParameters()
    none = context_weights({}, p)
    assert none["said"] == none[QUOTED] == p.start_weight
    seen = {"": (900, 100), "movie": (1, 60), "said": (300, 5), "you": (450, 50), QUOTED: (2, 40)}
    got = context_weights(seen, p)
    assert got["movie"] > p.quoted_at and got["said"] < 0.5 and "you" not in got and got[QUOTED] > p.start_weight
    m = Matcher(ToxicityModel(p, WORDS, context=got))
    assert m.counts("idiot of the movie")[4] == 1 and m.counts("he said idiot")[4] == 0


def test_quotation_is_learned_from_labels(spark):
    rng = random.Random(5)
    plain = lambda n: " ".join(rng.choice("red blue green grey pink".split()) + str(rng.randint(0, 99)) for _ in range(n))
    rows = []
    for i in range(3000):
        toxic, kind = i % 3 == 0, rng.random()
        hit = "you idiot" if toxic else "the idiot review column" if kind < 0.08 else ""
        rows.append((i, f"{plain(20)} {hit} {plain(20)}", int(toxic)))
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), ToxicityParameters(least_precision=0.8))
    assert model.context["review"] > 0.5 and model.context.get("you", 0) < 0
    score = lambda t: score_texts(spark.createDataFrame([(0, t)], "doc_id long, text string"), model).first().score
    assert score(f"{plain(20)} you idiot {plain(20)}") > 0.5 > score(f"{plain(20)} the idiot review column {plain(20)}")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(training_rows(docs, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    import zlib

    rows = [(r.score, truth[r.doc_id]) for r in score_texts(docs, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    caught = sum(s >= 0.5 for s, y in rows if y) / sum(y for _, y in rows)
    false = sum(s >= 0.5 for s, y in rows if not y) / sum(1 - y for _, y in rows)
    assert caught > 0.85 and false < 0.01


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "you idiot", None), (3, "idiot " * 200_000, "c"), (3, "idiot " * 200_000, "c")], "doc_id long, text string, score string")
    model = ToxicityModel(ToxicityParameters(), WORDS, frozenset(), -3.0, (5.0, 1.0, 1.0, 1.0, 0.2, 0.2))
    got = [(r.doc_id, r.score >= 0.5) for r in score_texts(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (None, True), (3, True), (3, True)], key=str)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    none = fit(training_rows(docs.limit(0), labels))
    assert 0 < score_texts(docs, none).first().score < 0.5 and score_texts(docs.limit(0), none).count() == 0
    assert fit(training_rows(docs, labels)).words == {}
