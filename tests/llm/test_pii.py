import hashlib
import re
from math import log2

import pytest
import regex

from recipeframe.llm.pii import KINDS, DisclosureParameters, report, sanitise

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+".replace("\\x20-", " -")), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def by_hand(text):
    text, out = text or "", []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def base(text):
    """Spans of each kind."""
    found = [x.split(":") for x in by_hand(text)]
    return {k: [(int(a), int(b)) for kind, a, b in found if kind == k] for k in KINDS}


def check(rows):
    for r, text in rows:
        want = by_hand(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in ("email:", "ip:", "card:", "phone:")], (text, want, r)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text[:200], want, r.spans)
        spans = [s for s in r.spans.split(",") if s]
        assert spans[: len(want)] == want and all(s.startswith("term:") for s in spans[len(want) :])


def test_patterns_against_plain_ones(spark):
    texts = [
        "a@b@c.com x", "a@b.c_d@e.f", "me.you+x@sub.example.co.uk.", "a@b", "@b.c", "a@-.-", "é1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.0255 1.2.3", "0001.2.3.4", "1..2.3.4", "99999999999999999999999.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4111  1111 1111 1111", "41111111111111112 4111111111111111", "x4111111111111111y", "4222222222222 4", "5500 0000 0000 0004-6011 0000 0000 0004",
        "+1 (736) 555-2678 v", "+1 5", "+12345678", "+123456789012345", "+1234567890123456", "++1 222 333 4445.", "+4-9 30 (1234567) x", "a@b.cd 𝔘𝔫𝔦 1.2.3.4 😀 +1 222 333 4445", "", None,
        "1" * 3000 + "@a.b" + "." * 50 + "x" * 3000, "1.2.3.4 " * 2500, "a@b.c " * 1100 + "𝔘 z@y.xx", "." * 2000 + "@", "a.b.c.d.e" * 2000 + "@" + "a." * 9000 + "z",
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, row string")
    check([(r, texts[r.doc_id]) for r in report(docs).collect()])


def test_whole_table_and_clean_rows_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = report(docs).collect()
    assert len(rows) == len(text)
    check([(r, text[r.doc_id]) for r in rows])
    new = {r.doc_id: r for r in sanitise(docs).collect()}
    dirty = {r.doc_id for r in rows if r.spans}
    assert all((new[d].text == text[d]) == (d not in dirty) for d in text)
    assert all(r.n_chars == len(r.text) for r in new.values()) and not any(EMAIL.search(r.text) for r in new.values())


def test_telling_terms(spark):
    # "zanzibar" stands only by one address, or alone; "common" stands everywhere
    rows = [(i, f"common words zanzibar boss@corp.example.com common {i}") for i in range(5)] + [(9, "zanzibarish alone"), (10, "clean common text"), (11, "far " * 60 + "Zanzibar again")]
    rows += [(100 + i, f"common words filler number {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (DisclosureParameters(), DisclosureParameters(broadcast_rows=-1)):
        got = {r.doc_id: r.spans for r in report(docs, p).collect()}
        assert got[1] == "email:22:43,term:13:21" and got[11] == "term:240:248" and got[9] == got[10] == ""
        clean = {r.doc_id: r.text for r in sanitise(docs, p).collect()}
        assert clean[1] == "common words [REMOVED] [EMAIL] common 1" and clean[9] == "zanzibarish alone" and clean[11].endswith("[REMOVED] again")
    assert report(docs.limit(0)).count() == 0 and sanitise(docs.limit(0)).count() == 0


def keys_of(kind, text):
    low, digits = text.lower(), re.sub("[^0-9]", "", text)
    groups = {
        "email": lambda: ["local:" + low.split("@")[0], "domain:" + low.split("@")[-1]], "ip": lambda: ["net:" + ".".join(text.split(".")[:3])],
        "card": lambda: ["issuer:" + digits[:6]], "phone": lambda: ["country:" + re.match("[+][0-9]{1,3}", text)[0], "area:" + digits[:5]],
    }
    return {f"{kind}:{low}", *groups[kind]()}


def brute_force_terms(texts, p):
    """Action of each term, by counting over plain Python sets of texts."""
    holds, terms = {}, {}
    for i, t in texts.items():
        cover = set()
        for kind, own in base(t).items():
            for a, b in own:
                cover |= set(range(a, b))
                for k in keys_of(kind, t[a:b]):
                    holds.setdefault(k, set()).add(i)
        masked = "".join("\n" if j in cover else c for j, c in enumerate(t))
        for w in regex.split(r"[^\p{L}\p{N}]+", masked.lower()):
            if len(w) >= p.least_length:
                terms.setdefault(w, set()).add(i)
    by_text = {}
    for e, own in holds.items():
        for i in own:
            by_text.setdefault(i, []).append(e)
    out = {}
    for term, own in terms.items():
        for e in {e for i in own for e in by_text.get(i, [])}:
            among = len(holds[e]) / len(texts)
            expected = (len(own & holds[e]) + p.prior * among) / (len(own) + p.prior)
            share = log2(expected / among) / -log2(among) if among < 1 else 0
            if expected >= p.least_expected and share >= p.generalise_at:
                out[term] = max(out.get(term, ""), "remove" if share >= p.remove_at else "generalise")
    return out


def marked(t, want):
    """Places of the terms outside of entities."""
    spans = [x for own in base(t).values() for x in own]
    words = regex.finditer(r"[\p{L}\p{N}]+", t)
    return [(m.start(), m.end()) for m in words if m.group().lower() in want and not any(x < m.end() and y > m.start() for x, y in spans)]


def spans_of(r):
    return [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term:")]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_terms_of_the_unmodified_tables_against_brute_force(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = brute_force_terms(texts, DisclosureParameters())
    assert len(want) > 100
    for r in report(docs).collect():
        assert spans_of(r) == marked(texts[r.doc_id], want), r.doc_id


def test_terms_far_away_of_groups_and_with_digits(spark):
    """A project's name 600 code points from addresses that share a domain only; a badge number by phones of one area."""
    rows = [(i, f"Zephyr{i % 2}falcon " + "filler words " * 50 + f" p{i}@falcon.example.org") for i in range(8)]
    rows += [(20 + i, f"badge k7x9q2 and +49 30 12{i}45 67{i}9 call") for i in range(6)]
    rows += [(100 + i, f"filler words badge number call {i} and other things") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    want = brute_force_terms(texts, DisclosureParameters())
    assert {"zephyr0falcon", "zephyr1falcon", "k7x9q2"} <= set(want) and not {"filler", "words", "badge", "call"} & set(want)
    for r in report(docs).collect():
        assert spans_of(r) == marked(texts[r.doc_id], want)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cd", 6), (1, None, None), (2, "a@b.cd", 6), (2, "a@b.cd", 6)], "doc_id long, text string, n_chars long")
    assert sorted((str(r.doc_id), r.n_email) for r in report(docs).collect()) == [("1", 0), ("2", 1), ("2", 1), ("None", 1)]
    got = sanitise(docs)
    assert got.columns == docs.columns and sorted((str(r.doc_id), r.text, r.n_chars) for r in got.collect() if r.text) == [("2", "[EMAIL]", 7)] * 2 + [("None", "[EMAIL]", 7)]
