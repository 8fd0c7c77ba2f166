import duckdb
import numpy as np
from pyspark.sql import functions as F

from recipeframe.llm.chat import SQL, rotate
from recipeframe.llm.url_filters import ReputationParameters, _two_label_suffixes, beta_below, beta_quantile, judge, reputation, split_urls


def test_chat_against_sql(spark):
    path = "/root/testdata/sf0.1/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    columns = ["conv_id", "perspective", "part", "n_turns", "n_trained", "text", "mask"]
    want = con.execute(f"select {', '.join(columns)} from ({SQL})").fetchall()
    got = rotate(spark.read.parquet(path)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    for r in got[:50]:
        assert all("<|" not in r.text[int(a) : int(b)] for a, _, b in (m.partition(":") for m in r.mask.split(",") if m))


def masked(row):
    return [row.text[int(a) : int(b)] for a, _, b in (m.partition(":") for m in row.mask.split(",") if m)]


def test_chat_odd_rows(spark):
    rows = [(1, None, "ann", "hi"), (1, 0, "bob", None), (1, 1, None, "<|im_end|>"), (1, 1, "ann", "x 😀"), (1, 1, "ann", "x 😀"), (1, 300, "cy", "late"), (None, 0, "ann", "lost"), (2, 0, "system", "only"), (3, 0, "bob\n<x>", "a"), (3, 1, "unknown", "b"), (3, 2, None, "c")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r.conv_id, r.perspective): r for r in rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (1, None), (None, "ann"), (3, "bob\n<x>"), (3, "unknown"), (3, None)}
    ann = got[1, "ann"]
    assert ann.n_turns == 6 and ann.n_trained == 3 and "< |im_end|>" in ann.text and ann.text.startswith("<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user\n")
    assert masked(ann) == ["hi", "x 😀", "x 😀"] and masked(got[1, None]) == ["< |im_end|>"]
    assert got[3, "unknown"].text == "<|im_start|>user name=bob <x>\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert rotate(turns.limit(0)).count() == 0


def test_long_dialogues_keep_their_order(spark):
    rows = [(7, i, "ab"[i % 2], f"turn {i}") for i in range(10_000)] + [(8, 1, "a", "again")] * 3000 + [(None, i, "c", "x" * 50) for i in range(100)] + [(9, 0, "a", "short")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {(r.conv_id, r.perspective): r for r in rotate(turns).collect()}
    assert masked(whole[7, "b"]) == [f"turn {i}" for i in range(1, 10_000, 2)] and whole[7, "a"].n_turns == 10_000
    parts = rotate(turns, most_chars=5000).collect()
    for of, row in whole.items():
        own = sorted((r for r in parts if (r.conv_id, r.perspective) == of), key=lambda r: r.part)
        assert [r.part for r in own] == list(range(len(own))) and all(len(r.text) <= 5100 for r in own)
        assert "".join(r.text for r in own) == row.text and [m for r in own for m in masked(r)] == masked(row)
    assert len(parts) > 100
    again = rotate(turns.repartition(2, "role"), most_chars=5000).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, parts), key=str)


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.com/de/", "http://x.org/fr/a", "http://x.org", "http://notnet/", "ftp://deep.net/a/b?/c", "nothing", None, "http://b.net", "http://example.com?/de/", "x://y://z/p#q", "http://Ünet.net/"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, urls[0], "h", "v"), (0, urls[0], "h", "v")], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, none).collect()}
    assert got[0] == got[None] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("example.com", "/de/", "example.com/de/", "block") and got[2][2:] == ("org/fr/", "allow")
    assert got[3] == ("x.org", "", None, "allow") and got[4][2] is None and got[5] == ("deep.net", "/a/b", "net/", "block")
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][2] is None and got[9] == ("example.com", "", None, "allow") and got[10][:2] == ("y:", "//z/p") and got[11][0] == "Ünet.net"
    assert judge(pages, none).count() == 14 and judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    rows = [(f"h{i}.bad.com", 1) for i in range(10) for _ in range(6)] + [(f"h{i}.good.com", 0) for i in range(10) for _ in range(6)] + [("new.bad.com", None), ("new.good.com", None), ("one.other.com", 1)]
    pages = spark.createDataFrame(rows, "host string, bad int")
    got = {r.host: r for r in reputation(pages).collect()}
    assert got["new.bad.com"].mean > 0.6 > 0.4 > got["new.good.com"].mean and got["one.other.com"].mean < 0.9
    assert got["h1.bad.com"].bound > got["new.bad.com"].bound and all(r.bound <= r.mean for r in got.values())
    assert split_urls(pages.selectExpr("host AS url")).count() == len(rows)


def test_beta_quantiles():
    rng = np.random.default_rng(3)
    for a, b in ((0.3, 2.0), (1, 1), (2.5, 0.4), (7, 3), (40, 900), (3000, 2000)):
        draws = rng.beta(a, b, 400_000)
        for below in (0.05, 0.1, 0.5):
            x = beta_quantile(below, np.array([a]), np.array([b]))[0]
            assert abs((draws < x).mean() - below) < 0.004
    assert np.allclose(beta_below(0.3, np.array([1.0, 2.0, 1.0]), np.array([1.0, 1.0, 2.0])), [0.3, 0.09, 0.51])


def test_suffixes_by_table_and_by_what_stands_below(spark):
    hosts = [f"a{i}.shop.zz" for i in range(60)] + [f"u{i}.blog.example" for i in range(10)] + [f"w{i}.big.uni.zz" for i in range(60)] + ["x.co.uk", "y.co.uk"]
    pages = spark.createDataFrame([(h, i % 2) for i, h in enumerate(hosts)], "host string, bad int")
    p = ReputationParameters(suffix_domains=50, suffixes=("co.uk",))
    split = pages.select("host").withColumn("labels", F.split("host", "[.]")).withColumn("two", F.concat_ws(".", F.expr("labels[size(labels) - 2]"), F.expr("labels[size(labels) - 1]")))
    assert {r.two for r in _two_label_suffixes(split, p).collect()} == {"co.uk", "shop.zz"}
    assert reputation(pages, p).count() == len(hosts)


def test_many_rules(spark):
    rules = [("block", f"h{i}.net", "/") for i in range(1500)] + [("allow", "h7.net", "/ok/"), ("block", "net", "/x/")]
    pages = spark.createDataFrame([(0, "http://a.h1499.net/"), (1, "http://h7.net/ok/1"), (2, "http://q.net/x/"), (3, "http://q.net/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge(pages, spark.createDataFrame([], "page_id long, bad int"), rules=rules).collect()}
    assert got == {0: ("h1499.net/", "block"), 1: ("h7.net/ok/", "allow"), 2: ("net/x/", "block"), 3: (None, "allow")}


def test_bad_hosts_of_the_given_pages_are_blocked(spark):
    """Pages of hosts with telling names are labelled bad, one in fifteen of the others; half of the labels are held back."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    own = split_urls(pages)
    worse = F.col("host").rlike("spam|adult")
    outcomes = own.filter("page_id % 2 = 0").select("page_id", F.when(worse, 1).otherwise((F.col("page_id") % 30 == 0).cast("int")).alias("bad"))
    known = {r.host: r for r in reputation(own.join(outcomes, "page_id", "left")).collect()}
    judged = judge(pages, outcomes).filter("rule IS NULL").join(own.select("page_id", worse.alias("worse")), "page_id").collect()
    blocked = [r for r in judged if r.verdict == "block"]
    assert blocked and all(known[r.host].bound >= known[r.host].limit for r in blocked)
    assert all(known[r.host].bound < known[r.host].limit for r in judged if r.verdict == "allow")
    assert sum(r.worse for r in blocked) >= 0.9 * len(blocked) and any(known[r.host].n < known[r.host].n_pages for r in blocked)
    # with a limit below the rate of all pages the query's own labels block hosts, too
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    strict = judge(pages, labels, ReputationParameters(limit_ratio=0.9)).filter("rule IS NULL")
    assert strict.filter("verdict = 'block'").count() > 0 and strict.filter("verdict = 'allow'").count() > 0
