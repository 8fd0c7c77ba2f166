"""Nodes found by columns of positions against those read by events."""

import time

import pytest

from recipeframe.sources import xml as X

PLAIN = [
    b"<a/>",
    b"<a>x</a>",
    b"<a>x<b/>y<b k='1' j=\"2\">z</b> <c/>\n</a>\n",
    b'<a xmlns="urn:a" xmlns:p="urn:p" p:k="1" k="2"><p:b q="&lt;&#65;&amp;"/>&quot;t&apos;<b xml:lang="en">\xc3\xa9\t</b></a>',
    b'<o xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><r xsi:nil="true"/><r xsi:nil="0" /><r><r><r/></r></r></o>',
    b"<a><b></b><c>1</c><b>2</b><c><b>3</b></c></a>",
]
OTHER = [b"<a><!-- <b> --></a>", b"<?xml version='1.0'?><a/>", b"<a><![CDATA[<b>]]></a>", b"<a>x>y</a>", b"<a k='>'/>", b"<a><b xmlns='u'/></a>", b"<a\n k='1'/>", b"<a>\r\n</a>"]
BAD = [b"", b"<a>", b"<a></b>", b"<!DOCTYPE a><a/>", b"x", b"<a>&nope;</a>", b"<a>" * 600 + b"</a>" * 600]


def by_events(monkeypatch, content):
    monkeypatch.setattr(X, "_shred_at_once", lambda *_: None)
    out = X.shred("s", content)
    monkeypatch.undo()
    return out


@pytest.mark.parametrize("content", PLAIN + OTHER + BAD)
def test_same_nodes(monkeypatch, content):
    assert X.shred("s", content) == by_events(monkeypatch, content)


def test_which_are_read_at_once():
    assert all(X._shred_at_once("s", c) is not None for c in PLAIN) and all(X._shred_at_once("s", c) is None for c in OTHER)


def test_orders_are_read_several_times_faster(monkeypatch):
    items = "".join(f'<item n="{i}"><qty>{i}</qty><flag>N</flag></item>' for i in range(4))
    content = ("<orders>" + "".join(f'<order key="{i}"><status/><price>{i}.50</price>{items}</order>' for i in range(2000)) + "</orders>").encode()
    took = []
    for at_once in (True, False):
        start = time.process_time()
        rows = list(X.shred_batches("s", content)) if at_once else None
        if not at_once:
            monkeypatch.setattr(X, "_shred_at_once", lambda *_: None)
            rows = list(X.shred_batches("s", content))
        took.append(time.process_time() - start)
        assert sum(b.num_rows for b in rows) == 1 + 2000 * 15
    assert took[0] < took[1] / 2, took


def test_documents_of_one_partition_are_dealt_to_all_tasks(spark):
    docs = spark.createDataFrame([(f"s{i}", bytearray(b"<a><b/></a>")) for i in range(200)], "source_file string, content binary").coalesce(1)
    nodes = X.shred_documents(docs)
    assert nodes.count() == 400
    assert len({r.p for r in nodes.selectExpr("spark_partition_id() AS p").distinct().collect()}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
