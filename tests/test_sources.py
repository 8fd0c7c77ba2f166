import os
import pytest

from recipeframe.functions.graph import connected_components
from recipeframe.operators import xml_tables as X
from recipeframe.sources import delimited as D
from recipeframe.sources.xml import read_documents, shred, shred_documents
from recipeframe.streaming.xml_export import SourceChanged, export_collection, source_states


def test_shredder():
    rows = shred("s", b"<r><a k='1'>x<b/>tail</a><a/><n xmlns='u'/></r>")
    assert [(r[4], r[2], r[7], r[8], r[9]) for r in rows] == [("/r", None, 0, None, None), ("/r/a", 0, 0, "x", None), ("/r/a/b", 1, 0, None, "tail"), ("/r/a", 0, 1, None, None), ("/r/{u}n", 0, 2, None, None)]
    assert rows[1][10] == [("k", "1")] and rows[2][3] == [0, 1, 2] and [r[12] for r in rows] == [False, False, True, True, True]
    assert "not read" in shred("s", b"<!DOCTYPE r><r/>")[0][13] and "well-formed" in shred("s", b"<r><c></r>")[0][13]


def test_bad_documents_keep_their_siblings(spark):
    docs = spark.createDataFrame([("a", b"<r><i>1</i></r>"), ("b", b"<r>"), ("c", b"")], "source_file string, content binary")
    nodes = shred_documents(docs)
    assert {r.source_file for r in nodes.filter("error IS NOT NULL").collect()} == {"b", "c"}
    assert X.extract(nodes, "/r", {"i": "text:/r/i"}).collect()[0].i == "1"


def test_export_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"s{i}.xml").write_text(f"<r><rec><n>{i}</n></rec></r>")
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), "/r/rec", {"n": "text:/r/rec/n"})
    export_collection(*args)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "2"]
    (folder / "s9.xml").write_text("<r><rec><n>9</n></rec></r>")
    export_collection(*args)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["0", "1", "2", "9"]
    assert read_documents(spark, str(folder)).count() == 4


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4,5\n6,7\n")
    (tmp_path / "b.csv").write_bytes(b"x;y\n1;\xe9\n")
    (tmp_path / "c.csv").write_bytes(b"\0\1\2")
    (tmp_path / "notes.md").write_text("no")
    found = {r.path.rsplit("/", 1)[1]: r for r in D.inspect_files(D.discover(spark, str(tmp_path))).collect()}
    assert set(found) == {"a.csv", "b.csv", "c.csv"} and found["c.csv"].status == "failed"
    assert (found["a.csv"].delimiter, found["a.csv"].columns, found["b.csv"].delimiter, found["b.csv"].encoding) == (",", ["a", "b"], ";", "cp1252")
    df = D.read_delimited(spark, str(tmp_path / "a.csv"), ["a", "b"])
    n, first = D.malformed_rows(df, 2)
    assert n == 1 and first[0].observed == 3
    assert D.display_columns(["", "x", "x"]) == ["column_1", "x", "x.1"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_changed_sources_are_refused(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"s{i}.xml").write_text(f"<r><rec><n>{i}</n></rec></r>")
    args = (spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), "/r/rec", {"n": "text:/r/rec/n"})
    states = lambda: {r.path.rsplit("/", 1)[1]: r.state for r in source_states(spark, str(folder), str(tmp_path / "check")).collect()}
    assert set(states().values()) == {"new"}
    export_collection(*args)
    (folder / "s0.xml").write_text("<r><rec><n>0</n></rec></r>")  # touched, the same bytes
    os.utime(folder / "s0.xml", (1, 1))
    (folder / "s2.xml").unlink()
    (folder / "s5.xml").write_text("<r><rec><n>5</n></rec></r>")
    assert states() == {"s0.xml": "done", "s1.xml": "done", "s2.xml": "gone", "s5.xml": "new"}
    export_collection(*args)
    rows = lambda: sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows() == ["0", "1", "2", "5"] and states()["s5.xml"] == "done"
    (folder / "s1.xml").write_text("<r><rec><n>7</n></rec></r>")
    (folder / "s6.xml").write_text("<r><rec><n>6</n></rec></r>")
    os.utime(folder / "s1.xml", (5, 5))
    assert states()["s1.xml"] == "changed"
    with pytest.raises(SourceChanged, match="s1.xml"):
        export_collection(*args)
    assert rows() == ["0", "1", "2", "5"]  # nothing was written
