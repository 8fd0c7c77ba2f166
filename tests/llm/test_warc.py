import glob
import gzip
import hashlib

from recipeframe.llm.warc import read_warc, write_warc

SCHEMA = "record_id long, uri string, payload binary, digest string, refers_to long"


def want(rows):
    best = {}
    for i, _, p in rows:
        p = p or b""
        if i is not None and len(p) >= 1000:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, u, p in rows:
        p = p or b""
        first = best.get(p)
        revisit = first is not None and i != first
        out.append((i, "revisit" if revisit else "response", first if revisit else None, len(p), hashlib.sha1(p).hexdigest(), None if revisit else p))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.digest, None if r.payload is None else bytes(r.payload)) for r in df.collect()), key=str)


def check(spark, rows, path):
    write_warc(spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA), path)
    assert got(read_warc(spark, path)) == want(rows)


def test_round_trip_in_small_ranges(spark, tmp_path):
    noise = hashlib.shake_256(b"n").digest(300_000)  # doesn't compress: records run over many ranges
    rows = [(i, f"http://h/{i}", noise[i * 999 : i * 999 + 3000 + 977 * (i % 9)]) for i in range(150)]
    rows += [(500 + i, None, b"same" * 400) for i in range(40)] + [(900, "u", noise), (901, "u", b"\x1f\x8b\x08" * 500), (902, "u", gzip.compress(b"WARC/1.0 inside"))]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("20000", "3000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            check(spark, rows, f"{tmp_path}/{size}")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "http://a b\r\nX: y", b""), (None, "u", b"q" * 2000), (None, "u", b"r" * 2000), (7, "u", b"r" * 2000), (7, "u", b"r" * 2000), (8, "u", b"s" * 999), (9, "u", b"s" * 999)]
    check(spark, rows, f"{tmp_path}/odd")
    check(spark, [(1, "u", b"\x00" * (17 << 20))], f"{tmp_path}/long")
    write_warc(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert read_warc(spark, f"{tmp_path}/none").count() == 0


def test_members_are_plain_gzip(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "http://x/", b"hello", "", 0)], SCHEMA), f"{tmp_path}/w")
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/w/part-*"))
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"hello\r\n\r\n")
