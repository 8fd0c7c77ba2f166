"""WARC archives: one gzip member per record, written and read in parallel.

Writing. ``write_warc`` finds equal payloads by SHA-1 and length; of each group
the largest id becomes a ``response``, the others ``revisit`` records that name
it. Payload bytes never shuffle by digest for frequent payloads: groups with
more than a thousandth of all rows (at most a thousand) are looked up from a
broadcast. Files are written by Spark's own committed writer, so they may lie
in any store Spark writes to and a lost task leaves no half record: a record's
member goes out as a line without its last byte, and the line end, a zero byte,
puts it back. That byte is the top of the member's size and is zero for records
below 16 MiB; longer ones get an empty member appended, which ends in zero.

Reading. Spark splits the files into byte ranges aligned to the byte 0x1f that
every gzip member starts with. A task scans its range for gzip magic, accepts a
candidate if its first bytes decode to a WARC header, and owns the records that
start inside. Records that run past a range are put together from the tail of
their range and the heads of the next ones; only those fragments shuffle.
"""

from __future__ import annotations

import base64
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recipeframe.functions.shared import hot_keys, lookup_join

_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id long, record_type string, refers_to long, uri string, date string, digest string, payload_bytes long, payload binary"


# ---------------------------------------------------------------- writing

def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _member(record_id, uri, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{record_id}>")
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()
    return out if out[-1] == 0 else out + _EMPTY


_pack = zlib.compressobj(6, zlib.DEFLATED, 31)
_EMPTY = _pack.compress(b"") + _pack.flush()


def _members(batches, date):
    for b in batches:
        rows = zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)
        held, size = [], 0
        for r in rows:
            held.append(_member(*r, date)[:-1])
            size += len(held[-1])
            if size > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])


def mark_revisits(records: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Add ``digest`` (hex SHA-1), ``refers_to`` (null for responses) to ``record_id, uri, payload``."""
    own = records.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload"))
    key = F.when(F.col("n_bytes") >= least_bytes, F.concat_ws(":", "digest", "n_bytes"))
    own = own.withColumn("same", key)
    groups = own.filter("same is not null").groupBy("same").agg(F.max("record_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    hot = hot_keys(groups, "same", "n")
    marked = lookup_join(own, groups.select("same", "first"), "same", hot)
    return marked.withColumn("refers_to", F.when(F.coalesce(F.col("record_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))).drop("same", "first", "n_bytes")


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 1000) -> None:
    """Write ``record_id long, uri string, payload binary`` as WARC files below ``path``.

    Null payloads are empty ones; a null ``uri`` or ``record_id`` leaves out its
    header. Control characters and spaces in URIs are percent-encoded. Payloads
    shorter than ``least_bytes`` are always responses. Rows with equal ids are
    all written. An empty table writes no record. Extra columns are ignored.
    """
    own = records.select("record_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = mark_revisits(own, least_bytes).select("record_id", "uri", "payload", "digest", "refers_to")
    lines = rows.mapInArrow(lambda it: _members(it, date), "member binary")
    lines.select(F.col("member").cast("string")).write.option("lineSep", "\u0000").option("compression", "none").text(path)


# ---------------------------------------------------------------- reading

def _inflate(data: memoryview, most: int | None = None):
    """The member at the start of ``data``: its content, and its size or None if it isn't complete."""
    unpack, out, at = zlib.decompressobj(31), [], 0
    while at < len(data) and not unpack.eof:
        step = data[at : at + (256 if most else 65536)]
        out.append(unpack.decompress(step, most or 0))
        at += len(step)
        if most:
            break
    return b"".join(out), (at - len(unpack.unused_data) if unpack.eof else None)


def _is_record(data: memoryview) -> bool | None:
    """Whether a WARC record starts here; None if too few bytes are left to tell."""
    if bytes(data[:3]) != _MAGIC[: len(data[:3])]:
        return False
    try:
        got, size = _inflate(data, 8)
    except zlib.error:
        return False
    return got.startswith(b"WARC/") if len(got) >= 5 else None if size is None and len(data) < 256 else False


def _parse(content: bytes):
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    block = block[: int(fields.get("Content-Length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    own, other = (x[len("<urn:page:") : -1] if x else None for x in (fields.get("WARC-Record-ID"), fields.get("WARC-Refers-To")))
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = fields.get("WARC-Type")
    return (
        int(own) if own else None, kind, int(other) if other else None, fields.get("WARC-Target-URI"), fields.get("WARC-Date"),
        base64.b32decode(digest).hex() if digest else None, size, payload if kind == "response" else None,
    )


def _candidates(data: bytes, at: int = 0):
    while (at := data.find(_MAGIC[:2], at)) >= 0:
        yield at
        at += 1


def _records(data: bytes):
    """All complete records of a byte range."""
    view, at = memoryview(data), 0
    for start in _candidates(data):
        if start < at or not _is_record(view[start:]):
            continue
        try:
            content, size = _inflate(view[start:])
        except zlib.error:
            continue
        if size is not None:
            at = start + size
            yield _parse(content)


def _fragments(data: bytes):
    """What a range can't decode alone: the bytes before its first record, and those of a last one that isn't complete."""
    view = memoryview(data)
    first = next((i for i in _candidates(data) if _is_record(view[i:])), None)
    if first is None:
        return data, b"", False
    at = len(data)
    while (at := data.rfind(_MAGIC[:2], 0, at)) >= 0:
        # the last start, or one that too few bytes are left to tell about
        told = _is_record(view[at:])
        if told is None:
            return data[:first], data[at:], True
        if told:
            break
    content = _inflate(view[at:])
    return data[:first], (data[at:] if content[1] is None else b""), True


def _ranges(batches):
    """Each range's place and bytes. Pieces are what lies between bytes 0x1f."""
    place, held = None, []
    for b in batches:
        for piece, path, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (path, start) != place:
                if held:
                    yield *place, b"\x1f".join(held)
                # a later range begins at a 0x1f that the one before has read over
                place, held = (path, start), [b""] if start else []
            held.append(piece)
    if held:
        yield *place, b"\x1f".join(held)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_SCHEMA = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _emit(records):
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[-1] or b"") + 200
        if size > 16 << 20:
            yield _batch(held, _SCHEMA)
            held, size = [], 0
    yield _batch(held, _SCHEMA)


def _own_records(batches):
    yield from _emit(r for _, _, data in _ranges(batches) for r in _records(data))


def _edges(batches):
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("any", pa.int32())])
    for path, start, data in _ranges(batches):
        head, tail, found = _fragments(data)
        yield _batch([(path, start, head, tail, int(found))], schema)


def _joined(table: pa.Table) -> pa.Table:
    parts = sorted(zip(table.column("at").to_pylist(), table.column("bytes").to_pylist(), strict=True))
    return pa.Table.from_batches(_emit(_records(b"".join(x for _, x in parts))))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files below ``path``, one row each, in no order.

    The files hold one gzip member per record; names must not end in ``.gz``,
    which Spark would unpack as a whole. Columns: ``record_id, record_type,
    refers_to, uri, date, digest`` (lower-case hex), ``payload_bytes`` (of the
    full payload, also for revisits), ``payload`` (null for revisits). Bytes that
    belong to no WARC record are skipped. A range is one split of the files, so
    ``spark.sql.files.maxPartitionBytes`` bounds a task's memory.
    """
    pieces = spark.read.schema("value string").option("lineSep", "\u001f").text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    whole = pieces.mapInArrow(_own_records, _RECORD)
    edges = pieces.mapInArrow(_edges, "path string, start long, head binary, tail binary, any int")
    order = W.partitionBy("path").orderBy("start")  # a row for each range of a file
    chain = edges.withColumn("chain", F.coalesce(F.sum("any").over(order), F.lit(0)).cast("long"))
    heads = chain.select("path", (F.col("chain") - F.col("any")).alias("chain"), (F.col("start") * 2).alias("at"), F.col("head").alias("bytes"))
    tails = chain.filter("any = 1").select("path", "chain", (F.col("start") * 2 + 1).alias("at"), F.col("tail").alias("bytes"))
    parts = heads.unionByName(tails).filter("octet_length(bytes) > 0")
    return whole.unionByName(parts.groupBy("path", "chain").applyInArrow(_joined, _RECORD))
