"""XML documents as a table of nodes.

Each document is parsed once, in a task; all that follows is joins and
aggregates of the node table. A node knows its ancestors' ids, so the record or
branch it belongs to is a lookup in an array, not a join, and its number (from 0) among the
children of its name, so how often names repeat below their parents is counted without a group for each parent. A document that isn't
well-formed, has a DTD, or passes a limit gives one row with ``error``: it is
read once to see that it is fine, and then again for its nodes. Of a document of
up to ``MOST_AT_ONCE`` bytes that has plain tags and texts only, these are found
by whole columns of positions; all others are read by events and leave in
batches, so that a task never holds more of a large document than its bytes, the
branch being read and a batch.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_file string, node_id long, parent_id long, ancestors array<long>, path string, tag string, depth int, sibling int, text string, tail string, attributes map<string,string>, nil boolean, leaf boolean, error string, occurrence int"
_ARROW = pa.schema([
    ("source_file", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("ancestors", pa.list_(pa.int64())), ("path", pa.string()), ("tag", pa.string()), ("depth", pa.int32()), ("sibling", pa.int32()),
    ("text", pa.string()), ("tail", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("nil", pa.bool_()), ("leaf", pa.bool_()), ("error", pa.string()), ("occurrence", pa.int32()),
])
_NAMESPACES = "source_file string, prefix string, uri string"
_NIL = "{http://www.w3.org/2001/XMLSchema-instance}nil"
#: Limits of a document; fixed values.
MOST_ELEMENTS, MOST_DEPTH = 2_000_000, 512
_BATCH = 50_000
MOST_AT_ONCE = 8 << 20
_ATTRIBUTE = re.compile(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(lt|gt|amp|quot|apos));")
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def step(qname: str) -> str:
    """A name as a step of a canonical path."""
    return qname.replace("~", "~0").replace("/", "~1")


def _name(x: str) -> str:
    """``{uri}local`` of a parser's name."""
    return "{" + x if "}" in x else x


class _Refused(Exception):
    pass


def _check(content: bytes) -> str | None:
    """Why a document isn't read, or None."""
    parser, count, depth = expat.ParserCreate(namespace_separator="}"), 0, 0

    def start(name, attributes):
        nonlocal count, depth
        count, depth = count + 1, depth + 1
        if count > MOST_ELEMENTS or depth > MOST_DEPTH:
            raise _Refused("too many elements or levels")

    def doctype(*_):
        raise _Refused("document type declarations are not read")

    def end(name):
        nonlocal depth
        depth -= 1

    parser.StartDoctypeDeclHandler = doctype
    if not _within_limits(content):
        parser.StartElementHandler, parser.EndElementHandler = start, end
    try:
        parser.Parse(content, True)
    except _Refused as x:
        return str(x)
    except expat.ExpatError as x:
        return f"not well-formed: {x}"
    return None


def _within_limits(content: bytes) -> bool:
    """Whether a document's tags, if it is well-formed and nothing else has a ``<``, surely keep to the limits."""
    if b"<!" in content or b"<?" in content or b"\0" in content or content.count(b"<") > MOST_ELEMENTS:
        return False
    buf = np.frombuffer(content, dtype=np.uint8)
    lt, gt = np.flatnonzero(buf == ord("<")), np.flatnonzero(buf == ord(">"))
    if len(lt) != len(gt) or (lt >= gt).any():
        return False
    closes, alone = buf[lt + 1] == ord("/"), buf[gt - 1] == ord("/")
    return int(np.cumsum(np.where(closes, -1, np.where(alone, 0, 1))).max(initial=0)) < MOST_DEPTH


class _Shredder:
    """Collects the nodes of one document as columns; each is complete once the text behind it is known."""

    def __init__(self, source: str):
        self.source, self.count, self.paths = source, 0, {}
        self.stack: list[list] = []  # open nodes: id, path, tag, children, text, attributes, sibling, occurrence, children by path
        self.closed: list[tuple | None] = []  # for each open node, its last closed child, whose tail is awaited
        self.chars: list[str] = []
        self.clear()

    def clear(self):
        self.ids, self.parents, self.flat, self.path, self.tag, self.depth, self.sibling, self.occurrence = [], [], [], [], [], [], [], []
        self.text, self.tail, self.names, self.values, self.own, self.nil, self.leaf = [], [], [], [], [], [], []

    def _chars(self) -> str | None:
        """The text since the last mark."""
        out = "".join(self.chars) if self.chars else None
        self.chars.clear()
        return out

    def start(self, name, attributes):
        text, name = self._chars(), _name(name)
        up = self.stack[-1] if self.stack else None
        if up is None:
            path, sibling, occurrence = "/" + step(name), 0, 0
        else:
            if up[3]:
                self._write(self.closed[-1], text)
                self.closed[-1] = None
            else:
                up[4] = text
            key = (up[1], name)
            path, sibling = self.paths.get(key) or self.paths.setdefault(key, f"{up[1]}/{step(name)}"), up[3]
            up[3] += 1
            occurrence = up[8].get(path, 0)
            up[8][path] = occurrence + 1
        self.stack.append([self.count, path, name, 0, None, attributes, sibling, occurrence, {}])
        self.closed.append(None)
        self.count += 1

    def end(self, _):
        text = self._chars()
        node, last = self.stack.pop(), self.closed.pop()
        if node[3]:
            self._write(last, text)
        else:
            node[4] = text
        done = (node, [n[0] for n in self.stack])
        if self.closed:
            self.closed[-1] = done
        else:
            self._write(done, None)

    def _write(self, done, tail):
        (node, children_of), above = done, done[1]
        at, path, tag, children, text, attributes, sibling, occurrence, _ = node
        self.ids.append(at)
        self.parents.append(above[-1] if above else None)
        self.flat += above
        self.flat.append(at)
        self.path.append(path)
        self.tag.append(tag)
        self.depth.append(len(above))
        self.sibling.append(sibling)
        self.occurrence.append(occurrence)
        self.text.append(text)
        self.tail.append(tail)
        self.leaf.append(not children)
        self.own.append(len(attributes))
        if attributes:
            own = sorted((_name(k), v) for k, v in attributes.items())
            self.names += [k for k, _ in own]
            self.values += [v for _, v in own]
            self.nil.append(any(k == _NIL and v.strip().lower() in ("true", "1") for k, v in own))
        else:
            self.nil.append(False)

    def batch(self) -> pa.RecordBatch:
        n = len(self.ids)
        offsets = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        columns = [
            pa.array([self.source] * n, pa.string()), pa.array(self.ids, pa.int64()), pa.array(self.parents, pa.int64()),
            pa.ListArray.from_arrays(offsets(np.array(self.depth, dtype=np.int64) + 1), pa.array(self.flat, pa.int64())),
            pa.array(self.path, pa.string()), pa.array(self.tag, pa.string()), pa.array(self.depth, pa.int32()), pa.array(self.sibling, pa.int32()),
            pa.array(self.text, pa.string()), pa.array(self.tail, pa.string()), pa.MapArray.from_arrays(offsets(self.own), pa.array(self.names, pa.string()), pa.array(self.values, pa.string())),
            pa.array(self.nil, pa.bool_()), pa.array(self.leaf, pa.bool_()), pa.nulls(n, pa.string()), pa.array(self.occurrence, pa.int32()),
        ]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _unescaped(x: str) -> str:
    return _ENTITY.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else _ENTITIES[m[3]], x) if "&" in x else x


def _stretches(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of some bytes, as texts."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=offsets[1:])
    own = buf[np.repeat(starts - offsets[:-1], size) + np.arange(int(offsets[-1]))]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(own)])


def _texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """As ``_stretches``, but without references, and null where there is none."""
    raw = _stretches(buf, starts, ends)
    if (buf == ord("&")).any():
        raw = pa.array([_unescaped(x) for x in raw.to_pylist()], pa.string())
    return pc.if_else(pa.array(ends > starts), raw, pa.scalar(None, pa.string()))


def _rank(key: np.ndarray) -> np.ndarray:
    """Each row's number among the rows before it with its key."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    change = np.ones(len(own), dtype=bool)
    change[1:] = own[1:] != own[:-1]
    first = np.flatnonzero(change)
    out = np.empty(len(own), dtype=np.int32)
    out[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return out


def _shred_at_once(source: str, content: bytes) -> pa.RecordBatch | None:
    """All nodes of a well-formed document; None if it isn't plain enough: declarations, comments, ``>`` in values, namespaces below the root."""
    if len(content) > MOST_AT_ONCE or content[:1] != b"<" or b"<!" in content or b"<?" in content or b"\r" in content or b"\0" in content:
        return None
    buf = np.frombuffer(content, dtype=np.uint8)
    lt, gt = np.flatnonzero(buf == ord("<")), np.flatnonzero(buf == ord(">"))
    if len(lt) != len(gt) or (lt >= gt).any() or (gt[:-1] >= lt[1:]).any():
        return None
    blanks = np.flatnonzero((buf == 9) | (buf == 10))
    if len(blanks) and (blanks < gt[np.maximum(np.searchsorted(lt, blanks) - 1, 0)]).any():
        return None
    closes, alone = buf[lt + 1] == ord("/"), buf[gt - 1] == ord("/")
    tags = np.flatnonzero(~closes)
    n, inner = len(tags), alone[tags]
    after = np.cumsum(np.where(closes, -1, np.where(alone, 0, 1)))
    depth = after[tags] - 1 + inner
    # names and attributes
    starts, ends = lt[tags] + 1, gt[tags] - inner
    space = np.append(np.flatnonzero(buf == 32), len(buf))
    first = space[np.searchsorted(space, starts)]
    named = np.minimum(first, ends)
    coded = _stretches(buf, starts, named).dictionary_encode()
    raw, name = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    more = np.flatnonzero(first < ends)
    bodies = _stretches(buf, named[more], ends[more]).dictionary_encode()
    parsed = [[(m[1], _unescaped(m[2] if m[2] is not None else m[3])) for m in _ATTRIBUTE.finditer(x)] for x in bodies.dictionary.to_pylist()]
    body = bodies.indices.to_numpy()
    spaces = {"xml": "http://www.w3.org/XML/1998/namespace"}
    declared = lambda k: k == "xmlns" or k.startswith("xmlns:")
    for i, own in enumerate(parsed):
        if any(declared(k) for k, _ in own):
            if (more[body == i] != 0).any():
                return None
            spaces |= {k[6:]: v for k, v in own if declared(k)}

    def expanded(x: str, default: str) -> str:
        prefix, _, local = x.rpartition(":")
        uri = spaces[prefix] if prefix else default
        return f"{{{uri}}}{local}" if uri else local

    names = [expanded(x, spaces.get("", "")) for x in raw]
    parsed = [sorted((expanded(k, ""), v) for k, v in own if not declared(k)) for own in parsed]
    count = np.zeros(n, dtype=np.int64)
    count[more] = np.array([len(x) for x in parsed], dtype=np.int64)[body]
    nil = np.zeros(n, dtype=bool)
    nil[more] = np.array([any(k == _NIL and v.strip().lower() in ("true", "1") for k, v in own) for own in parsed], dtype=bool)[body]
    keys, values = [k for b in body.tolist() for k, _ in parsed[b]], [v for b in body.tolist() for _, v in parsed[b]]
    # ancestors, paths and end tags, level by level
    ids, offsets = np.arange(n), np.zeros(n + 1, dtype=np.int32)
    np.cumsum(depth + 1, out=offsets[1:])
    above, parent, path = np.empty(int(offsets[-1]), dtype=np.int64), np.full(n, -1), np.zeros(n, dtype=np.int64)
    end, paths = tags.copy(), []
    for level in range(int(depth.max()) + 1):
        own, deeper = np.flatnonzero(depth == level), np.flatnonzero(depth >= level)
        above[offsets[deeper] + level] = own[np.searchsorted(own, deeper, "right") - 1]
        end[own[~inner[own]]] = np.flatnonzero(closes & (after == level))
        if level:
            parent[own] = above[offsets[own] + level - 1]
        key, where = np.unique((path[parent[own]] if level else np.zeros(len(own), dtype=np.int64)) * len(names) + name[own], return_inverse=True)
        path[own] = where + len(paths)
        paths += [(paths[k // len(names)] if level else "") + "/" + step(names[k % len(names)]) for k in key.tolist()]
    following = np.append(lt[1:], len(buf))
    start_text, start_tail = gt[tags] + 1, gt[end] + 1
    tail_end = np.where(ids == 0, start_tail, following[end])
    strings = lambda values, at: pa.array(values, pa.string()).take(pa.array(at))
    columns = [
        strings([source], np.zeros(n, dtype=np.int64)), pa.array(ids, pa.int64()), pa.array(parent, pa.int64(), mask=parent < 0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(above)),
        strings(paths, path), strings(names, name), pa.array(depth.astype(np.int32)), pa.array(_rank(parent)),
        _texts(buf, start_text, np.where(inner, start_text, following[tags])), _texts(buf, start_tail, tail_end),
        pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys, pa.string()), pa.array(values, pa.string())),
        pa.array(nil), pa.array(np.bincount(parent[1:], minlength=n) == 0), pa.nulls(n, pa.string()), pa.array(_rank(parent * len(paths) + path)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def shred(source: str, content: bytes) -> list[tuple]:
    """All nodes of a document in order, or one row with an error."""
    rows = [tuple(r.values()) for b in shred_batches(source, content) for r in b.to_pylist()]
    return sorted(rows, key=lambda r: r[1] or 0)


def shred_batches(source: str, content: bytes):
    """Batches of the nodes of a document, or of one row with an error."""
    if why := _check(content):
        yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), *[pa.array([why], pa.string()) if f.name == "error" else pa.nulls(1, f.type) for f in list(_ARROW)[1:]]], schema=_ARROW)
        return
    if (whole := _shred_at_once(source, content)) is not None:
        for i in range(0, whole.num_rows, _BATCH):
            yield whole.slice(i, _BATCH)
        return
    parser, nodes = expat.ParserCreate(namespace_separator="}"), _Shredder(source)
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = nodes.start, nodes.end, nodes.chars.append
    for i in range(0, len(content), 1 << 18):
        parser.Parse(content[i : i + (1 << 18)], False)
        if len(nodes.ids) >= _BATCH:
            yield nodes.batch()
    parser.Parse(b"", True)
    yield nodes.batch()


def _shred_batches(batches):
    for b in batches:
        for source, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield from shred_batches(source, content.as_py() or b"")


def dealt(documents: DataFrame) -> DataFrame:
    """``source_file, content`` over all tasks.

    Documents are much smaller than their nodes, so a few files or coalesced
    partitions hold many of them: they are dealt to all tasks before they are parsed.
    """
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.select("source_file", "content").repartition(tasks, "source_file")


def shred_documents(documents: DataFrame) -> DataFrame:
    """Nodes of ``source_file string, content binary``."""
    return dealt(documents).mapInArrow(_shred_batches, SCHEMA)


def _prefixes(batches):
    for b in batches:
        rows = []
        for source, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            content = content.as_py() or b""
            if _check(content):
                continue
            parser, seen = expat.ParserCreate(namespace_separator="}"), {}
            parser.StartNamespaceDeclHandler = lambda prefix, uri, seen=seen: seen.setdefault((prefix or "", uri or ""), len(seen))
            parser.Parse(content, True)
            rows += [(source, prefix, uri) for prefix, uri in seen]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["source_file", "prefix", "uri"])


def namespaces(documents: DataFrame) -> DataFrame:
    """``source_file, prefix, uri`` of each distinct declaration; the default namespace has an empty prefix."""
    return documents.select("source_file", "content").mapInArrow(_prefixes, _NAMESPACES)


def read_documents(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Files below a folder, as ``source_file, content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("source_file"), "content")


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
