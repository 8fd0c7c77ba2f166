"""Words of many texts at once, as Arrow arrays and numpy masks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

WORD, GAP, BREAK = 0, 1, 2


def byte_kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The kind of each byte: part of a word, between words, or between pieces that no phrase crosses."""
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


def cut_words(buf: bytes, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of ``buf``, and for each the number of breaks before it."""
    own = np.frombuffer(buf, dtype=np.uint8)
    kind = kinds[own]
    edge = np.diff(np.concatenate(([0], (kind == WORD).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own[kind == WORD]))])
    return words, np.cumsum(kind == BREAK)[starts]


def cut_text(text: bytes, most: int, delimiters: bytes, carry: int):
    """Parts of about ``most`` bytes of a text, and how many words of each were in the part before.

    A part ends at a delimiter, so words are never cut, however long. The next one
    starts with its last ``carry`` words, so that no phrase of ``carry + 1`` words is lost.
    """
    delimiter = re.compile(b"[" + re.escape(delimiters) + b"]")
    at, end, carried = 0, 0, 0
    while found := delimiter.search(text, end + most):
        end = found.start()
        yield text[at:end], carried
        start, carried = end, 0
        while carried < carry:
            last = start
            while last > at and text[last - 1] in delimiters:
                last -= 1
            if last == at:
                break
            start = max(at, *(text.rfind(x, at, last) + 1 for x in (delimiters[i : i + 1] for i in range(len(delimiters)))))
            carried += 1
        at = start
    yield text[at:], carried
