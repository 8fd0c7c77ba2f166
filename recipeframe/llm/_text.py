"""Byte-level helpers shared by the text operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all other bytes unchanged: safe on UTF-8.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Never a byte of valid UTF-8, so it can mark the end of a text.
END = 0xFF

_ENDS_UNIT = np.zeros(256, dtype=bool)
_ENDS_UNIT[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, END]] = True


def cut_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case texts and cut them after every whitespace byte and at their end.

    Returns the bytes (each text closed by ``END``), the units' end offsets and
    the index of each unit's text. The units of a text join up to that text, so
    nothing is lost; a unit without its last byte is a token, or empty.
    """
    joined = b"\xff".join(t.replace(b"\xff", b"\xfe") for t in texts) + b"\xff" if texts else b""
    buf = np.frombuffer(joined.translate(LOWER), dtype=np.uint8)
    ends = np.flatnonzero(_ENDS_UNIT[buf]) + 1
    last = buf[ends - 1] == END
    return buf, ends, np.cumsum(last) - last


def binary_array(buf: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The units as an Arrow array that shares their bytes."""
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(buf)])


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def cut_segments(text: bytes, most: int) -> list[bytes]:
    """Cut a text after the first white space from every ``most`` bytes on; a word is never cut. At least one part."""
    parts, at = [], 0
    while at < len(text) or not parts:
        space = _SPACE.search(text, at + most)
        cut = space.end() if space else len(text)
        parts.append(text[at:cut])
        at = cut
    return parts


def in_pieces(rows, most_bytes: int):
    """Group ``(key, text)`` pairs into lists of about ``most_bytes`` of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held
