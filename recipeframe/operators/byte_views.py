"""Bytes as pictures and tokens: cut or filled up with zeros to a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _byte(hexed: Column, at: Column) -> Column:
    return F.conv(F.substring(hexed, 2 * at + 1, F.lit(2)), 16, 10).cast("int")


def _fixed(content: Column, size: int) -> Column:
    return F.rpad(F.hex(F.substring(F.coalesce(content, F.lit(b"").cast("binary")), 1, size)), 2 * size, "0")


def rgb_cells(df: DataFrame, key: str, content: str, cells: int) -> DataFrame:
    """``key, cell, r, g, b``: three bytes a cell, of the first ``3 * cells`` bytes; a null content is all zeros."""
    own = df.select(key, _fixed(F.col(content), 3 * cells).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    return own.select(key, "cell", *[_byte(F.col("_h"), 3 * F.col("cell") + k).alias(c) for k, c in enumerate("rgb")])


def patch_tokens(df: DataFrame, key: str, content: str, patches: int, patch_bytes: int, scaled: bool = True) -> DataFrame:
    """``key, patch, token``: each patch's bytes in a row, divided by 255 if ``scaled``."""
    own = df.select(key, _fixed(F.col(content), patches * patch_bytes).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(patches - 1))).alias("patch"))
    values = F.array(*[_byte(F.col("_h"), patch_bytes * F.col("patch") + k) for k in range(patch_bytes)])
    return own.select(key, "patch", (F.transform(values, lambda v: v / 255) if scaled else values).alias("token"))
