"""Bitmaps of a bounded size that tell which keys may be in a set. They let through too much, never too little."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 32768  # bits in one value of bitmap_construct_agg
ROW_BITS = 1 << 26  # 8 MiB: bitmaps that are joined to rows


def pages_of(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """The set of keys (longs, well mixed) as pages: at most bits / PAGE_BITS rows of 4 KiB."""
    slots = keys.select(F.pmod(key, F.lit(bits)).alias("slot"))
    return (slots.groupBy(F.floor(F.col("slot") / PAGE_BITS).alias("_page"))
            .agg(F.bitmap_construct_agg(F.col("slot") % PAGE_BITS).alias("_bits")))


def with_membership(rows: DataFrame, pages: DataFrame, key: Column, bits: int, name: str) -> DataFrame:
    """Adds a boolean: whether the key's bit is set. The pages have a fixed largest size, so they are broadcast."""
    slot = F.pmod(key, F.lit(bits))
    at = (slot % PAGE_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_at_page", F.floor(slot / PAGE_BITS))
            .join(F.broadcast(pages), F.col("_at_page") == F.col("_page"), "left")
            .withColumn(name, F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)))
            .drop("_at_page", "_page", "_bits"))


def as_array(pages: DataFrame, bits: int) -> np.ndarray:
    """The bitmap as bits / 8 bytes on the driver. The caller bounds the bits."""
    out = np.zeros(max(bits, PAGE_BITS) // 8, np.uint8)
    for page, value in pages.select("_page", "_bits").toLocalIterator():
        out[page * (PAGE_BITS // 8):(page + 1) * (PAGE_BITS // 8)] = np.frombuffer(bytes(value), np.uint8)
    return out


def in_array(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which of the keys (int64) have their bit set."""
    slot = keys.view(np.int64) % bits
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
