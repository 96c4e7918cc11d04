"""CRC-32 of many byte spans at once, from a table of byte contributions by distance from the span's end.

CRC-32 is affine over bits: the value of a span is a constant of its length, XORed with one contribution for each byte
that depends only on the byte and on how many bytes follow it. Contributions at a distance of up to BLOCK come from a
table and are XORed over all spans by bitwise_xor.reduceat. Longer spans are cut, from their end, into blocks of that many
bytes; pairs of neighbouring blocks are folded, level by level, by the table of the shift that parts them.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

BLOCK = 64
LENGTHS = 4096


def _shifted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as four tables of 256 values, of every value."""
    parts = [table[k][(values >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


def _map_of(images: np.ndarray) -> np.ndarray:
    """Four tables of 256 values of the linear map that takes bit i to images[i]."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k, np.arange(256) >> bit & 1 == 1] ^= images[8 * k + bit]
    return out


@cache
def byte_table() -> np.ndarray:
    """Row d: contribution of each byte value that d more bytes follow."""
    table = np.empty((BLOCK, 256), np.uint32)
    for d in range(BLOCK):
        zero = zlib.crc32(bytes(d + 1))
        table[d] = [zlib.crc32(bytes([b]) + bytes(d)) ^ zero for b in range(256)]
    return table


@cache
def _one_byte() -> np.ndarray:
    """The map of a remainder that one more zero byte follows."""
    low = byte_table()[0]
    return _map_of(np.array([low[1 << i] if i < 8 else 1 << (i - 8) for i in range(32)], np.uint32))


@cache
def fold_table(level: int) -> np.ndarray:
    """The map of a remainder that BLOCK << level zero bytes follow."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if level:
        half = fold_table(level - 1)
        return _map_of(_shifted(_shifted(images, half), half))
    for _ in range(BLOCK):
        images = _shifted(images, _one_byte())
    return _map_of(images)


@cache
def _known_lengths() -> np.ndarray:
    return np.array([zlib.crc32(bytes(n)) for n in range(LENGTHS)], np.uint32)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes."""
    out = _known_lengths()[np.minimum(lengths, LENGTHS - 1)]
    for at in np.flatnonzero(lengths >= LENGTHS):
        out[at] = zlib.crc32(bytes(int(lengths[at])))
    return out


def span_remainders(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """XOR of the contributions of spans that lie one behind another and cover `data` (bytes).

    A span starts at starts[i], has counts[i] > 0 bytes, and after[i] more bytes of its feature follow it.
    """
    if not len(starts):
        return np.zeros(0, np.uint32)
    far = np.repeat(starts + counts - 1 + after, counts) - np.arange(len(data))
    part = byte_table()[far & (BLOCK - 1), data]
    if int((counts + after).max()) <= BLOCK:
        return np.bitwise_xor.reduceat(part, starts)
    block = far // BLOCK
    span = np.repeat(np.arange(len(starts)), counts)
    level = 0
    while True:
        heads = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (block[1:] != block[:-1])])
        part, span, block = np.bitwise_xor.reduceat(part, heads), span[heads], block[heads]
        if not block.any():
            return part
        part = np.where(block & 1, _shifted(part, fold_table(level)), part)
        block >>= 1
        level += 1


def feature_crcs(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every word and of every pair of neighbouring words with one space between them.

    `data` holds the words, each with one space behind it; word i has counts[i] bytes from starts[i] on. follows[i] tells
    whether word i + 1 belongs to the same text; pairs are those (i, i + 1), in order.
    """
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    # Seen from the next word's end a word and its space are one span, so a pair is two spans XORed.
    bare = np.delete(data, starts + counts)
    words = span_remainders(bare, starts - np.arange(len(starts)), counts, np.zeros(len(starts), np.int64))
    first = np.flatnonzero(follows)
    behind = np.append(counts[1:], 0)
    leads = span_remainders(data, starts, counts + 1, np.where(follows, behind, 0))[first]
    pairs = leads ^ words[first + 1] ^ length_constants((counts + 1 + behind)[first])
    return words ^ length_constants(counts), pairs
