"""Incompressible text goes at every length that compression can judge, clean prose stays."""

from __future__ import annotations

import base64
import random
import string

import pytest
import zstandard

from quillgraph.llm.quality_rules import judge
from tests.llm.test_operators import prose

SQUEEZE = zstandard.ZstdCompressor(level=3)
LETTERS = string.ascii_letters + string.digits


def kept(text):
    return judge(text, SQUEEZE)[6]


def in_words(line, n_bytes, size):
    return " ".join(line[i:i + size] for i in range(0, n_bytes, size))[:n_bytes]


@pytest.mark.parametrize("n_bytes", [250, 500, 1000, 2000, 4000, 6000, 20_000])
@pytest.mark.parametrize("size", [8, 9, 10])
def test_junk_goes_and_prose_stays(n_bytes, size):
    for seed in range(20):
        dice = random.Random(1000 * size + seed)
        assert not kept(in_words(base64.b64encode(dice.randbytes(n_bytes)).decode(), n_bytes, size))
        assert not kept(in_words("".join(dice.choices(LETTERS, k=n_bytes)), n_bytes, size))
        assert kept(prose(n_bytes, seed)[:n_bytes])


def test_junk_after_the_last_whole_chunk_and_in_some_chunks():
    dice = random.Random(4)
    junk = in_words(base64.b64encode(dice.randbytes(20_000)).decode(), 20_000, 10)
    clean = prose(10_000, 3)
    assert kept(clean[:40_000])
    assert not kept(clean[:8190] + "\n\n" + junk[:4000])  # a third, all after the second chunk
    assert not kept(clean[:4096 * 5] + junk[:4096 * 3])  # three chunks of eight
    assert kept(clean[:4096 * 5] + junk[:500])
