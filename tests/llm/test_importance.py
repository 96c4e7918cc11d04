"""Importance resampling beside a plain version on checksums of the standard library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm.crc_features import BLOCK, length_constants, span_remainders
from quillgraph.llm.importance import BUCKETS, LEAST_WORDS, SEED, SHARE, _features, op11_importance, resample, resample_report
from tests.llm.test_operators import SCHEMA, prose

LONG = "".join(random.Random(5).choice("abcdé漢09") for _ in range(40_000))
ROWS = ([(i, prose(10 + 3 * i, i)) for i in range(40)]
        + [(7, prose(31, 7)), (7, prose(31, 7)), (7, prose(31, 7)), (50, None), (51, ""), (52, " .,; "), (53, LONG), (54, "one"), (None, prose(40, 3)), (None, prose(40, 3)),
           (None, None), (55, prose(6000, 8)), (56, "Zwei WÖRTER a-b_c " * 9), (57, prose(30, 2)), (58, prose(30, 2))])
TARGET = [(0, prose(50, 100)), (1, None), (2, ""), (3, prose(80, 2)), (3, prose(80, 2))]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_buckets(text):
    words = plain_words(text)
    return [zlib.crc32(f.encode()) % BUCKETS for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_report(rows, target):
    s, t = (Counter(b for _, text in table for b in plain_buckets(text)) for table in (rows, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + BUCKETS) / ((s[b] + 1) * (all_t + BUCKETS)))) for b in plain_buckets(text)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    eligible = sorted((r for r in out if r[5] >= LEAST_WORDS), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(eligible[:len(eligible) * SHARE[0] // SHARE[1]], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "r", "n", -1, -2, "l") for i, t in rows], SCHEMA).repartition(3)


def target_frame(spark, rows):
    return spark.createDataFrame(rows, "item long, passage string")


def report(spark, rows, target):
    got = resample_report(frame(spark, rows), target_frame(spark, target), target_text="passage")
    return Counter((r.id, r.n_features, r.weight, r.score, r.rank) for r in got.collect())


def test_checksums_of_spans_of_any_length():
    dice = random.Random(2)
    texts = [" ".join("".join(dice.choice("aZ9é😀") for _ in range(n)) for n in [1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK, 700, 5000] * 3), None, "", "x", LONG, "a b"]
    bucket, owner, words = _features(texts)
    for i, text in enumerate(texts):
        assert sorted(bucket[owner == i].tolist()) == sorted(plain_buckets(text))
        assert words[i] == len(plain_words(text))
    whole = np.frombuffer(LONG.encode(), np.uint8)
    size = np.array([len(whole)])
    assert int((span_remainders(whole, np.array([0]), size, np.array([0])) ^ length_constants(size))[0]) == zlib.crc32(LONG.encode())


def test_report_is_the_plain_one(spark):
    assert report(spark, ROWS, TARGET) == plain_report(ROWS, TARGET)


@pytest.mark.parametrize("rows, target", [([], TARGET), (ROWS[:9], []), ([(1, None), (None, "")], TARGET), ([(3, prose(30, 1))] * 11, TARGET)])
def test_empty_short_and_equal_rows(spark, rows, target):
    assert report(spark, rows, target) == plain_report(rows, target)


def test_draw_keeps_columns_and_as_many_rows_as_ranks(spark):
    docs = frame(spark, ROWS)
    out = resample(docs, target_frame(spark, TARGET), target_text="passage")
    assert out.columns == docs.columns
    want = Counter(row[0] for row, n in plain_report(ROWS, TARGET).items() if row[4] for _ in range(n))
    assert Counter(r.doc_id for r in out.collect()) == want
    same = frame(spark, [(3, prose(30, 1))] * 11)
    assert resample(same, target_frame(spark, TARGET), target_text="passage").count() == 2
    assert resample(frame(spark, []), target_frame(spark, TARGET), target_text="passage").count() == 0


def test_query_columns(spark):
    out = op11_importance(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
