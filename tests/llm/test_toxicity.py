"""Toxicity on made-up prose with marked words, held-out accuracy on the driver tables, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillgraph.llm.toxicity import (
    STEP, WINDOW, context_counts, fit_toxicity, letters_of, marking_stems, op12_toxicity, spread_words, toxicity_scores, windows_of)

SCHEMA = "doc_id long, text string, score double, label string, row string"
SYLLABLES = "an be co da el fi go ha il jo ka lu me ni or pa qui ra so tu".split()
MARKS = ["grumbag", "snoddle", "wretchling"]


def prose(seed: int, words: int = 150, marked: float = 0.0) -> str:
    dice = random.Random(seed)
    return " ".join(dice.choice(MARKS) + dice.choice(["", "s", "y"]) if dice.random() < marked else "".join(dice.choices(SYLLABLES, k=dice.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, prose(i, 80 + i % 200, 0.06 if i % 4 == 0 else 0.0), 1.0, "l", "r") for i in range(400)]
    docs += [(4, prose(4, 90), 1.0, "l", "r"), (None, prose(9), 1.0, "l", "r"), (5, None, 1.0, "l", "r")]
    labels = [(i, int(i % 4 == 0), 1) for i in range(320)] + [(None, 1, 1), (9999, 1, 1), (10, None, 1)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_stems_come_from_contexts_not_from_copies():
    clean = [prose(i).encode().split() for i in range(60)]
    toxic = [prose(100 + i, marked=0.05).encode().split() for i in range(30)]
    stems = marking_stems(toxic, clean)
    assert {m[:4].encode() for m in MARKS} <= {s[:4] for s in stems}
    copies = [["one", "copied", "unheard", "passage"]] * 500
    copied = [[w.encode() for w in c] for c in copies]
    assert not any(s.startswith((b"cop", b"unh", b"pas")) for s in marking_stems(toxic + copied, clean))
    counts, total = context_counts([[b"abc", b"abd"], [b"abc", b"abd"], [b"abc"]])
    assert counts[b"abc "] == 2 and total == 3
    assert marking_stems([], clean) == []


def test_windows_cover_every_word():
    for n in (0, 1, WINDOW - 1, WINDOW, WINDOW + 1, 5 * WINDOW + STEP - 1):
        words = [b"w%d" % i for i in range(n)]
        assert {w for window in windows_of(words) for w in window.split()} == set(words) and windows_of(words)
    long = [b"%d" % i for i in range(100_000)]
    assert len(spread_words(long)) == 600 and spread_words(long)[0] == b"0" and spread_words(long)[-1] == b"99999"
    assert letters_of("Ä b9C\n") == ["Ä".encode(), b"b", b"c"] and letters_of(None) == []


def test_scores_tell_held_out_documents_apart(tables):
    docs, labels = tables
    model = fit_toxicity(docs, labels)
    rows = [r for r in toxicity_scores(docs, model, carry=("doc_id",)).collect() if r.row.doc_id and r.row.doc_id >= 320]
    right = [(r.score >= 0.5) == (r.row.doc_id % 4 == 0) for r in rows]
    assert len(rows) == 80 and np.mean(right) > 0.95
    again = fit_toxicity(docs.repartition(7), labels.repartition(5))
    assert again.toxic == model.toxic and again.ordinary == model.ordinary


def test_odd_rows_and_columns(spark, tables):
    docs, labels = tables
    model = fit_toxicity(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "9 ."), (2, "漢" * 50_000), (3, prose(3, 60_000)), (3, prose(3, 60_000)), (4, prose(5, 40_000, 0.08))], "doc_id long, text string")
    got = {}
    for r in toxicity_scores(odd, model).collect():
        got.setdefault((r.row.doc_id, r.row.text), set()).add(r.score)
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in got.values())
    assert min(got[(4, prose(5, 40_000, 0.08))]) > 0.5 > min(got[(3, prose(3, 60_000))])
    assert min(got[(1, None)]) < 0.5
    out = toxicity_scores(docs, model)
    assert out.select("row.*").columns == docs.columns and out.count() == 403
    assert toxicity_scores(docs.limit(0), model).count() == 0


def test_without_labels_of_both_kinds(tables):
    docs, labels = tables
    nothing = fit_toxicity(docs, labels.filter("toxic IS NULL"))
    assert max(r.score for r in toxicity_scores(docs, nothing).collect()) < 1e-9
    only = fit_toxicity(docs, labels.filter("toxic = 0"))
    assert max(r.score for r in toxicity_scores(docs, only).collect()) < 1e-6


def test_accuracy_on_labels_never_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    scores = op12_toxicity(spark, sf)
    assert scores.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scores.filter("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    toxic, clean = (sorted(r.score for r in rows if r.toxic == k) for k in (1, 0))
    auc = (np.searchsorted(clean, toxic, "left") + np.searchsorted(clean, toxic, "right")).mean() / 2 / len(clean)
    assert auc > 0.94
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.6
