"""The pipeline beside a plain version of its five stages."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import zstandard

import corpus_pipeline
from quillgraph.llm.mixing import _rows, _times_taken, mixing_plan
from quillgraph.llm.quality_rules import judge
from quillgraph.llm.sentence_pieces import _sha
from quillgraph.llm.simhash import fingerprint
from tests.llm.test_operators import one_spaced
from tests.llm.test_simhash_tree import all_links, classes


def one_of_each_group(rows):
    """Row by row in order of id: those whose fingerprint reaches no earlier one by steps of three bits."""
    rows = sorted(rows)
    points = np.unique(np.array([fingerprint(text) for _, text, _ in rows], np.uint64))
    group = classes(points, all_links(points))
    stay = {}
    for row in rows:
        stay.setdefault(group[fingerprint(row[1])], row)
    return list(stay.values())


def test_rows(spark, tmp_path):
    from quillgraph.session import table
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()]
    squeeze = zstandard.ZstdCompressor(level=3)
    docs = [r for r in docs if judge(r[1], squeeze)[6]]
    first = {}
    for r in sorted(docs):
        first.setdefault(one_spaced(r[1]), r)
    docs = one_of_each_group(first.values())
    rows = _rows(spark.createDataFrame(docs, "doc_id long, text string, source string"), "doc_id", "source", "text")
    times = {r.doc_id: r.times for r in _times_taken(rows, mixing_plan(rows)).select("r.doc_id", "times").collect()}
    want = sorted((r[0], _sha(r[1])) for r in docs for _ in range(times[r[0]]))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == want
    assert len({r.doc_id for r in got}) > 50


def test_stages_keep_the_columns(spark):
    from quillgraph.session import table
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    kept = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] += 1
    assert len(kept) == 4
