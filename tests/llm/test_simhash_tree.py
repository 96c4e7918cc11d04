"""Links found through vantage-point trees beside all pairs: random, clustered and inseparable fingerprints."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from quillgraph.llm.components import component_labels
from quillgraph.llm.simhash import fingerprint, linked_fingerprints, near_duplicate_classes, op8_simhash
from quillgraph.llm.vantage_tree import LEAF, build_tree, groups_of_ball, leaf_pairs, routed, shard_pairs

RADIUS = 3


def random_prints(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def clustered(seed, centres=60, each=40, bits=2):
    """Members at up to `bits` bits around centres, so that groups chain and overlap."""
    dice = np.random.default_rng(seed)
    flips = np.uint64(1) << dice.integers(0, 64, (centres, each, bits), dtype=np.uint64)
    return np.unique(np.bitwise_xor.reduce(flips, axis=2) ^ random_prints(centres, seed)[:, None])


def classes(points, pairs):
    """Smallest member reached from every point over the pairs."""
    above = {p: p for p in points.tolist()}

    def top(p):
        while above[p] != p:
            p = above[p]
        return p

    for a, b in pairs:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {p: top(p) for p in above}


def all_links(points):
    for i, p in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1:] ^ p) <= RADIUS):
            yield int(p), int(points[i + 1 + j])


def mixed(seed):
    return np.unique(np.concatenate([clustered(seed), random_prints(3000, seed + 1), random_prints(1, 5) ^ np.arange(300, dtype=np.uint64)]))


def test_every_link_meets_in_some_shard():
    points = mixed(1)
    tree = build_tree(points[::3], len(points), 300, RADIUS)
    assert tree.shards > 8
    row, shard = routed(tree, points, RADIUS)
    at = [set() for _ in points]
    for r, s in zip(row.tolist(), shard.tolist()):
        assert s not in at[r]
        at[r].add(s)
    where = {p: at[i] for i, p in enumerate(points.tolist())}
    links = list(all_links(points))
    assert len(links) > 500 and all(where[a] & where[b] for a, b in links)
    # The bounds prune: no shard holds nearly all, and members are not sent everywhere.
    assert np.bincount(shard).max() < len(points) / 2 and len(row) < len(points) * tree.shards / 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_of_a_shard_connect_what_links_connect(seed):
    points = mixed(seed)
    assert len(points) > 4 * LEAF
    pairs = shard_pairs(points, RADIUS)
    assert (np.bitwise_count(points) >= 0).all()
    assert classes(points, pairs.tolist()) == classes(points, all_links(points))
    part = points[:LEAF]
    assert classes(part, leaf_pairs(part, RADIUS).tolist()) == classes(part, all_links(part))


def test_members_that_no_point_tells_apart():
    # All members at one or two bits around a point that is none of them, and a code whose words are 4 or more apart.
    ball = np.array([(1 << i) | (1 << j) for i in range(64) for j in range(i + 1, 64)], np.uint64)
    assert classes(ball, shard_pairs(ball, RADIUS).tolist()) == classes(ball, all_links(ball))
    root = groups_of_ball(ball, RADIUS)
    assert (root == ball.min()).all()
    apart = np.array([sum(15 << 4 * i for i in range(16) if n >> i & 1) for n in range(2000)], np.uint64)
    assert not len(shard_pairs(apart, RADIUS))
    assert (groups_of_ball(apart, RADIUS) == apart).all()


def test_small_and_empty_shards():
    none = np.empty(0, np.uint64)
    assert shard_pairs(none, RADIUS).shape == (0, 2)
    assert build_tree(none, 0, 10, RADIUS).shards == 1
    assert shard_pairs(np.array([0, 7], np.uint64), RADIUS).tolist() == [[7, 0]]
    assert not len(shard_pairs(np.array([0, 15], np.uint64), RADIUS))


def test_components_over_many_shards(spark):
    points = mixed(4)
    prints = spark.createDataFrame([(p,) for p in points.view(np.int64).tolist()], "fp long").repartition(5)
    labels = component_labels(linked_fingerprints(prints, RADIUS, 400)).collect()
    got = {}
    for r in labels:
        got.setdefault(r.label, set()).add(r.node % (1 << 64))
    want = {}
    for p, root in classes(points, all_links(points)).items():
        want.setdefault(root, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_query_beside_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    points = np.unique(np.array([fp for _, fp in rows], np.uint64))
    of = classes(points, all_links(points))
    first = {}
    for doc_id, fp in rows:
        first[of[fp]] = min(doc_id, first.get(of[fp], doc_id))
    want = sorted((doc_id, f"{fp:016x}", first[of[fp]]) for doc_id, fp in rows)
    assert sorted(map(tuple, op8_simhash(spark, sf).collect())) == want


def test_other_radius_and_shingle(spark):
    dice = random.Random(3)
    words = [f"w{dice.randrange(9000)}" for _ in range(300)]
    near = words[:150] + ["other"] + words[151:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    apart = (fingerprint(" ".join(words), 2) ^ fingerprint(" ".join(near), 2)).bit_count()
    for radius in (0, apart - 1, apart):
        got = {r.id: r.component_id for r in near_duplicate_classes(docs, shingle=2, radius=max(radius, 0)).collect()}
        assert (got[2] == 1) == (radius >= apart)


def test_stage_keeps_one_of_each_group_and_all_others(spark):
    dice = random.Random(7)
    def text():
        return " ".join(f"w{dice.randrange(50_000)}" for _ in range(200))
    alone = [(i, text(), "en", "s", 1) for i in range(50)]
    copied = text()
    copies = [(100 + i, copied.upper() if i % 2 else copied.replace(" ", "\n"), None, "s", i) for i in range(40)]
    odd = [(200, None, "", "", 1), (201, "", "", "", 2), (202, " \t", None, None, None), (None, text(), "x", "y", 3), (None, copied, "", "", 4),
           (100, copied, "again", "", 5), (203, "a b", "", "", 1), (300, "long " * 200_000, "", "", 1)]
    docs = spark.createDataFrame(alone + copies + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert left == sorted([*range(50), 100, 200, -1, 203, 300])
