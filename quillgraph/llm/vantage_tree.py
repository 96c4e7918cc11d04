"""Vantage-point trees over 64-bit fingerprints under the Hamming distance, for pairs within a small radius.

A node holds a vantage point v and a cut c. Fingerprints with d(v, x) <= c go to the inner branch and those with
d(v, x) > c - radius to the outer one; the band between lies in both. By the triangle inequality a pair within the
radius differs by at most the radius in its distances to v, so either both are inner or, once one lies beyond the cut,
both are outer: every pair meets in some leaf, and no branch is entered that the bounds exclude.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

CANDIDATES = 8
PROBE = 2048  # members on which the candidates of a split are judged
LEAF = 512  # members of a leaf that are compared directly
WORTH = 0.95  # a split must bring the pairs to compare below this share
FRONTIER = 128


class Tree(NamedTuple):
    """Nodes by number; a branch below zero is the shard ~branch. `root` is a branch as well."""

    root: int
    point: np.ndarray
    cut: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    shards: int


def distances(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


def best_split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Of some members the one, with its cut, that leaves the fewest pairs in both branches; None if none is worth it."""
    seen = points[::max(1, len(points) // PROBE)]
    n, best = len(seen), None
    for point in seen[np.linspace(0, n - 1, min(CANDIDATES, n)).astype(int)]:
        within = np.cumsum(np.bincount(distances(seen, point), minlength=65)).astype(float)
        outer = n - np.concatenate([np.zeros(radius), within[:65 - radius]])
        pairs = within ** 2 + outer ** 2
        cut = int(pairs.argmin())
        if best is None or pairs[cut] < best[0]:
            best = (pairs[cut], point, cut)
    return best[1:] if best and best[0] < WORTH * n * n else None


def branches(points: np.ndarray, split: tuple[np.uint64, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    far = distances(points, split[0])
    return points[far <= split[1]], points[far > split[1] - radius]


def build_tree(sample: np.ndarray, total: int, shard: int, radius: int, least: int = 64) -> Tree:
    """A tree for `total` fingerprints, fitted on a sample of them, whose shards hold about `shard` each.

    Branches of the sample below `least` members are not split further, which bounds the tree by the sample.
    """
    scale = total / max(len(sample), 1)
    point, cut, children, shards = [], [], [], 0
    root, todo = -1, [(sample, -1, 0)]
    while todo:
        members, parent, side = todo.pop()
        split = best_split(members, radius) if len(members) * scale > shard and len(members) >= least else None
        if split:
            name = len(point)
            point.append(split[0])
            cut.append(split[1])
            children.append([0, 0])
            todo += [(part, name, i) for i, part in enumerate(branches(members, split, radius))]
        else:
            name, shards = ~shards, shards + 1
        if parent < 0:
            root = name
        else:
            children[parent][side] = name
    links = np.array(children, np.int64).reshape(-1, 2)
    return Tree(root, np.array(point, np.uint64), np.array(cut, np.int16), links[:, 0], links[:, 1], shards)


def routed(tree: Tree, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, shard) of every fingerprint: its own shard and those whose border it is near."""
    row, node = np.arange(len(fps)), np.full(len(fps), tree.root, np.int64)
    rows, shards = [], []
    while True:
        done = node < 0
        rows.append(row[done])
        shards.append(~node[done])
        row, node = row[~done], node[~done]
        if not len(row):
            return np.concatenate(rows), np.concatenate(shards)
        far, cut = np.bitwise_count(fps[row] ^ tree.point[node]).astype(np.int16), tree.cut[node]
        low, high = far <= cut, far > cut - radius
        row, node = np.concatenate([row[low], row[high]]), np.concatenate([tree.inner[node[low]], tree.outer[node[high]]])


def leaf_pairs(points: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (member, first member of its group) within a leaf; links are tested and never listed."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    linked = np.flatnonzero(near.sum(axis=1) > 1)
    near, label = near[np.ix_(linked, linked)], np.arange(len(linked))
    while len(linked):
        low = np.where(near, label[None, :], len(linked)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    changed = label != np.arange(len(linked))
    return np.stack([points[linked][changed], points[linked][label[changed]]], axis=1)


def groups_of_ball(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each member, the smallest member it reaches by steps of at most `radius` bits.

    For members that no vantage point tells apart. A breadth-first search takes every member once as origin.
    """
    root = fps.copy()
    spread = distances(fps, fps[0])
    order = np.argsort(spread, kind="stable")
    left, depth, place = fps[order], spread[order], order
    while len(left):
        group, origin, origin_depth = [place[:1]], left[:1], depth[:1]
        left, depth, place = left[1:], depth[1:], place[1:]
        while len(origin) and len(left):
            now, now_depth = origin[:FRONTIER], origin_depth[:FRONTIER]
            origin, origin_depth = origin[FRONTIER:], origin_depth[FRONTIER:]
            low, high = np.searchsorted(depth, [now_depth.min() - radius, now_depth.max() + radius + 1])
            near = (np.bitwise_count(now[:, None] ^ left[None, low:high]) <= radius).any(axis=0)
            if near.any():
                hit = np.zeros(len(left), bool)
                hit[low:high] = near
                group.append(place[hit])
                origin, origin_depth = np.concatenate([origin, left[hit]]), np.concatenate([origin_depth, depth[hit]])
                left, depth, place = left[~hit], depth[~hit], place[~hit]
        members = np.concatenate(group)
        root[members] = fps[members].min()
    return root


def shard_pairs(points: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (member, other member) that connect whatever links connect within a shard: the tree goes on inside it."""
    found, todo = [np.empty((0, 2), np.uint64)], [points]
    while todo:
        members = todo.pop()
        if len(members) <= LEAF:
            found.append(leaf_pairs(members, radius))
            continue
        split = best_split(members, radius)
        parts = branches(members, split, radius) if split else ()
        if parts and max(map(len, parts)) < len(members):
            todo += parts
        else:
            root = groups_of_ball(members, radius)
            found.append(np.stack([members, root], axis=1)[members != root])
    return np.unique(np.concatenate(found), axis=0)
