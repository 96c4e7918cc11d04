"""Gradient-boosted trees for two classes, fitted on a bounded sample and applied anywhere: to arrays or as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class BoostedTrees:
    """Trees of equal depth in heap order: node i has the children 2i + 1 and 2i + 2; rows at or under the threshold go left."""

    depth: int
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        out = np.full(len(x), self.start)
        each = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[each, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def expression(self, columns: list[Column]) -> Column:
        """The same log-odds over numeric columns."""
        def below(tree: int, node: int) -> Column:
            inner = len(self.features[tree])
            if node >= inner:
                return F.lit(float(self.leaves[tree][node - inner]))
            left, right = below(tree, 2 * node + 1), below(tree, 2 * node + 2)
            if not np.isfinite(self.thresholds[tree][node]):  # an unsplit node sends everything left
                return left
            column = columns[int(self.features[tree][node])]
            return F.when(column <= float(self.thresholds[tree][node]), left).otherwise(right)

        out = F.lit(float(self.start))
        for tree in range(len(self.features)):
            out = out + below(tree, 0)
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32,
        smoothing: float = 1.0, least: float = 5.0) -> BoostedTrees:
    """Newton boosting of the logistic loss over quantile bins. Deterministic for given rows in a given order."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = BoostedTrees(depth, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.start)
    inner = 2 ** depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = node - first
            g, h = (np.bincount(local, weights=v, minlength=width) for v in (grad, hess))
            best = np.full(width, 1e-6)
            cut = np.full(width, -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                slot = local * (len(e) + 1) + binned[:, j]
                left_g, left_h = (np.bincount(slot, weights=v, minlength=width * (len(e) + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1] for v in (grad, hess))
                right_g, right_h = g[:, None] - left_g, h[:, None] - left_h
                gain = left_g ** 2 / (left_h + smoothing) + right_g ** 2 / (right_h + smoothing) - (g ** 2 / (h + smoothing))[:, None]
                gain[(left_h < least / 4) | (right_h < least / 4)] = -1
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                cut[better] = at[better]
                feature[first:first + width][better] = j
                threshold[first:first + width][better] = e[at[better]]
            split = cut[local]
            node = 2 * node + 1 + ((split >= 0) & (binned[np.arange(len(y)), feature[node]] > split))
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (grad, hess))
        values = rate * g / (h + smoothing)
        margin += values[leaf]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(values)
    return model
