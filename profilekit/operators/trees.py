"""Isolation trees on numpy arrays: small helpers that run inside Spark tasks.

Liu, Ting and Zhou, "Isolation Forest", ICDM 2008. A tree sees a few hundred
sampled rows; all row-scale work is done by the Spark jobs that call this.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

# Ship these helpers with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER = 0.5772156649015329


def average_path(n):
    """Expected path length c(n) of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    large = np.maximum(n, 3.0)
    body = 2.0 * (np.log(large - 1.0) + EULER) - 2.0 * (large - 1.0) / large
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, body))


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth_limit: int, candidates: np.ndarray):
    """Node arrays of one isolation tree.

    ``left`` is the left child, the right one follows it; a leaf is its own
    left child and has an infinite threshold. Children follow their parent.
    """
    feature, threshold, left, size, depth = [-1], [np.inf], [0], [len(x)], [0]
    stack = [(np.arange(len(x)), 0)]
    while stack:
        rows, node = stack.pop()
        if depth[node] >= depth_limit or len(rows) <= 1:
            continue
        block = x[np.ix_(rows, candidates)]
        low, high = np.fmin.reduce(block), np.fmax.reduce(block)
        usable = np.flatnonzero(high > low)
        if len(usable) == 0:
            continue
        pick = usable[rng.integers(len(usable))]
        cut = rng.uniform(low[pick], high[pick])
        if cut >= high[pick]:
            cut = low[pick]
        goes_right = block[:, pick] > cut
        first = len(feature)
        feature[node], threshold[node], left[node] = int(candidates[pick]), float(cut), first
        for child, part in ((first, rows[~goes_right]), (first + 1, rows[goes_right])):
            feature.append(-1)
            threshold.append(np.inf)
            left.append(child)
            size.append(len(part))
            depth.append(depth[node] + 1)
            stack.append((part, child))
    value = np.asarray(depth) + average_path(size)
    expected = value.copy()
    for node in range(len(feature) - 1, -1, -1):
        if feature[node] >= 0:
            a = left[node]
            expected[node] = (size[a] * expected[a] + size[a + 1] * expected[a + 1]) / size[node]
    return {
        "feature": feature, "threshold": threshold, "left": left, "size": size, "depth": depth, "expected": expected,
    }


@dataclass
class NodeArrays:
    """All trees in flat arrays, each node's children at ``left`` and ``left + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    expected: np.ndarray
    depth_limit: int
    normaliser: float

    def walk(self, x: np.ndarray, tree: int):
        """Yield (node before, feature tested, node after) for every level of one tree.

        All indexes come from the arrays themselves, so range checks are off.
        """
        flat = np.ascontiguousarray(x).ravel()
        base = np.arange(len(x)) * x.shape[1]
        node = np.full(len(x), self.roots[tree])
        for _ in range(self.depth_limit):
            tested = self.feature.take(node, mode="clip")
            value = flat.take(base + tested, mode="clip")
            after = self.left.take(node, mode="clip")
            after += value > self.threshold.take(node, mode="clip")
            yield node, tested, after
            node = after

    def path_lengths(self, x: np.ndarray, prefixes) -> np.ndarray:
        """Mean path length over the first k trees, one column per k in ``prefixes``."""
        out = np.empty((len(x), len(prefixes)))
        total = np.zeros(len(x))
        wanted = {k: i for i, k in enumerate(prefixes)}
        for tree in range(max(prefixes)):
            after = np.full(len(x), self.roots[tree])
            for _, _, after in self.walk(x, tree):
                pass
            total += self.expected.take(after, mode="clip")
            if tree + 1 in wanted:
                out[:, wanted[tree + 1]] = total / (tree + 1)
        return out

    def scores(self, x: np.ndarray, prefixes) -> np.ndarray:
        return np.exp2(-self.path_lengths(x, prefixes) / self.normaliser)

    def paths(self, x: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """For each tree the splits and leaves of all rows: row, tree, step, feature, threshold, value, side (2: leaf), rest of the path.

        What holds for splits alone is NaN at leaves and the other way round; a leaf's feature is -1.
        """
        for tree in range(len(self.roots)):
            step, last, parts = np.zeros(len(x), dtype=int), np.full(len(x), self.roots[tree]), []
            for node, tested, after in self.walk(x, tree):
                # A leaf leads to itself.
                i = np.flatnonzero(after != node)
                at, nan = node[i], np.full(len(i), np.nan)
                parts.append((i, step[i], tested[i], self.threshold[at], x[i, tested[i]], (after[i] > self.left[at]).astype(int), nan))
                step += after != node
                last = after
            nan = np.full(len(x), np.nan)
            parts.append((np.arange(len(x)), step, np.full(len(x), -1), nan, nan, np.full(len(x), 2), self.expected[last] - step))
            names = ("row", "step", "feature", "threshold", "value", "side", "rest")
            out = {n: np.concatenate(p) for n, p in zip(names, zip(*parts))}
            yield out | {"tree": np.full(len(out["row"]), tree)}

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Change of the expected path length, credited to the feature tested at each step."""
        out = np.zeros(x.shape)
        flat = out.ravel()
        base = np.arange(len(x)) * x.shape[1]
        for tree in range(len(self.roots)):
            for node, tested, after in self.walk(x, tree):
                flat[base + tested] += self.expected[after] - self.expected[node]
        return out / len(self.roots)

    def expected_path(self) -> float:
        return float(self.expected[self.roots].mean())
