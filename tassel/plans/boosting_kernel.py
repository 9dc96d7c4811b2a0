"""The numpy part of boosted trees: rows in blocks of binned features, margins, histograms and splits."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Rows that are handled at once; a block holds a byte or two per feature and a margin per fit for each of them.
BLOCK_ROWS = 50_000


@dataclass
class Spec:
    """What all fits on the same rows have in common. ``edges`` are the thresholds of a feature, None for codes."""

    edges: list[np.ndarray | None]
    sizes: list[int]
    held_out: list[int]  # the fold that a fit leaves out, -1 for none
    trees: int
    depth: int
    step: float
    share: float  # of the rows, for a tree
    choice: int  # features that a node may choose from
    least_rows: int
    least_gain: float
    seed: int

    @property
    def width(self) -> int:
        return max(2, *self.sizes)


@dataclass
class Trees:
    """One tree of every fit, nodes as in a heap: a feature (-1 in a leaf), the bins that go left, a value."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    weight: float = 1.0

    @classmethod
    def empty(cls, n_fits: int, depth: int, width: int) -> Trees:
        nodes = 2 ** (depth + 1) - 1
        return cls(np.full((n_fits, nodes), -1), np.zeros((n_fits, nodes, width), bool), np.zeros((n_fits, nodes)))

    def node_of(self, fit: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has come to after so many levels; a leaf keeps its rows."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[fit][at]
            goes_left = self.left[fit][at, bins[rows, feature]]
            at = np.where(feature >= 0, 2 * at + 2 - goes_left, at)
        return at

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2


@dataclass
class Node:
    """A node with (rows, sum, sum of squares) of its residuals and, unless it is a leaf, its split."""

    stats: tuple[float, float, float]
    gain: float = -1.0
    feature: int = -1
    left: np.ndarray | None = None

    @property
    def prediction(self) -> float:
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0

    @property
    def impurity(self) -> float:
        n, s, squares = self.stats
        return (squares - s * s / n) / n if n else 0.0


def to_blocks(spec: Spec, batches: Iterable) -> Iterator:
    """Arrow batches (label, x, fold) to pickled blocks: bins, outcome as -1 or 1, fold, margin of every fit."""
    import pyarrow as pa

    def block(parts: list) -> pa.RecordBatch:
        y, x, fold = (np.concatenate(p) for p in zip(*parts))
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("labels of boosted trees must be 0 or 1")
        bins = np.empty(x.shape, np.min_scalar_type(spec.width))
        for f, edges in enumerate(spec.edges):
            # codes are their own bins; x <= edges[i] holds for the bins up to i
            bins[:, f] = x[:, f] if edges is None else np.searchsorted(edges, x[:, f], side="left")
        made = (bins, 2.0 * y - 1.0, fold, np.zeros((len(y), len(spec.held_out))))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["block"])

    parts, n = [], 0
    for batch in batches:
        label, x, fold = batch.columns
        if batch.num_rows:
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(spec.sizes))
            parts.append((label.to_numpy(zero_copy_only=False), values, fold.to_numpy(zero_copy_only=False)))
            n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block(parts)
            parts, n = [], 0
    if parts:
        yield block(parts)


def margins(recent: list[Trees], block: tuple) -> np.ndarray:
    """The margins of a block's rows with the trees that are not yet in them."""
    bins, _, _, margin = block
    out = margin.copy()
    for trees in recent:
        for fit in range(out.shape[1]):
            out[:, fit] += trees.weight * trees.value[fit][trees.node_of(fit, bins, trees.depth)]
    return out


def moved_on(recent: list[Trees], block: tuple) -> tuple:
    return (*block[:3], margins(recent, block))


def histograms(spec: Spec, recent: list[Trees], trees: Trees, turn: int, level: int, part: int, blocks: Iterable) -> Iterator:
    """Rows, residuals and squared residuals of one level by (fit, node, feature, bin), one array for all blocks of a part.

    The first tree learns the outcome itself, the later ones twice the negative gradient of the logistic loss, as MLlib's do.
    """
    n_features, width, nodes = len(spec.sizes), spec.width, 2**level
    cells = nodes * n_features * width
    total, found = np.zeros((3, len(spec.held_out), cells)), False
    offsets = np.arange(n_features) * width
    for number, block in enumerate(blocks):
        found = True
        bins, sign, fold, _ = block
        drawn = np.random.default_rng([spec.seed, turn, part, number]).random(len(bins)) < spec.share
        margin = margins(recent, block) if turn else None
        for fit, out in enumerate(spec.held_out):
            at = trees.node_of(fit, bins, level) - (nodes - 1)
            rows = np.flatnonzero(drawn & (fold != out) & (at >= 0))
            y = sign[rows]
            with np.errstate(over="ignore"):
                residual = 4.0 * y / (1.0 + np.exp(2.0 * y * margin[rows, fit])) if turn else y
            cell = (bins[rows] + offsets + (at[rows] * (n_features * width))[:, None]).ravel()
            residual = np.repeat(residual, n_features)
            total[0, fit] += np.bincount(cell, minlength=cells)
            total[1, fit] += np.bincount(cell, residual, cells)
            total[2, fit] += np.bincount(cell, residual * residual, cells)
    if found:
        yield total.reshape(3, len(spec.held_out), nodes, n_features, width)


def held_out_rows(spec: Spec, recent: list[Trees], block: tuple) -> Iterator[tuple]:
    """(fold, label, score) of the rows that a fit has left out, by that fit."""
    margin = margins(recent, block)
    _, sign, fold, _ = block
    for fit, out in enumerate(spec.held_out):
        if out >= 0:
            for i in np.flatnonzero(fold == out).tolist():
                yield out, float(sign[i] > 0), float(margin[i, fit])


def best_splits(spec: Spec, found: np.ndarray, turn: int, level: int) -> list[list[Node | None]]:
    """The nodes of one level of each fit, from their histograms; None where no rows have come."""
    n, s, q = found
    n_fits, n_nodes, n_features, _ = n.shape
    is_code = np.array([e is None for e in spec.edges])[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        # codes by their mean, those that do not occur last
        by = np.where(is_code, np.where(n > 0, s / n, np.inf), np.arange(spec.width))
        order = np.argsort(by, axis=-1, kind="stable")
        below = [np.cumsum(np.take_along_axis(a, order, -1), -1)[..., :-1] for a in (n, s, q)]
        whole = [a.sum(-1)[..., :1, None] for a in (n, s, q)]
        above = [w - b for w, b in zip(whole, below)]
        spread = lambda m: m[2] - m[1] * m[1] / m[0]
        gain = (spread(whole) - spread(below) - spread(above)) / whole[0]
    draws = np.random.default_rng([spec.seed, turn, level]).random((n_fits, n_nodes, n_features))
    allowed = np.argsort(np.argsort(draws, -1), -1) < spec.choice
    least = max(1, spec.least_rows)
    valid = (below[0] >= least) & (above[0] >= least) & allowed[..., None] & (gain >= spec.least_gain)
    gain = np.where(valid, gain, -np.inf).reshape(n_fits, n_nodes, -1)
    out: list[list[Node | None]] = []
    for fit in range(n_fits):
        out.append([])
        for i in range(n_nodes):
            stats = tuple(float(w[fit, i, 0, 0]) for w in whole)
            if not stats[0] and level:
                out[-1].append(None)
                continue
            best = int(np.argmax(gain[fit, i]))
            node = Node(stats)
            if gain[fit, i, best] > 0:
                node.gain = float(gain[fit, i, best])
                node.feature, at = divmod(best, spec.width - 1)
                node.left = np.zeros(spec.width, bool)
                node.left[order[fit, i, node.feature, : at + 1]] = True
            out[-1].append(node)
    return out


def grown(spec: Spec, turn: int, add_up: Callable) -> tuple[Trees, list[dict[int, Node]]]:
    """The next tree of every fit, as arrays and as nodes by their place in the heap; ``add_up`` gives a level's histograms."""
    n_fits = len(spec.held_out)
    trees = Trees.empty(n_fits, spec.depth, spec.width)
    trees.weight = spec.step if turn else 1.0
    nodes: list[dict[int, Node]] = [{} for _ in range(n_fits)]
    for level in range(max(1, spec.depth)):
        first = 2**level - 1
        if level and not (trees.feature[:, (first - 1) // 2 : first] >= 0).any():
            break
        found = add_up(trees, level)
        for fit, row in enumerate(best_splits(spec, found, turn, level)):
            for i, node in enumerate(row):
                at = first + i
                if node is None:
                    continue
                nodes[fit][at], trees.value[fit, at] = node, node.prediction
                if node.left is None or not spec.depth:
                    node.left = None
                    continue
                trees.feature[fit, at], trees.left[fit, at] = node.feature, node.left
                if level + 1 == spec.depth:  # what the last splits leave on either side was counted with them
                    cells = found[:, fit, i, node.feature]
                    for side, child in ((node.left, 2 * at + 1), (~node.left, 2 * at + 2)):
                        leaf = Node(tuple(cells[:, side].sum(-1).tolist()))
                        nodes[fit][child], trees.value[fit, child] = leaf, leaf.prediction
    return trees, nodes


def all_grown(spec: Spec, blocks: Iterable) -> Iterator:
    """Every tree of every fit from the blocks of one part: the nodes, then the rows that the fits left out."""
    held, out = list(blocks), []
    for turn in range(spec.trees):
        trees, nodes = grown(spec, turn, lambda t, level: sum(histograms(spec, [], t, turn, level, 0, held)))
        held = [moved_on([trees], block) for block in held]
        out.append(nodes)
    yield out
    for block in held:
        yield from held_out_rows(spec, [], block)
