"""Tree learners as programs of additive steps.

``forest``   random forest (Poisson bootstrap, best of binned splits over a
    random part of the features) or extremely randomised trees (no bootstrap, one
    random threshold per node and feature between the node's extremes).  All
    trees grow together, level by level.
``boosting`` gradient boosting of the log loss:
    ``newton``  gains and leaves from gradients and hessians with L1 and L2
                regularisation, level-wise growth;
    ``leafwise`` the same gains, but the tree is grown where the gain is
                largest until it has ``leaves`` leaves;
    ``classic`` splits by the gain of squared residuals, Newton leaves.
A node's gain does not depend on the order in which nodes are split, so
growing level by level to the depth limit and then keeping the splits that a
best-first search would make gives the same tree as growing leaf by leaf.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np

from cirro.operators.programs import Block, Request, uniform

CELLS = 1 << 19                       # of a histogram that is asked for at once


@dataclass
class Constant:
    """Of a learner that saw one class only."""
    value: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


@dataclass
class Trees:
    """Trees in flat arrays; ``feature`` -1 marks a leaf; rows with x <= threshold go left."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at = np.repeat(self.roots[None], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            low = x[row, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)

    def importances(self, width: int) -> np.ndarray:
        """Share of the gain that each feature's splits bring, averaged over the trees."""
        out, n = np.zeros(width), len(self.roots)
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1 if (np.diff(self.roots) > 0).all() else np.zeros(len(self.feature), int)
        for t in range(n):
            own = (tree == t) & (self.feature >= 0)
            part = np.bincount(self.feature[own], weights=self.gain[own] * self.cover[own], minlength=width)
            out += part / part.sum() if part.sum() > 0 else 0
        return out / out.sum() if out.sum() > 0 else out


class Growing:
    """Trees under construction: nodes are added level by level."""

    def __init__(self, count: int):
        self.tree = list(range(count))
        self.feature, self.threshold, self.bin = [-1] * count, [0.0] * count, [0] * count
        self.left, self.right, self.value = [-1] * count, [-1] * count, [0.0] * count
        self.gain, self.cover = [0.0] * count, [0.0] * count

    def split(self, node: int, feature: int, threshold: float, at_bin: int, gain: float) -> tuple[int, int]:
        a = len(self.feature)
        for _ in range(2):
            self.tree.append(self.tree[node])
            for c, v in ((self.feature, -1), (self.threshold, 0.0), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0), (self.cover, 0.0)):
                c.append(v)
        self.feature[node], self.threshold[node], self.bin[node], self.gain[node] = feature, threshold, at_bin, gain
        self.left[node], self.right[node] = a, a + 1
        return a, a + 1

    def arrays(self, count: int) -> dict:
        return {"roots": np.arange(count), "tree": np.array(self.tree), "feature": np.array(self.feature), "threshold": np.array(self.threshold),
                "bin": np.array(self.bin), "left": np.array(self.left)}

    def finished(self, count: int) -> Trees:
        """With each tree's nodes together."""
        order = np.argsort(np.array(self.tree), kind="stable")
        new = np.empty(len(order), dtype=np.int64)
        new[order] = np.arange(len(order))

        def moved(child):
            c = np.array(child)[order]
            return np.where(c >= 0, new[np.maximum(c, 0)], -1)
        f = lambda values, kind=float: np.array(values, dtype=kind)[order]
        return Trees(new[:count], f(self.feature, np.int64), f(self.threshold), moved(self.left), moved(self.right), f(self.value), f(self.gain), f(self.cover))


def node_of(trees: dict, b: Block, rows: np.ndarray, by_value: bool, depth: int) -> np.ndarray:
    """The node of each of the block's ``rows`` in each tree as far as it has grown (by bins, or by values); right children follow left ones."""
    feature, here = trees["feature"], np.arange(len(trees["feature"]))
    inner = feature >= 0
    pick, down = np.maximum(feature, 0), np.where(inner, trees["left"], here)
    cells, limit = (b.x.reshape(-1), trees["threshold"]) if by_value else (b.bins.reshape(-1), np.where(inner, trees["bin"], 255).astype(np.uint8))
    at = np.repeat(trees["roots"][None], len(rows), axis=0)
    start = (rows * b.x.shape[1])[:, None]
    for _ in range(depth):
        v = cells.take(start + pick.take(at))
        right = ~(v <= limit.take(at)) & inner.take(at) if by_value else v > limit.take(at)
        at = down.take(at) + right
    return at


_POISSON = np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040, 40320]))


def trees_of(shape: dict, nodes: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """(the trees that hold ``nodes`` with their nodes only, the place of each node kept among ``nodes`` or -1, numbers of these trees)."""
    own = np.unique(shape["tree"][nodes])
    kept = np.flatnonzero(np.isin(shape["tree"], own))
    new = np.full(len(shape["tree"]), -1)
    new[kept] = np.arange(len(kept))
    place = np.full(len(kept), -1)
    place[new[nodes]] = np.arange(len(nodes))
    left = shape["left"][kept]
    return {"roots": new[own], "left": np.where(left >= 0, new[np.maximum(left, 0)], -1), **{c: shape[c][kept] for c in ("feature", "threshold", "bin")}}, place, own


def class_sums(which: int):
    """Request for (rows, positive rows) of a set."""
    def partial(b: Block):
        y = b.y[b.of(which)]
        return [np.array([len(y), y.sum()], dtype=float)]
    return Request(partial)


def _weights(y: np.ndarray, balance: tuple[float, float]) -> np.ndarray:
    return np.where(y == 1, balance[1], balance[0])


def _balance(n: float, pos: float, balanced: bool) -> tuple[float, float]:
    return (n / (2 * (n - pos)), n / (2 * pos)) if balanced else (1.0, 1.0)


# --- forests --------------------------------------------------------------------------------
@dataclass
class Forest:
    trees: Trees
    width: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            out[a:a + 4096] = self.trees.value[self.trees.leaves(x[a:a + 4096])].mean(axis=1)
        return out

    def importances(self) -> np.ndarray:
        return self.trees.importances(self.width)


def _gini(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = pos / np.maximum(n, 1e-300)
    return 2 * p * (1 - p)


def _best_class_split(n: np.ndarray, pos: np.ndarray, total: tuple[np.ndarray, np.ndarray], least: float):
    """Best cell per node of (node, candidate, cut) sums on the left side: (flat index, gain; -1 where there is none)."""
    tn, tp = total[0][:, None, None], total[1][:, None, None]
    rn, rp = tn - n, tp - pos
    gain = _gini(tp, tn) - (n * _gini(pos, n) + rn * _gini(rp, rn)) / np.maximum(tn, 1e-300)
    gain = np.where((n >= least) & (rn >= least), gain, -1.0).reshape(len(n), -1)
    best = gain.argmax(axis=1)
    return best, gain[np.arange(len(n)), best]


def forest(which: int, width: int, edges=None, trees: int = 100, depth: int = 8, min_leaf: float = 1, part: int | None = None, bootstrap: bool = True,
           random_thresholds: bool = False, balanced: bool = False, seed: int = 7):
    """Program of a forest; ``edges``: the features' cut points (needed without ``random_thresholds``)."""
    n, pos = (yield class_sums(which))[0]
    if pos in (0, n):
        return Constant(float(pos > 0))
    balance, m = _balance(n, pos, balanced), part or max(1, int(np.sqrt(width)))
    grown = Growing(trees)
    n_bins = 1 if random_thresholds else max(len(e) for e in edges) + 1
    front = list(range(trees))
    for level in range(depth + 1):
        if not front:
            break
        last, shape = level == depth, grown.arrays(trees)
        if not last:
            rng = np.random.default_rng([seed, level])
            wanted = np.sort(np.argsort(rng.random((len(front), width)), axis=1)[:, :m], axis=1)
            chance = rng.random((len(front), m))
        new: list[int] = []
        chunk = CELLS if last else max(1, CELLS // (m * n_bins))
        for a in range(0, len(front), chunk):
            nodes = np.array(front[a:a + chunk])
            rows = _node_rows(which, *trees_of(shape, nodes), level, bootstrap, random_thresholds, balance, seed)
            if last:                                                  # nothing is split there
                best, gain, (tn, tp) = None, None, (yield _totals(rows, len(nodes)))
            elif random_thresholds:
                cand = wanted[a:a + chunk]
                low, high = yield _ranges(rows, cand)
                cuts = low + chance[a:a + chunk] * (high - low)
                best, gain, tn, tp = yield _sides(rows, cand, cuts, min_leaf)
            else:
                cand = wanted[a:a + chunk]
                best, gain, tn, tp = yield _histograms(rows, cand, n_bins, min_leaf)
            for i, node in enumerate(nodes.tolist()):
                grown.value[node], grown.cover[node] = (tp[i] / tn[i] if tn[i] > 0 else 0.5), tn[i]
                if not last and gain[i] > 1e-12:
                    j, at_bin = (int(best[i]), 0) if random_thresholds else divmod(int(best[i]), n_bins)
                    f = int(cand[i, j])
                    if not random_thresholds and at_bin >= len(edges[f]):
                        continue
                    new += grown.split(node, f, float(cuts[i, j] if random_thresholds else edges[f][at_bin]), at_bin, float(gain[i]))
        front = new
    return Forest(grown.finished(trees), width)


def _node_rows(which, shape, place, own_trees, level, bootstrap, by_value, balance, seed):
    """For a block: (rows, their place among the asked nodes, weight) of all (row, tree) pairs that are in one."""
    def rows(b: Block):
        at = b.of(which)
        node = place.take(node_of(shape, b, at, by_value, level)).reshape(-1)
        w = np.repeat(_weights(b.y[at], balance)[:, None], len(own_trees), axis=1)
        if bootstrap:
            for i, t in enumerate(own_trees.tolist()):
                w[:, i] *= _times(b, seed, t)[at]
        w = w.reshape(-1)
        here = np.flatnonzero((node >= 0) & (w > 0))
        return at[here // len(own_trees)], node[here], w[here]
    return rows


def _times(b: Block, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row; all forests of a seed draw alike."""
    return b.once(("times", seed, tree), lambda: np.searchsorted(_POISSON, uniform(b.key, seed, tree), side="right").astype(np.uint8))


def _totals(rows, k):
    """Request: weight of all and of the positive rows of each node."""
    def partial(b: Block):
        r, node, w = rows(b)
        return [np.bincount(node, weights=w, minlength=k), np.bincount(node, weights=w * b.y[r], minlength=k)]
    return Request(partial)


def _ranges(rows, cand):
    """Request: the least and largest value of each node's candidate features."""
    def partial(b: Block):
        r, node, _ = rows(b)
        low, high = np.full(cand.shape, np.inf), np.full(cand.shape, np.inf)
        start, x = r * b.x.shape[1], b.x.reshape(-1)
        for j in range(cand.shape[1]):
            v = x.take(start + cand[:, j].take(node))
            np.minimum.at(low[:, j], node, v)
            np.minimum.at(high[:, j], node, -v)
        return [low, high]
    return Request(partial, lambda s: (np.where(np.isfinite(s[0]), s[0], 0.0), np.where(np.isfinite(s[1]), -s[1], 0.0)), np.minimum)


def _sides(rows, cand, cuts, least):
    """Request: the best candidate of each node at its random threshold."""
    k, m = cand.shape

    def partial(b: Block):
        r, node, w = rows(b)
        wy, start, x = w * b.y[r], r * b.x.shape[1], b.x.reshape(-1)
        out = [np.bincount(node, weights=w, minlength=k), np.bincount(node, weights=wy, minlength=k), np.empty((k, m)), np.empty((k, m))]
        for j in range(m):
            low = np.flatnonzero(x.take(start + cand[:, j].take(node)) <= cuts[:, j].take(node))
            at = node.take(low)
            out[2][:, j], out[3][:, j] = np.bincount(at, weights=w.take(low), minlength=k), np.bincount(at, weights=wy.take(low), minlength=k)
        return out

    def finish(s):
        best, gain = _best_class_split(s[2][:, :, None], s[3][:, :, None], (s[0], s[1]), least)
        return best, gain, s[0], s[1]
    return Request(partial, finish)


def _histograms(rows, cand, n_bins, least):
    """Request: the best candidate and bin of each node."""
    k, m = cand.shape

    def partial(b: Block):
        r, node, w = rows(b)
        wy = w * b.y[r]
        out = [np.bincount(node, weights=w, minlength=k), np.bincount(node, weights=wy, minlength=k), np.empty((k, m, n_bins)), np.empty((k, m, n_bins))]
        start, base, bins = r * b.bins.shape[1], node * n_bins, b.bins.reshape(-1)
        for j in range(m):
            cell = base + bins.take(start + cand[:, j].take(node))
            out[2][:, j] = np.bincount(cell, weights=w, minlength=k * n_bins).reshape(k, n_bins)
            out[3][:, j] = np.bincount(cell, weights=wy, minlength=k * n_bins).reshape(k, n_bins)
        return out

    def finish(s):
        best, gain = _best_class_split(np.cumsum(s[2], axis=2), np.cumsum(s[3], axis=2), (s[0], s[1]), least)
        return best, gain, s[0], s[1]
    return Request(partial, finish)


def random_forest(which, width, **params):
    return forest(which, width, **params)


def extra_trees(which, width, **params):
    return forest(which, width, bootstrap=False, random_thresholds=True, **params)


# --- boosting -------------------------------------------------------------------------------
@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Trees]
    width: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.value[t.leaves(x)[:, 0]]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def importances(self) -> np.ndarray:
        out = sum((t.importances(self.width) for t in self.trees), np.zeros(self.width))
        return out / out.sum() if out.sum() > 0 else out


_MARGINS: dict[tuple, tuple[int, np.ndarray]] = {}             # what a worker still knows, the last used at the end; worked out anew where it doesn't
KEPT_MARGINS = 256 << 20                                       # bytes
_kept = 0


def _margin(base: float, rate: float, trees: list[bytes], b: Block, at: np.ndarray, name: str) -> np.ndarray:
    """Of pickled trees, of which a worker reads those it has not added yet."""
    global _kept
    key = (b.run, name, b.number)
    done, out = _MARGINS.pop(key, (0, None))
    _kept -= 0 if out is None else out.nbytes
    if out is None or done > len(trees) or not b.run:
        done, out = 0, np.full(len(at), base)
    x = b.x[at] if done < len(trees) else None
    for t in map(pickle.loads, trees[done:]):
        out = out + rate * t.value[t.leaves(x)[:, 0]]
    if b.run:
        _MARGINS[key] = (len(trees), out)
        _kept += out.nbytes
        while _kept > KEPT_MARGINS:
            _kept -= _MARGINS.pop(next(iter(_MARGINS)))[1].nbytes
    return out


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def newton_gain(gl, hl, g, h, l1: float, l2: float) -> np.ndarray:
    def score(a, b):
        return shrunk(a, l1) ** 2 / (b + l2)
    return 0.5 * (score(gl, hl) + score(g - gl, h - hl) - score(g, h))


def classic_gain(gl, nl, g, n) -> np.ndarray:
    nr = n - nl
    left, right = gl / np.maximum(nl, 1e-9), (g - gl) / np.maximum(nr, 1e-9)
    return nl * nr / np.maximum(n, 1e-9) * (left - right) ** 2


def boosting(which: int, width: int, edges=None, mode: str = "newton", rounds: int = 50, depth: int = 3, rate: float = 0.1, subsample: float = 1.0,
             columns: float = 1.0, l1: float = 0.0, l2: float = 1.0, leaves: int = 31, min_hessian: float = 1e-3, min_leaf: float = 1, min_split: float = 2,
             balanced: bool = False, seed: int = 7):
    """Program of a boosted ensemble."""
    n, pos = (yield class_sums(which))[0]
    if pos in (0, n):
        return Constant(float(pos > 0))
    balance = _balance(n, pos, balanced)
    start = 0.0 if mode == "newton" else float(np.log(pos * balance[1] / ((n - pos) * balance[0])))
    model, sent = Boosted(start, rate, [], width), []
    n_bins = max(len(e) for e in edges) + 1
    name = repr((which, mode, rounds, depth, rate, subsample, columns, l1, l2, leaves, min_hessian, min_leaf, min_split, balanced, seed))
    for r in range(rounds):
        rng = np.random.default_rng([seed, r])
        cols = np.sort(rng.permutation(width)[:max(1, round(columns * width))])
        grown, front = Growing(1), [0]
        for level in range(depth + 1):
            if not front:
                break
            asked = cols if level < depth else cols[:1]              # nothing is split at the last level: one column has all sums
            answer = yield _gradients(which, (start, rate, [*sent]), name, grown.arrays(1), np.array(front), level, asked, n_bins, balance, r, subsample, seed,
                                      mode, l1, l2, min_hessian, min_leaf, min_split)
            new = []
            for i, node in enumerate(front):
                best, gain, value, cover = (a[i] for a in answer)
                grown.value[node], grown.cover[node] = float(value), float(cover)
                j, at_bin = divmod(int(best), n_bins)
                f = int(cols[j])
                if level < depth and gain > 1e-12 and at_bin < len(edges[f]):
                    new += grown.split(node, f, float(edges[f][at_bin]), at_bin, float(gain))
            front = new
        if mode == "leafwise":
            best_first(grown, leaves)
        tree = grown.finished(1)
        model.trees.append(tree)
        sent.append(pickle.dumps(tree))
    return model


def best_first(grown: Growing, leaves: int) -> None:
    """Keep the splits that growing leaf by leaf, the largest gain first, would make for ``leaves`` leaves."""
    heap, kept, count = [(-grown.gain[0], 0)] if grown.feature[0] >= 0 else [], set(), 1
    while heap and count < leaves:
        _, node = heapq.heappop(heap)
        kept.add(node)
        count += 1
        for child in (grown.left[node], grown.right[node]):
            if grown.feature[child] >= 0:
                heapq.heappush(heap, (-grown.gain[child], child))
    for node in range(len(grown.feature)):
        if grown.feature[node] >= 0 and node not in kept:
            grown.feature[node] = -1


def _gradients(which, grown, name, shape, nodes, level, cols, n_bins, balance, round_, subsample, seed, mode, l1, l2, min_hessian, min_leaf, min_split):
    """Request: best split, gain, leaf value and hessian of each node, from sums of gradients and hessians per bin."""
    place = np.full(len(shape["feature"]), -1)
    place[nodes] = np.arange(len(nodes))
    k, m = len(nodes), len(cols)

    def partial(b: Block):
        at = b.of(which)
        p = 1 / (1 + np.exp(-_margin(*grown, b, at, name)))
        w = _weights(b.y[at], balance)
        if subsample < 1:
            w = w * (b.once(("part", seed, round_), lambda: uniform(b.key, seed, 1000 + round_))[at] < subsample)
        node = place[node_of(shape, b, at, False, level)[:, 0]]
        here = np.flatnonzero((node >= 0) & (w > 0))
        g, h, one = ((p - b.y[at]) * w)[here], (p * (1 - p) * w)[here], w[here] if mode != "classic" else np.ones(len(here))
        node, at = node[here], at[here]
        # Cells of all columns, so that each sum is one call; rows keep their order in every cell.
        cells = (b.columns().take(cols, axis=0).take(at, axis=1) + (node * (m * n_bins))[None] + (np.arange(m) * n_bins)[:, None]).reshape(-1)
        sums = [np.bincount(cells, weights=np.tile(v, m), minlength=k * m * n_bins) for v in (g, h)]
        sums.append(np.bincount(cells, minlength=k * m * n_bins).astype(float) if (one == 1).all() else np.bincount(cells, weights=np.tile(one, m), minlength=k * m * n_bins))
        return [s.reshape(k, m, n_bins) for s in sums]

    def finish(s):
        total = [a[:, 0].sum(axis=1) for a in s]
        gl, hl, nl = (np.cumsum(a, axis=2) for a in s)
        g, h, n = (t[:, None, None] for t in total)
        if mode == "classic":
            gain = np.where((nl >= min_leaf) & (n - nl >= min_leaf) & (n >= min_split), classic_gain(gl, nl, g, n), -1.0)
            value = -total[0] / np.maximum(total[1], 1e-16)
        else:
            ok = (hl >= min_hessian) & (h - hl >= min_hessian) & (nl >= min_leaf) & (n - nl >= min_leaf)
            gain = np.where(ok, newton_gain(gl, hl, g, h, l1, l2), -1.0)
            value = -shrunk(total[0], l1) / (total[1] + l2)
        flat = gain.reshape(k, -1)
        best = flat.argmax(axis=1)
        return best, flat[np.arange(k), best], value, total[1]
    return Request(partial, finish)
