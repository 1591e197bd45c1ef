"""Learners as programs against plain numpy, and the same models in one task and in step."""

import numpy as np
import pytest

from cirro.operators import kernel as K
from cirro.operators import neural as NN
from cirro.operators import programs as P
from cirro.operators import search as S
from cirro.operators import trees as T


def rings(n, seed=0):
    """Two rings: no line separates them."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    r, a = 1.0 + 2.0 * y + 0.15 * rng.normal(size=n), rng.uniform(0, 2 * np.pi, n)
    return np.column_stack([r * np.cos(a), r * np.sin(a), rng.normal(size=n)]), y


def block(x, y, edges, key=None, number=0):
    bins = np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)
    key = np.arange(len(x), dtype=np.uint64) if key is None else key
    return P.Block(number, x, bins, y.astype(float), key, np.ones((1, len(x)), np.uint8))


def grown(program, blocks, width, **params):
    return P._run_local(P.Fit(program, 0, params), blocks, width)


@pytest.fixture(scope="module")
def data():
    x, y = rings(400)
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, 16) / 16)) for i in range(3)]
    return x, y, edges


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, _ = data
    rows = spark.createDataFrame([(f"k{i}", int(y[i]), *map(float, x[i]), 1 if i % 4 else 2, 1) for i in range(len(x))], "key string, label int, a double, b double, c double, r0 int, r1 int")
    return P.training_table(rows.repartition(3), ["a", "b", "c"], "label", "key", ["r0", "r1"], bins=16)


def test_blocks_hold_all_rows(table, data):
    x, y, _ = data
    blocks = [b for batch in table.blocks.toArrow().to_batches() for b in P._decoded(batch, 3, 2, "")]
    got = np.vstack([np.column_stack([b.x, b.y]) for b in blocks])
    assert sorted(map(tuple, got)) == sorted(map(tuple, np.column_stack([x, y])))
    for b in blocks:
        for i, e in enumerate(table.edges):
            assert (b.bins[:, i] == (e[None] < b.x[:, [i]]).sum(axis=1)).all()


@pytest.mark.parametrize("kind, params", [("rf", dict(trees=7, depth=4)), ("et", dict(trees=7, depth=4)), ("xgb", dict(rounds=4, depth=3, subsample=0.8, columns=0.7, l1=0.1)),
                                          ("lgb", dict(rounds=3, depth=4, leaves=6)), ("gb", dict(rounds=3, depth=2)), ("mlp", dict(hidden=(8,), max_epochs=4))])
def test_one_task_and_steps_give_the_same_model(table, data, kind, params):
    fits = [S.as_fit(kind, table, w, params) for w in (0, 1)]
    for a, b in zip(P.fit_all(table, fits), P.fit_all(table, fits, local_bytes=0)):
        assert np.allclose(a.probability(data[0]), b.probability(data[0]), atol=1e-8)


def plain_gain(g, h, left, l1, l2):
    def s(a, b):
        return (np.sign(a) * max(abs(a) - l1, 0)) ** 2 / (b + l2)
    return 0.5 * (s(g[left].sum(), h[left].sum()) + s(g[~left].sum(), h[~left].sum()) - s(g.sum(), h.sum()))


def plain_tree(x, g, h, edges, depth, l1, l2, min_hessian):
    """Nested splits (feature, threshold, gain, left, right) or a leaf value, by trying all."""
    value = -np.sign(g.sum()) * max(abs(g.sum()) - l1, 0) / (h.sum() + l2)
    best = (1e-12, None, None)
    if depth:
        for f, e in enumerate(edges):
            for t in e:
                left = x[:, f] <= t
                if left.any() and not left.all() and h[left].sum() >= min_hessian and h[~left].sum() >= min_hessian:
                    gain = plain_gain(g, h, left, l1, l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, t)
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], best[0], plain_tree(x[left], g[left], h[left], edges, depth - 1, l1, l2, min_hessian), plain_tree(x[~left], g[~left], h[~left], edges, depth - 1, l1, l2, min_hessian))


def nested(t, node):
    if t.feature[node] < 0:
        return t.value[node]
    return (t.feature[node], t.threshold[node], t.gain[node], nested(t, t.left[node]), nested(t, t.right[node]))


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 and abs(a[2] - b[2]) < 1e-8 and same(a[3], b[3]) and same(a[4], b[4])
    return not isinstance(b, tuple) and abs(a - b) < 1e-9


@pytest.mark.parametrize("l1, l2", [(0.0, 1.0), (0.5, 3.0)])
def test_newton_gains_and_leaves_equal_brute_force(data, l1, l2):
    x, y, edges = data
    model = grown(T.boosting, [block(x[:150], y[:150], edges), block(x[150:], y[150:], edges, np.arange(150, 400, dtype=np.uint64), 1)], 3,
                  edges=edges, rounds=3, depth=3, rate=0.3, l1=l1, l2=l2, min_hessian=1.0)
    margin = np.zeros(len(x))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, p - y, p * (1 - p), edges, 3, l1, l2, 1.0)
        assert same(want, nested(tree, 0))
        margin += 0.3 * tree.value[tree.leaves(x)[:, 0]]
    assert np.allclose(model.margin(x), margin)


def test_leafwise_growth_equals_a_best_first_search(data):
    x, y, edges = data
    model = grown(T.boosting, [block(x, y, edges)], 3, edges=edges, mode="leafwise", rounds=1, depth=5, leaves=6, min_hessian=1e-3)
    p = np.full(len(y), y.mean())
    g, h = p - y, p * (1 - p)
    parts, splits = [np.ones(len(y), bool)], []
    depths = [0]
    while len(parts) < 6:
        found = []
        for i, own in enumerate(parts):
            if depths[i] < 5:
                for f, e in enumerate(edges):
                    for t in e:
                        left = x[own][:, f] <= t
                        if left.any() and not left.all() and min(h[own][left].sum(), h[own][~left].sum()) >= 1e-3:
                            found.append((plain_gain(g[own], h[own], left, 0, 1.0), i, f, t))
        gain = max(found)[0]
        _, i, f, t = next(a for a in found if a[0] > gain - 1e-12)             # of equal splits the first
        splits.append((f, round(t, 9)))
        own, left = parts[i], x[:, f] <= t
        parts[i:i + 1] = [own & left, own & ~left]
        depths[i:i + 1] = [depths[i] + 1] * 2
    tree = model.trees[0]
    inner = []
    stack = [0]
    while stack:
        node = stack.pop()
        if tree.feature[node] >= 0:
            inner.append((tree.feature[node], round(tree.threshold[node], 9)))
            stack += [tree.left[node], tree.right[node]]
    assert sorted(inner) == sorted(splits)


def test_classic_gain_and_newton_leaves(data):
    x, y, edges = data
    model = grown(T.boosting, [block(x, y, edges)], 3, edges=edges, mode="classic", rounds=1, depth=1)
    r = y - y.mean()
    best = max(((left.sum() * (~left).sum() / len(y) * (r[left].mean() - r[~left].mean()) ** 2, f, t) for f, e in enumerate(edges) for t in e
                for left in [x[:, f] <= t] if left.any() and not left.all()))
    t = model.trees[0]
    assert t.feature[0] == best[1] and t.threshold[0] == pytest.approx(best[2]) and t.gain[0] == pytest.approx(best[0])
    left, v = x[:, best[1]] <= best[2], y.mean() * (1 - y.mean())
    assert t.value[t.left[0]] == pytest.approx(r[left].sum() / (left.sum() * v)) and t.value[t.right[0]] == pytest.approx(r[~left].sum() / ((~left).sum() * v))


def test_extra_trees_equal_a_plain_version(data):
    """The same seeds: candidates and thresholds per node, level by level; every row once, no bootstrap."""
    x, y, edges = data
    trees, depth, m, seed = 5, 4, 2, 11
    model = grown(T.extra_trees, [block(x[:90], y[:90], edges), block(x[90:], y[90:], edges, None, 1)], 3, trees=trees, depth=depth, part=m, seed=seed, min_leaf=2)
    nodes = [(t, np.arange(len(y))) for t in range(trees)]
    value, shape, front = {}, {}, list(range(trees))
    for level in range(depth + 1):
        rng = np.random.default_rng([seed, level])
        cand = np.sort(np.argsort(rng.random((len(front), 3)), axis=1)[:, :m], axis=1)
        draw = rng.random((len(front), m))
        new = []
        for i, node in enumerate(front):
            rows = nodes[node][1]
            value[node] = y[rows].mean()
            best = (1e-12, None)
            if level < depth:
                for j, f in enumerate(cand[i]):
                    v = x[rows, f]
                    cut = v.min() + draw[i, j] * (v.max() - v.min())
                    left = v <= cut
                    if left.sum() < 2 or (~left).sum() < 2:
                        continue
                    def gini(q):
                        return 2 * q.mean() * (1 - q.mean())
                    gain = gini(y[rows]) - (left.sum() * gini(y[rows][left]) + (~left).sum() * gini(y[rows][~left])) / len(rows)
                    if gain > best[0] + 1e-15:
                        best = (gain, f, cut, left)
            if best[1] is not None:
                a = len(nodes)
                nodes += [(nodes[node][0], rows[best[3]]), (nodes[node][0], rows[~best[3]])]
                shape[node] = (best[1], best[2], a, a + 1)
                new += [a, a + 1]
        front = new
    out = np.zeros(len(x))
    for i in range(len(x)):
        for t in range(trees):
            node = t
            while node in shape:
                f, cut, a, b = shape[node]
                node = a if x[i, f] <= cut else b
            out[i] += value[node] / trees
    assert np.allclose(model.probability(x), out)
    assert sum(model.trees.cover[model.trees.roots]) == trees * len(y)


def test_random_forest_learns_and_finds_what_matters(data):
    x, y, edges = data
    model = grown(T.random_forest, [block(x, y, edges)], 3, edges=edges, trees=30, depth=6)
    other, true = rings(300, 5)
    assert ((model.probability(other) >= 0.5) == true).mean() > 0.9
    imp = model.importances()
    assert imp.sum() == pytest.approx(1) and imp[2] < min(imp[0], imp[1])


def test_network_gradients_and_early_stopping(data):
    x, y, edges = data
    rng = np.random.default_rng(1)
    for activation in ("relu", "tanh"):
        net = NN.Network([rng.normal(size=(3, 5)), rng.normal(size=(5, 4)), rng.normal(size=(4, 1))], [rng.normal(size=5), rng.normal(size=4), rng.normal(size=1)], activation)
        got = net.gradients(x[:20], y[:20].astype(float))
        for layer, (i, j) in ((0, (1, 2)), (1, (3, 1)), (2, (2, 0))):
            old, loss = net.weights[layer][i, j], []
            for d in (1e-5, -1e-5):
                net.weights[layer][i, j] = old + d
                loss.append(NN.log_loss(net.probability(x[:20]), y[:20]))
            net.weights[layer][i, j] = old
            assert got[2 * layer][i, j] == pytest.approx((loss[0] - loss[1]) / 2e-5, rel=1e-4, abs=1e-5)
    noise = rng.integers(0, 2, len(y))
    stopped = grown(NN.network, [block(x, noise, edges)], 3, hidden=(20,), rate=0.05, max_epochs=200, patience=5)
    assert stopped.epochs < 190
    learned = grown(NN.network, [block(x, y, edges)], 3, hidden=(20,), rate=0.02, max_epochs=80)
    other, true = rings(300, 5)
    assert ((learned.probability(other) >= 0.5) == true).mean() > 0.95


def test_network_does_not_depend_on_partitioning(data):
    x, y, edges = data
    key = np.arange(len(x), dtype=np.uint64)
    order = np.random.default_rng(3).permutation(len(x))
    a = grown(NN.network, [block(x, y, edges, key)], 3, hidden=(6,), max_epochs=5)
    b = grown(NN.network, [block(x[o], y[o], edges, key[o], n) for n, o in enumerate(np.array_split(order, 4))], 3, hidden=(6,), max_epochs=5)
    assert np.allclose(a.probability(x), b.probability(x), atol=1e-9)


def test_kernel_approximation_and_rings(table, data):
    x, y, _ = data
    mapping = K.FourierMap.of(3, 0.5, 4000)
    true = np.exp(-0.5 * ((x[:40, None] - x[None, :40]) ** 2).sum(axis=2))
    assert np.abs(mapping(x[:40]) @ mapping(x[:40]).T - true).max() < 0.08
    other, label = rings(300, 5)
    svm = K.fit_svm(table, 1, c=10.0, gamma=0.5)
    line = K.fit_logistic(table, 1)
    assert ((svm.probability(other) >= 0.5) == label).mean() > 0.95
    assert ((line.probability(other) >= 0.5) == label).mean() < 0.7


def test_one_class_is_a_constant(spark):
    rows = spark.createDataFrame([(f"k{i}", 1, float(i), 1) for i in range(20)], "key string, label int, a double, r int")
    t = P.training_table(rows, ["a"], "label", "key", ["r"])
    for kind in ("rf", "et", "xgb", "mlp", "lr", "svm"):
        assert (S.fit_many(t, [(kind, 0, {})])[0].probability(np.zeros((3, 1))) == 1.0).all()


def test_search_settings():
    for kind, grid in S.GRIDS.items():
        got = S.search_settings(kind, 10)
        size = int(np.prod([len(v) for v in grid.values()]))
        assert len(got) == len({str(s) for s in got}) == min(10, size) and got == S.search_settings(kind, 10)


def test_search_keeps_the_best_setting(table, data, monkeypatch):
    monkeypatch.setitem(S.GRIDS, "rf", {"trees": [1, 25], "depth": [1, 6]})
    found = S.search(table, ["rf", "lr"], [0], 1, n_iter=10)
    model, params, score = found["rf"]
    x, y, _ = data
    counts = P.test_confusion(table, [(0, S.fit_many(table, [("rf", 0, params)])[0])])
    assert score == pytest.approx(S.f_beta(*counts[0])) and score > 0.85 and params["depth"] == 6
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.9


def test_predictions_of_all_models(spark, table, data):
    x, y, _ = data
    rf, lr = S.fit_many(table, [("rf", 1, {"trees": 5, "depth": 3}), ("lr", 1, {})])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x[:50])], "i int, a double, b double, c double")
    out = P.predictions(rows, ["a", "b", "c"], {"rf": rf, "lr": lr}).orderBy("i").toPandas()
    assert np.allclose(out["rf"], rf.probability(x[:50])) and np.allclose(out["lr"], lr.probability(x[:50]))
