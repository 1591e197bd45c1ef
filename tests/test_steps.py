"""What a step of the learners asks for and sends."""

import numpy as np

from cirro.operators import neural as NN
from cirro.operators import programs as P
from cirro.operators import trees as TR


def block(n=600, width=6, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    edges = [np.quantile(x[:, i], np.arange(1, 8) / 8) for i in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    return P.Block(0, x, bins, y, rng.integers(0, 2 ** 63, n).astype(np.uint64), np.ones((1, n), np.uint8), "r"), edges


def run(program, b):
    """(model, sizes of the sums each step sends)"""
    sizes, request = [], next(program)
    while True:
        sums = request.partial(b)
        sizes.append(sum(np.size(s) for s in sums))
        try:
            request = program.send(request.finish(sums))
        except StopIteration as end:
            return end.value, sizes


def test_last_levels_send_totals_only():
    b, edges = block()
    _, forest = run(TR.random_forest(0, 6, edges=edges, trees=20, depth=3), b)
    model, boosted = run(TR.boosting(0, 6, edges=edges, mode="classic", rounds=2, depth=2), b)
    assert len(forest) == 5 and forest[4] < forest[1] and len(model.trees) == 2
    assert len(boosted) == 7 and boosted[3] == boosted[6] == 3 * 4 * 8


def test_a_tree_travels_with_its_own_nodes():
    shape = {"roots": np.arange(3), "tree": np.array([0, 1, 2, 1, 1]), "feature": np.array([-1, 2, -1, -1, -1]), "threshold": np.zeros(5), "bin": np.zeros(5, int),
             "left": np.array([-1, 3, -1, -1, -1])}
    own, place, trees = TR.trees_of(shape, np.array([3, 4]))
    assert trees.tolist() == [1] and own["roots"].tolist() == [0] and own["left"].tolist() == [1, -1, -1] and place.tolist() == [-1, 0, 1]


def test_margins_are_bounded_in_bytes(monkeypatch):
    b, edges = block()
    model, _ = run(TR.boosting(0, 6, edges=edges, mode="classic", rounds=3, depth=2), b)
    monkeypatch.setattr(TR, "KEPT_MARGINS", 20_000)
    sent = [TR.pickle.dumps(t) for t in model.trees]
    for name in "abcdefgh":
        assert np.allclose(TR._margin(model.base, model.rate, sent, b, np.arange(600), name), model.margin(b.x))
    assert sum(v[1].nbytes for v in TR._MARGINS.values()) <= 20_000 and TR._MARGINS[b.run, "h", 0][0] == 3
    TR._MARGINS[b.run, "h", 0] = (2, np.zeros(600))                       # only what is missing is added
    assert np.allclose(TR._margin(model.base, model.rate, sent, b, np.arange(600), "h"), model.rate * model.trees[2].value[model.trees[2].leaves(b.x)[:, 0]])


def test_held_out_loss_comes_with_the_next_gradients():
    b, _ = block()
    net, sizes = run(NN.network(0, 6, hidden=(4,), batches=3, max_epochs=5, patience=50), b)
    assert len(sizes) == 1 + 5 * 3 + 1 and net.epochs <= 5
