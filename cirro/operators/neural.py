"""A feed-forward network as a program of additive steps.

One or two hidden layers, log loss, Adam on gradients that are summed over all
partitions, mini-batches by a hash of the row's key and the epoch, a tenth of the rows
(by hash) held out for early stopping; the weights of the best epoch stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cirro.operators.programs import Block, Request, uniform
from cirro.operators.trees import Constant, class_sums


@dataclass
class Network:
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    activation: str
    epochs: int = 0

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(z if i == len(self.weights) - 1 else np.maximum(z, 0.0) if self.activation == "relu" else np.tanh(z))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.layers(x)[-1][:, 0], -500, 500)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Sums over the rows, for weights and biases in turn."""
        a = self.layers(x)
        delta = (1 / (1 + np.exp(-np.clip(a[-1], -500, 500)))) - y[:, None]
        out: list[np.ndarray] = []
        for i in range(len(self.weights) - 1, -1, -1):
            out[:0] = [a[i].T @ delta, delta.sum(axis=0)]
            if i:
                delta = (delta @ self.weights[i].T) * ((a[i] > 0) if self.activation == "relu" else 1 - a[i] ** 2)
        return out


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def network(which: int, width: int, hidden=(50,), activation: str = "relu", alpha: float = 1e-4, rate: float = 0.01, batches: int = 4, max_epochs: int = 100,
            held: float = 0.1, patience: int = 10, tol: float = 1e-4, seed: int = 7):
    """Program of a network."""
    n, pos = (yield class_sums(which))[0]
    if pos in (0, n):
        return Constant(float(pos > 0))
    rng = np.random.default_rng(seed)
    sizes = [width, *hidden, 1]
    net = Network([rng.normal(size=(a, b)) * np.sqrt(2.0 / a) for a, b in zip(sizes, sizes[1:])], [np.zeros(b) for b in sizes[1:]], activation)
    params = [p for pair in zip(net.weights, net.biases) for p in pair]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    best, best_loss, waited, step, ahead = None, np.inf, 0, 0, None
    for epoch in range(max_epochs):
        for batch in range(batches):
            *sums, count = ahead if batch == 0 and ahead else (yield _batch(which, net, held, epoch, batch, batches, seed))
            if count[0] == 0:
                continue
            step += 1
            new = []
            for i, (p, g) in enumerate(zip(params, sums)):
                g = g / count[0] + (alpha * p / count[0] if i % 2 == 0 else 0.0)
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                new.append(p - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8))
            params = new
            net = Network(params[::2], params[1::2], activation, epoch + 1)
        # The epoch's loss and the gradients that the next epoch begins with are those of one network: one step for both.
        *ahead, (loss, rows) = yield _held_out(which, net, held, seed, _batch(which, net, held, epoch + 1, 0, batches, seed) if epoch + 1 < max_epochs else None)
        loss = loss / max(rows, 1.0)
        if loss < best_loss - tol:
            best, best_loss, waited = net, loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best or net


def _batch(which, net, held, epoch, batch, batches, seed):
    def partial(b: Block):
        at = b.of(which)
        own = (_share(b, seed)[at] >= held) & (np.floor(b.once(("epoch", seed, epoch), lambda: uniform(b.key, seed, 1 + epoch))[at] * batches) == batch)
        x, y = b.x[at[own]], b.y[at[own]]
        return [*net.gradients(x, y), np.array([float(len(y))])]
    return Request(partial)


def _share(b: Block, seed: int) -> np.ndarray:
    return b.once(("share", seed), lambda: uniform(b.key, seed))


def _held_out(which, net, held, seed, following: Request | None = None):
    """Request: (sum of losses, rows) of the held-out rows, after the sums of ``following``."""
    def partial(b: Block):
        at = b.of(which)
        at = at[_share(b, seed)[at] < held]
        return [*(following.partial(b) if following else []), np.array([log_loss(net.probability(b.x[at]), b.y[at]), float(len(at))])]
    return Request(partial)
