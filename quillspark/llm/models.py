"""Small models over hashed features, fitted with numpy on a bounded sample and applied to chunks of documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .features import Sparse


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` of each document."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _batches(x: Sparse, seed: int, size: int) -> list[tuple[np.ndarray, Sparse]]:
    order = np.random.default_rng(seed).permutation(len(x.first) - 1)
    out = []
    for k in range(0, len(order), size):
        rows = order[k : k + size]
        n = x.first[rows + 1] - x.first[rows]
        ends = np.cumsum(n)
        at = np.repeat(x.first[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        out.append((rows, Sparse(x.index[at], x.value[at], np.append(0, ends))))
    return out


class _Adagrad:
    """Steps for the rows that a batch touches."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights, self.rate, self.seen = weights, rate, np.full(weights.shape, 1e-2, np.float32)

    def step(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        self.seen[rows] += gradient**2
        self.weights[rows] -= self.rate * gradient / np.sqrt(self.seen[rows])


def _by_index(index: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    rows, first = np.unique(index[order], return_index=True)
    return rows, np.add.reduceat(gradient[order], first, axis=0)


@dataclass
class Ordinal:
    """Cumulative-link regression: P(grade >= grades[k + 1]) = sigmoid(x . weights - cuts[k]), cuts ascending."""

    weights: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray

    @classmethod
    def fit(cls, x: Sparse, rating: np.ndarray, bits: int, epochs: int = 12, rate: float = 0.08, decay: float = 2e-5, seed: int = 5) -> Ordinal:
        """All grades share the weights of a feature; the cuts are a first cut and positive gaps, so that they stay in order."""
        grades, level = np.unique(rating, return_inverse=True)
        steps = max(1, len(grades) - 1)
        shares = np.array([(level > k).mean() for k in range(steps)]) if len(level) else np.full(steps, 0.5)
        cuts = -np.log(np.clip(shares, 1e-3, 1 - 1e-3) / (1 - np.clip(shares, 1e-3, 1 - 1e-3)))
        gaps = np.append(cuts[0], np.log(np.maximum(np.diff(cuts), 1e-2)))
        weights = np.zeros((1 << bits, 1), np.float32)
        move = _Adagrad(weights, rate)
        above = (level[:, None] > np.arange(steps)).astype(np.float64)
        for epoch in range(epochs if len(grades) > 1 else 0):
            for rows, part in _batches(x, seed + epoch, 64):
                score = _sums(weights[part.index, 0] * part.value, part.first)
                cuts = np.cumsum(np.append(gaps[0], np.exp(gaps[1:])))
                error = _sigmoid(score[:, None] - cuts) - above[rows]
                flow = error.sum(axis=1)
                touched, gradient = _by_index(part.index, (flow[part.doc] * part.value / len(rows) * 8)[:, None].astype(np.float32))
                move.step(touched, gradient + decay * weights[touched])
                slope = -error.sum(axis=0) / len(rows)
                back = np.cumsum(slope[::-1])[::-1]  # a gap moves all cuts after it
                gaps -= 0.05 * back * np.append(1, np.exp(gaps[1:]))
        return cls(weights[:, 0], np.cumsum(np.append(gaps[0], np.exp(gaps[1:]))), grades.astype(np.float64))

    def tails(self, x: Sparse) -> np.ndarray:
        """P(grade >= grades[k]) for k from 1, for each document."""
        if len(self.grades) < 2:
            return np.ones((len(x.first) - 1, 0))
        return _sigmoid(_sums(self.weights[x.index] * x.value, x.first)[:, None] - self.cuts)

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades) if len(self.grades) else np.zeros(len(tails))


#: Size of a factor that is more than its random start.
_GROWN = 0.1


@dataclass
class Factors:
    """Factorization machine: bias + x . weights + sum over feature pairs of (v_i . v_j) x_i x_j, as a probability.

    Linear weights are fitted with an absolute penalty (follow the regularised leader), so that most are zero. A feature
    has factors from when it first has a linear weight, and keeps them without one if they have grown by then. Without that the many
    pairs of neutral terms in a long text would drown the few that matter.
    """

    bias: float
    weights: np.ndarray  # column 0: linear; the rest: factors
    live: np.ndarray  # features that have weights or factors

    def __getstate__(self) -> tuple:
        rows = np.flatnonzero(self.live)
        return self.bias, self.weights.shape, rows, self.weights[rows]

    def __setstate__(self, state: tuple) -> None:
        self.bias, shape, rows, values = state
        self.weights, self.live = np.zeros(shape, np.float32), np.zeros(shape[0], bool)
        self.weights[rows], self.live[rows] = values, True

    @classmethod
    def fit(cls, x: Sparse, label: np.ndarray, bits: int, rank: int = 4, epochs: int = 8, rate: float = 0.5, penalty: float = 8.0, positive: float = 1.5, factor_rate: float = 0.02, factor_decay: float = 1e-2, seed: int = 11) -> Factors:
        # the penalty stands against gradients summed over documents: it is that of 12,000, and less for fewer
        penalty = max(2, penalty * min(1, len(label) / 12_000) ** 0.5)
        share = float(np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3))
        model = cls(float(np.log(share / (1 - share))), np.zeros((1 << bits, 1 + rank), np.float32), np.zeros(1 << bits, bool))
        model.weights[:, 1:] = np.random.default_rng(seed).normal(0, 0.02, (1 << bits, rank))
        lead, squares = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
        move = _Adagrad(model.weights[:, 1:], factor_rate)
        for epoch in range(epochs if len(set(label.tolist())) > 1 else 0):
            for rows, part in _batches(x, seed + epoch, 32):
                score, inner = model._score(part)
                error = (_sigmoid(score) - label[rows]) * np.where(label[rows] > 0, positive, 1)
                doc = part.doc
                pull = error[doc] * part.value
                touched, gradient = _by_index(part.index, pull)
                old = np.sqrt(squares[touched])
                squares[touched] += gradient**2
                new = np.sqrt(squares[touched])
                z = lead[touched] + gradient - (new - old) / rate * model.weights[touched, 0]
                lead[touched] = z
                model.weights[touched, 0] = np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) * rate / (1 + new))
                model.live[touched] = (model.weights[touched, 0] != 0) | model.live[touched] & (np.abs(model.weights[touched, 1:]).max(axis=1, initial=0) > _GROWN)
                live = np.flatnonzero(model.live[part.index])
                if len(live) and rank:
                    own = model.weights[part.index[live], 1:] * part.value[live, None]
                    flow = (pull[live, None] * (inner[doc[live]] - own)).astype(np.float32)
                    touched, gradient = _by_index(part.index[live], flow)
                    move.step(touched, gradient + factor_decay * move.weights[touched])
                model.bias -= 0.005 * float(error.sum())
        model.weights[~model.live] = 0
        return model

    def _score(self, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
        rank = self.weights.shape[1] - 1
        live = np.flatnonzero(self.live[x.index])
        own = self.weights[x.index[live]] * x.value[live, None]
        sums = _sums(np.concatenate([own, own[:, 1:] ** 2], axis=1), np.searchsorted(live, x.first))
        inner = sums[:, 1 : 1 + rank]
        return self.bias + sums[:, 0] + 0.5 * (inner**2 - sums[:, 1 + rank :]).sum(axis=1), inner

    def score(self, x: Sparse) -> np.ndarray:
        return _sigmoid(self._score(x)[0])
