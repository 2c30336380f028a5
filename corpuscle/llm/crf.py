"""A linear-chain conditional random field with two labels over indicator features, on many sequences at once.

The score of label 1 at a position is the sum of the weights of its active features, that of label 0 is zero; a 2 x 2
table scores neighbouring labels and a pair of numbers the first label. All recursions run over time, each step on all
sequences that are that long, in probabilities normalised at every step, so no length under- or overflows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


#: Sequences longer than this are decoded one by one.
ALONE = 2000


class Chains:
    """Sequences laid end to end, with the layout by time that the recursions use."""

    def __init__(self, lengths: np.ndarray):
        lengths = self.lengths = np.asarray(lengths, np.int64)
        start = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        self.first = start[order]
        n_long = lengths[order]
        steps = int(n_long[0]) if len(n_long) else 0
        self.active = np.searchsorted(-n_long, -np.arange(steps), "left") if steps else np.zeros(0, np.int64)
        self.n = int(lengths.sum())

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


class Ragged(NamedTuple):
    """Active features of positions laid end to end, and where each position's begin and the last one's end; none is without features."""

    ids: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1


class Crf:
    def __init__(self, n_features: int):
        self.w = np.zeros(n_features)
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)

    def unary(self, active: np.ndarray | Ragged) -> np.ndarray:
        """Score of label 1 at each position from its (positions, k) or ragged active features."""
        if isinstance(active, Ragged):
            return np.add.reduceat(self.w[active.ids], active.offs[:-1]) if len(active) else np.zeros(0)
        return self.w[active].sum(1) if len(active) else np.zeros(0)

    def marginals(self, u: np.ndarray, chains: Chains, expect: bool = False):
        """P(label 1) at each position; with ``expect`` also the expected label pairs and first labels."""
        p1 = 1 / (1 + np.exp(-np.clip(u, -60, 60)))
        e = np.stack([1 - p1, p1], 1) + 1e-300
        t_, s_ = np.exp(self.trans - self.trans.max()), np.exp(self.start - self.start.max())
        alpha = np.zeros((chains.n, 2))
        for t in range(len(chains.active)):
            i = chains.at(t)
            a = e[i] * (s_ if t == 0 else alpha[i - 1] @ t_)
            alpha[i] = a / a.sum(1, keepdims=True)
        beta = np.ones((chains.n, 2))
        pairs = np.zeros((2, 2))
        for t in range(len(chains.active) - 1, 0, -1):
            i = chains.at(t)
            eb = e[i] * beta[i]
            b = eb @ t_.T
            beta[i - 1] = b / b.sum(1, keepdims=True)
            if expect:
                z = (alpha[i - 1] * b).sum(1)
                pairs += t_ * ((alpha[i - 1] / z[:, None]).T @ eb)
        m = alpha * beta
        m = m[:, 1] / np.maximum(m.sum(1), 1e-300)
        if not expect:
            return m
        first = chains.first
        return m, pairs, np.array([(1 - m[first]).sum(), m[first].sum()])

    def _viterbi_alone(self, u: np.ndarray) -> np.ndarray:
        """The most probable labels of one long sequence, step by step in plain numbers: a step on arrays of one sequence costs ten times as much."""
        (t00, t01), (t10, t11) = self.trans.tolist()
        d0, d1 = float(self.start[0]), float(self.start[1] + u[0])
        back0, back1 = bytearray(len(u)), bytearray(len(u))
        for i, x in enumerate(u.tolist()):
            if not i:
                continue
            a, b, c, d = d0 + t00, d1 + t10, d0 + t01, d1 + t11
            back0[i], back1[i] = b > a, d > c
            d0, d1 = (b if b > a else a), (d if d > c else c) + x
            top = d0 if d0 > d1 else d1
            d0, d1 = d0 - top, d1 - top
        y = np.zeros(len(u), np.int8)
        now = int(d1 > d0)
        for i in range(len(u) - 1, -1, -1):
            y[i] = now
            now = back1[i] if now else back0[i]
        return y

    def viterbi(self, u: np.ndarray, chains: Chains) -> np.ndarray:
        """The most probable labels of each whole sequence; ties go to label 0."""
        long = chains.lengths > ALONE
        if long.any():
            y = np.zeros(chains.n, np.int8)
            start = np.cumsum(chains.lengths) - chains.lengths
            for a, n in zip(start[long], chains.lengths[long], strict=True):
                y[a : a + n] = self._viterbi_alone(u[a : a + n])
            rest = np.repeat(~long, chains.lengths)
            y[rest] = self.viterbi(u[rest], Chains(chains.lengths[~long]))
            return y
        best = np.zeros((chains.n, 2))
        back = np.zeros((chains.n, 2), np.int8)
        for t in range(len(chains.active)):
            i = chains.at(t)
            if t == 0:
                best[i] = self.start + np.stack([np.zeros(len(i)), u[i]], 1)
                continue
            s = best[i - 1][:, :, None] + self.trans[None]
            back[i] = s.argmax(1)
            b = s.max(1) + np.stack([np.zeros(len(i)), u[i]], 1)
            best[i] = b - b.max(1, keepdims=True)
        y = np.zeros(chains.n, np.int8)
        done = np.zeros(chains.n, bool)
        for t in range(len(chains.active) - 1, -1, -1):
            i = chains.at(t)
            last = ~done[i]
            y[i[last]] = best[i[last]].argmax(1)
            done[i] = True
            if t:
                y[i - 1] = back[i, y[i]]
                done[i - 1] = True
        return y

    def fit(self, active: np.ndarray | Ragged, chains: Chains, y: np.ndarray, steps: int = 60, rate: float = 0.1, l2: float = 1e-3, null: int | None = None) -> Crf:
        """Raise the penalised conditional log-likelihood of labels ``y`` with Adam on the exact gradient. The feature ``null`` keeps no weight."""
        n = max(1, chains.n)
        theta = np.concatenate([self.w, self.trans.ravel(), self.start])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pairs_y, yf = np.zeros((2, 2)), y.astype(float)
        for t in range(1, len(chains.active)):
            i = chains.at(t)
            np.add.at(pairs_y, (y[i - 1].astype(int), y[i].astype(int)), 1.0)
        first_y = np.array([(1 - yf[chains.first]).sum(), yf[chains.first].sum()])
        k = len(self.w)
        ids, each = (active.ids, np.diff(active.offs)) if isinstance(active, Ragged) else (active.ravel(), active.shape[1])
        for step in range(1, steps + 1):
            mu, pairs, first = self.marginals(self.unary(active), chains, expect=True)
            d = yf - mu
            g = np.concatenate([np.bincount(ids, np.repeat(d, each), k), (pairs_y - pairs).ravel(), first_y - first]) / n - l2 * theta / 10
            if null is not None:
                g[null] = 0.0
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.w, self.trans, self.start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
        return self
