"""A linear-chain conditional random field over blocks with sparse features, in numpy."""

from __future__ import annotations

import numpy as np


class LinearChain:
    """Weights of features by label and of label pairs; trained by stochastic gradients of the log-likelihood."""

    def __init__(self, labels: tuple[str, ...], feature_ids: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.labels, self.feature_ids, self.weights, self.moves = labels, feature_ids, weights, moves

    def scores(self, blocks: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(blocks), len(self.labels)))
        for i, feats in enumerate(blocks):
            ids = [self.feature_ids[f] for f in feats if f in self.feature_ids]
            if ids:
                out[i] = self.weights[ids].sum(axis=0)
        return out

    def decode(self, blocks: list[list[str]]) -> list[str]:
        """The most probable labels (Viterbi)."""
        if not blocks:
            return []
        emit = self.scores(blocks)
        score, back = emit[0], []
        for row in emit[1:]:
            total = score[:, None] + self.moves
            best = total.argmax(axis=0)
            back.append(best)
            score = total[best, np.arange(len(self.labels))] + row
        path = [int(score.argmax())]
        for best in reversed(back):
            path.append(int(best[path[-1]]))
        return [self.labels[k] for k in reversed(path)]

    @classmethod
    def fit(cls, labels: tuple[str, ...], sequences: list[list[tuple[list[str], str]]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4, seed: int = 5) -> LinearChain:
        ids: dict[str, int] = {}
        place = {label: k for k, label in enumerate(labels)}
        data = []
        for sequence in sequences:
            if sequence:
                data.append(([[ids.setdefault(f, len(ids)) for f in feats] for feats, _ in sequence], [place[y] for _, y in sequence]))
        n = len(labels)
        w, t = np.zeros((len(ids), n)), np.zeros((n, n))
        gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                feats, ys = data[k]
                emit = np.array([w[f].sum(axis=0) for f in feats])
                alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
                alpha[0] = emit[0]
                for i in range(1, len(ys)):
                    alpha[i] = emit[i] + _logsum(alpha[i - 1][:, None] + t, 0)
                for i in range(len(ys) - 2, -1, -1):
                    beta[i] = _logsum(t + (emit[i + 1] + beta[i + 1])[None, :], 1)
                z = _logsum(alpha[-1], 0)
                mass = np.exp(alpha + beta - z)
                for i, (f, y) in enumerate(zip(feats, ys, strict=True)):
                    g = mass[i].copy()
                    g[y] -= 1
                    step = g[None, :] + decay * w[f]
                    gw[f] += step**2
                    w[f] -= rate * step / np.sqrt(gw[f])
                if len(ys) > 1:
                    g = np.zeros_like(t)
                    for i in range(1, len(ys)):
                        g += np.exp(alpha[i - 1][:, None] + t + (emit[i] + beta[i])[None, :] - z)
                        g[ys[i - 1], ys[i]] -= 1
                    g += decay * t
                    gt += g**2
                    t -= rate * g / np.sqrt(gt)
        return cls(labels, ids, w, t)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))
