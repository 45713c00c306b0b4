"""Gradient-boosted trees in numpy for small feature tables: logistic loss, binned features."""

import numpy as np

BINS = 32


class Boosted:
    """Binary classifier; ``fit`` on a bounded table, ``predict`` gives calibrated probabilities."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, least: int = 8, l2: float = 1.0, part: float = 0.5):
        self.rounds, self.depth, self.rate, self.least, self.l2, self.part = rounds, depth, rate, least, l2, part

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        b = self._bin(x)
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(n, self.base)
        nodes = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.value = (np.zeros((self.rounds, nodes), t) for t in (np.int32, np.int32, np.float64))
        self.feature[:] = -1
        used = [j for j in range(m) if len(self.edges[j])]
        cells = (b[:, used] + np.arange(len(used)) * BINS).astype(np.int64)  # one histogram cell per row and feature
        width, rows, rng = len(used) * BINS, np.arange(n), np.random.default_rng(1)
        for t in range(self.rounds):
            drawn = rng.random(n) < self.part  # each tree is grown on a part of the rows
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, count = 2**level - 1, 2**level
                there = at >= first
                here = there & drawn
                local = at[here] - first
                gs, hs, ns = (np.bincount(local, w, count) for w in (g[here], h[here], np.ones(here.sum())))
                self.value[t, first : first + count] = np.where(ns > 0, self.rate * gs / (hs + self.l2), 0.0)
                if level == self.depth or not used:
                    break
                flat = (cells[here] + (local * width)[:, None]).ravel()
                cg, ch, cn = (np.bincount(flat, np.repeat(w, len(used)), count * width).reshape(count, len(used), BINS).cumsum(2)[:, :, :-1] for w in (g[here], h[here], np.ones(here.sum())))
                gt, ht, nt = (x[:, None, None] for x in (gs, hs, ns))
                gain = cg**2 / (ch + self.l2) + (gt - cg) ** 2 / (ht - ch + self.l2) - gt**2 / (ht + self.l2)
                gain[(cn < self.least) | (nt - cn < self.least)] = -1
                best = gain.reshape(count, -1).argmax(1)
                split = gain.reshape(count, -1)[np.arange(count), best] > 1e-3
                j, c = np.array(used)[best // (BINS - 1)], best % (BINS - 1)
                self.feature[t, first : first + count] = np.where(split, j, -1)
                self.cut[t, first : first + count] = c
                move = rows[there][split[at[there] - first]]
                k = at[move] - first
                at[move] = 2 * at[move] + 1 + (b[move, j[k]] > c[k])
            score += self.value[t, at]
        self.scale = (1.0, 0.0)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for t in range(self.rounds):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = self.feature[t, at]
                go = f >= 0
                nxt = 2 * at + 1 + (b[rows, np.maximum(f, 0)] > self.cut[t, at])
                at = np.where(go, nxt, at)
            out += self.value[t, at]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Platt scaling on held-out rows."""
        s, (a, c) = self.score(x), (1.0, 0.0)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * s + c)))
            a += 0.5 * ((y - p) * s).mean() / (s.var() + 1)
            c += 0.5 * (y - p).mean()
        self.scale = (float(a), float(c))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        a, c = self.scale
        return 1 / (1 + np.exp(-(a * self.score(x) + c)))
