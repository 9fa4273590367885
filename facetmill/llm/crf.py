"""A linear-chain conditional random field with two labels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """weights: feature -> score of label 1; steps: [from, to] transition scores; first: score of label 1 at the start."""

    weights: dict[str, float]
    steps: np.ndarray
    first: float

    def decode(self, scores: Sequence[float]) -> list[int]:
        """Viterbi: the best labels for the blocks' scores of label 1 (label 0 scores 0)."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        zero, one = 0.0, self.first + scores[0]
        back = []
        for e in scores[1:]:
            z0, z1, o0, o1 = zero + s00, one + s10, zero + s01, one + s11
            back.append((z1 > z0, o1 > o0))
            zero, one = max(z0, z1), max(o0, o1) + e
        label = int(one > zero)
        out = [label]
        for from_one in reversed(back):
            label = int(from_one[label])
            out.append(label)
        return out[::-1]


def _sum_product(emission: np.ndarray, mask: np.ndarray, steps: np.ndarray, first: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Log normaliser, P(label 1) of each block, and expected transitions; rows are chains, padded as by mask."""
    n, length = emission.shape
    alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    alpha[:, 0, 1] = first + emission[:, 0]
    for t in range(1, length):
        step = np.logaddexp(alpha[:, t - 1, 0, None] + steps[0], alpha[:, t - 1, 1, None] + steps[1])
        step[:, 1] += emission[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        ahead = beta[:, t + 1] + np.stack([np.zeros(n), emission[:, t + 1]], axis=1)
        step = np.logaddexp(steps[:, 0] + ahead[:, 0, None], steps[:, 1] + ahead[:, 1, None])
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    one = np.where(mask, np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None]), 0.0)
    pair = np.zeros((2, 2))
    for t in range(1, length):
        ahead = beta[:, t] + np.stack([np.zeros(n), emission[:, t]], axis=1)
        p = np.exp(alpha[:, t - 1, :, None] + steps + ahead[:, None, :] - log_z[:, None, None])
        pair += (p * mask[:, t, None, None]).sum(axis=0)
    return float(log_z.sum()), one, pair


def train(chains: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], rounds: int = 150, l2: float = 0.005, rate: float = 0.15, least: int = 1) -> Chain:
    """Maximises the penalised likelihood of (features of each block, labels) chains by Adam steps on all of them; features in fewer than ``least`` chains are not learned."""
    chains = [c for c in chains if len(c[1])]
    often = Counter(f for blocks, _ in chains for f in {f for b in blocks for f in b})
    names = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= least))}
    n, length = len(chains), max((len(y) for _, y in chains), default=1)
    mask, labels = np.zeros((n, length), bool), np.zeros((n, length), np.int64)
    cell, feature = [], []
    for i, (blocks, y) in enumerate(chains):
        mask[i, : len(y)], labels[i, : len(y)] = True, y
        for t, b in enumerate(blocks):
            known = [names[f] for f in b if f in names]
            cell += [i * length + t] * len(known)
            feature += known
    cell, feature = np.array(cell, np.int64), np.array(feature, np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][mask[:, 1:]], labels[:, 1:][mask[:, 1:]]), 1)
    theta = np.zeros(len(names) + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1 if n else 1):
        w, steps, first = theta[:-5], theta[-5:-1].reshape(2, 2), theta[-1]
        emission = np.bincount(cell, w[feature], minlength=n * length).reshape(n, length)
        _, one, pair = _sum_product(emission, mask, steps, first)
        gap = (labels * mask - one).ravel()
        grad = np.concatenate([np.bincount(feature, gap[cell], minlength=len(names)), (seen - pair).ravel(), [(labels[:, 0] - one[:, 0]).sum()]]) / n - l2 * theta / np.sqrt(n)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Chain({f: float(theta[i]) for f, i in names.items()}, theta[-5:-1].reshape(2, 2).copy(), float(theta[-1]))
