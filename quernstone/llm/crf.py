"""A linear-chain conditional random field over binary features, trained and decoded in numpy."""

from __future__ import annotations

import numpy as np


class Crf:
    """Scores of a label sequence: the weights of each position's features plus those of neighbouring labels."""

    def __init__(self, labels: tuple[str, ...], features: int):
        self.labels = labels
        self.emit = np.zeros((features, len(labels)))
        self.move = np.zeros((len(labels), len(labels)))
        self.start = np.zeros(len(labels))

    @staticmethod
    def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sequences])
        x = np.zeros((len(sequences), sizes.max(), sequences[0].shape[1]))
        for row, s in zip(x, sequences):
            row[: len(s)] = s
        return x, sizes

    def fit(self, sequences: list[np.ndarray], tags: list[np.ndarray], rounds: int = 250, decay: float = 3e-4) -> "Crf":
        """Maximises the penalised conditional likelihood over all sequences at once, by limited-memory quasi-Newton steps;
        equal sequences count as one with a weight."""
        weights: dict[tuple, float] = {}
        unique: dict[tuple, tuple] = {}
        for s, t in zip(sequences, tags):
            key = (s.tobytes(), t.tobytes())
            weights[key] = weights.get(key, 0.0) + 1.0
            unique[key] = (s, t)
        w = np.array(list(weights.values()))
        w /= w.sum()
        sequences, tags = zip(*unique.values())
        x, sizes = self._padded(sequences)
        n, length, f = x.shape
        k = len(self.labels)
        flat = x.reshape(n * length, f)
        y = np.zeros((n, length), np.int64)
        for row, t in zip(y, tags):
            row[: len(t)] = t
        on = np.arange(length)[None, :] < sizes[:, None]
        gold = np.eye(k)[y] * on[..., None] * w[:, None, None]
        gold_emit = flat.T @ gold.reshape(-1, k)
        gold_move = np.einsum("nti,ntj->ij", np.eye(k)[y[:, :-1]] * on[:, 1:, None] * w[:, None, None], np.eye(k)[y[:, 1:]])
        gold_start = gold[:, 0].sum(0)

        def loss(theta):
            emit, move, start = theta[: f * k].reshape(f, k), theta[f * k : f * k + k * k].reshape(k, k), theta[f * k + k * k :]
            s = (flat @ emit).reshape(n, length, k)
            alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
            alpha[:, 0] = s[:, 0] + start
            for t in range(1, length):
                step = _logsum(alpha[:, t - 1, :, None] + move, 1) + s[:, t]
                alpha[:, t] = np.where(on[:, t, None], step, alpha[:, t - 1])
            for t in range(length - 2, -1, -1):
                step = _logsum(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(on[:, t + 1, None], step, beta[:, t + 1])
            z = _logsum(alpha[:, -1], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * on[..., None] * w[:, None, None]
            pair = np.zeros((k, k))
            for t in range(1, length):
                both = alpha[:, t - 1, :, None] + move + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
                pair += (np.exp(both) * (on[:, t] * w)[:, None, None]).sum(0)
            value = w @ z - (gold_emit * emit).sum() - (gold_move * move).sum() - gold_start @ start + decay / 2 * theta @ theta
            slope = np.concatenate([(flat.T @ p.reshape(-1, k) - gold_emit).ravel(), (pair - gold_move).ravel(), p[:, 0].sum(0) - gold_start])
            return value, slope + decay * theta

        theta = np.concatenate([self.emit.ravel(), self.move.ravel(), self.start])
        theta = _descend(loss, theta, rounds)
        self.emit, self.move, self.start = theta[: f * k].reshape(f, k), theta[f * k : f * k + k * k].reshape(k, k), theta[f * k + k * k :]
        return self

    def decode(self, sequences: list[np.ndarray], at_once: int = 512) -> list[np.ndarray]:
        """The best label sequence of each input, by Viterbi, for groups of similar length at once."""
        out: list = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        for a in range(0, len(order), at_once):
            part = order[a : a + at_once]
            x, sizes = self._padded([sequences[i] for i in part])
            s = x @ self.emit
            best = s[:, 0] + self.start
            back = np.zeros(s.shape, np.int64)
            kept = [best]
            for t in range(1, s.shape[1]):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                best = step.max(1) + s[:, t]
                kept.append(best)
            kept = np.stack(kept, 1)
            for r, i in enumerate(part):
                tags = np.zeros(sizes[r], np.int64)
                tags[-1] = kept[r, sizes[r] - 1].argmax()
                for t in range(sizes[r] - 1, 0, -1):
                    tags[t - 1] = back[r, t, tags[t]]
                out[i] = tags
        return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _descend(loss, theta: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """The minimum of a convex function given with its slope, by limited-memory quasi-Newton steps."""
    value, slope = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, parts = slope.copy(), []
        for s, y, r in reversed(past):
            parts.append(r * (s @ way))
            way -= parts[-1] * y
        if past:
            s, y, _ = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(parts)):
            way += (a - r * (y @ way)) * s
        size = 1.0 if past else 1.0 / max(1.0, np.abs(slope).sum())
        fall = slope @ way
        for _ in range(20):
            to = theta - size * way
            new, new_slope = loss(to)
            if new <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = to - theta, new_slope - slope
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1.0 / (s @ y))]
        done = value - new < 1e-8
        theta, value, slope = to, new, new_slope
        if done:
            break
    return theta
