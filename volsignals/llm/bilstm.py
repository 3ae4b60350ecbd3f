"""A bidirectional LSTM over characters with CRF transitions, in numpy.

Characters are classes of characters: letters, digits and other signs by themselves. Both
directions run as one batch. The tags of a sequence are those of the path with the highest sum of
emissions and transitions; training maximises the likelihood of the labelled path (forward-backward
through the CRF, backpropagation through time, Adam).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Cells of each direction.
CELLS = 16
#: Sequences of a training step, steps, first rate of learning.
BATCH, STEPS, RATE = 64, 120, 0.04

_LOWER, _UPPER, _DIGIT, _SPACE, _BREAK, _OTHER, _PAD = range(7)


def _classes() -> np.ndarray:
    """Class of each code point up to 128, which stands for all others."""
    out, new = np.full(129, _OTHER), _PAD + 1
    for i in range(33, 127):
        c = chr(i)
        if c.islower() or c.isupper() or c.isdigit():
            out[i] = _LOWER if c.islower() else _UPPER if c.isupper() else _DIGIT
        else:
            out[i], new = new, new + 1
    out[:33] = _BREAK
    out[32] = _SPACE
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1


def encoded(text: str) -> np.ndarray:
    """Classes of a text's characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(points, 128)].astype(np.uint8)


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as rows of one array, and which places are real."""
    length = max(map(len, sequences))
    ids, real = np.full((len(sequences), length), _PAD, np.uint8), np.zeros((len(sequences), length), bool)
    for i, s in enumerate(sequences):
        ids[i, : len(s)] = s
        real[i, : len(s)] = True
    return ids, real


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """``table``: gate inputs of each class by direction; ``rec``: from the last state to the gates;
    ``out``, ``bias``: from both states to tags; ``trans``, ``first``: of the CRF."""

    table: np.ndarray
    rec: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    first: np.ndarray

    NAMES = ("table", "rec", "out", "bias", "trans", "first")

    @staticmethod
    def new(tags: int, seed: int = 1, cells: int = CELLS) -> Tagger:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        table = normal(0.3, 2, N_CLASSES, 4 * cells)
        table[:, :, cells : 2 * cells] += 1  # gates start open to the past
        return Tagger(
            table, normal(cells**-0.5, 2, cells, 4 * cells), normal(0.2, 2 * cells, tags), np.zeros(tags, np.float32),
            normal(0.1, tags, tags), np.zeros(tags, np.float32),
        )

    def _states(self, ids: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions at each place; ``keep`` gets what backpropagation needs."""
        n, length = ids.shape
        cells = self.rec.shape[1]
        both = np.stack([ids, ids[:, ::-1]])
        there = np.stack([real, real[:, ::-1]]).astype(np.float32)[..., None]
        h = c = np.zeros((2, n, cells), np.float32)
        states = np.empty((2, n, length, cells), np.float32)
        for t in range(length):
            z = h @ self.rec
            z[0] += self.table[0][both[0, :, t]]
            z[1] += self.table[1][both[1, :, t]]
            z[..., : 3 * cells] *= 0.5
            np.tanh(z, out=z)
            z[..., : 3 * cells] += 1
            z[..., : 3 * cells] *= 0.5
            i, f, o, g = (z[..., k * cells : (k + 1) * cells] for k in range(4))
            m = there[:, :, t]
            new = (f * c + i * g) * m
            tan = np.tanh(new)
            if keep is not None:
                keep.append((z, c, tan, h, m))
            h, c = o * tan * m, new
            states[:, :, t] = h
        return np.concatenate([states[0], states[1][:, ::-1]], axis=2)

    def emissions(self, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        return self._states(ids, real) @ self.out + self.bias

    def decode(self, ids: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best path of each row, and the probability of each of its tags, all paths counted."""
        e = self.emissions(ids, real)
        n, length, tags = e.shape
        rows = np.arange(n)
        back = np.empty((n, length, tags), np.uint8)
        score = self.first + e[:, 0]
        same = np.arange(tags, dtype=np.uint8)
        for t in range(1, length):
            step = score[:, :, None] + self.trans
            best = step.argmax(1)
            on = real[:, t, None]
            back[:, t] = np.where(on, best, same)
            score = np.where(on, np.take_along_axis(step, best[:, None], 1)[:, 0] + e[:, t], score)
        path = np.empty((n, length), np.uint8)
        path[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[rows, t, path[:, t]]
        sure = np.take_along_axis(self._posterior(e, real), path[..., None].astype(np.int64), 2)[..., 0]
        return path, sure

    def _posterior(self, e: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Probability of each tag at each place, all paths counted."""
        share, moves = np.exp(e - e.max(2, keepdims=True)), np.exp(self.trans)
        ahead, behind = np.empty_like(share), np.ones_like(share)
        ahead[:, 0] = share[:, 0] * np.exp(self.first)
        ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
        for t in range(1, e.shape[1]):
            new = (ahead[:, t - 1] @ moves) * share[:, t]
            ahead[:, t] = np.where(real[:, t, None], new / new.sum(1, keepdims=True), ahead[:, t - 1])
        for t in range(e.shape[1] - 2, -1, -1):
            new = (behind[:, t + 1] * share[:, t + 1]) @ moves.T
            behind[:, t] = np.where(real[:, t + 1, None], new / new.sum(1, keepdims=True), behind[:, t + 1])
        both = ahead * behind
        return both / both.sum(2, keepdims=True)

    def _crf(self, e: np.ndarray, real: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Negative log-likelihood a sequence, and its gradients by emissions, trans and first."""
        n, length, tags = e.shape
        rows = np.arange(n)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = self.first + e[:, 0]
        for t in range(1, length):
            new = _logsumexp(alpha[:, t - 1, :, None] + self.trans, 1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _logsumexp(self.trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], new, beta[:, t + 1])
        total = _logsumexp(alpha[:, -1], 1)
        there = real[..., None]
        d_e = np.exp(alpha + beta - total[:, None, None]) * there
        pairs = np.exp(
            alpha[:, :-1, :, None] + self.trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * real[:, 1:, None, None]
        d_trans = pairs.sum((0, 1))
        d_first = d_e[:, 0].sum(0)
        path = np.where(real, np.take_along_axis(e, gold[..., None], 2)[..., 0], 0).sum(1) + self.first[gold[:, 0]]
        moves = np.where(real[:, 1:], self.trans[gold[:, :-1], gold[:, 1:]], 0).sum(1)
        np.put_along_axis(d_e, gold[..., None], np.take_along_axis(d_e, gold[..., None], 2) - there, 2)
        np.add.at(d_trans, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), -1)
        np.add.at(d_first, gold[rows, 0], -1)
        return float((total - path - moves).mean()), d_e / n, d_trans / n, d_first / n

    def gradients(self, ids: np.ndarray, real: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: list = []
        states = self._states(ids, real, keep)
        loss, d_e, d_trans, d_first = self._crf(states @ self.out + self.bias, real, gold)
        d_e = d_e.astype(np.float32)
        n, length, width = states.shape
        cells = width // 2
        d_states = d_e @ self.out.T
        d_both = np.stack([d_states[..., :cells], d_states[:, ::-1, cells:]])
        both = np.stack([ids, ids[:, ::-1]])
        d_rec, d_table = np.zeros_like(self.rec), np.zeros_like(self.table)
        d_h = d_c = np.zeros((2, n, cells), np.float32)
        back = self.rec.transpose(0, 2, 1)
        d_z = np.empty((2, n, length, 4 * cells), np.float32)
        for t in range(length - 1, -1, -1):
            z, before, tan, last, m = keep[t]
            i, f, o, g = (z[..., k * cells : (k + 1) * cells] for k in range(4))
            d_h = (d_h + d_both[:, :, t]) * m
            d_c = (d_c + d_h * o * (1 - tan * tan)) * m
            own = d_z[:, :, t]
            own[..., :cells] = d_c * g * i * (1 - i)
            own[..., cells : 2 * cells] = d_c * before * f * (1 - f)
            own[..., 2 * cells : 3 * cells] = d_h * tan * o * (1 - o)
            own[..., 3 * cells :] = d_c * i * (1 - g * g)
            d_rec += last.transpose(0, 2, 1) @ own
            d_h, d_c = own @ back, d_c * f
        for k in range(2):
            marks = np.zeros((n * length, N_CLASSES), np.float32)
            marks[np.arange(n * length), both[k].ravel()] = 1
            d_table[k] = marks.T @ d_z[k].reshape(n * length, -1)
        flat = states.reshape(-1, width)
        d_out = flat.T @ d_e.reshape(len(flat), -1)
        found = (d_table, d_rec, d_out, d_e.sum((0, 1)), d_trans.astype(np.float32), d_first.astype(np.float32))
        return loss, dict(zip(self.NAMES, found, strict=True))


def train(sequences: list[np.ndarray], tags: list[np.ndarray], n_tags: int, seed: int = 1, steps: int = STEPS) -> Tagger:
    """Fit to labelled sequences; the same sequences in the same order give the same model."""
    model = Tagger.new(n_tags, seed)
    rng = np.random.default_rng(seed)
    order: list[int] = []
    mean = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}
    square = {k: np.zeros_like(getattr(model, k)) for k in model.NAMES}
    for step in range(1, steps + 1):
        while len(order) < BATCH:
            order += rng.permutation(len(sequences)).tolist()
        own, order = order[:BATCH], order[BATCH:]
        ids, real = padded([sequences[i] for i in own])
        gold = np.zeros(ids.shape, np.int64)
        for row, i in enumerate(own):
            gold[row, : len(tags[i])] = tags[i]
        _, grads = model.gradients(ids, real, gold)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.02 * (g * g - square[k])
            change = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.98**step)) + 1e-6)
            setattr(model, k, (getattr(model, k) - rate * change).astype(np.float32))
    return model
