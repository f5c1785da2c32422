"""A small bidirectional LSTM in numpy, with softmax or CRF outputs.

Arrays are laid out as (time, feature, sequence), so that every step works on long contiguous rows. Sequences of a batch are sorted
by length, shortest first: the backward direction starts each one at its own end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ended(lengths: np.ndarray, steps: int) -> np.ndarray:
    """For each step how many of the sorted sequences have ended by then."""
    return np.searchsorted(lengths, np.arange(steps), "right")


class BiLSTM:
    """``inputs`` features, ``hidden`` cells in each direction, ``outputs`` scores for each step."""

    def __init__(self, inputs: int, hidden: int, outputs: int, crf: bool = False, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-1])).astype(np.float32)
        self.hidden, self.outputs, self.crf = hidden, outputs, crf
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p |= {f"w{d}": draw(4 * hidden, inputs), f"u{d}": draw(4 * hidden, hidden), f"b{d}": np.zeros((4 * hidden, 1), np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1
        self.p |= {"v": draw(outputs, 2 * hidden), "c": np.zeros((outputs, 1), np.float32)}
        if crf:
            self.p |= {"t": np.zeros((outputs, outputs), np.float32), "s": np.zeros((outputs, 1), np.float32)}

    # ---- one direction

    def _run(self, x: np.ndarray, d: str, gone: np.ndarray | None, keep: bool, begin: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states, what the gradients need, and the last state; x is in reading order of the direction.

        gone: sequences that have not begun yet at a step (backward only). begin: the state before the first step, zero if None."""
        h4, n = 4 * self.hidden, self.hidden
        w, u, b = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
        steps, _, batch = x.shape
        h, c = begin or (np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32))
        out = np.empty((steps, n, batch), np.float32)
        saved = []
        z = np.empty((h4, batch), np.float32)
        for t in range(steps):
            if hasattr(x, "project"):
                x.project(w, t, z)
            else:
                np.matmul(w, x[t], out=z)
            z += u @ h
            z += b
            z[: 3 * n] *= 0.5
            np.tanh(z, out=z)
            z[: 3 * n] *= 0.5
            z[: 3 * n] += 0.5
            before = (h, c)
            c = z[n : 2 * n] * c
            c += z[:n] * z[3 * n :]
            tc = np.tanh(c)
            h = z[2 * n : 3 * n] * tc
            if gone is not None and gone[t]:
                h[:, : gone[t]] = 0
                c[:, : gone[t]] = 0
            out[t] = h
            if keep:
                saved.append((z.copy(), before, tc))
        return out, saved, (h, c)

    def _back(self, x: np.ndarray, d: str, gone: np.ndarray | None, saved, d_out: np.ndarray, grads: dict) -> None:
        n = self.hidden
        w, u = self.p[f"w{d}"], self.p[f"u{d}"]
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros_like(self.p[f"b{d}"])
        for t in range(len(x) - 1, -1, -1):
            z, (h, c), tc = saved[t]
            i, f, o, g = z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :]
            dh = dh + d_out[t]
            if gone is not None and gone[t]:
                dh[:, : gone[t]] = 0
                dc[:, : gone[t]] = 0
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
            gw += dz @ x[t].T
            gu += dz @ h.T
            gb += dz.sum(1, keepdims=True)
            dh, dc = u.T @ dz, dc * f
        grads[f"w{d}"], grads[f"u{d}"], grads[f"b{d}"] = gw, gu, gb

    # ---- both directions

    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(time, output, sequence) scores; sequences sorted by length."""
        gone = ended(lengths, len(x))
        hf, _, _ = self._run(x, "f", None, False)
        hb, _, _ = self._run(x[::-1], "b", gone[::-1], False)
        n = self.hidden
        return self.p["v"][:, :n] @ hf + self.p["v"][:, n:] @ hb[::-1] + self.p["c"]

    def long_scores(self, inputs: Callable[[int, int, int], np.ndarray], lengths: list[int], piece: int) -> list[np.ndarray]:
        """(length, output) scores of sequences of any length, the same as ``scores`` gives.

        ``inputs(i, lo, hi)`` makes the steps lo to hi of sequence i. Both directions hand their states on from piece to piece, the forward
        one from the first piece on and the backward one from the last, so at most ``piece`` steps of a sequence are held; inputs are made twice."""
        n, v = self.hidden, self.p["v"]
        order = sorted(range(len(lengths)), key=lengths.__getitem__)
        sizes = np.array([lengths[i] for i in order])
        out = [np.empty((size, self.outputs), np.float32) for size in lengths]

        def steps_of(lo: int) -> tuple[int, np.ndarray, np.ndarray]:
            """The sequences that reach beyond ``lo`` (the last ones, being the longest), and their steps from there."""
            first = int(np.searchsorted(sizes, lo, "right"))
            ends = np.minimum(sizes[first:], lo + piece)
            x = None
            for j, i in enumerate(order[first:]):
                part = inputs(i, lo, int(ends[j]))
                if x is None:
                    x = np.zeros((int(ends[-1]) - lo, part.shape[1], len(ends)), np.float32)
                x[: len(part), :, j] = part
            return first, ends, x

        starts = range(0, int(sizes[-1]) if len(sizes) else 0, piece)
        state, held = None, 0
        for lo in starts:
            first, ends, x = steps_of(lo)
            begin = None if state is None else tuple(a[:, first - held :] for a in state)
            h, _, state = self._run(x, "f", None, False, begin)
            held = first
            for j, i in enumerate(order[first:]):
                out[i][lo : ends[j]] = h[: ends[j] - lo, :, j] @ v[:, :n].T
        state, held = None, len(order)
        for lo in reversed(starts):
            first, ends, x = steps_of(lo)
            begin = tuple(np.zeros((n, len(order) - first), np.float32) for _ in "hc")
            if state is not None:  # sequences that end in this piece begin with zeros
                for a, b in zip(begin, state):
                    a[:, held - first :] = b
            h, _, state = self._run(x[::-1], "b", ended(ends - lo, len(x))[::-1], False, begin)
            held = first
            for j, i in enumerate(order[first:]):
                out[i][lo : ends[j]] += h[::-1][: ends[j] - lo, :, j] @ v[:, n:].T + self.p["c"][:, 0]
        return out

    def _loss(self, s: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, dict]:
        steps, k, batch = s.shape
        live = (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)
        hot = (y[:, None, :] == np.arange(k)[None, :, None]) * live[:, None, :]
        if not self.crf:
            e = s - s.max(1, keepdims=True)
            p = np.exp(e) / np.exp(e).sum(1, keepdims=True)
            total = max(live.sum(), 1)
            loss = -float((np.log(p + 1e-9) * hot).sum()) / total
            return loss, ((p * live[:, None, :] - hot) / total).astype(np.float32), {}
        trans, start = self.p["t"], self.p["s"]

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[0] = start + s[0]
        for t in range(1, steps):
            new = lse(alpha[t - 1][:, None, :] + trans[:, :, None], 0) + s[t]
            alpha[t] = np.where(live[t][None, :] > 0, new, alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            new = lse(trans[:, :, None] + (s[t + 1] + beta[t + 1])[None, :, :], 1)
            beta[t] = np.where(live[t + 1][None, :] > 0, new, 0)
        z = lse(alpha[-1], 0)
        p = np.exp(alpha + beta - z[None, None, :]) * live[:, None, :]
        g_trans = np.zeros_like(trans)
        for t in range(1, steps):
            joint = np.exp(alpha[t - 1][:, None, :] + trans[:, :, None] + (s[t] + beta[t])[None, :, :] - z[None, None, :]) * live[t][None, None, :]
            g_trans += joint.sum(2) - hot[t - 1] @ hot[t].T
        gold = (s * hot).sum() + (start * hot[0]).sum() + sum((trans * (hot[t - 1] @ hot[t].T)).sum() for t in range(1, steps))
        n = float(live.sum())
        return float((z.sum() - gold) / n), ((p - hot) / n).astype(np.float32), {"t": g_trans / n, "s": (p[0] - hot[0]).sum(1, keepdims=True) / n}

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, dict]:
        n, gone = self.hidden, ended(lengths, len(x))
        hf, saved_f, _ = self._run(x, "f", None, True)
        hb, saved_b, _ = self._run(x[::-1], "b", gone[::-1], True)
        both = np.concatenate([hf, hb[::-1]], 1)
        loss, ds, grads = self._loss(self.p["v"] @ both + self.p["c"], y, lengths)
        grads["v"] = np.einsum("tkb,thb->kh", ds, both)
        grads["c"] = ds.sum((0, 2))[:, None]
        d_both = self.p["v"].T @ ds
        self._back(x, "f", None, saved_f, d_both[:, :n], grads)
        self._back(x[::-1], "b", gone[::-1], saved_b, d_both[::-1, n:], grads)
        return loss, grads

    def fit(self, batches, epochs: int, rate: float = 0.02) -> list[float]:
        """Adam over ``batches``: a list of (x, y, lengths). Returns the mean loss of each epoch."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        losses, step, order = [], 0, np.random.default_rng(1)
        for epoch in range(epochs):
            total = 0.0
            for i in order.permutation(len(batches)):
                loss, grads = self.gradients(*batches[i])
                total += loss
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = np.float32(rate * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
                for k, g in grads.items():
                    g = g.astype(np.float32) * np.float32(1 / max(size, 1.0))
                    m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * g
                    v[k] = np.float32(0.99) * v[k] + np.float32(0.01) * g * g
                    self.p[k] -= now * m[k] / (np.sqrt(v[k]) + np.float32(1e-7))
            losses.append(total / max(len(batches), 1))
        return losses

    def viterbi(self, s: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (time, sequence) under the CRF's transitions; past a sequence's end the last tag is repeated."""
        steps, k, batch = s.shape
        trans = self.p["t"].astype(np.float32)
        gone = ended(lengths, steps)
        best = self.p["s"] + s[0]
        back = np.empty((steps, k, batch), np.int8)
        for t in range(1, steps):
            top = best[0][None, :] + trans[0][:, None]
            arg = np.zeros((k, batch), np.int8)
            for j in range(1, k):
                other = best[j][None, :] + trans[j][:, None]
                better = other > top
                np.copyto(top, other, where=better)
                arg[better] = j
            top += s[t]
            if gone[t]:
                top[:, : gone[t]] = best[:, : gone[t]]
                arg[:, : gone[t]] = np.arange(k, dtype=np.int8)[:, None]
            best, back[t] = top, arg
        tags = np.empty((steps, batch), np.int8)
        tags[-1] = best.argmax(0)
        columns = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][tags[t], columns]
        return tags
