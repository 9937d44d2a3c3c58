"""A small causal self-attention model over token ids, in numpy: forward, backward, updates.

One block: embeddings and positions, masked attention, a layer of rectified units, both with a
residual. The next token's probability is that of its class times that within the class; classes
hold tokens of like frequency, so that a step costs the square root of the vocabulary. Outputs
start at zero with the corpus frequencies as offsets: an untrained model is the unigram model.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

DENSE = ("place", "qkv", "mixed", "up", "up_offset", "down", "klass", "klass_offset")
BY_TOKEN = ("seen", "next", "next_offset")
BLOCKED = np.float32(-1e9)


@dataclass(frozen=True)
class Shape:
    width: int = 16
    window: int = 16
    hidden: int = 32
    classes: int = 16
    tail: int = 2048  # tokens of a class of rare ones, at most
    seed: int = 1


class Classes:
    """Tokens by falling count, cut into classes of about equal sums of roots of counts."""

    def __init__(self, counts: np.ndarray, s: Shape):
        self.order = np.argsort(-counts, kind="stable")  # position -> token
        self.position = np.empty(len(counts), np.int32)
        self.position[self.order] = np.arange(len(counts))
        weight = counts[self.order] + 0.1
        share = np.cumsum(np.sqrt(weight))
        cut = np.minimum((share / share[-1] * s.classes).astype(np.int64), s.classes - 1)
        first = np.flatnonzero(np.diff(cut, prepend=-1))
        ends = [*first[1:], len(counts)]
        self.begin = np.array([b for a, e in zip(first, ends) for b in range(a, e, s.tail)], np.int64)
        self.end = np.append(self.begin[1:], len(counts))
        self.of = np.repeat(np.arange(len(self.begin)), self.end - self.begin).astype(np.int16)
        mass = np.add.reduceat(weight, self.begin)
        self.offset = np.log(mass / mass.sum()).astype(np.float32)
        self.within = np.log(weight / mass[self.of]).astype(np.float32)


def start(counts: np.ndarray, s: Shape = Shape()) -> tuple[Classes, dict[str, np.ndarray]]:
    classes = Classes(counts.astype(float), s)
    rng = np.random.default_rng(s.seed)
    normal = lambda scale, *size: (scale * rng.standard_normal(size)).astype(np.float32)
    d = s.width
    return classes, {
        "seen": normal(0.3, len(counts), d),
        "place": normal(0.1, s.window, d),
        "qkv": normal(d**-0.5, d, 3 * d),
        "mixed": normal(0.5 * d**-0.5, d, d),
        "up": normal(d**-0.5, d, s.hidden),
        "up_offset": np.zeros(s.hidden, np.float32),
        "down": normal(0.5 * s.hidden**-0.5, s.hidden, d),
        "klass": np.zeros((d, len(classes.begin)), np.float32),
        "klass_offset": classes.offset.copy(),
        "next": np.zeros((len(counts), d), np.float32),
        "next_offset": classes.within.copy(),
    }


def _safe(x: np.ndarray) -> bool:
    """Whether powers of e, their sums and one over these stay far from the ends of 32-bit numbers."""
    return x.size == 0 or bool(x.max() < 60 and x.min() > -60)


def _powers(x: np.ndarray) -> np.ndarray:
    """Softmax of each column (last axis but one) but for a factor, in place."""
    if not _safe(x):
        x -= x.max(axis=-2, keepdims=True)
    return np.exp(x, out=x)


def _beside(rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Rows, each followed by its offset and a one: a product with them gives sums as well."""
    return np.column_stack([rows, offset, np.ones_like(offset)])


@cache
def _earlier(size: int, new: int) -> np.ndarray:
    """One where (attending, attended) is no later place, else zero; attending are those from `new` on."""
    return np.tril(np.ones((size, size), np.float32))[new:]


def _joined(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Queries times keys, and values times what mixes them.

    With one head a state meets another by the first alone, and what is gathered passes the second.
    """
    d = p["mixed"].shape[0]
    q, k, v = (p["qkv"][:, i * d : (i + 1) * d] for i in range(3))
    return (q * q.dtype.type(d**-0.5)) @ k.T, v @ p["mixed"]


def trunk(p: dict, x: np.ndarray, new: int = 0) -> tuple:
    """Activations for windows of positions (batch, window); the last is (batch * (window - new), width).

    Only places from `new` on attend. Attention weights are the first half of (batch, 2 * attending, attended),
    not divided by their sums, of which the inverse is given; the queries are the second half of `meeting`.
    """
    b, size = x.shape
    m = size - new
    d = p["mixed"].shape[0]
    both, mixed = _joined(p)
    first = p["seen"].take(x, axis=0)
    first += p["place"][:size]
    own = np.ascontiguousarray(first[:, new:])
    flat = own.reshape(-1, d)
    meeting = np.empty((b, 2 * m, d), first.dtype)
    meeting[:, m:] = (flat @ both).reshape(own.shape)
    weights = np.empty((b, 2 * m, size), first.dtype)
    weight = np.matmul(meeting[:, m:], first.transpose(0, 2, 1), out=weights[:, :m])
    earlier = _earlier(size, new)
    if not _safe(weight):
        weight += np.where(earlier > 0, 0, BLOCKED)
        weight -= weight.max(axis=-1, keepdims=True)
    np.exp(weight, out=weight)
    weight *= earlier
    over = weight @ np.ones(size, first.dtype)
    np.divide(1, over, out=over)
    gathered = (weight @ first).reshape(-1, d)
    gathered *= over.reshape(-1, 1)
    second = gathered @ mixed
    second += flat
    up = second @ p["up"]
    up += p["up_offset"]
    np.maximum(up, 0, out=up)
    last = up @ p["down"]
    last += second
    return first, meeting, weights, over, gathered, second, up, last


def by_class(c: Classes, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in the order of their targets' classes, and (class, first, end) of each class there."""
    klass = c.of[target]
    order = np.argsort(klass, kind="stable")  # 16 bits: sorted by digits
    times = np.bincount(klass)
    there, end = np.flatnonzero(times), np.cumsum(times)
    return order, list(zip(there.tolist(), (end - times)[there].tolist(), end[there].tolist()))


def log_probabilities(p: dict, c: Classes, state: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithms of the targets' probabilities, one for each row of `state`."""
    d = state.shape[1]
    order, groups = by_class(c, target)
    target = target[order]
    own = np.ones((len(target), d + 1), state.dtype)
    own[:, :d] = state[order]
    out = np.zeros(len(target), state.dtype)

    def add(rows: np.ndarray, lo: int, hi: int, right: np.ndarray) -> None:
        x = rows @ own[lo:hi].T
        if not _safe(x):
            x -= x.max(axis=0)
        out[lo:hi] += x[right, np.arange(hi - lo)]
        out[lo:hi] -= np.log(np.exp(x, out=x).sum(axis=0))

    klass, right = np.column_stack([p["klass"].T, p["klass_offset"]]), c.of[target]
    for k in range(0, len(target), 4096):
        end = min(k + 4096, len(target))
        add(klass, k, end, right[k:end])
    for k, lo, hi in groups:
        a, b = c.begin[k], c.end[k]
        rows = np.column_stack([p["next"][a:b], p["next_offset"][a:b]])
        step = max(64, (1 << 17) // int(b - a))  # what is read again stays in the cache
        for m in range(lo, hi, step):
            end = min(m + step, hi)
            add(rows, m, end, target[m:end] - a)
    back = np.empty_like(out)
    back[order] = out
    return back


class Trainer:
    """Adagrad steps on windows; remembers which tokens it has moved, and how often."""

    def __init__(self, p: dict, c: Classes, rate: float):
        self.start, self.p, self.c, self.rate = p, {k: v.copy() for k, v in p.items()}, c, np.float32(rate)
        d = p["mixed"].shape[0]
        # What a step moves as a whole lies in one piece; a token's and a class's outputs lie beside their offsets.
        self.outputs = _beside(p["next"], p["next_offset"])
        self.p["next"], self.p["next_offset"] = self.outputs[:, :d], self.outputs[:, d]
        parts = {k: p[k] for k in DENSE if not k.startswith("klass")} | {"klass": _beside(p["klass"].T, p["klass_offset"])}
        self.dense = np.concatenate([v.ravel() for v in parts.values()])
        self.d_dense = np.zeros_like(self.dense)
        at, self.d_parts = 0, {}
        for k, v in parts.items():
            self.p[k] = self.dense[at : at + v.size].reshape(v.shape)
            self.d_parts[k] = self.d_dense[at : at + v.size].reshape(v.shape)
            at += v.size
        self.klass = self.p["klass"]
        self.p["klass"], self.p["klass_offset"] = self.klass[:, :d].T, self.klass[:, d]
        self.square = {k: np.full(v.shape, 1e-6, np.float32) for k, v in (("dense", self.dense), ("seen", p["seen"]), ("outputs", self.outputs))}
        self.d_outputs = np.zeros_like(self.outputs)
        self.times = {"seen": np.zeros(len(p["seen"]), np.int64), "klass": np.zeros(len(c.begin), np.int64)}
        self.tokens = 0

    @property
    def touched(self) -> dict[str, np.ndarray]:
        """How often each token was read, and how often its class was in question."""
        return {"seen": self.times["seen"].astype(np.float32), "next": self.times["klass"][self.c.of].astype(np.float32)}

    def _move(self, values: np.ndarray, square: np.ndarray, gradient: np.ndarray) -> None:
        """All in place: the gradient becomes the step."""
        root = gradient * gradient
        square += root
        np.sqrt(square, out=root)
        gradient *= self.rate
        gradient /= root
        values -= gradient

    def gradients(self, x: np.ndarray, target: np.ndarray, valid: np.ndarray, move=True) -> tuple[float, dict]:
        """Loss per target, and the gradients of the dense parts and of the embeddings by row.

        With `move`, outputs within classes are moved on the way, and the loss is left out; without,
        their gradients are returned.
        """
        p, c, g = self.p, self.c, self.d_parts
        d = p["mixed"].shape[0]
        first, meeting, weights, over, gathered, second, up, last = trunk(p, x)
        klass = self.klass if move else _beside(p["klass"].T, p["klass_offset"])
        outputs = self.outputs if move else _beside(p["next"], p["next_offset"])
        # Targets in the order of their classes. A state is followed by a one for the offset, and by a zero,
        # so that the ones beside the outputs add nothing here and stay as they are.
        there = np.flatnonzero(valid)
        t = target.ravel()[there]
        order, groups = by_class(c, t)
        there, t = there[order], t[order]
        n, numbers, right = last.dtype.type(len(t)), np.arange(len(t)), c.of[t]
        own = np.zeros((len(t), d + 2), last.dtype)
        own[:, :d] = last.take(there, axis=0)
        own[:, d] = 1
        soft = _powers(klass @ own.T)
        sums, share = soft.sum(axis=0), soft[right, numbers]
        loss = 0 if move else np.log(sums).sum() - np.log(share + 1e-30).sum()
        soft[right, numbers] = share - sums
        sums *= n
        np.matmul(soft, own / sums[:, None], out=g["klass"])
        d_own = soft.T @ klass
        d_own /= sums[:, None]
        # All classes' cells in one piece, (token of the class, target) of one class after the other.
        cells, views, cell, runs = self._cells(outputs, own, t, groups)
        d_inner = np.empty_like(own)
        for (_, lo, hi), (a, b, inner) in zip(groups, views):
            np.matmul(inner.T, outputs[a:b], out=d_inner[lo:hi])
        sums, share = d_inner[:, d + 1].copy(), cells[cell]
        loss += 0 if move else np.log(sums).sum() - np.log(share + 1e-30).sum()
        cells[cell] = share - sums
        sums *= n
        d_inner /= sums[:, None]
        d_own += d_inner
        d_own -= outputs[t] / n
        scaled = own / sums[:, None]
        d_outputs = self.d_outputs if move else np.zeros_like(outputs)
        for (_, lo, hi), (a, b, inner) in zip(groups, views):
            np.matmul(inner, scaled[lo:hi], out=d_outputs[a:b])
        if move:
            for a, b in runs:
                self._move(outputs[a:b], self.square["outputs"][a:b], d_outputs[a:b])
            for kk, lo, hi in groups:
                self.times["klass"][kk] += hi - lo
        flat = np.zeros((x.size, d), last.dtype)
        flat[there] = d_own[:, :d]
        np.matmul(up.T, flat, out=g["down"])
        d_up = flat @ p["down"].T
        d_up *= up > 0
        np.matmul(second.T, d_up, out=g["up"])
        np.matmul(np.ones(len(flat), flat.dtype), d_up, out=g["up_offset"])
        flat += d_up @ p["up"].T
        # What a softmax takes off each row is the product of its result and gradient.
        both, mixed = _joined(p)
        size = x.shape[1]
        d_gathered = flat @ mixed.T
        taken = (gathered * d_gathered) @ np.ones(d, last.dtype)
        meeting[:, :size] = (d_gathered * over.reshape(-1, 1)).reshape(first.shape)
        d_weight = np.matmul(meeting[:, :size], first.transpose(0, 2, 1), out=weights[:, size:])
        d_weight -= (taken * over.ravel()).reshape(*x.shape, 1)
        d_weight *= weights[:, :size]
        d_query = (d_weight @ first).reshape(-1, d)
        d_first = (weights.transpose(0, 2, 1) @ meeting).reshape(-1, d)
        d_first += d_query @ both.T
        d_first += flat
        d_both = (first.reshape(-1, d).T @ d_query) * last.dtype.type(d**-0.5)
        d_mixed = gathered.T @ flat
        wq, wk, wv = (p["qkv"][:, i * d : (i + 1) * d] for i in range(3))
        g["qkv"][:, :d], g["qkv"][:, d : 2 * d], g["qkv"][:, 2 * d :] = d_both @ wk, d_both.T @ wq, d_mixed @ p["mixed"].T
        np.matmul(wv.T, d_mixed, out=g["mixed"])
        g["place"][:] = 0
        g["place"][:size] = d_first.reshape(*x.shape, d).sum(axis=0)
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(p["seen"]) <= 1 << 16 else ids, kind="stable")  # 16 bits: sorted by digits
        sorted_ids = ids[order]
        begin = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
        times = np.diff(np.append(begin, len(order)))
        by_token = d_first.take(order, axis=0)
        if d % 2 == 0:  # two numbers at once: complex ones are added part by part
            by_token = by_token.view(np.complex64 if by_token.dtype == np.float32 else np.complex128)
        rows = np.add.reduceat(by_token, begin).view(last.dtype)
        out = g | {"klass": g["klass"][:, :d].T, "klass_offset": g["klass"][:, d], "seen": (sorted_ids[begin], rows, times)}
        if not move:
            out |= {"next": d_outputs[:, :d], "next_offset": d_outputs[:, d]}
        return float(loss / n), out

    def _cells(self, outputs: np.ndarray, own: np.ndarray, t: np.ndarray, groups: list) -> tuple:
        """Softmaxes within classes but for factors: in one piece, by class, each target's place in it, and runs of tokens."""
        c = self.c
        kk, lo, hi = np.array(groups).T
        m = hi - lo
        size = (c.end[kk] - c.begin[kk]) * m
        at = np.cumsum(size) - size
        cells = np.empty(int(size.sum()), own.dtype)
        views, runs = [], []
        for i, (k, low, high) in enumerate(groups):
            a, b = int(c.begin[k]), int(c.end[k])
            inner = cells[at[i] : at[i] + size[i]].reshape(b - a, high - low)
            np.matmul(outputs[a:b], own[low:high].T, out=inner)
            views.append((a, b, inner))
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        if not _safe(cells):
            for _, _, inner in views:
                inner -= inner.max(axis=0)
        np.exp(cells, out=cells)
        cell = np.repeat(at - lo, m) + (t - np.repeat(c.begin[kk], m)) * np.repeat(m, m) + np.arange(len(t))
        return cells, views, cell, runs

    def step(self, x: np.ndarray, target: np.ndarray, valid: np.ndarray) -> None:
        ids, rows, times = self.gradients(x, target, valid)[1]["seen"]
        values, square = self.p["seen"][ids], self.square["seen"][ids]
        self._move(values, square, rows)
        self.p["seen"][ids], self.square["seen"][ids] = values, square
        self.times["seen"][ids] += times
        self._move(self.dense, self.square["dense"], self.d_dense)
        self.tokens += int(np.count_nonzero(valid))


def windows(sizes: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of `sizes` targets -> (text, start, length, first new target).

    The windows of a text overlap by size - stride; each target is new in exactly one of them.
    """
    number = 1 + np.maximum(-(-(sizes - size) // stride), 0)
    number = np.where(sizes > 0, number, 0)
    text = np.repeat(np.arange(len(sizes)), number)
    k = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    begin = k * stride
    return text, begin, np.minimum(size, sizes[text] - begin), np.where(k == 0, 0, size - stride)
