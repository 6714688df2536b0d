"""Three graph networks over NumPy arrays, with gradients by a tape of the operations.

sage: means over the sources of a node's edges, and in a second branch over their targets, each added to a map of the node
itself; both branches stand side by side. gat: two heads of attention over a node's sources and the node itself. gin: a
small network of the node, weighted by a learned number, plus the sum of its sources. Each layer ends in a ramp and dropout;
a linear head gives one logit for each node.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

KINDS = ("sage", "gat", "gin")
HEADS, SLOPE = 2, 0.2


class Value:
    """An array on the tape: what it was made from and how its gradient flows back."""

    def __init__(self, data: np.ndarray, made_from: tuple[Value, ...] = (), back: Callable | None = None):
        self.data, self.made_from, self.back = data, made_from, back
        self.grad: np.ndarray | None = None

    def take(self, g: np.ndarray) -> None:
        """Adds a gradient, summed over the axes along which the array was repeated."""
        while g.ndim > self.data.ndim:
            g = g.sum(axis=0)
        for axis, n in enumerate(self.data.shape):
            if n == 1 and g.shape[axis] != 1:
                g = g.sum(axis=axis, keepdims=True)
        self.grad = g if self.grad is None else self.grad + g


def flow_back(end: Value, g: np.ndarray) -> None:
    """Gradients of everything that `end` was made from."""
    order, seen, stack = [], set(), [(end, False)]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack += [(x, False) for x in v.made_from]
    end.take(g)
    for v in reversed(order):
        if v.back is not None and v.grad is not None:
            v.back(v.grad)


def matmul(a: Value, b: Value) -> Value:
    return Value(a.data @ b.data, (a, b), lambda g: (a.take(g @ b.data.T), b.take(a.data.T @ g)))


def affine(a: Value, w: Value, offset: Value, parts: list[tuple[Value, np.ndarray, slice]]) -> Value:
    """a @ w + offset, with the rows of each part added at the rows and columns told, no row of a part at the same one."""
    data = a.data @ w.data
    data += offset.data
    for part, at, columns in parts:
        data[at, columns] += part.data

    def back(g: np.ndarray) -> None:
        a.take(g @ w.data.T)
        w.take(a.data.T @ g)
        offset.take(g)
        for part, at, columns in parts:
            part.take(g[at, columns])

    return Value(data, (a, w, offset, *(part for part, _, _ in parts)), back)


def add(a: Value, b: Value) -> Value:
    return Value(a.data + b.data, (a, b), lambda g: (a.take(g), b.take(g)))


def times(a: Value, b: Value) -> Value:
    return Value(a.data * b.data, (a, b), lambda g: (a.take(g * b.data), b.take(g * a.data)))


def scaled(a: Value, by: np.ndarray) -> Value:
    """a times numbers without a gradient."""
    return Value(a.data * by, (a,), lambda g: a.take(g * by))


def ramp(a: Value, slope: float = 0.0) -> Value:
    if not slope:
        return Value(np.maximum(a.data, 0), (a,), lambda g: a.take(g * (a.data > 0)))
    return scaled(a, np.where(a.data > 0, 1.0, slope))


def beside(*parts: Value) -> Value:
    cuts = np.cumsum([p.data.shape[-1] for p in parts])[:-1]
    return Value(np.concatenate([p.data for p in parts], -1), parts, lambda g: [p.take(x) for p, x in zip(parts, np.split(g, cuts, -1))])


def shaped(a: Value, *shape: int) -> Value:
    return Value(a.data.reshape(shape), (a,), lambda g: a.take(g.reshape(a.data.shape)))


def summed(a: Value, axis: int) -> Value:
    return Value(a.data.sum(axis=axis), (a,), lambda g: a.take(np.broadcast_to(np.expand_dims(g, axis), a.data.shape)))


def _runs(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of `to`, the distinct values in it, and where each begins in that order."""
    order = np.argsort(to, kind="stable")
    at = to[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return order, at[first], first


def _scattered(x: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *x.shape[1:]))
    if len(to):
        order, at, first = _runs(to)
        out[at] = np.add.reduceat(x[order], first, axis=0)
    return out


def means(a: Value, start: np.ndarray, end: np.ndarray) -> tuple[Value, np.ndarray]:
    """The mean over the starts of all edges with the same end, and the ends, each once: no row for what no edge reaches."""
    order, at, first = _runs(end)
    counts = np.diff(first, append=len(end))
    start, shares = start[order], (1.0 / counts)[:, None]
    data = np.add.reduceat(a.data[start], first, axis=0) * shares if len(at) else np.zeros((0, a.data.shape[1]))
    return Value(data, (a,), lambda g: a.take(_scattered(np.repeat(g * shares, counts, axis=0), start, len(a.data)))), at


def gathered(a: Value, at: np.ndarray, once: bool = False) -> Value:
    """Rows of a. once: none of them twice."""

    def back(g: np.ndarray) -> None:
        if not once:
            return a.take(_scattered(g, at, len(a.data)))
        out = np.zeros_like(a.data)
        out[at] = g
        a.take(out)

    return Value(a.data[at], (a,), back)


def scattered(a: Value, to: np.ndarray, n: int) -> Value:
    return Value(_scattered(a.data, to, n), (a,), lambda g: a.take(g[to]))


def softmax_by(a: Value, to: np.ndarray, n: int) -> Value:
    """Shares of exp(a) among the rows with the same `to`."""
    top = np.full((n, *a.data.shape[1:]), -np.inf)
    np.maximum.at(top, to, a.data)
    e = np.exp(a.data - top[to])
    share = e / _scattered(e, to, n)[to]
    return Value(share, (a,), lambda g: a.take(share * (g - _scattered(g * share, to, n)[to])))


def parameters(kind: str, width: int, hidden: int, layers: int, seed: int) -> dict[str, np.ndarray]:
    """Fresh weights, drawn evenly within bounds by the number of inputs."""
    if kind not in KINDS:
        raise ValueError(f"unknown graph network: {kind}")
    if kind == "gat" and hidden % HEADS:
        raise ValueError("the hidden width of gat must be even")
    draw, out = np.random.default_rng(seed), {}

    def linear(name: str, n: int, m: int, offset: bool = True) -> None:
        out[f"{name}.w"] = draw.uniform(-1, 1, (n, m)) / np.sqrt(n)
        if offset:
            out[f"{name}.b"] = draw.uniform(-1, 1, (1, m)) / np.sqrt(n)

    for k in range(layers):
        if kind == "sage":
            for side in ("out", "in"):
                linear(f"{k}.{side}.near", width, hidden)
                linear(f"{k}.{side}.self", width, hidden, offset=False)
            width = 2 * hidden
        elif kind == "gat":
            linear(f"{k}.map", width, hidden, offset=False)
            out[f"{k}.offset"] = np.zeros((1, hidden))
            for end in ("from", "to"):
                out[f"{k}.{end}"] = draw.uniform(-1, 1, (1, HEADS, hidden // HEADS)) * np.sqrt(6 / (HEADS + hidden // HEADS))
            width = hidden
        else:
            linear(f"{k}.first", width, hidden)
            linear(f"{k}.second", hidden, hidden)
            out[f"{k}.eps"] = np.zeros((1, 1))
            width = hidden
    linear("head", width, 1)
    return out


def _kept(sides: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, layers: int) -> list[np.ndarray]:
    """The rows that the input and each layer must hold for the wanted rows of the last one."""
    out = [wanted]
    for _ in range(layers):
        more = out[0].copy()
        for start, end in sides:
            more[start[out[0][end]]] = True
        out.insert(0, more)
    return out


def logits(kind: str, p: dict[str, Value], x: np.ndarray, sources: np.ndarray, targets: np.ndarray, dropout: float = 0.0, draw: np.random.Generator | None = None, wanted: np.ndarray | None = None) -> Value:
    """One logit for each row of x, or each wanted one; edges lead from sources to targets. With `draw`, parts are dropped as in training.

    A layer holds only the rows on which the wanted ones depend, so others cost nothing and the logits are the same.
    """
    first = {"sage": "out.near.w", "gat": "map.w", "gin": "first.w"}[kind]
    layers = next(k for k in range(len(p)) if f"{k}.{first}" not in p)
    sides = [(sources, targets), (targets, sources)] if kind == "sage" else [(sources, targets)]
    kept = _kept(sides, np.ones(len(x), bool) if wanted is None else wanted, layers)
    now = Value(x[kept[0]])

    def linear(a: Value, name: str) -> Value:
        out = matmul(a, p[f"{name}.w"])
        return add(out, p[f"{name}.b"]) if f"{name}.b" in p else out

    def dropped(a: Value) -> Value:
        if draw is None or not dropout:
            return a
        return scaled(a, (draw.random(a.data.shape, np.float32) >= dropout) * (1 / (1 - dropout)))

    for k in range(layers):
        place, new = np.cumsum(kept[k]) - 1, np.cumsum(kept[k + 1]) - 1
        own, n = place[kept[k + 1]], int(kept[k + 1].sum())  # where the rows to make stand in the layer before
        mine = now if n == len(now.data) else gathered(now, own, True)
        reaching = [(place[a[ok]], new[b[ok]]) for a, b in sides for ok in [kept[k + 1][b]]]
        if kind == "sage":
            parts, width = [], p[f"{k}.out.near.w"].data.shape[1]
            for i, (side, (start, end)) in enumerate(zip(("out", "in"), reaching)):
                mean, at = means(now, start, end)
                parts.append((matmul(mean, p[f"{k}.{side}.near.w"]), at, slice(i * width, (i + 1) * width)))
            both = [beside(*[p[f"{k}.{side}.{name}"] for side in ("out", "in")]) for name in ("self.w", "near.b")]
            now = ramp(affine(mine, *both, parts))
        elif kind == "gat":
            start, end = reaching[0]
            other = start != own[end]  # a node attends to itself once
            starts, ends = np.concatenate([start[other], own]), np.concatenate([end[other], np.arange(n)])
            heads = shaped(linear(now, f"{k}.map"), len(now.data), *p[f"{k}.from"].data.shape[1:])
            score = lambda end: summed(times(heads, p[f"{k}.{end}"]), 2)  # noqa: B023, E731
            share = dropped(softmax_by(ramp(add(gathered(score("from"), starts), gathered(score("to"), own[ends])), SLOPE), ends, n))
            seen = scattered(times(gathered(heads, starts), shaped(share, len(starts), HEADS, 1)), ends, n)
            now = ramp(add(shaped(seen, n, p[f"{k}.offset"].data.shape[1]), p[f"{k}.offset"]))
        else:
            near = scattered(gathered(now, reaching[0][0]), reaching[0][1], n)
            own_part = times(mine, add(Value(np.ones((1, 1))), p[f"{k}.eps"]))
            now = ramp(linear(ramp(linear(add(own_part, near), f"{k}.first")), f"{k}.second"))
        now = dropped(now)
    return linear(now, "head")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def loss_and_slopes(kind: str, weights: dict[str, np.ndarray], x: np.ndarray, sources: np.ndarray, targets: np.ndarray, y: np.ndarray, fit: np.ndarray, dropout: float, draw: np.random.Generator | None) -> tuple[float, dict[str, np.ndarray]]:
    """The sum over the rows to fit of the cross-entropy of their logits, and its slopes."""
    p = {k: Value(v) for k, v in weights.items()}
    z = logits(kind, p, x, sources, targets, dropout, draw, fit)
    s, y = z.data[:, 0], y[fit]
    loss = (np.logaddexp(0, s) - s * y).sum()
    flow_back(z, (sigmoid(s) - y)[:, None])
    return float(loss), {k: v.grad if v.grad is not None else np.zeros_like(v.data) for k, v in p.items()}
