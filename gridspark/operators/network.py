"""A feed-forward net as a list of matrices, for use inside tasks.

Each matrix has one more row than its layer has inputs; the last row is the bias. The
trunk is shared; each output has a head of its own when head widths are given, else one
linear layer ends the net.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

# Layer widths of the full net and of the small one.
TRUNK = (256, 256, 256, 256)
HEAD = (256, 128, 64, 32)
SMALL_TRUNK = (128, 64, 64)


@dataclass
class Net:
    trunk: list
    heads: list  # one list of matrices per output group; the last matrix is linear

    @property
    def matrices(self):
        return [*self.trunk, *(m for head in self.heads for m in head)]

    @property
    def is_linear(self):
        return not self.trunk and all(len(h) == 1 for h in self.heads)

    def flat(self) -> np.ndarray:
        return np.concatenate([m.ravel() for m in self.matrices])

    def with_flat(self, flat: np.ndarray) -> "Net":
        ends = np.cumsum([m.size for m in self.matrices])[:-1]
        parts = iter(p.reshape(m.shape) for p, m in zip(np.split(flat, ends), self.matrices))
        return Net([next(parts) for _ in self.trunk], [[next(parts) for _ in h] for h in self.heads])


def _layer(rng, n_in, n_out):
    weights = rng.normal(0.0, np.sqrt(2.0 / (n_in + n_out)), (n_in, n_out))
    return np.vstack([weights, np.zeros((1, n_out))])


def new_net(n_in: int, n_out: int, trunk=TRUNK, head=HEAD, seed: int = 0) -> Net:
    """Random weights with variance 2 / (inputs + outputs), zero biases."""
    rng = np.random.default_rng(seed)
    widths = [n_in, *trunk]
    shared = [_layer(rng, a, b) for a, b in zip(widths, widths[1:])]
    if head is None:
        return Net(shared, [[_layer(rng, widths[-1], n_out)]])
    own = [widths[-1], *head, 1]
    return Net(shared, [[_layer(rng, a, b) for a, b in zip(own, own[1:])] for _ in range(n_out)])


def _affine(x, m):
    return x @ m[:-1] + m[-1]


def forward(net: Net, x: np.ndarray) -> np.ndarray:
    """(rows, outputs)"""
    for m in net.trunk:
        x = np.maximum(_affine(x, m), 0.0)
    outputs = []
    for head in net.heads:
        h = x
        for m in head[:-1]:
            h = np.maximum(_affine(h, m), 0.0)
        outputs.append(_affine(h, head[-1]))
    return np.hstack(outputs)


def _loss(name, d):
    """Loss and its slope at error d, per element."""
    if name == "log_cosh":
        size = np.abs(d)
        return size + np.log1p(np.exp(-2.0 * size)) - np.log(2.0), np.tanh(d)
    if name == "mse":
        return d * d, 2.0 * d
    if name == "mae":
        return np.abs(d), np.sign(d)
    raise ValueError(f"unknown loss {name!r}")


def _backward(matrices, inputs, slope, last_linear):
    """Gradients of a chain of layers and the slope at its input."""
    grads = []
    for i in range(len(matrices) - 1, -1, -1):
        x, out = inputs[i]
        if not (last_linear and i == len(matrices) - 1):
            slope = slope * (out > 0)
        grads.append(np.vstack([x.T @ slope, slope.sum(axis=0, keepdims=True)]))
        slope = slope @ matrices[i][:-1].T
    return grads[::-1], slope


def losses(net: Net, x: np.ndarray, y: np.ndarray, loss: str):
    """(summed loss, summed |error|, summed error²) over the rows, by a forward pass only."""
    d = forward(net, x) - y
    value, _ = _loss(loss, d)
    return value.sum(), np.abs(d).sum(), (d * d).sum()


def gradient(net: Net, x: np.ndarray, y: np.ndarray, loss: str):
    """(summed loss, summed |error|, summed error², flat summed gradient) over the rows.

    Everything is a sum over rows, so partial results of any partitioning add up.
    """
    trunk_io, h = [], x
    for m in net.trunk:
        out = np.maximum(_affine(h, m), 0.0)
        trunk_io.append((h, out))
        h = out
    total = absolute = square = 0.0
    back, head_grads, start = np.zeros_like(h), [], 0
    for head in net.heads:
        io, t = [], h
        for i, m in enumerate(head):
            out = _affine(t, m)
            if i < len(head) - 1:
                out = np.maximum(out, 0.0)
            io.append((t, out))
            t = out
        d = t - y[:, start:start + t.shape[1]]
        start += t.shape[1]
        value, slope = _loss(loss, d)
        total += value.sum()
        absolute += np.abs(d).sum()
        square += (d * d).sum()
        grads, slope = _backward(head, io, slope, last_linear=True)
        head_grads += grads
        back += slope
    trunk_grads, _ = _backward(net.trunk, trunk_io, back, last_linear=False)
    flat = np.concatenate([g.ravel() for g in [*trunk_grads, *head_grads]])
    return total, absolute, square, flat


def slopes(matrices: list, x: np.ndarray, way: np.ndarray, output: int):
    """One output of a chain of layers, the last one linear, seen from x along ``way``.

    (value, gradient at x, how far along the way the first rectifier turns, at most infinity)
    """
    h, along, active = x, way, []
    turn = np.full(len(x), np.inf)
    for m in matrices[:-1]:
        before, change = _affine(h, m), along @ m[:-1]
        on = before > 0
        # A unit turns ahead if it moves towards zero from where it is.
        ahead = np.divide(-before, change, out=np.full_like(before, np.inf), where=(change != 0) & (before * change < 0))
        turn = np.minimum(turn, ahead.min(axis=1))
        h, along = before * on, change * on
        active.append(on)
    value = _affine(h, matrices[-1])[:, output]
    back = np.tile(matrices[-1][:-1, output], (len(x), 1))
    for m, on in zip(matrices[-2::-1], active[::-1]):
        back = (back * on) @ m[:-1].T
    return value, back, turn


SKIP = 1e-10


def path_contributions(matrices: list, x: np.ndarray, base: np.ndarray, output: int, steps: int | None = None):
    """(contributions, rise) of each row: gradients integrated along the straight way from base to x.

    A net of rectifiers is a chain of straight pieces on that way. Without ``steps`` every
    row walks from bend to bend, so its contributions add up to its rise but for rounding
    (pieces below ``SKIP`` of the way count to the next one). With ``steps``, gradients are
    taken in the middle of as many equal parts: the sum is off by at most the changes of
    slope on the way over 2 * steps, and a linear net is exact with one.
    """
    gap = x - base
    total = np.zeros_like(x)
    rise = slopes(matrices, x, gap, output)[0] - slopes(matrices, base, gap, output)[0]
    if steps:
        for at in (np.arange(steps) + 0.5) / steps:
            total += slopes(matrices, base + at * gap, gap, output)[1]
        return total * gap / steps, rise
    at, going = np.zeros(len(x)), np.arange(len(x))
    while len(going):
        start = at[going]
        seen = np.minimum(start + SKIP, 1.0)
        _, gradient, turn = slopes(matrices, base[going] + seen[:, None] * gap[going], gap[going], output)
        end = np.minimum(seen + turn, 1.0)
        total[going] += gradient * (end - start)[:, None]
        at[going] = end
        going = going[end < 1.0]
    return total * gap, rise


# --- weights as a table ----------------------------------------------------------------

WEIGHTS = "part STRING, head INT, layer INT, n_rows INT, n_cols INT, weights ARRAY<DOUBLE>"


def to_table(spark: SparkSession, net: Net) -> DataFrame:
    parts = [("trunk", 0, i, m) for i, m in enumerate(net.trunk)]
    parts += [("head", h, i, m) for h, head in enumerate(net.heads) for i, m in enumerate(head)]
    rows = [(p, h, i, *m.shape, m.ravel().tolist()) for p, h, i, m in parts]
    return spark.createDataFrame(rows, WEIGHTS)


def from_table(weights: DataFrame) -> Net:
    """The model itself comes to the driver; its size does not depend on the data."""
    trunk, heads = {}, {}
    for r in weights.collect():
        m = np.array(r.weights, dtype=float).reshape(r.n_rows, r.n_cols)
        if r.part == "trunk":
            trunk[r.layer] = m
        else:
            heads.setdefault(r.head, {})[r.layer] = m
    return Net([trunk[i] for i in sorted(trunk)],
               [[heads[h][i] for i in sorted(heads[h])] for h in sorted(heads)])
