"""A bidirectional LSTM over characters with CRF transitions, trained in numpy.

Both directions are run side by side as one array. The emissions are a linear map of the two hidden states;
the CRF adds start scores and transitions between tags. Training maximises the likelihood of the labelled tag
sequences with Adam; its gradient comes from the forward-backward sums of the CRF and from back-propagation
through time. All draws come from a fixed seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    symbols: int
    tags: int
    embedding: int = 12
    hidden: int = 16


Params = dict[str, np.ndarray]


def start_params(shape: Shape, rng: np.random.Generator) -> Params:
    e, h, k = shape.embedding, shape.hidden, shape.tags
    params = {
        "embed": rng.normal(0, 0.3, (shape.symbols, e)),
        "wx": rng.normal(0, e**-0.5, (2, e, 4 * h)),
        "wh": rng.normal(0, h**-0.5, (2, h, 4 * h)),
        "b": np.zeros((2, 1, 4 * h)),
        "out": rng.normal(0, (2 * h) ** -0.5, (2 * h, k)),
        "bias": np.zeros(k),
        "start": np.zeros(k),
        "move": rng.normal(0, 0.1, (k, k)),
    }
    params["b"][:, :, h : 2 * h] = 1.0  # remember at first
    return {name: v.astype(np.float32) for name, v in params.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(params: Params, x: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (batch, time, 2 hidden) for symbols (batch, time)."""
    batch, time = x.shape
    h_size = params["wh"].shape[1]
    table = np.matmul(params["embed"][None], params["wx"]) + params["b"]
    both = np.stack([x, x[:, ::-1]])
    h = np.zeros((2, batch, h_size), np.float32)
    c = np.zeros_like(h)
    states = np.empty((time, 2, batch, h_size), np.float32)
    side = np.arange(2)[:, None]
    for t in range(time):
        gates = table[side, both[:, :, t]] + np.matmul(h, params["wh"])
        squashed = _sigmoid(gates[:, :, : 3 * h_size])
        i, f, o = (squashed[:, :, n * h_size : (n + 1) * h_size] for n in range(3))
        g = np.tanh(gates[:, :, 3 * h_size :])
        before, previous = c, h
        c = f * c + i * g
        squeezed = np.tanh(c)
        h = o * squeezed
        states[t] = h
        if keep is not None:
            keep.append((i, f, o, g, before, previous, squeezed))
    return np.concatenate([states[:, 0].swapaxes(0, 1), states[::-1, 1].swapaxes(0, 1)], axis=2)


def emissions(params: Params, x: np.ndarray) -> np.ndarray:
    """Scores (batch, time, tags) of the tags at each place."""
    return _lstm(params, x, None) @ params["out"] + params["bias"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf(params: Params, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean loss, and its gradients by the scores, the transitions and the start scores."""
    batch, time, k = scores.shape
    move, start = params["move"], params["start"]
    forward = np.empty((time, batch, k), np.float32)
    backward = np.zeros((time, batch, k), np.float32)
    forward[0] = start + scores[:, 0]
    for t in range(1, time):
        forward[t] = _log_sum(forward[t - 1][:, :, None] + move[None], 1) + scores[:, t]
    for t in range(time - 2, -1, -1):
        backward[t] = _log_sum(move[None] + (scores[:, t + 1] + backward[t + 1])[:, None, :], 2)
    total = _log_sum(forward[-1], 1)
    rows = np.arange(batch)
    gold = start[tags[:, 0]] + scores[rows[:, None], np.arange(time), tags].sum(1) + move[tags[:, :-1], tags[:, 1:]].sum(1)
    d_scores = np.exp(forward + backward - total[None, :, None]).swapaxes(0, 1)
    d_start = d_scores[:, 0].sum(0)
    pairs = (
        forward[:-1].swapaxes(0, 1)[:, :, :, None]
        + move
        + (scores[:, 1:] + backward[1:].swapaxes(0, 1))[:, :, None, :]
        - total[:, None, None, None]
    )
    d_move = np.exp(pairs).sum((0, 1))
    d_scores[rows[:, None], np.arange(time), tags] -= 1
    np.add.at(d_start, tags[:, 0], -1)
    np.add.at(d_move, (tags[:, :-1], tags[:, 1:]), -1)
    return float((total - gold).mean()), d_scores / batch, d_move / batch, d_start / batch


def loss_and_gradient(params: Params, x: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Mean negative log-likelihood of the tags, and its gradient by every parameter."""
    kept: list = []
    states = _lstm(params, x, kept)
    scores = states @ params["out"] + params["bias"]
    loss, d_scores, d_move, d_start = _crf(params, scores, tags)
    batch, time = x.shape
    h_size = params["wh"].shape[1]
    grad = {
        "move": d_move,
        "start": d_start,
        "out": np.einsum("bth,btk->hk", states, d_scores),
        "bias": d_scores.sum((0, 1)),
        "wh": np.zeros_like(params["wh"]),
    }
    d_states = d_scores @ params["out"].T
    ahead = d_states[:, :, :h_size].swapaxes(0, 1)
    back = d_states[:, :, h_size:].swapaxes(0, 1)[::-1]
    both = np.stack([x, x[:, ::-1]])
    table_grad = np.zeros((2, params["embed"].shape[0], 4 * h_size), np.float32)
    d_h = np.zeros((2, batch, h_size), np.float32)
    d_c = np.zeros_like(d_h)
    for t in range(time - 1, -1, -1):
        i, f, o, g, before, previous, squeezed = kept[t]
        d_h = d_h + np.stack([ahead[t], back[t]])
        d_c = d_c + d_h * o * (1 - squeezed**2)
        gates = np.concatenate(
            [d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * squeezed * o * (1 - o), d_c * i * (1 - g**2)], 2
        )
        for side in range(2):
            np.add.at(table_grad[side], both[side, :, t], gates[side])
        grad["wh"] += np.matmul(previous.swapaxes(1, 2), gates)
        d_h = np.matmul(gates, params["wh"].swapaxes(1, 2))
        d_c = d_c * f
    grad["b"] = table_grad.sum(1, keepdims=True)
    grad["wx"] = np.matmul(params["embed"].T[None], table_grad)
    grad["embed"] = np.matmul(table_grad, params["wx"].swapaxes(1, 2)).sum(0)
    return loss, grad


def train(
    x: np.ndarray, tags: np.ndarray, shape: Shape, steps: int, batch: int = 32, rate: float = 0.02, seed: int = 7
) -> Params:
    """Parameters after ``steps`` batches drawn from the labelled windows, the rate falling to a tenth."""
    rng = np.random.default_rng(seed)
    params = start_params(shape, rng)
    first = {name: np.zeros_like(v) for name, v in params.items()}
    second = {name: np.zeros_like(v) for name, v in params.items()}
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(x), batch)
        _, grad = loss_and_gradient(params, x[chosen], tags[chosen])
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        now = rate * (1 - 0.9 * step / steps)
        for name, g in grad.items():
            g = g * scale
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g**2
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
            params[name] = (params[name] - now * move).astype(np.float32)
    return params


def best_path(params: Params, scores: np.ndarray) -> np.ndarray:
    """The tags of the highest total for one sequence of scores (time, tags)."""
    time, k = scores.shape
    best = params["start"] + scores[0]
    back = np.zeros((time, k), np.int64)
    for t in range(1, time):
        reach = best[:, None] + params["move"]
        back[t] = reach.argmax(0)
        best = reach[back[t], np.arange(k)] + scores[t]
    path = np.empty(time, np.int64)
    path[-1] = best.argmax()
    for t in range(time - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path
