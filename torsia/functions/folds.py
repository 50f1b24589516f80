"""Folds of short runs of columns through a chain of states, many runs at once, with numpy inside tasks.

A run is handed a vector over what stands before its first column: the start of the
chain, then the states. Its matrix has a row for each of these and a column per
state, every row scaled to a largest entry of 1, with the log of the scale beside
it. Nulls among the scores of a run, or too few of them, make its matrix null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def cells_of(e: pa.ListArray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, offsets, whole) of lists of score lists: a row per column, offsets per list, and which lists lack nothing."""
    inner = e.flatten()
    at = np.concatenate([[0], np.cumsum(e.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    lengths = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = inner.flatten()
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    held = np.concatenate([[0], np.cumsum(nulls)])
    fit = (lengths == states) & (held[ends[1:]] == held[ends[:-1]])
    scores = np.zeros((len(lengths), states))
    if fit.all():
        scores[:] = flat.to_numpy(zero_copy_only=False).reshape(-1, states)
    else:
        values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
        scores[fit] = values[ends[:-1][fit][:, None] + np.arange(states)]
    gaps = np.concatenate([[0], np.cumsum(~fit)])
    return scores, at, gaps[at[1:]] == gaps[at[:-1]]


def weights_of(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials with the top of each column taken out first, so none overflows, and these tops."""
    top = scores.max(axis=1) if len(scores) else np.zeros(0)
    return np.exp(scores - top[:, None]), top


def _by_length(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs, longest first, and how many have more than t columns."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    return order, np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")


def _unit(v: np.ndarray) -> np.ndarray:
    top = v.max(axis=-1, keepdims=True)
    return v / np.where(top == 0, 1.0, top)


def matrices(weights: np.ndarray, tops: np.ndarray, at: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, logs) of each run; ``start`` has a vector per run that enters its first column without a move."""
    n, s = len(at) - 1, moves.shape[0]
    rows, logs = np.zeros((n, s + 1, s)), np.zeros((n, s + 1))
    order, more = _by_length(at)
    with np.errstate(divide="ignore"):
        for t, k in enumerate(more):
            live = order[:k]
            cell = at[live] + t
            before = rows[live] @ moves if t else np.concatenate([start[live][:, None], np.broadcast_to(moves, (k, s, s))], axis=1)
            after = before * weights[cell][:, None, :]
            top = after.max(axis=2)
            logs[live] += np.log(top) + tops[cell][:, None]
            rows[live] = after / np.where(top == 0, 1.0, top)[:, :, None]
    return rows, logs


def through(v: np.ndarray, rows: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (n, states + 1) carried through matrices: the same kind of vectors, scaled, and the logs of the scales."""
    scale = np.where(v > 0, logs, -np.inf)
    top = scale.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    out = np.einsum("ni,nij->nj", v * np.exp(scale - safe[:, None]), rows)
    size = out.max(axis=1)
    with np.errstate(divide="ignore"):
        log = safe + np.log(size)
    return np.concatenate([np.zeros((len(v), 1)), out / np.where(size == 0, 1.0, size)[:, None]], axis=1), log


def back(rows: np.ndarray, logs: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Vectors (n, states) of what follows, carried back through matrices, scaled."""
    scale = logs[:, 1:]
    top = scale.max(axis=1, keepdims=True)
    return _unit(np.einsum("nij,nj->ni", rows[:, 1:], out) * np.exp(scale - np.where(np.isfinite(top), top, 0.0)))


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (rows, logs) of runs followed by others."""
    (x, p), (y, q) = a, b
    n, r, s = x.shape
    flat = np.concatenate([np.zeros((n * r, 1)), x.reshape(n * r, s)], axis=1)
    v, log = through(flat, np.repeat(y, r, axis=0), np.repeat(q, r, axis=0))
    return v[:, 1:].reshape(n, r, s), p + log.reshape(n, r)


def products(rows: np.ndarray, logs: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product of each list of ``n`` neighbouring matrices from ``first`` on."""
    out, scale = rows[first].copy(), logs[first].copy()
    for t in range(1, n.max(initial=0)):
        live = np.flatnonzero(n > t)
        out[live], scale[live] = product((out[live], scale[live]), (rows[first[live] + t], logs[first[live] + t]))
    return out, scale


def posterior(weights: np.ndarray, at: np.ndarray, enter: np.ndarray, leave: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Shares of the states per column; ``enter`` (start, then states) and ``leave`` per run."""
    order, more = _by_length(at)
    ahead, behind = np.zeros_like(weights), np.zeros_like(weights)
    for t, k in enumerate(more):
        live = order[:k]
        cell = at[live] + t
        moved = ahead[cell - 1] @ moves if t else enter[live, :1] * start[live] + enter[live, 1:] @ moves
        ahead[cell] = _unit(moved * weights[cell])
    v = leave.copy()
    for t in range(len(more)):
        live = order[: more[t]]
        cell = at[live + 1] - 1 - t
        behind[cell] = v[live]
        v[live] = _unit((v[live] * weights[cell]) @ moves.T)
    both = ahead * behind
    with np.errstate(invalid="ignore"):
        return both / both.sum(axis=1, keepdims=True)


def packed(rows: np.ndarray, logs: np.ndarray, whole: np.ndarray) -> pa.ListArray:
    """Matrices as one list each, null where not whole."""
    flat = np.concatenate([rows.reshape(len(rows), rows.shape[1] * rows.shape[2]), logs], axis=1)
    return lists(flat, whole)


def lists(flat: np.ndarray, whole: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], mask=np.append(~whole, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1)))


def rows_of(given: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ``width`` numbers as rows, zeros for a null, and which are given."""
    whole = ~given.is_null().to_numpy(zero_copy_only=False)
    flat = np.zeros((len(given), width))
    begins = given.offsets.to_numpy()[:-1][whole]
    flat[whole] = given.values.to_numpy(zero_copy_only=False)[begins[:, None] + np.arange(width)]
    return flat, whole


def unpacked(m: pa.ListArray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, logs, whole) of packed matrices."""
    flat, whole = rows_of(m, (states + 1) * (states + 1))
    split = (states + 1) * states
    return flat[:, :split].reshape(-1, states + 1, states), flat[:, split:], whole
