"""The logistic loss over all pairs of a good and a bad row, minimised in one pass over the rows a step.

A pair counts by the difference of two scores only. Scores lie in bins of WIDTH; the loss around two bins' centres is a
power series (radius pi, the offsets differ by WIDTH at most), so sums of powers of the offsets, alone and times the
row, give the loss and its gradient over all pairs, to rounding, from a table of the bins. The bins' number depends on
the range of the scores, not on the rows. The curvature counts rows at their bins' centres, which only steers the steps.
"""

import pickle
from collections.abc import Callable
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, TERMS = 0.5, 16


def gathered(rows: DataFrame, visit: Callable, merge: Callable):
    """visit(x, y) of the batches (x: array<double>, y) of a table that isn't empty, merged in its tasks and then between them."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = batch.column("y").to_numpy(zero_copy_only=False)
                got = visit(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y)
                total = got if total is None else merge(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["state"])

    return rows.select("x", "y").mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(bytes(r.state))).treeReduce(merge)


def spread_of(x: np.ndarray, y: np.ndarray) -> tuple:
    """Rows, good and bad ones, means and sums of squared differences from them."""
    mean = x.mean(0)
    return len(x), int((y == 1).sum()), int((y == 0).sum()), mean, ((x - mean) ** 2).sum(0)


def merged_spread(one: tuple, two: tuple) -> tuple:
    n, apart = one[0] + two[0], two[3] - one[3]
    return n, one[1] + two[1], one[2] + two[2], one[3] + apart * (two[0] / n), one[4] + two[4] + apart**2 * (one[0] * two[0] / n)


def moments(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """For each class (0, 1) and bin: sums of powers of the scores' offsets, alone and times the row, and of the rows' products."""
    out = {}
    for kind in (0, 1):
        rows = x[y == kind]
        s = rows @ w
        bins = np.floor(s / WIDTH).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        rows, s, bins = rows[order], s[order], bins[order]
        starts = np.flatnonzero(np.diff(bins, prepend=bins[:1] - 1))
        for lo, hi in zip(starts, [*starts[1:], len(bins)]):
            z = rows[lo:hi]
            powers = (s[lo:hi] - (bins[lo] + 0.5) * WIDTH)[None, :] ** np.arange(TERMS)[:, None]
            out[kind, int(bins[lo])] = np.column_stack([powers.sum(1), powers @ z]), z.T @ z
    return out


def merged_moments(one: dict, two: dict) -> dict:
    for at, (a, b) in two.items():
        one[at] = (one[at][0] + a, one[at][1] + b) if at in one else (a, b)
    return one


def derivatives(d: np.ndarray, n: int) -> list[np.ndarray]:
    """log(1 + exp(-d)) and its first n derivatives, which are polynomials of the logistic function."""
    s = 1 / (1 + np.exp(np.clip(d, -700, 700)))
    out, p = [np.logaddexp(0, -d)], np.polynomial.Polynomial([0, -1])
    for _ in range(n):
        out.append(p(s))
        p = p.deriv() * np.polynomial.Polynomial([0, -1, 1])
    return out


def pair_sums(found: dict) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs, its gradient and its curvature, of merged `moments`."""
    at = [sorted(b for kind, b in found if kind == k) for k in (0, 1)]
    (bad, bad2), (good, good2) = ([np.array(x) for x in zip(*(found[k, b] for b in at[k]))] for k in (0, 1))
    f = derivatives(WIDTH * np.subtract.outer(np.array(at[1], float), np.array(at[0], float)), TERMS)
    pairs = good[:, 0, 0].sum() * bad[:, 0, 0].sum()
    loss, grad = 0.0, np.zeros(good.shape[2] - 1)
    for k in range(TERMS):
        for m in range(TERMS - k):
            g, b = good[:, k] / factorial(k), bad[:, m] * ((-1) ** m / factorial(m))
            loss += g[:, 0] @ f[k + m] @ b[:, 0]
            grad += (f[k + m + 1] @ b[:, 0]) @ g[:, 1:] - (g[:, 0] @ f[k + m + 1]) @ b[:, 1:]
    across = good[:, 0, 1:].T @ f[2] @ bad[:, 0, 1:]
    curve = np.tensordot(f[2] @ bad[:, 0, 0], good2, 1) + np.tensordot(good[:, 0, 0] @ f[2], bad2, 1) - across - across.T
    return loss / pairs, grad / pairs, curve / pairs


def fitted(sums: Callable, size: int, decay: float, steps: int = 100, least: float = 1e-8) -> np.ndarray:
    """Weights of the least loss plus decay / 2 times their squares: Newton steps, halved until the loss falls; `sums(w)` gives `pair_sums`."""

    def at(w):
        loss, grad, curve = sums(w)
        return w, loss + decay / 2 * w @ w, grad + decay * w, curve + decay * np.eye(size)

    w, loss, grad, curve = at(np.zeros(size))
    for _ in range(steps):
        step = -np.linalg.solve(curve, grad)
        new = at(w + step)
        while new[1] > loss + 1e-4 * (grad @ step) + 1e-13 and np.abs(step).max() > least:
            step = step / 2
            new = at(w + step)
        w, loss, grad, curve = new
        if np.abs(step).max() <= least:
            return w
    raise RuntimeError(f"the pair loss did not settle in {steps} steps")


def order_values(count: Callable, ranks: list[int], lo: float, hi: float) -> list[float]:
    """The values of these ranks (from 0) among scores from lo to hi; `count(ranges)` gives `ranks_within`, so each pass narrows a range 4 096 times."""
    ranges = [(lo, hi)] * len(ranks)
    while any(a < b for a, b in ranges):
        narrowed = []
        for rank, (below, counts, least, most) in zip(ranks, count(ranges)):
            i = int(np.searchsorted(below + np.cumsum(counts), rank, "right"))
            narrowed.append((float(least[i]), float(most[i])))
        ranges = narrowed
    return [a for a, _ in ranges]


def ranks_within(s: np.ndarray, ranges: list[tuple[float, float]], parts: int = 4096) -> list[tuple]:
    """For each closed range: the scores below it, and of each of its parts their number, least and greatest."""
    s, out = np.sort(s), []
    for a, b in ranges:
        within = s[np.searchsorted(s, a, "left") : np.searchsorted(s, b, "right")]
        ends = np.searchsorted(within, np.linspace(a, b, parts + 1)[1:-1], "left")
        starts, ends = np.concatenate([[0], ends]), np.concatenate([ends, [len(within)]])
        some = ends > starts
        least, most = np.full(parts, np.inf), np.full(parts, -np.inf)
        least[some], most[some] = within[starts[some]], within[ends[some] - 1]
        out.append((int(np.searchsorted(s, a, "left")), ends - starts, least, most))
    return out


def merged_ranks(one: list, two: list) -> list:
    return [(a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])) for a, b in zip(one, two)]
