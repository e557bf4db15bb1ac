"""Array work done inside tasks on one bounded batch or group at a time.

The module is shipped to executors by value, so a cluster needs no copy of the
package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

EULER = 0.5772156649015329
BLOCK = 4_000_000  # distances held at a time


# -- text -------------------------------------------------------------------
def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by one bit row per character of ``b``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# -- isolation trees --------------------------------------------------------
def expected_depth(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_intervals(values: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list[float], list[float]]:
    """A one-column isolation tree as a step function.

    ``depths[i]`` is the path length of a value between ``cuts[i-1]`` and
    ``cuts[i]``; leaves are visited from left to right.
    """
    cuts: list[float] = []
    depths: list[float] = []
    # (first, last + 1, depth, cut to the left of this node)
    stack: list[tuple[int, int, int, float | None]] = [(0, len(values), 0, None)]
    while stack:
        start, stop, depth, left_cut = stack.pop()
        lo, hi = values[start], values[stop - 1]
        if depth >= limit or stop - start <= 1 or lo == hi:
            if left_cut is not None:
                cuts.append(left_cut)
            depths.append(depth + expected_depth(stop - start))
            continue
        cut = float(rng.uniform(lo, hi))
        middle = start + int(np.searchsorted(values[start:stop], cut, side="right"))
        middle = min(max(middle, start + 1), stop - 1)
        stack.append((middle, stop, depth + 1, cut))
        stack.append((start, middle, depth + 1, left_cut))
    return cuts, depths


def merge_steps(steps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The mean of step functions, itself a step function over all their cuts."""
    edges = np.unique(np.concatenate([c for c, _ in steps])) if steps else np.array([])
    inner = np.append(edges, np.inf)
    total = np.zeros(len(inner))
    for cuts, depths in steps:
        total += depths[np.searchsorted(cuts, inner, side="left")]
    return edges, total / max(len(steps), 1)


# -- local outlier factor ---------------------------------------------------
def nearest_windows(values: np.ndarray, k: int) -> np.ndarray:
    """Start of the window of k + 1 sorted values that holds each value's k nearest.

    On equal distance the value to the left is the nearer one.
    """
    m = len(values)
    places = np.arange(m)
    padded = np.append(values, np.inf)
    best = np.zeros(m, dtype=int)
    reach = np.full(m, np.inf)
    for offset in range(k, -1, -1):
        start = places - offset
        valid = (start >= 0) & (start + k < m)
        safe = np.where(valid, start, 0)
        far = np.maximum(values - values[safe], values[np.minimum(safe + k, m - 1)] - values)
        # Nothing left out on the right may be nearer than what is in.
        left_out = padded[np.minimum(safe + k + 1, m)] - values
        better = valid & (left_out >= far) & (far < reach)
        best[better], reach[better] = start[better], far[better]
    return best


def local_factors(values: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factor of every value of a sorted array."""
    starts = nearest_windows(values, k)
    distance = np.maximum(values - values[starts], values[starts + k] - values)
    reached = np.zeros(len(values))
    places = np.arange(len(values))
    for step in range(k + 1):
        other = starts + step
        gap = np.maximum(np.abs(values - values[other]), distance[other])
        reached += np.where(other == places, 0.0, gap)
    density = 1.0 / (reached / k + 1e-10)
    around = np.zeros(len(values))
    for step in range(k + 1):
        other = starts + step
        around += np.where(other == places, 0.0, density[other])
    return around / k / density


# -- nearest neighbours -----------------------------------------------------
class Cells:
    """Median cuts as a complete binary tree; its leaves are the cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        inner = 2**depth - 1
        self.depth = depth
        self.dims = np.zeros(inner, dtype=int)
        self.cuts = np.zeros(inner)
        width = sample.shape[1]
        low = np.full((2 * inner + 1, width), -np.inf)
        high = np.full((2 * inner + 1, width), np.inf)
        parts = {0: sample}
        for node in range(inner):
            points = parts.pop(node)
            dim = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
            cut = float(np.median(points[:, dim])) if len(points) else 0.0
            self.dims[node], self.cuts[node] = dim, cut
            goes_left = points[:, dim] <= cut
            for child, side in ((2 * node + 1, goes_left), (2 * node + 2, ~goes_left)):
                parts[child] = points[side]
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, dim] = min(high[node, dim], cut)
            low[2 * node + 2, dim] = max(low[node, dim], cut)
        self.low, self.high = low[inner:], high[inner:]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=int)
        for _ in range(self.depth):
            value = points[np.arange(len(points)), self.dims[node]]
            node = 2 * node + 1 + (value > self.cuts[node])
        return node - (2**self.depth - 1)

    def within(self, points: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """Cells that may hold a point within each query's radius."""
        found = []
        for point, reach in zip(points, radius):
            gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
            found.append(np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= reach * (1 + 1e-12)))
        return found


def _distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    total = np.zeros((len(queries), len(points)))
    for j in range(points.shape[1]):
        total += (queries[:, j, None] - points[None, :, j]) ** 2
    return np.sqrt(total)


def as_matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float)


def distance_blocks(queries: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    step = max(1, BLOCK // max(len(points), 1))
    for start in range(0, len(queries), step):
        yield start, _distances(queries[start : start + step], points)


def nearest_in_rows(distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest entries of every row, first column on ties."""
    take = min(k, distances.shape[1])
    limit = np.partition(distances, take - 1, axis=1)[:, take - 1]
    rows, columns = np.nonzero(distances <= limit[:, None])
    order = np.lexsort((columns, distances[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < take], columns[place < take]


# -- bootstraps -------------------------------------------------------------
def drawn_sums(
    batches: Iterator[pd.DataFrame], keys: list[str], count: str, trees: int, rate: float, replace: bool, powers: int, seed: list[int]
) -> Iterator[pd.DataFrame]:
    """Each tree's drawn rows summed by group: (keys, first, w, s, q), the sums of w, w * y and w * y * y from tree ``first`` on."""
    rng = np.random.default_rng(seed)
    for rows in _gathered(batches):
        n, y = rows[count].to_numpy(), rows["y"].to_numpy()
        place = rows.groupby(keys, sort=False).ngroup().to_numpy()  # numbered by first sight
        groups = rows.loc[~rows.duplicated(keys), keys].reset_index(drop=True)
        step = max(1, BLOCK // (3 * len(groups)))
        for first in range(0, trees, step):
            sums = np.zeros((3, len(groups), min(step, trees - first)))
            for tree in range(sums.shape[2]):
                w = (rng.poisson(n * rate) if replace else rng.binomial(n, rate)).astype(float)
                for power in range(powers):
                    sums[power, :, tree] = np.bincount(place, w * y**power, len(groups))
            yield groups.assign(first=first, w=list(sums[0]), s=list(sums[1]), q=list(sums[2]))


def _gathered(batches: Iterator[pd.DataFrame], least: int = 200_000) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


# -- trees over cells -------------------------------------------------------
def _impurity(sums: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity by row of (w, w * y, w * y * y), or of weights by class."""
    w = sums[:, 0] if kind == "variance" else sums.sum(axis=1)
    part = sums / np.where(w > 0, w, 1.0)[:, None]
    if kind == "variance":
        return w, np.maximum(part[:, 2] - part[:, 1] ** 2, 0.0)
    if kind == "gini":
        return w, 1 - (part**2).sum(axis=1)
    return w, -(part * np.log2(np.where(part > 0, part, 1.0))).sum(axis=1)


def grow_tree(
    bins: np.ndarray, sums: np.ndarray, kind: str, features: int, depth: int, least: float, gain: float, rng: np.random.Generator
) -> dict[str, np.ndarray]:
    """A tree over cells: what MLlib grows from their rows, with as many features drawn at each node.

    Nodes are rows of ``feature`` (-1 at a leaf), ``cut`` (the last bin that goes left), ``left`` and ``right``.
    """
    won: dict[int, float] = {}
    nodes: list[list[int]] = [[-1, 0, 0, 0]]
    ends: list[np.ndarray] = [sums.sum(axis=0)]
    todo = [(0, np.arange(len(bins)), 0)]
    while todo:
        node, rows, level = todo.pop()
        whole = ends[node]
        (weight,), (before,) = _impurity(whole[None], kind)
        best = (0.0, -1, 0, whole)
        if level < depth and before > 0:
            for feature in rng.permutation(bins.shape[1])[:features]:
                at = bins[rows, feature]
                left = np.cumsum([np.bincount(at, part) for part in sums[rows].T], axis=1).T[:-1]
                (lw, li), (rw, ri) = _impurity(left, kind), _impurity(whole - left, kind)
                gains = np.where((lw >= least) & (rw >= least), before - (lw * li + rw * ri) / weight, 0.0)
                if len(gains) and gains.max() > best[0] and gains.max() >= gain:
                    best = (gains.max(), int(feature), int(gains.argmax()), left[gains.argmax()])
        if best[1] >= 0:
            goes_left = bins[rows, best[1]] <= best[2]
            won[node] = best[0] * weight
            nodes[node] = [best[1], best[2], len(nodes), len(nodes) + 1]
            for part, end in ((rows[goes_left], best[3]), (rows[~goes_left], whole - best[3])):
                todo.append((len(nodes), part, level + 1))
                nodes.append([-1, 0, 0, 0])
                ends.append(end)
    if kind == "variance":
        values = np.array([[e[1] / e[0]] for e in ends])
    else:
        values = np.array([e / e.sum() for e in ends])
    answers = values[:, 0] if kind == "variance" else values.argmax(axis=1)
    for node in reversed(list(won)):  # a split into leaves of one answer is undone
        _, _, left, right = nodes[node]
        if nodes[left][0] < 0 and nodes[right][0] < 0 and answers[left] == answers[right]:
            nodes[node] = [-1, 0, 0, 0]
            del won[node]
    importance = np.zeros(bins.shape[1])
    for node, gained in won.items():
        importance[nodes[node][0]] += gained
    feature, cut, left, right = np.array(nodes).T
    return {"feature": feature, "cut": cut, "left": left, "right": right, "value": values.ravel(), "importance": importance / (importance.sum() or 1.0)}


def forest_votes(bins: np.ndarray, trees: list[dict[str, np.ndarray]], width: int) -> np.ndarray:
    """The sum of all trees' values for each row."""
    cells, place = np.unique(bins, axis=0, return_inverse=True)
    votes = np.zeros((len(cells), width))
    for tree in trees:
        node = np.zeros(len(cells), dtype=int)
        while (inner := np.flatnonzero(tree["feature"][node] >= 0)).size:
            at = node[inner]
            goes_left = cells[inner, tree["feature"][at]] <= tree["cut"][at]
            node[inner] = np.where(goes_left, tree["left"][at], tree["right"][at])
        votes += tree["value"].reshape(-1, width)[node]
    return votes[place.ravel()]


# -- neural networks --------------------------------------------------------
def network_loss(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy of sigmoid layers under a softmax, and its gradient; ``weights`` as MLlib lays them out."""
    parts, at = [], 0
    for a, b in zip(layers, layers[1:]):
        parts.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    loss, slopes = 0.0, [(np.zeros_like(m), np.zeros_like(b)) for m, b in parts]
    step = max(1, BLOCK // (20 * max(layers)))
    for low in range(0, len(x), step):
        outs, own = [x[low : low + step]], share[low : low + step, None]
        for matrix, bias in parts[:-1]:
            outs.append(1 / (1 + np.exp(-(outs[-1] @ matrix + bias))))
        top = outs[-1] @ parts[-1][0] + parts[-1][1]
        top = np.exp(top - top.max(axis=1, keepdims=True))
        top /= top.sum(axis=1, keepdims=True)
        target = np.zeros_like(top)
        target[np.arange(len(top)), y[low : low + step]] = 1.0
        loss -= (own * target * np.log(top)).sum()
        delta = own * (top - target)
        for i in reversed(range(len(parts))):
            slopes[i][0][:] += outs[i].T @ delta
            slopes[i][1][:] += delta.sum(axis=0)
            if i:
                delta = (delta @ parts[i][0].T) * outs[i] * (1 - outs[i])
    return loss, np.concatenate([v.ravel() for pair in slopes for v in pair])


class _NoStep(Exception):
    """A search for a step that failed."""


def _wolfe(phi: Callable[[float], tuple[float, float]], value: float, slope: float, t: float) -> float:
    """A step that meets the strong Wolfe conditions, searched as Breeze does."""
    if slope > 0:
        raise _NoStep

    def between(l: tuple[float, float, float], r: tuple[float, float, float]) -> float:
        d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        d2 = np.sqrt(np.float64(d1 * d1 - l[2] * r[2]))
        t = r[0] - (r[0] - l[0]) * (r[2] + d2 - d1) / (r[2] - l[2] + 2 * d2)
        low, high = l[0] + 0.1 * (r[0] - l[0]), l[0] + 0.9 * (r[0] - l[0])
        return low if t < low else high if t > high else t

    def zoom(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
        for _ in range(10):
            t = between(high, low) if low[0] > high[0] else between(low, high)
            c = (t, *phi(t))
            if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return t
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _NoStep

    low = (0.0, value, slope)
    for i in range(10):
        c = (t, *phi(t))
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _NoStep


def minimized(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Where L-BFGS ends, by the steps and tests of Breeze, which MLlib uses."""
    (value, grad), first, done, failed = loss(x), None, 0, False
    first, moves, last = value, [], [np.inf]  # moves: (step, change of the gradient), newest first
    while done < steps:
        # The loss of the last twenty steps no longer falls, or the gradient is small.
        if (len(last) >= 2 and abs(value - max(last)) <= tolerance * first) or np.linalg.norm(grad) < max(tolerance * value, 1e-8):
            break
        try:
            way, kept = grad.copy(), []
            for s, g in moves:
                rho = s @ g
                if not (s @ way) / rho == (s @ way) / rho or (not kept and rho < 0):
                    raise _NoStep
                kept.append((rho, (s @ way) / rho))
                way -= kept[-1][1] * g
            if moves:
                way *= kept[0][0] / (moves[0][1] @ moves[0][1])
            for (s, g), (rho, a) in zip(reversed(moves), reversed(kept)):
                way += (a - (g @ way) / rho) * s
            way = -way
            seen: dict[float, tuple[float, np.ndarray]] = {}

            def phi(t: float) -> tuple[float, float]:
                seen[t] = loss(x + t * way)
                return seen[t][0], seen[t][1] @ way

            t = _wolfe(phi, value, grad @ way, 1.0 if done else 1 / np.linalg.norm(way))
            if t * np.linalg.norm(grad) < 1e-10:
                raise _NoStep
        except _NoStep:
            if failed:
                break
            failed, moves = True, []
            continue
        moves = [(t * way, seen[t][1] - grad), *moves][:memory]
        x, (value, grad), done, failed = x + t * way, seen[t], done + 1, False
        last = [*last, value][-20:]
    return x


def fit_network(start: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, count: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """The weights of a network fitted on rows that stand for ``count`` rows each."""
    share = count / count.sum()
    with np.errstate(all="ignore"):  # a step too far gives no finite loss, and is halved
        return minimized(lambda w: network_loss(w, layers, x, y, share), start, steps, tolerance)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
