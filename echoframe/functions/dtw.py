"""Symmetric-2 dynamic time warping.

    R[1,1] = D[1,1],  R[i,j] = D[i,j] + min(R[i-1,j-1] + D[i,j], R[i-1,j], R[i,j-1])

over the Euclidean distances D of two clips' frames, on true lengths. The distance is R at the last
cell over a norm, and similarity its negative. `kernel` runs all pairs of clips of two lengths at once in numpy;
`dtw_column` is the same recurrence in Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import euclidean

#: Cells of a cost tensor that are held at once.
CELLS = 4_000_000
#: Numbers of a row of costs that quick() runs together, and its columns at most: three such rows stay in a core's cache. Rows and
#: columns of numbers are multiples of LINE, so that each starts on a line of the cache.
TILE, COLUMNS, LINE = 131_072, 512, 16


def kernel(a: np.ndarray, b: np.ndarray, band: float = 0.0) -> np.ndarray:
    """Unnormalised costs of clip pairs: a is [pairs, La, D], b is [pairs, Lb, D]. Cells with |i - j| > band are skipped
    where band is positive."""
    if a.shape[1] == 0 or b.shape[1] == 0:
        raise ValueError("clips must have a frame at least")
    n, la, lb = len(a), a.shape[1], b.shape[1]
    cost = np.empty((la, lb, n))
    if a.shape[2] < 8:
        # Each dimension of a frame of all pairs lies together.
        a, b = (np.ascontiguousarray(x.transpose(1, 2, 0)) for x in (a, b))
        for frame, row in zip(a, cost, strict=True):
            x = frame - b
            np.multiply(x, x, out=x)
            np.add.reduce(x, axis=1, out=row)
    else:
        for i in range(la):
            for j in range(lb):
                x = a[:, i] - b[:, j]
                np.einsum("nd,nd->n", x, x, out=cost[i, j])
    np.sqrt(cost, out=cost)
    if band <= 0:
        return recur(cost)
    above = np.full((lb + 1, n), np.inf)
    for i in range(la):
        row = np.full((lb + 1, n), np.inf)
        for j in range(lb):
            if abs(i - j) > band:
                continue
            d = cost[i, j]
            row[j + 1] = d if i == j == 0 else d + np.minimum(np.minimum(above[j] + d, above[j + 1]), row[j])
        above = row
    return above[lb]


def frame_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all frames of two lists, [m, D] and [n, D]. Few dimensions are summed one after the other; many by
    a matrix product, after which what it leaves near zero, where it would round, is computed from the differences."""
    if a.shape[1] < 8:
        out, x = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
        for d in range(a.shape[1]):
            np.subtract.outer(a[:, d], b[:, d], out=x)
            np.multiply(x, x, out=x)
            out += x
        return np.sqrt(out, out=out)
    sizes = np.add.outer(np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b))
    out = sizes - 2 * (a @ b.T)
    i, j = np.nonzero(out < 1e-5 * sizes)
    for k in range(0, len(i), 10_000):
        x = a[i[k : k + 10_000]] - b[j[k : k + 10_000]]
        out[i[k : k + 10_000], j[k : k + 10_000]] = np.einsum("ij,ij->i", x, x)
    return np.sqrt(out, out=out)


def recur(cost: np.ndarray) -> np.ndarray:
    """Unnormalised costs from frame distances [La, Lb, n]; the distances are overwritten."""
    la, lb, n = cost.shape
    above = None
    for i in range(la):
        row = cost[i]
        for j in range(lb):
            d = row[j]
            if i == 0:
                if j:
                    d += row[j - 1]
                continue
            best = above[j] if j == 0 else np.minimum(np.minimum(last + d, above[j]), row[j - 1])  # noqa: F821  `last` is the row above, one place back
            last = above[j]
            d += best
        above = row
    return above[lb - 1]


class Bounds:
    """Lower bounds of symmetric-2 costs. A path enters every row and every column once at least, and pays the distance where
    it does (the first cell counts for its row or its column alone), so a cost is at least the sum of each frame's distance
    to the other clip, the first frame of one side left out; and a frame is no nearer to a clip than to the balls
    around its segments."""

    def __init__(self, clips: list[np.ndarray], segment: int = 4):
        self.length = np.array([len(c) for c in clips])
        self.frames = np.concatenate(clips)
        self.start = np.cumsum(self.length) - self.length
        # Segments of all clips, in order: where each begins, and how many frames it has.
        parts = -(-self.length // segment)
        self.first = np.cumsum(parts) - parts
        cuts = np.repeat(self.start, parts) + segment * (np.arange(parts.sum()) - np.repeat(self.first, parts))
        self.sizes = np.diff(np.append(cuts, len(self.frames)))
        self.centre = np.add.reduceat(self.frames, cuts, axis=0) / self.sizes[:, None]
        away = self.frames - np.repeat(self.centre, self.sizes, axis=0)
        self.radius = np.maximum.reduceat(np.sqrt(np.einsum("ij,ij->i", away, away)), cuts)
        #: What rounding can make of a distance, relative to the numbers' size.
        self.slack = 1e-7 * np.abs(self.frames).max(initial=0) * self.frames.shape[1] ** 0.5

    def to(self, other: Bounds) -> np.ndarray:
        """[frames of self, clips of other]: the least distance of a frame to a clip's balls."""
        d = frame_distances(self.frames, other.centre) - (other.radius + self.slack + other.slack)
        return np.minimum.reduceat(np.maximum(d, 0, out=d), other.first, axis=1)

    def distances(self, other: Bounds, norm: str = "mean_length") -> np.ndarray:
        """[clips of self, clips of other]: bounds of the distances."""
        a, b = self.to(other), other.to(self)
        raw = np.add.reduceat(a, self.start, axis=0) + np.add.reduceat(b, other.start, axis=0).T - np.minimum(a[self.start], b[other.start].T)
        return NORMS[norm](raw, self.length[:, None], other.length[None])

    def within(self, other: Bounds, limit: np.ndarray, others: np.ndarray, norm: str = "mean_length") -> tuple[np.ndarray, np.ndarray]:
        """Pairs of clips whose bound is not above the limit of both. Bounds that are less than this one, and cheaper, are asked
        first: of boxes around parts of the clips, of boxes around clips, of segments with segments; each leaves
        its pairs to the next."""
        none = np.zeros(0, np.int64)
        a, b = self._boxes(limit), other._boxes(others)
        found = [(none, none)]
        x, y = np.nonzero(_reach(a.part, b.part, np.arange(len(a.part.limit))[:, None], np.arange(len(b.part.limit))[None], norm, 0.0))
        for k in range(0, len(x), step := max(1, PAIRS // PART**2)):
            i, j = (np.broadcast_to(m, (len(x[k : k + step]), PART, PART)) for m in (a.members[x[k : k + step], :, None], b.members[y[k : k + step], None, :]))
            near = _reach(a, b, i, j, norm, self.slack + other.slack) & (i >= 0) & (j >= 0)
            i, j = i[near], j[near]
            for n in range(0, len(i), PAIRS // 4):
                found.append(self._within(other, i[n : n + PAIRS // 4], j[n : n + PAIRS // 4], np.maximum(limit[i[n : n + PAIRS // 4]], others[j[n : n + PAIRS // 4]]), norm))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _within(self, other: Bounds, i: np.ndarray, j: np.ndarray, limit: np.ndarray, norm: str) -> tuple[np.ndarray, np.ndarray]:
        """Those of some pairs whose bound is not above the limit."""
        slack = self.slack + other.slack
        keep = NORMS[norm](_segments(self, other, i, j, slack), self.length[i], other.length[j]) * (1 - 1e-9) <= limit
        i, j, limit = i[keep], j[keep], limit[keep]
        found = np.zeros(len(i), bool)
        for some in _runs(self.length[i], other.length[j]):
            m, n = int(self.length[i[some[0]]]), int(other.length[j[some[0]]])
            for k in range(0, len(some), step := max(1, PAIRS // (m + n))):
                at = some[k : k + step]
                raw = _balls(self, other, i[at], j[at], m, n, slack)
                found[at] = NORMS[norm](raw, m, n) <= limit[at]
        return i[found], j[found]

    def _boxes(self, limit: np.ndarray) -> _Boxes:
        """Boxes of the clips' balls, and of parts of PART clips that lie together."""
        reach = (self.radius + self.slack)[:, None]
        wide = np.argsort(-np.ptp(self.centre, axis=0), kind="stable")[:SPANNED]
        low = np.minimum.reduceat((self.centre - reach)[:, wide], self.first)
        high = np.maximum.reduceat((self.centre + reach)[:, wide], self.first)
        full = np.zeros((2, len(low), self.centre.shape[1]))
        full[0], full[1] = -np.inf, np.inf
        full[0][:, wide], full[1][:, wide] = low, high
        order = np.argsort(low[:, 0] + high[:, 0], kind="stable")
        begin = np.arange(0, len(order), PART)
        members = np.full((len(begin), PART), -1)
        members.reshape(-1)[: len(order)] = order
        part = _Boxes(np.minimum.reduceat(full[0][order], begin), np.maximum.reduceat(full[1][order], begin), np.minimum.reduceat(self.length[order], begin), np.maximum.reduceat(limit[order], begin))
        return _Boxes(*full, self.length, limit, members, part)


#: Clips of a part that are ruled out together, dimensions that boxes span at most, pairs whose bounds are computed together.
PART, SPANNED, PAIRS = 16, 8, 1 << 16


@dataclass
class _Boxes:
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    limit: np.ndarray
    members: np.ndarray | None = None
    part: _Boxes | None = None


def _reach(a: _Boxes, b: _Boxes, i: np.ndarray, j: np.ndarray, norm: str, slack: float) -> np.ndarray:
    """Which boxes are not so far apart that a path between them, a step less than both lengths, exceeds the limit of both."""
    square = np.zeros(np.broadcast_shapes(i.shape, j.shape))
    for d in np.flatnonzero(np.isfinite(a.low[0]) & np.isfinite(b.low[0])):
        gap = np.maximum(a.low[i, d] - b.high[j, d], b.low[j, d] - a.high[i, d])
        np.maximum(gap, 0, out=gap)
        square += np.multiply(gap, gap, out=gap)
    steps = a.length[i] + b.length[j]
    # The mean of the lengths that a path is divided by grows slower than its steps, so the shortest clips give the bound.
    least = NORMS[norm](np.maximum(np.sqrt(square) - slack, 0) * (steps - 1), a.length[i], b.length[j])
    return least * (1 - 1e-9) <= np.maximum(a.limit[i], b.limit[j])


def _runs(*keys: np.ndarray):
    """Places of equal keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    return np.split(order, np.flatnonzero(new)) if len(order) else []


def _segments(a: Bounds, b: Bounds, i: np.ndarray, j: np.ndarray, slack: float) -> np.ndarray:
    """Less than the raw bounds of pairs: each frame stands where its segment's ball is nearest."""
    out = np.empty(len(i))
    m, n = (np.diff(np.append(x.first, len(x.sizes)))[at] for x, at in ((a, i), (b, j)))
    for some in _runs(m, n):
        s, t = (x.first[at[some]] + np.arange(c[some[0]])[:, None] for x, at, c in ((a, i, m), (b, j, n)))
        d = _apart(a.centre, b.centre, s[:, None], t[None])
        mine = np.maximum((d - b.radius[t]).min(1) - a.radius[s] - slack, 0)
        theirs = np.maximum((d - a.radius[s][:, None]).min(0) - b.radius[t] - slack, 0)
        out[some] = (mine * a.sizes[s]).sum(0) + (theirs * b.sizes[t]).sum(0) - np.minimum(mine[0], theirs[0])
    return out


def _balls(a: Bounds, b: Bounds, i: np.ndarray, j: np.ndarray, m: int, n: int, slack: float) -> np.ndarray:
    """The raw bounds of pairs of clips of m and n frames."""

    def side(x, y, i, j, m):
        f, t = x.start[i] + np.arange(m)[:, None], y.first[j] + np.arange(np.append(y.first, len(y.sizes))[j[0] + 1] - y.first[j[0]])[:, None]
        least = None
        for ball in t:
            d = _apart(x.frames, y.centre, f, ball[None]) - (y.radius[ball] + slack)
            least = d if least is None else np.minimum(least, d, out=least)
        return np.maximum(least, 0, out=least)

    mine, theirs = side(a, b, i, j, m), side(b, a, j, i, n)
    return mine.sum(0) + theirs.sum(0) - np.minimum(mine[0], theirs[0])


def _apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = None
    for d in range(x.shape[1]):
        gap = x[i, d] - y[j, d]
        np.multiply(gap, gap, out=gap)
        out = gap if out is None else np.add(out, gap, out=out)
    return np.sqrt(out, out=out)


def cross(left: list[np.ndarray], right: list[np.ndarray], needed: np.ndarray | None = None, method: str = "symmetric2", norm: str = "mean_length") -> np.ndarray:
    """The matrix of distances of two lists of clips. Clips of one length are taken together, so frame distances are one
    array for each pair of lengths; where `needed` is given, lengths are narrowed to the clips that it has, and
    the rest of the matrix is inf."""
    for name, known in ((method, METHODS), (norm, NORMS)):
        if name not in known:
            raise ValueError(f"{name!r} is not one of {sorted(known)}")
    la, lb = np.array([len(c) for c in left]), np.array([len(c) for c in right])
    if (la == 0).any() or (lb == 0).any():
        raise ValueError("clips must have a frame at least")
    out = np.full((len(la), len(lb)), np.inf)
    for m in np.unique(la):
        rows = np.flatnonzero(la == m)
        for n in np.unique(lb):
            columns = np.flatnonzero(lb == n)
            x, y = rows, columns
            if needed is not None:
                part = needed[np.ix_(rows, columns)]
                x, y = rows[part.any(1)], columns[part.any(0)]
            if not len(x) or not len(y):
                continue
            b = np.concatenate([right[j] for j in y])
            step = max(1, CELLS // (m * len(b)))
            for k in range(0, len(x), step):
                some = x[k : k + step]
                d = frame_distances(np.concatenate([left[i] for i in some]), b)
                cost = np.ascontiguousarray(d.reshape(len(some), m, len(y), n).transpose(1, 3, 0, 2)).reshape(m, n, -1)
                out[np.ix_(some, y)] = NORMS[norm](recur(cost), m, n).reshape(len(some), len(y))
    return out


def extent(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, float, int] | None:
    """What quick() takes its bounds from: a middle of the frames of two lists, the most that squares of a frame of each add up to,
    and the lengths of the longest clips together. None where there is no frame, or numbers are not finite or out of
    single precision's range."""
    if not left or not right or not min(map(len, left)) or not min(map(len, right)):
        return None
    a, b = np.concatenate(left), np.concatenate(right)
    middle = a.mean(0)
    sizes = sum(np.einsum("ij,ij->i", x, x).max() for x in (a - middle, b - middle))
    return (middle, float(sizes), max(map(len, left)) + max(map(len, right))) if sizes < 1e30 else None


def quick(left: list[np.ndarray], right: list[np.ndarray], norm: str = "mean_length", of: tuple[np.ndarray, float, int] | None = None) -> tuple[np.ndarray, float] | None:
    """(single-precision symmetric-2 distances of two lists of clips, room): if one distance does not exceed another, its quick
    value exceeds the other's by `room` at most, and a quick value exceeds its own distance by no more. None where
    numbers are not finite or out of single precision's range. Quick values compare across calls that are given the same
    extent(), `of` lists that hold the clips of all of them.

    A squared frame distance is one product of the rows (-2a, |a|^2, 1) and (b, 1, |b|^2 + e), with e the most that
    rounding can take from it, so none is negative and all are too large by 2e at most; a path's weights add up to less than
    both lengths."""
    of = of or extent(left, right)
    if of is None:
        return None
    middle, sizes, steps = of
    unit = 2.0**-24
    e = 2 * (len(middle) + 8) * unit * max(sizes, 1e-30)
    rounding = (2 * steps + 4) * unit * (2 * sizes + 2 * e) ** 0.5
    weight = {"mean_length": 2, "none": steps}[norm]
    room = weight * ((2 * e) ** 0.5 + 2 * rounding) + 1e-8  # similarities tie at 9 places

    def side(clips, last):
        """(length, places, clips of these as rows by frame), of a part of the columns in the `last` side."""
        lengths = np.array([len(c) for c in clips])
        start = np.cumsum(lengths) - lengths
        x = np.concatenate(clips) - middle
        square, one = np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1))
        rows = np.concatenate([x, one, square + e] if last else [-2 * x, square, one], axis=1).astype(np.float32)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            step = max(LINE, min(COLUMNS, TILE // (LINE * int(n)) // LINE * LINE)) if last else len(at)
            for k in range(0, len(at), step):
                yield int(n), at[k : k + step], rows[start[at[k : k + step]] + np.arange(n)[:, None]]

    columns = []
    for n, at, x in side(right, True):
        y = np.zeros((n, x.shape[2], -(-len(at) // LINE) * LINE), np.float32)
        y[:, :, : len(at)] = x.transpose(0, 2, 1)
        columns.append((n, at, y))
    out = np.empty((len(left), len(right)), np.float32)
    # Rows of costs are written to the same three places throughout, which a core's cache keeps.
    held = [_aligned(max(TILE, *(LINE * n * y.shape[2] for n, _, y in columns))) for _ in range(3)]
    for m, rows, x in side(left, False):
        for n, at, y in columns:
            step = max(LINE, TILE // (n * y.shape[2]) // LINE * LINE)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                costs = _quick_costs(x[:, k : k + step], y, held)[:, : len(at)]
                out[_block(some, at)] = NORMS[norm](costs, np.float32(m), np.float32(n))
    return out, float(room)


def _aligned(n: int) -> np.ndarray:
    held = np.empty(n + LINE, np.float32)
    at = -(held.ctypes.data // held.itemsize) % LINE
    return held[at : at + n]


def _block(rows: np.ndarray, columns: np.ndarray):
    """An index of a matrix's rows and columns, by slices where both are runs."""
    runs = [slice(x[0], x[-1] + 1) if x[-1] - x[0] == len(x) - 1 else None for x in (rows, columns)]
    return np.ix_(rows, columns) if None in runs else tuple(runs)


def _quick_costs(x: np.ndarray, y: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    """recur() over frame distances that are made a row of cells at a time, in arrays that are given."""
    shape = len(y), x.shape[1], y.shape[2]
    row, above, best = (h[: np.prod(shape)].reshape(shape) for h in held)
    cells, over, least = list(row), list(above), list(best)
    for i, frame in enumerate(x):
        np.matmul(frame, y, out=row)
        np.sqrt(row, out=row)
        last = cells[0]
        if i == 0:
            for d in cells[1:]:
                np.add(d, last, out=d)
                last = d
        else:
            np.add(above[:-1], row[1:], out=best[1:])
            np.minimum(best[1:], above[1:], out=best[1:])
            np.add(last, over[0], out=last)
            for d, c in zip(cells[1:], least[1:], strict=True):
                np.minimum(c, last, out=c)
                np.add(d, c, out=d)
                last = d
        row, above, cells, over = above, row, over, cells
    return above[-1]


def mean_length(raw, la, lb):
    return raw / ((la + lb) / 2.0)


def no_norm(raw, la, lb):
    return raw


NORMS: dict[str, Callable] = {"mean_length": mean_length, "none": no_norm}
METHODS: dict[str, Callable] = {"symmetric2": kernel}


def distances(left: list[np.ndarray], right: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray], method: str = "symmetric2", norm: str = "mean_length") -> np.ndarray:
    """Distances of clip pairs given as places in two lists; pairs of equal lengths are run together."""
    for name, known in ((method, METHODS), (norm, NORMS)):
        if name not in known:
            raise ValueError(f"{name!r} is not one of {sorted(known)}")
    run, scale = METHODS[method], NORMS[norm]
    x, y = pairs
    la = np.array([len(c) for c in left])
    lb = np.array([len(c) for c in right])
    out = np.empty(len(x))
    if not len(x):
        return out
    f, g = np.concatenate(left), np.concatenate(right)
    at, to = (np.cumsum(n) - n for n in (la, lb))
    key = la[x] * (lb.max(initial=0) + 1) + lb[y]
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        m, n = int(la[x[part[0]]]), int(lb[y[part[0]]])
        step = max(1, CELLS // (m * n))
        for k in range(0, len(part), step):
            some = part[k : k + step]
            a = f[at[x[some], None] + np.arange(m)]
            b = g[to[y[some], None] + np.arange(n)]
            out[some] = scale(run(a, b), m, n)
    return out


def dtw_column(a: Column, b: Column, la: Column, lb: Column) -> Column:
    """Distance with the mean-length norm as nested higher-order functions, for plans without Python."""
    big = F.lit(float("inf"))

    def row(acc: Column, frame: Column) -> Column:
        def cell(r: Column, j: Column) -> Column:
            d = euclidean(frame, F.get(b, j))
            above = F.when(F.size(acc) == 0, F.when(j == 0, F.lit(0.0)).otherwise(big)).otherwise(F.least(F.get(acc, j), F.when(j == 0, big).otherwise(F.get(acc, j - 1) + d)))
            left = F.when(j == 0, big).otherwise(F.element_at(r, -1))
            return F.concat(r, F.array(d + F.least(above, F.coalesce(left, big))))

        return F.aggregate(F.sequence(F.lit(0), (lb - 1).cast("int")), F.array().cast("array<double>"), cell)

    last = F.aggregate(a, F.array().cast("array<double>"), row)
    return F.element_at(last, -1) / ((la + lb) / F.lit(2.0))
