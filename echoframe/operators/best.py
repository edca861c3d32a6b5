"""The k best: of edge tables, and of the matrices that tasks score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGES = "clip_idx long, neighbor_idx long, sim double"
#: Cells of a matrix, of double and of single precision, that are looked at together.
STRIP_CELLS = 1 << 19


def best(edges: DataFrame, k: int, by: str = "clip_idx", other: str = "neighbor_idx", sim: str = "sim", digits: int | None = 9) -> DataFrame:
    """The k best rows of each key with their rank, ties to the smaller id. Similarities that agree to `digits`
    places are ties. The rank filter is applied before the shuffle as well as after."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    value = F.col(sim) if digits is None else F.round(sim, digits)
    order = Window.partitionBy(by).orderBy(value.desc(), F.col(other))
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def k_best(ids: np.ndarray, others: np.ndarray, sim: np.ndarray, k: int) -> pa.Table:
    """Rows (id, other, sim) of the k largest in each row of a matrix, ties to the smaller id; -inf is absent."""
    parts = []
    for at in range(0, len(sim), step := max(1, STRIP_CELLS // max(1, sim.shape[1]))):
        value = -sim[at : at + step]
        # Everything up to the k-th value, what may tie with it included, before the few that are left are sorted.
        kth = np.partition(value, k - 1, axis=1)[:, k - 1 : k] + 2e-9 if k < sim.shape[1] else np.inf
        i, j = np.nonzero((value <= kth) & (value < np.inf))
        parts.append((i + at, j))
    if not parts:
        return table([], [], [])
    i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((others[j], -np.round(sim[i, j], 9), i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return table(ids[i[keep]], others[j[keep]], sim[i[keep], j[keep]])


def best_of(ids: np.ndarray, others: np.ndarray, sim: np.ndarray, k: int) -> pa.Table:
    """The k best rows of each id in a list of pairs, by the order of k_best."""
    order = np.lexsort((others, -np.round(sim, 9), ids))
    ids, others, sim = ids[order], others[order], sim[order]
    keep = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return table(ids[keep], others[keep], sim[keep])


class Running:
    """The k best of each of some ids, of all that it has been given so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        #: What a similarity must reach to be among the k best of its id, ties included.
        self.floor = np.full(len(ids), -np.inf)
        self.parts, self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, at: np.ndarray, others: np.ndarray, sim: np.ndarray) -> None:
        """Edges from the ids at places."""
        self.parts.append((at, others, sim))
        self.held += len(at)
        if self.held > 2 * self.k * len(self.ids) or len(self.parts) == 2:
            self.settle()

    def offer(self, sim: np.ndarray, others: np.ndarray, begin: int | np.ndarray = 0) -> None:
        """The edges of a matrix, a row for each id from place `begin` on, or at places that it lists; -inf is absent."""
        at = begin if isinstance(begin, np.ndarray) else np.arange(begin, begin + len(sim))
        floor = self.floor[at]
        if np.isneginf(floor).any():
            t = k_best(at, others, sim, self.k)
            self.add(*(c.to_numpy() for c in (t["clip_idx"], t["neighbor_idx"], t["sim"])))
        else:
            i, j = np.nonzero(sim >= floor[:, None])
            self.add(at[i], others[j], sim[i, j])

    def settle(self) -> None:
        at, others, sim = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((others, -np.round(sim, 9), at))
        at, others, sim = at[order], others[order], sim[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep, last = place < self.k, place == self.k - 1
        self.floor[at[last]] = sim[last] - 2e-9
        self.parts, self.held = [(at[keep], others[keep], sim[keep])], int(keep.sum())

    def table(self) -> pa.Table:
        self.settle()
        at, others, sim = self.parts[0]
        return table(self.ids[at], others, sim)


class Asked:
    """Pairs of two groups of ids (or of the `same` group) that may be among the k best of an end, by values that are right within
    `room`, the least first. What the k least so far of an id rule out is not kept."""

    def __init__(self, k: int, left: int, right: int, same: bool):
        self.k, self.room, self.held = k, 0.0, 0
        self.left = np.full(left, np.inf, np.float32)
        self.right = self.left if same else np.full(right, np.inf, np.float32)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, near: np.ndarray, s: slice, t: slice, once: bool) -> bool:
        """The pairs of two slices from the matrix of their values, inf is absent; where `once`, each counts for its row alone. False,
        and none is kept, where a quarter and more of the matrix is in question."""
        rows, columns = self.left[s], self.right[t]
        rows[:] = np.minimum(rows, self._least(near))
        if not once:
            columns[:] = np.minimum(columns, self._least(near.T))
        parts, n = [], 0
        for at in range(0, len(near), step := max(1, STRIP_CELLS // max(1, near.shape[1]))):
            part, limit = near[at : at + step], rows[at : at + step, None]
            i, j = np.nonzero((part <= (limit if once else np.maximum(limit, columns))) & (part < np.inf))
            parts.append((i + (at + s.start), j + t.start, part[i, j], np.full(len(i), not once)))
            n += len(i)
            if 4 * n > near.size:
                return False
        self.parts += parts
        self.held += n
        return True

    def limit(self, left: np.ndarray, right: np.ndarray) -> None:
        """Exact values that the k least do not exceed."""
        for mine, most in ((self.left, left), (self.right, right)):
            mine[:] = np.minimum(mine, self._upto(most))

    def _least(self, near: np.ndarray) -> np.ndarray:
        """What a value may be, to be among the k least of its row."""
        kth = np.empty(len(near), np.float32)
        for at in range(0, len(near), step := max(1, STRIP_CELLS // max(1, near.shape[1]))):
            kth[at : at + step] = np.partition(near[at : at + step], self.k - 1, axis=1)[:, self.k - 1]
        return self._upto(kth)

    def _upto(self, value: np.ndarray) -> np.ndarray:
        return np.nextafter((value + self.room).astype(np.float32), np.float32(np.inf))

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places on the left, places on the right, which of the pairs count for the left, and which for the right) of what the k
        least of all that is held leave; nothing is held then."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
        i, j, value, both = (np.concatenate(x) for x in zip(none, *self.parts, strict=True))
        self.parts, self.held = [], 0
        if self.right is self.left:
            self._cut(self.left, np.concatenate([i, j[both]]), np.concatenate([value, value[both]]))
        else:
            self._cut(self.left, i, value)
            self._cut(self.right, j[both], value[both])
        forth, back = value <= self.left[i], both & (value <= self.right[j])
        keep = forth | back
        return i[keep], j[keep], forth[keep], back[keep]

    def _cut(self, limit: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        # Values are not negative, so their bits have their order.
        key = np.sort(ids << 32 | value.view(np.uint32))
        begin = np.searchsorted(key, np.arange(len(limit) + 1) << 32)
        full = np.flatnonzero(np.diff(begin) >= self.k)
        kth = (key[begin[full] + self.k - 1] & 0xFFFFFFFF).astype(np.uint32).view(np.float32)
        limit[full] = np.minimum(limit[full], self._upto(kth))


def slices(n: int, rows: int) -> list[slice]:
    cut = np.linspace(0, n, max(1, -(-n // rows)) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def running(left: np.ndarray, right: np.ndarray, same: bool, k: int, rows: int, score) -> pa.Table:
    """The k best of the ids of two groups on the other side (in the `same` group, among the others), from
    score(i, j, mine, theirs) for slices of `rows` rows: it gives their edges to both, or to `mine` where `theirs` is None,
    as both are one slice. Each unordered pair of slices meets once."""
    mine = [(s, Running(left[s], k)) for s in slices(len(left), rows)]
    theirs = mine if same else [(s, Running(right[s], k)) for s in slices(len(right), rows)]
    for n, (i, a) in enumerate(mine):
        for j, b in theirs[n:] if same else theirs:
            score(i, j, a, None if a is b else b)
    return pa.concat_tables([r.table() for _, r in (mine if same else mine + theirs)])


def close(quick: np.ndarray, k: int, room: float, upto: np.ndarray | None = None) -> np.ndarray:
    """Mask of what may be among the k least of each row of a matrix whose values are right within `room`; inf is absent. No
    value of a row that exceeds `upto` is among them."""
    mask = np.empty(quick.shape, bool)
    for at in range(0, len(quick), step := max(1, STRIP_CELLS // max(1, quick.shape[1]))):
        part = quick[at : at + step]
        kth = np.partition(part, k - 1, axis=1)[:, k - 1 : k] if k < part.shape[1] else np.float32(np.inf)
        if upto is not None:
            kth = np.minimum(kth, upto[at : at + step, None])
        limit = np.nextafter(np.float32(kth + room), np.float32(np.inf))
        mask[at : at + step] = (part <= limit) & (part < np.inf)
    return mask


def table(a, b, c) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["clip_idx", "neighbor_idx", "sim"])
