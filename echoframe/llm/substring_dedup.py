"""Repeated passages across documents, by compact windows.

A text is the sequence of its 5-word shingles. For each of K hash functions, every run of LEAST shingles or more has a
smallest hash; the runs whose smallest stands at position c are those between the nearest smaller hashes left and
right of c: c's compact window, a node of the Cartesian tree over the hashes. Only nodes of LEAST
shingles or more matter, and those are the smallest of some run of exactly LEAST shingles, so a sliding
minimum finds them, and their nearest smaller ones bound their windows: about 2n / LEAST for each function.

Windows that share function and shingle are grouped, by a pass that deals sorted packs by ranges of hashes as the
n-gram join does. In a group every window meets one of the group's first document in hash order (and that
document's meet the second's), and the document before it in that order. A group may hold strangers that share
no more than a stock sentence, so windows carry tags of the shingles at ten offsets, and further rounds go by these:
windows that agree on two tags form a set, all meet the set's first window, and those that agree
with each other where it differs form sets again, until none do. So any two windows whose tags allow a passage of
LEAST shingles meet, or have both met one that agrees with them wherever they agree.
Back at its document, windows that meet the same partner at shifts no more than BAND apart are joined as
intervals: where NEED functions cover a stretch, it is a candidate passage. Candidates are verified on the texts, shingle by
shingle at these shifts and those within BAND of them, so that inserted and deleted words do not end a passage;
one candidate may hold several passages, with unequal words between them.

Being alike in a share SAME does not carry over: of copies with edits of their own, two may be alike that both differ too much
from their hub. So a member's stretch beside its hub is kept where it differs, and those that failed are verified against the
other members: in one pass where a hub has few, in pairs of blocks where it has many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ngram_join import BITS, WORDS, shingle_sequence

#: Hash functions; how many must agree; shingles in a passage of 50 words; share of equal shingles.
K, NEED, PASSAGE, SAME = 6, 2, 50, 0.8
#: Bytes of text in a block; windows that pass the further rounds together, but for a larger group.
BLOCK_BYTES, SLICE = 6 << 20, 20_000
LEAST = PASSAGE - WORDS + 1
#: Words by which a change of length within a passage may move what follows. If neither side of it has LEAST shingles, a larger
#: one leaves less than SAME of the longer text equal.
BAND = 20
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def order_hash(h: np.ndarray, j: int) -> np.ndarray:
    """32 bits by which function j orders shingles, 1 at least."""
    with np.errstate(over="ignore"):
        x = (h ^ _SEEDS[j]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= _SEEDS[j] | np.uint64(1)
    return np.maximum(x >> np.uint64(32), np.uint64(1))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width`, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def nearest_smaller(value: np.ndarray) -> np.ndarray:
    """The place of the last smaller element before each of some distinct elements, -1 if there is none. All are looked for
    together: what lies between an element and where it looks is larger, so from a larger one it goes on to where that looks."""
    look = np.arange(-1, len(value) - 1)
    wait = np.arange(1, len(value))
    while len(wait):
        there = look[wait]
        larger = value[there] > value[wait]
        wait, there = wait[larger], look[there[larger]]
        look[wait] = there
        wait = wait[there >= 0]
    return look


def compact_windows(x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, position, right) of the Cartesian tree's nodes that span `least` elements or more. Equal elements:
    the leftmost is the smaller. Zeros divide sequences from each other and are in no window."""
    keys = (x << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)
    if len(x) < least:
        return (np.zeros(0, np.int64),) * 3
    low = sliding_least(keys, least)
    # Zeros bound windows whether they are the smallest of a run or not.
    node = x == 0
    node[(low & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(node)
    value = keys[at]
    left = np.append(at, -1)[nearest_smaller(value)] + 1
    right = np.append(at[::-1], len(x))[nearest_smaller(value[::-1])][::-1] - 1
    keep = (right - left + 1 >= least) & (x[at] > 0)
    return left[keep], at[keep], right[keep]


#: Where, from its smallest shingle, a window is tagged. LEAST equal shingles around that one hold four neighbouring tags
#: or more, and of nine that differ no two are tagged: three of four neighbours agree, which no two windows of a passage of
#: that length fail. All such triples hold one of the KEYS.
OFFSETS = [9 * k for k in range(-5, 6) if k]
KEYS = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8)]
_LINE = [[m >> k & 1 for k in range(5)] + [1] + [m >> k & 1 for k in range(5, 10)] for m in range(1 << 10)]
_ALLOWS = np.array([any(sum(line[k : k + 5]) >= 4 for k in range(1, 6)) for line in _LINE])

_WINDOW = np.dtype([("q", np.uint64), ("at", np.uint32), ("l", np.uint32), ("c", np.uint32), ("r", np.uint32), ("s", np.uint8, len(OFFSETS))])


def _pack(w: np.ndarray) -> bytes:
    d = np.diff(w["q"])
    wide = bool(d.max(initial=0) >= 1 << 32)
    small = bool(max(w[k].max(initial=0) for k in ("at", "c", "r")) < 1 << 16)
    kind = np.uint16 if small else np.uint32
    return bytes([wide, small]) + len(w).to_bytes(4, "little") + w["q"][:1].tobytes() + d.astype(np.uint64 if wide else np.uint32).tobytes() + b"".join(w[k].astype(kind).tobytes() for k in ("at", "l", "c", "r")) + w["s"].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n, kind, small = int.from_bytes(data[2:6], "little"), np.uint64 if data[0] else np.uint32, np.uint16 if data[1] else np.uint32
    w = np.empty(n, _WINDOW)
    d = np.frombuffer(data, kind, n - 1, 14)
    w["q"] = np.cumsum(np.concatenate((np.frombuffer(data, np.uint64, 1, 6), d.astype(np.uint64))))
    at = 14 + d.nbytes
    for k in ("at", "l", "c", "r"):
        w[k] = np.frombuffer(data, small, n, at)
        at += n * small().itemsize
    w["s"] = np.frombuffer(data, np.uint8, n * len(OFFSETS), at).reshape(n, -1)
    return w


def local_copies(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, the earlier one each repeats): of a block's windows in order of group, document and place, those that agree
    with another document's in group, every tag and extent. Whatever agrees with the copy agrees
    with the other, so they meet here and the copy goes no further: a passage in any share of the rows
    sends a window or two for each block."""
    shared = np.flatnonzero(repeats(w["q"]))
    w = w[shared]
    kind = np.dtype([("q", np.uint64), ("l", np.uint32), ("r", np.uint32), ("s", np.uint8, len(OFFSETS))])
    x = np.zeros(len(w), kind)
    x["q"], x["l"], x["r"], x["s"] = w["q"], w["c"] - w["l"], w["r"] - w["c"], w["s"]
    _, first, of = np.unique(x.view(f"V{kind.itemsize}"), return_index=True, return_inverse=True)
    first = first[of]
    copies = np.flatnonzero(w["at"][first] != w["at"])
    return shared[copies], shared[first[copies]]


def repeats(x: np.ndarray) -> np.ndarray:
    """Which elements of a sorted array are not alone."""
    same = np.concatenate(([False], x[1:] == x[:-1], [False]))
    return same[1:] | same[:-1]


_SPREAD = "bucket int, block long, data binary, at int, doc_id long"
_NAMES = [f.split()[0] for f in _SPREAD.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]


def _rows(**columns):
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


#: Rows of a block's documents that pass the ranges of hashes together.
TOGETHER = 100


def _spread(buckets: int, block_bytes: int):
    def flush(block, ids, seqs):
        for k in range(0, len(ids), 5000):
            n = len(ids[k : k + 5000])
            yield _rows(bucket=[-1 - i // TOGETHER for i in range(k, k + n)], block=[block] * n, at=list(range(k, k + n)), doc_id=ids[k : k + 5000])
        starts = np.cumsum([0] + [len(s) + 1 for s in seqs])
        h = np.zeros(starts[-1], np.uint64)
        real = np.ones(len(h), bool)
        real[starts[1:] - 1] = False
        h[real] = np.concatenate(seqs)
        tag = (h % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        found = []
        for j in range(K):
            left, c, right = compact_windows(np.where(real, order_hash(h, j), np.uint64(0)))
            w = np.empty(len(c), _WINDOW)
            w["at"] = np.searchsorted(starts, c, "right") - 1
            w["q"] = (h[c] & ~np.uint64(7)) | np.uint64(j)
            for k, x in (("l", left), ("c", c), ("r", right)):
                w[k] = x - starts[w["at"]]
            for k, offset in enumerate(OFFSETS):
                x = c + offset
                w["s"][:, k] = np.where((x >= left) & (x <= right), tag[np.clip(x, 0, len(h) - 1)], 0)
            found.append(w)
        w = np.concatenate(found)
        w = w[np.lexsort(((w["at"].astype(np.uint64) << np.uint64(32)) | w["c"], w["q"]))]
        copies, first = local_copies(w)
        if len(copies):
            m = _meetings(w[copies], w[first], np.full(len(copies), block, np.uint64))
            for k in range(0, len(m), 50_000):
                yield _rows(bucket=[-1 - k % 997], block=[block], data=[m[k : k + 50_000].tobytes()])
            w = np.delete(w, copies)
        bucket = (w["q"] >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(w)])) if len(w) else np.zeros(1, int)
        for k in range(0, len(cuts) - 1, 256):
            some = list(zip(cuts[k : k + 256], cuts[k + 1 : k + 257], strict=False))
            yield _rows(bucket=[int(bucket[a]) for a, _ in some], block=[block] * len(some), data=[_pack(w[a:b]) for a, b in some])

    def run(batches):
        block, ids, seqs, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                seqs.append(shingle_sequence(text))
                size += len(text or "") + 200
                if size > block_bytes:
                    yield from flush(block, ids, seqs)
                    block, ids, seqs, size = block + 1, [], [], 0
        if ids:
            yield from flush(block, ids, seqs)

    return run


#: A window's stretch that its partner's spans as well, and the shift between them.
_MEETING = np.dtype([("at", np.uint32), ("pblock", np.uint64), ("pat", np.uint32), ("shift", np.int32), ("j", np.uint8), ("l", np.uint32), ("r", np.uint32)])


def _meetings(w: np.ndarray, other: np.ndarray, pblock: np.ndarray) -> np.ndarray:
    m = np.empty(len(w), _MEETING)
    shift = w["c"].astype(np.int64) - other["c"]
    m["at"], m["pat"], m["pblock"], m["j"], m["shift"] = w["at"], other["at"], pblock, w["q"] & np.uint64(7), shift
    m["l"] = np.maximum(w["l"].astype(np.int64), other["l"] + shift)
    m["r"] = np.minimum(w["r"].astype(np.int64), other["r"] + shift) + 1
    return m


def further_rounds(group: np.ndarray, doc: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, partners) of windows in order of group and document. For any two windows of a group and of different
    documents whose tags agree as _ALLOWS asks, they meet, or both meet a window that agrees with them where they agree
    (one of the same document as that window meets another partner)."""
    mine, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    mark = np.random.default_rng(0).integers(0, 1 << 63, size=len(doc), dtype=np.uint64)
    bits = 1 << np.arange(len(OFFSETS))

    def sets(of, win):
        """Numbered sets of two documents or more, each once."""
        order = np.lexsort((win, of))
        of, win = of[order], win[order]
        begins = np.flatnonzero(np.concatenate(([True], np.diff(of) != 0))) if len(of) else np.zeros(0, np.int64)
        size = np.diff(np.append(begins, len(of)))
        use = doc[win[begins]] != doc[win[begins + size - 1]]
        if use.any():
            _, one = np.unique(np.add.reduceat(mark[win], begins), return_index=True)
            once = np.zeros(len(begins), bool)
            once[one] = True
            use &= once
        keep = np.repeat(use, size)
        return np.repeat(np.arange(use.sum()), size[use]), win[keep]

    # Groups of three windows have met in full.
    some = np.flatnonzero(np.bincount(group, minlength=1)[group] > 3)
    of, win = [], []
    for k, (a, b) in enumerate(KEYS):
        at = some[(tags[some, a] > 0) & (tags[some, b] > 0)]
        of.append(((group[at] * len(KEYS) + k) << 16) + (tags[at, a].astype(np.int64) << 8) + tags[at, b])
        win.append(at)
    of, win = sets(np.concatenate(of), np.concatenate(win))
    while len(of):
        begins = np.flatnonzero(np.concatenate(([True], np.diff(of) != 0)))
        hub = win[begins][of]
        own = doc[win] == doc[hub]
        other = np.flatnonzero(~own)
        second = np.zeros(len(begins), np.int64)
        second[of[other][::-1]] = win[other][::-1]
        partner = np.where(own, second[of], hub)
        t = tags[win]
        meet = _ALLOWS[((t == tags[partner]) & (t > 0)) @ bits]
        mine.append(win[meet])
        theirs.append(partner[meet])
        differ, where = np.nonzero((t != tags[hub]) & (t > 0))
        after_of, after_win = [((of[differ] * len(OFFSETS) + where) << 8) + t[differ, where]], [win[differ]]
        # Windows of the hub's document that do not meet the second's meet the others in a set without the hub.
        left = own & ~meet & (win != hub)
        if left.any():
            again = np.bincount(of[left], minlength=len(begins)) > 0
            rest = again[of] & (left | ~own)
            after_of.append(-1 - of[rest])
            after_win.append(win[rest])
        of, win = sets(np.concatenate(after_of), np.concatenate(after_win))
    return np.concatenate(mine), np.concatenate(theirs)


def _meet(batches):
    """Of each range of hashes: every window of a shingle that two documents share, with its partner's, back to its block."""
    bucket, blocks, parts = None, [], []

    def flush():
        if not parts:
            return
        w = np.concatenate(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        # A window that is alone with its shingle meets none.
        order = np.argsort(w["q"], kind="stable")
        some = order[repeats(w["q"][order])]
        if not len(some):
            return
        w, of = w[some], of[some]
        block = np.array(blocks, np.uint64)[of]
        with np.errstate(over="ignore"):
            doc = ((block << np.uint64(20)) ^ w["at"]) * np.uint64(0x9E3779B97F4A7C15)
            doc ^= doc >> np.uint64(31)
        order = np.lexsort((w["c"], doc, w["q"]))
        w, block, of, doc = w[order], block[order], of[order], doc[order]
        new = np.concatenate(([True], np.diff(w["q"]) != 0))
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)[run]  # the group's first document
        other = doc != doc[first]
        n = int(run[-1]) + 1
        second = np.full(n, -1)
        at = np.flatnonzero(other)
        second[run[at][::-1]] = at[::-1]  # the first window of another document
        partner = np.where(other, first, second[run])
        # The document before in that order as well, where it is not the first.
        begins = np.flatnonzero(new | np.concatenate(([True], np.diff(doc) != 0)))
        before = np.repeat(begins, np.diff(np.append(begins, len(w)))) - 1
        before = np.where(other & (before >= 0), before, -1)
        before[(before >= 0) & (doc[before] == doc[first])] = -1
        # A slice of whole groups at a time, since a round may hold a window many times.
        more, with_ = [], []
        sizes = np.bincount(run)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(w):
            to = int(max(ends[run[at]], ends[max(0, np.searchsorted(ends, at + SLICE, "right") - 1)]))
            if sizes[run[at] : run[to - 1] + 1].max() > 3:
                a, b = further_rounds(run[at:to] - run[at], doc[at:to], w["s"][at:to])
                more.append(a + at)
                with_.append(b + at)
            at = to
        more, with_ = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (more, with_))
        mine = np.concatenate((np.flatnonzero(partner >= 0), np.flatnonzero(before >= 0), more))
        partner = np.concatenate((partner[partner >= 0], before[before >= 0], with_))
        # Two windows meet once, at the later one's document.
        mine, partner = np.divmod(np.unique(np.maximum(mine, partner) * len(w) + np.minimum(mine, partner)), len(w))
        m, of = _meetings(w[mine], w[partner], block[partner]), of[mine]
        long = m["r"].astype(np.int64) - m["l"] >= LEAST
        m, of = m[long], of[long]
        order = np.argsort(of, kind="stable")
        m, ends = m[order], np.cumsum(np.bincount(of, minlength=len(parts)))
        data = [(i, m[a:b].tobytes()) for i, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if b > a]
        for k in range(0, len(data), 50):
            some = data[k : k + 50]
            yield _rows(block=[blocks[i] for i, _ in some], data=[d for _, d in some])

    for b in batches:
        documents = np.asarray(b.column(0)) < 0
        if documents.any():
            yield b.filter(pa.array(documents))
        for k, block, data in zip(*(c.to_pylist() for c in b.filter(pa.array(~documents)).columns[:3]), strict=True):
            if k != bucket:
                yield from flush()
                bucket, blocks, parts = k, [], []
            blocks.append(block)
            parts.append(_unpack(data))
    yield from flush()


_CANDIDATE = "block long, at int, doc_id long, start int, end int, pblock long, pat int, low int, high int"


def stretches(m: np.ndarray, need: int = NEED, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches that windows of `need` functions or more cover, of meetings with one partner at near shifts."""
    j, left, right = (m[c].astype(np.int64) for c in ("j", "l", "r"))
    order = np.lexsort((left, j))
    j, left, right = j[order], left[order], right[order]
    # The union of each function's intervals, by their left ends; functions lie apart.
    apart = j * (int(right.max(initial=0)) + 2)
    upto = np.maximum.accumulate(right + apart)
    new = np.concatenate(([True], left[1:] + apart[1:] > upto[:-1]))
    last = np.append(new[1:], True)
    # Ends by place, what begins there before what ends.
    events = np.sort(np.concatenate((2 * left[new], 2 * (upto - apart)[last] + 1)))
    deep = np.cumsum(1 - 2 * (events & 1)) >= need
    x = events >> 1
    change = np.flatnonzero(np.diff(deep, prepend=False))
    return [(s, e) for s, e in zip(x[change[::2]].tolist(), x[change[1::2]].tolist(), strict=True) if e - s >= least]


def near_shifts(shift: np.ndarray) -> list[tuple[int, int]]:
    """Parts of sorted shifts, so that any two no more than BAND apart are in one, and none spans more than 2 * BAND."""
    if shift[-1] - shift[0] <= 2 * BAND:
        return [(0, len(shift))]
    low = np.arange(shift[0], shift[-1], BAND)
    parts = set(zip(np.searchsorted(shift, low).tolist(), np.searchsorted(shift, low + 2 * BAND, "right").tolist(), strict=True))
    return sorted((a, b) for a, b in parts if b > a and not any(x <= a and b <= y and (x, y) != (a, b) for x, y in parts))


def _gather(batches):
    """Of each block: a row for each document and for each candidate passage."""
    names = [f.split()[0] for f in _CANDIDATE.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def emit(rows):
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), types, strict=True)], names=names)

    def flush(block, documents, parts):
        rows = [(block, at, doc_id, *[None] * 6) for at, doc_id in documents]
        if parts:
            m = np.concatenate([np.frombuffer(p, _MEETING) for p in parts])
            m = m[np.lexsort((m["shift"], m["pat"], m["pblock"], m["at"]))]
            new = np.concatenate(([True], (np.diff(m["shift"]) > BAND) | (np.diff(m["pat"]) != 0) | (np.diff(m["pblock"]) != 0) | (np.diff(m["at"]) != 0)))
            cuts = np.append(np.flatnonzero(new), len(m))
            functions = np.bitwise_count(np.bitwise_or.reduceat(np.left_shift(1, m["j"], dtype=np.uint8), cuts[:-1]))
            enough = functions >= NEED
            for a, b in zip(cuts[:-1][enough].tolist(), cuts[1:][enough].tolist(), strict=True):
                for x, y in near_shifts(m["shift"][a:b]):
                    low, high = int(m["shift"][a + x]), int(m["shift"][a + y - 1])
                    for s, e in stretches(m[a + x : a + y], least=LEAST - (high - low)):
                        rows.append((block, int(m["at"][a]), None, s, e, int(m["pblock"][a]), int(m["pat"][a]), low, high))
        yield from emit(rows)

    block, documents, parts = None, [], []
    for b in batches:
        for of, data, at, doc_id in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
            if of != block:
                if block is not None:
                    yield from flush(block, documents, parts)
                block, documents, parts = of, [], []
            if data is None:
                documents.append((at, doc_id))
            else:
                parts.append(data)
    if block is not None:
        yield from flush(block, documents, parts)


def _longest(at: np.ndarray, same: float, least: int) -> tuple[int, int] | None:
    """Of the places of equal elements, the numbers of the first and the last of the longest good stretch."""
    n = len(at)
    if n < same * least:
        return None
    # gain(x) = hits before x - same * x: a stretch [s, e) is good where gain(e) >= gain(s).
    if same * int(at[0]) >= same * (int(at[-1]) + 1) - n - 1e-9:
        return (0, n - 1) if at[-1] + 1 - at[0] >= least else None
    count = np.arange(n + 1)
    lows = np.maximum.accumulate(same * at - count[:n])  # the earliest start that is low enough
    k = np.searchsorted(lows, same * (at + 1) - count[1:] - 1e-9, "left")
    length = np.where(k < n, at + 1 - at[np.minimum(k, n - 1)], 0)
    i = int(length.argmax())
    return (int(k[i]), i) if length[i] >= least else None


def _all_at(at: np.ndarray, same: float, least: int, begin: int = 0) -> list[tuple[int, int]]:
    """_all() of the places of equal elements from `begin` on: the numbers of the first and the last of each stretch."""
    found, left = [], [(0, len(at), begin)]
    while left:
        i, j, s = left.pop()
        if j - i >= same * least and (best := _longest(at[i:j] - s, same, least)):
            a, b = i + best[0], i + best[1]
            found.append((a, b))
            left += [(i, a, s), (b + 1, j, int(at[b]) + 1)]
    return sorted(found)


def _all(hit: np.ndarray, same: float, least: int) -> list[tuple[int, int]]:
    at = hit.nonzero()[0]
    return [(int(at[a]), int(at[b]) + 1) for a, b in _all_at(at, same, least)]


def verify(a: np.ndarray, b: np.ndarray, same: float = SAME, least: int = LEAST) -> tuple[int, int] | None:
    """The longest stretch of two aligned sequences that begins and ends with equal elements, has `least` or more, and is
    equal in a share `same`; None if there is none. Of equally long ones the first."""
    n = min(len(a), len(b))
    at = (a[:n] == b[:n]).nonzero()[0]
    best = _longest(at, same, least)
    return best and (int(at[best[0]]), int(at[best[1]]) + 1)


def verify_all(a: np.ndarray, b: np.ndarray, same: float = SAME, least: int = LEAST) -> list[tuple[int, int]]:
    """In order, the longest such stretch, and those in what is left before and after it."""
    n = min(len(a), len(b))
    return _all(a[:n] == b[:n], same, least)


def verify_near(a: np.ndarray, b: np.ndarray, low: int, high: int, same: float = SAME, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """Stretches (start, end) of a and of b, `least` elements or more of each, in which elements at shifts (place in a less place
    in b) from low to high are equal in a share `same` of the longer; and those of one shift that hold BAND elements of a or of b or more that are in none of these."""
    n, m = len(a), len(b)
    if n < least or m < least:
        return []
    count, zero = high - low + 1, abs(low) + abs(high)

    def shifted(x, kind, fill):
        """A row for each shift from `low` on: of each element of a, what stands at its place in x."""
        padded = np.full(n + high - low + m + 2 * zero, fill, kind)
        padded[zero : zero + m] = x
        size = padded.itemsize
        return np.ndarray((count, n), kind, padded, (zero - low) * size, (-size, size))

    hits = shifted(b, np.int32, -1) == a.astype(np.int32)
    total = hits.sum(1)
    order = np.argsort(-total, kind="stable")
    place = np.empty(count, np.uint8 if count < 256 else np.int32)
    place[order] = np.arange(count, 0, -1)
    # Each element against its equal at the shift that has most.
    first = (hits.view(np.uint8) * place[:, None]).max(0)
    at = first.nonzero()[0]
    if len(at) < same * least:
        return []
    shift = low + order[count - first[at].astype(np.int64)]
    found, left = [], [(0, len(at), 0)]
    while left:
        i, j, begin = left.pop()
        for x, y in _all_at(at[i:j], same, least, begin):
            x, y = i + x, i + y + 1
            there = at[x:y] - shift[x:y]
            s, e, ps, pe = int(at[x]), int(at[y - 1]) + 1, int(there[0]), int(there[-1]) + 1
            jump = np.abs(shift[x + 1 : y] - shift[x : y - 1])
            if not jump.any():
                distinct = y - x
            elif pe - ps >= least:
                seen = np.zeros(pe - ps, bool)
                seen[there[(there >= ps) & (there < pe)] - ps] = True
                distinct = int(seen.sum())
            if pe - ps >= least and distinct >= same * max(e - s, pe - ps) - 1e-9:
                found.append((s, e, ps, pe))
            elif jump.any():
                # Too much stands between parts of different shifts: each for itself.
                k = int(jump.argmax())
                left += [(x, x + k + 1, s), (x + k + 1, y, int(at[x + k + 1]))]
    # Single shifts, the fullest first, as far as they hold BAND elements of either or more that are in no stretch yet.
    full = order[total[order] >= same * least]
    if not len(full):
        return sorted(found)
    mine, theirs = np.zeros(n, bool), np.zeros(m, bool)
    for s, e, ps, pe in found:
        mine[s:e] = theirs[ps:pe] = True
    if found:
        some = hits[full]
        full = full[np.maximum((some & ~mine).sum(1), (some & shifted(~theirs, bool, False)[full]).sum(1)) >= BAND]
    for k in full.tolist():
        at, shift = hits[k].nonzero()[0], low + k
        if max(len(at) - np.count_nonzero(mine[at]), len(at) - np.count_nonzero(theirs[at - shift])) < BAND:
            continue
        for x, y in _all_at(at, same, least):
            s, e = int(at[x]), int(at[y]) + 1
            if max(e - s - np.count_nonzero(mine[s:e]), e - s - np.count_nonzero(theirs[s - shift : e - shift])) >= BAND:
                found.append((s, e, s - shift, e - shift))
                mine[s:e] = theirs[s - shift : e - shift] = True
    return sorted(found)


def verify_at(a: np.ndarray, b: np.ndarray, shift: int, low: int, high: int, same: float = SAME, least: int = LEAST) -> list[tuple[int, int, int, int]] | None:
    """verify_near() where one shift says all: None where an element without its equal at that shift has one at another."""
    begin, end = max(0, shift), min(len(a), len(b) + shift)
    if end - begin < least:
        return None
    hit = a[begin:end] == b[begin - shift : end - shift]
    odd = np.concatenate((np.arange(begin), np.flatnonzero(~hit) + begin, np.arange(end, len(a))))
    there = odd[:, None] - np.arange(low, high + 1)
    within = (there >= 0) & (there < len(b))
    if ((a[odd][:, None] == b[np.where(within, there, 0)]) & within).any():
        return None
    return [(begin + s, begin + e, begin + s - shift, begin + e - shift) for s, e in _all(hit, same, least)]


_CHECKED = "doc_id long, start int, end int, partner_id long, partner_start int, partner_end int, hub long, token int, lo int, moved int, passed boolean, seq binary"


def _arrow(rows: list[tuple], schema: str):
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def beside_hub(a: np.ndarray, c: np.ndarray, shift: int, passed: bool) -> list[tuple[int, int, int]]:
    """(token, first, end): the stretch of a member, BAND elements wider on either side than its first and last equal with
    its hub's stretch at a shift, and up to three places of the member where a run of unequal elements begins or, if there
    is none, where it ends. None for a member that equals its hub, or hardly."""
    begin, end = max(0, shift), min(len(a), len(c) + shift)
    if end - begin < LEAST // 2:
        return []
    hit = a[begin:end] == c[begin - shift : end - shift]
    at = np.flatnonzero(hit)
    if len(at) < LEAST // 2:
        return []
    first, last = int(at[0]), int(at[-1]) + 1
    runs = at[:-1][np.diff(at) > 1] + 1
    if not len(runs):
        if passed:
            return []
        runs = np.array([last])
    tokens = sorted({int(runs[0]), int(runs[len(runs) // 2]), int(runs[-1])})
    return [(begin + t, max(0, begin + first - BAND), min(len(a), begin + last + BAND)) for t in tokens]


def _check(batches):
    """Verifies candidate pairs; of those that are not equal, the member's stretch beside its hub as well."""
    for b in (whole.slice(k, 200) for whole in batches for k in range(0, whole.num_rows, 200)):
        out = []
        for doc_id, start, partner_id, pstart, low, high, a, c, hub_first in zip(*(x.to_pylist() for x in b.columns), strict=True):
            a, c, moved = np.frombuffer(a, np.uint16), np.frombuffer(c, np.uint16), pstart - start
            if low == high == -moved and len(a) == len(c) >= LEAST and (a == c).all():
                hits = [(0, len(a), 0, len(c))]
            else:
                shifts = low - BAND + moved, high + BAND + moved
                hits = verify_at(a, c, low + moved, *shifts) if low == high else None
                hits = verify_near(a, c, *shifts) if hits is None else hits
                # Places are told in the hub's elements: a member's place is its hub's and a shift.
                member, other, at, hub_at, shift = (c, a, pstart, start, -low - moved) if hub_first else (a, c, start, pstart, low + moved)
                for token, s, e in beside_hub(member, other, shift, bool(hits)):
                    out.append((partner_id if hub_first else doc_id, *[None] * 5, doc_id if hub_first else partner_id, token - shift + hub_at, s - shift + hub_at, at + s, bool(hits), member[s:e].tobytes()))
            for s, e, ps, pe in hits:
                out.append((doc_id, start + s, start + e + WORDS - 1, partner_id, pstart + ps, pstart + pe + WORDS - 1, *[None] * 6))
        if out:
            yield _arrow(out, _CHECKED)


#: Rows of a hub that are compared in one pass, in order of where they differ from it; of a block of a hub that has more.
BESIDE, BLOCK_ROWS = 256, 2048
#: Cells of the table that a block's stretches are laid out in.
CELLS = 1 << 22


def _siblings(batches):
    """Links between members of a hub that do not reach it themselves: in a crowd of edited copies, two may be SAME whose edits
    lie together, though neither is to the hub. Each member that failed is compared with all before it and
    those after it, nearest first, until all are linked with it or do not verify; linked ones are not compared again. For hubs of
    few rows, each in one task."""
    hub, near, parent = None, [], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        out = []
        for of, _, doc_id, lo, moved, passed, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if of != hub:
                hub, near, parent = of, [], {}
            if passed:
                parent[root(doc_id)] = root(None)  # the hub's own
            seq = np.frombuffer(seq, np.uint16)
            mine = root(doc_id)
            for other, olo, omoved, opassed, oseq in reversed(near):
                if (passed and opassed) or root(other) == mine:
                    continue
                s, e = max(lo, olo), min(lo + len(seq), olo + len(oseq))
                if e - s < LEAST:
                    continue
                hit = seq[s - lo : e - lo] == oseq[s - olo : e - olo]
                if hit.sum() < SAME * LEAST or not (found := _all(hit, SAME, LEAST)):
                    continue
                for x, y in found:
                    here, there = (doc_id, moved + s - lo), (other, omoved + s - olo)
                    (i, p), (j, q) = sorted((here, there))
                    out.append((i, p + x, p + y + WORDS - 1, j, q + x, q + y + WORDS - 1))
                parent[root(other)] = mine
            near.append((doc_id, lo, moved, passed, seq))
        if out:
            yield _arrow(out, ", ".join(_CHECKED.split(", ")[:6]))


def crowd_links(t: pa.Table, same: bool) -> list[tuple]:
    """What _siblings() does, for two blocks of a hub's members, told apart by `side` (one, if `same`): every pair of the two is
    linked here, or compared, or both of it reach the hub. Stretches lie in a table by the hub's places, so one is counted
    against many at a time, and those with enough equal elements are verified."""
    docs, doc = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
    lo, moved, side = (t[c].to_numpy() for c in ("lo", "moved", "side"))
    seqs = [np.frombuffer(x, np.uint16) for x in t["seq"].to_pylist()]
    high = lo + np.array([len(x) for x in seqs], np.int64)
    comp = np.arange(len(docs))
    comp[doc[t["passed"].to_numpy(zero_copy_only=False)]] = len(docs)  # the hub's own
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    right = right[np.argsort(lo[right], kind="stable")]
    out, at = [], 0
    while at < len(right):
        # As many stretches as fit, one at least.
        width = np.maximum.accumulate(high[right[at:]]) - lo[right[at]]
        some = right[at : at + max(1, int((width * np.arange(1, len(width) + 1) <= CELLS).sum()))]
        at += len(some)
        begin, end = int(lo[some].min()), int(high[some].max())
        table = np.full((len(some), end - begin), -1, np.int32)
        for row, i in zip(table, some.tolist(), strict=True):
            row[lo[i] - begin : high[i] - begin] = seqs[i]
        for i in left.tolist():
            s, e = max(int(lo[i]), begin), min(int(high[i]), end)
            open_ = np.flatnonzero(comp[doc[some]] != comp[doc[i]])
            if e - s < LEAST or not len(open_):
                continue
            part = table[:, s - begin : e - begin] if len(open_) == len(some) else table[open_, s - begin : e - begin]
            equal = (part == seqs[i][s - lo[i] : e - lo[i]]).sum(1)
            for j in some[open_[equal >= SAME * LEAST]].tolist():
                if comp[doc[i]] == comp[doc[j]]:
                    continue
                x, y = max(int(lo[i]), int(lo[j])), min(int(high[i]), int(high[j]))
                found = _all(seqs[i][x - lo[i] : y - lo[i]] == seqs[j][x - lo[j] : y - lo[j]], SAME, LEAST)
                here, there = (int(docs[doc[i]]), int(moved[i] + x - lo[i])), (int(docs[doc[j]]), int(moved[j] + x - lo[j]))
                (a, p), (b, q) = sorted((here, there))
                out += [(a, p + f, p + g + WORDS - 1, b, q + f, q + g + WORDS - 1) for f, g in found]
                if found:
                    comp[comp == comp[doc[i]]] = comp[doc[j]]
    return out


_LINK = ", ".join(_CHECKED.split(", ")[:6])


def _crowds(key, t):
    rows = crowd_links(t, key[1].as_py() == key[2].as_py())
    return pa.Table.from_batches([_arrow(rows or [(0,) * 6], _LINK)]).slice(0 if rows else 1)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows doc_id, start, end, partner_id, partner_start, partner_end: words [start, end) of a document that another
    holds as well, 50 words or more of each with 0.8 or more of the longer one's 5-word shingles equal, at one
    shift or at several that are BAND words apart at most. There is a row for each
    verified pair and one for its reverse, so a document has as many as partners. Not all pairs of a passage that many hold meet:
    members of a group meet its hubs, and those that differ too much from them meet all other members that are not linked with
    them yet. Components over the rows give groups back. Only what lies inside
    a longer passage of the same two documents is left out, where both begin at the same shift, and what would add less than
    BAND words of either document to the passages that the two share (a line that repeats itself agrees at many shifts).

    Words are lowered A-Z and parted by ASCII white space. Null ids take no part; rows that repeat an id are one
    document, of which any row's text may verify. Null, empty and short texts have no passage, repeats
    within one document alone are none, and an empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    spread = texts.mapInArrow(_spread(buckets, block_bytes), _SPREAD).withColumn("to", F.when(F.col("bucket") < 0, F.hash("block", "bucket")).otherwise(F.col("bucket")))
    met = spread.repartition("to").sortWithinPartitions("bucket").drop("to").mapInArrow(_meet, _SPREAD)
    found = common.materialize(met.repartition("block").sortWithinPartitions("block").mapInArrow(_gather, _CANDIDATE), "passage-candidates")
    ids = found.where("doc_id is not null").select("block", "at", "doc_id")
    pairs = found.where("doc_id is null").drop("doc_id").join(ids, ["block", "at"]).join(ids.select(F.col("block").alias("pblock"), F.col("at").alias("pat"), F.col("doc_id").alias("partner_id")), ["pblock", "pat"])
    wide = lambda x: F.greatest(F.lit(0), x)
    pairs = pairs.where("doc_id != partner_id").select("doc_id", wide(F.col("start") - BAND).alias("start"), (F.col("end") + BAND).alias("end"), "partner_id", wide(F.col("start") - F.col("high") - 2 * BAND).alias("pstart"), wide(F.col("end") - F.col("low") + 2 * BAND).alias("pend"), "low", "high")
    # Each pair once, the smaller id first.
    turn = {"doc_id": "partner_id", "start": "pstart", "end": "pend"}
    turn = {c: F.col(x) for a, b in turn.items() for c, x in ((a, b), (b, a))} | {"low": -F.col("high"), "high": -F.col("low")}
    hub_first = (F.col("doc_id") > F.col("partner_id")).alias("hub_first")  # partners are what a group's other windows meet as well
    pairs = common.materialize(pairs.select(*(F.when(F.col("doc_id") < F.col("partner_id"), F.col(c)).otherwise(turn[c]).alias(c) for c in pairs.columns), hub_first).distinct(), "passage-pairs")

    # The shingles of every stretch that a pair names, once each, by 16 bits of their hashes: two stretches of LEAST
    # shingles agree by chance in the share SAME once in 10**150 times.
    sides = pairs.select("doc_id", "start", "end").union(pairs.select("partner_id", "pstart", "pend")).distinct()
    asked = sides.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("parts"))

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, text, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seq = shingle_sequence(text)
                out += [(doc_id, p["start"], p["end"], seq[p["start"] : p["end"]].astype(np.uint16).tobytes()) for p in parts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc_id", "start", "end", "seq"])

    parts = texts.join(asked, "doc_id").select("doc_id", "text", "parts").mapInArrow(cut, "doc_id long, start int, end int, seq binary")
    parts = common.materialize(parts, "passage-parts")
    both = pairs.join(parts, ["doc_id", "start", "end"]).join(parts.select(F.col("doc_id").alias("partner_id"), F.col("start").alias("pstart"), F.col("end").alias("pend"), F.col("seq").alias("pseq")), ["partner_id", "pstart", "pend"])

    checked = both.select("doc_id", "start", "partner_id", "pstart", "low", "high", "seq", "pseq", "hub_first").mapInArrow(_check, _CHECKED)
    checked = common.materialize(checked, "passage-checked")
    links = ["doc_id", "start", "end", "partner_id", "partner_start", "partner_end"]
    # Members of a hub meet in one task where they are few, in order of the places where they differ from it; and by pairs of
    # blocks where they are many, so that a crowd is many tasks.
    order = ["hub", "token", "doc_id"]
    beside = checked.where("hub is not null").select(*order, "lo", "moved", "passed", "seq")
    sizes = beside.groupBy("hub").agg(F.count("*").alias("n"), F.bool_and("passed").alias("all_passed")).where("not all_passed")
    large = common.materialize(sizes.where(F.col("n") > BESIDE).select("hub", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "crowds")
    few = beside.join(sizes.where(F.col("n") <= BESIDE).select("hub"), "hub", "left_semi").select(beside.columns)
    few = few.repartition("hub").sortWithinPartitions(*order).mapInArrow(_siblings, _LINK)
    crowd = beside.drop("token").join(large, "hub").distinct().withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    crowd = crowd.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o"), "side": (F.col("b") > F.col("o")).cast("int")})
    crowd = crowd.groupBy("hub", "i", "j").applyInArrow(_crowds, _LINK)
    beside = few.union(crowd)
    good = checked.where("hub is null").select(*links).union(beside.select(*links))
    before = Window.partitionBy("doc_id", "partner_id", F.col("start") - F.col("partner_start")).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    good = common.materialize(good.distinct().withColumn("_upto", F.coalesce(F.max("end").over(before), F.lit(-1))).where("end > _upto").drop("_upto"), "passage-links")
    back = {"doc_id": "partner_id", "start": "partner_start", "end": "partner_end"}
    back |= {b: a for a, b in back.items()}
    return good.union(good.select(*(F.col(back[c]).alias(c) for c in good.columns)))
