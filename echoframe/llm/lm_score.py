"""Language-model scores: the likelihood of a text over a subword lattice.

A word's lattice holds every way to cut it into pieces of an existing vocabulary (single bytes where a letter is no
piece), and scores of the pieces weight the cuts: their sum over all paths, by a forward recursion in log
space, is the probability of spelling the word. The vocabulary's own scores alone give `lattice_score`. They are places in
an order, not probabilities, so `score` goes on from them: each round takes every piece's expected uses over
all cuts of all distinct training words as its new weight. The training rows also add an arc for each whole word that
they hold, weighted by its discounted count; the mass that discounts free goes to the spelled paths. So a word's
marginal is over the whole-word arc and all segmentations, and a document's is the product over its words and its
end, since all paths meet between words. Counts are kept for each language label of the training rows, and a
text's probability sums over the labels (its own is not looked at).

Spelling does not depend on the language, so each distinct word of the corpus passes each recursion once. Counts are exact and
cover all training rows. Documents are read once into blocks: a block holds its distinct words and, for each
document, their numbers. Words meet the counts by an equi-join with one row per block and word, so a word
in every document is a row per block.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_counts import SPACE, load_pieces

#: Bytes of text in a block.
BLOCK_BYTES = 24 << 20
#: The vocabulary's scores are places in its order, 0, -1, ...: a piece weighs 1 / (OFFSET - score).
OFFSET = 50.0
#: Distinct words that pass the recursion together.
TOGETHER = 100_000
#: Rounds of re-estimation, and what a piece's expected uses are raised by.
ROUNDS, LEAST = 2, 0.01
#: Weight of each byte, and of the end of a word, beside the pieces that do not begin a word.
BYTE, STOP = 1e-6, 1.0
#: The end of a document as a token: no word holds a blank.
END = " "
_MIX, _EMPTY, _PREFIX = np.uint64(0x9E3779B97F4A7C15), -1, -2


class Lattice:
    """Forward recursion over batches of words of one length, under {piece: score}.

    Pieces that begin a word share one distribution; the others, bytes and the end of a word share another. With
    `offset` None the scores are natural-log weights themselves.
    """

    def __init__(self, scores: dict[str, float], offset: float | None = OFFSET):
        self.pieces = list(scores)
        score = np.array([scores[p] for p in self.pieces])
        weight = np.concatenate([np.exp(score) if offset is None else 1 / (offset - score), np.full(256, BYTE), [STOP]])
        self.starts = np.array([p.startswith(SPACE) for p in self.pieces] + [False] * 257)
        self.given = self.normalize(weight)
        self.longest = max(map(len, self.pieces))
        codes = sorted({c for p in self.pieces for c in p})
        self.code = np.zeros(0x110000, np.uint64)
        self.code[[ord(c) for c in codes]] = np.arange(1, len(codes) + 1, dtype=np.uint64)
        self.spelled = np.ones(0x110000, bool)  # by bytes: letters that are no piece
        self.spelled[[ord(p) for p in self.pieces if len(p) == 1]] = False
        # An open-addressing table of all pieces and of what begins one.
        number = {p[:k]: _PREFIX for p in self.pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(self.pieces)}
        known = list(number)
        keys = np.zeros(len(known), np.uint64)
        for n in range(1, self.longest + 1):
            at = [i for i, p in enumerate(known) if len(p) == n]
            x = self.code[np.array([np.frombuffer(known[i].encode("utf-32-le"), np.uint32) for i in at]).reshape(len(at), n)]
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = self._add(h, x[:, k])
            keys[at] = h
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ids = np.zeros(1 << bits, np.uint64), np.full(1 << bits, _EMPTY, np.int32)
        for h, p in zip(keys, known, strict=True):
            at = int(h >> self.shift)
            while self.ids[at] != _EMPTY:
                at = (at + 1) & self.mask
            self.keys[at], self.ids[at] = h, number[p]

    def normalize(self, weight: np.ndarray) -> np.ndarray:
        """log scores of pieces, 256 bytes and a word's end."""
        return np.log(weight / np.where(self.starts, weight[self.starts].sum(), weight[~self.starts].sum()))

    @staticmethod
    def _add(h, code):
        with np.errstate(over="ignore"):
            return (h + code + np.uint64(1)) * _MIX ^ ((h + code) >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Of each hash: its piece's number, _PREFIX where it only begins pieces, or _EMPTY."""
        at = (h >> self.shift).astype(np.int64)
        out = self.ids[at]
        left = np.flatnonzero((out != _EMPTY) & (self.keys[at] != h))
        at = at[left]
        while len(left):  # an empty slot ends the probing
            at = (at + 1) & self.mask
            ids = self.ids[at]
            out[left] = ids
            on = (ids != _EMPTY) & (self.keys[at] != h[left])
            left, at = left[on], at[on]
        return out

    def _letters(self, words: list[str]):
        x = np.array([np.frombuffer((SPACE + w).encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]).T
        return x, self.code[x], self.spelled[x]

    def _arcs(self, i: int, letters):
        """(end, words, pieces) of the arcs that begin at i, for the words that have one; and (word, its bytes) of those by bytes."""
        x, code, spelled = letters
        rows, h = np.arange(x.shape[1]), np.zeros(x.shape[1], np.uint64)
        for j in range(i, min(len(x), i + self.longest)):
            h = self._add(h, code[j, rows])
            ids = self.find(h)
            hit = ids >= 0
            if hit.any():
                yield j + 1, rows[hit], ids[hit]
            on = ids != _EMPTY
            rows, h = rows[on], h[on]
            if not len(rows):
                break
        for k in np.flatnonzero(spelled[i]):
            yield i + 1, k, len(self.pieces) + np.frombuffer(chr(x[i, k]).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)

    def _forward(self, letters, logp: np.ndarray) -> np.ndarray:
        at = np.full((len(letters[0]) + 1, letters[0].shape[1]), -np.inf)
        at[0] = 0
        for i in range(len(at) - 1):
            for j, rows, ids in self._arcs(i, letters):
                cost = logp[ids] if isinstance(rows, np.ndarray) else logp[ids].sum()
                at[j, rows] = np.logaddexp(at[j, rows], at[i, rows] + cost)
        return at

    def forward(self, words: list[str], logp: np.ndarray | None = None) -> np.ndarray:
        """Natural-log probabilities of words of one length, each with its end, under given scores or the vocabulary's own."""
        logp = self.given if logp is None else logp
        return self._forward(self._letters(words), logp)[-1] + logp[-1]

    def expect(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Expected uses of pieces, bytes and the end over all cuts of words of one length: forward, then backward."""
        letters, uses = self._letters(words), np.zeros(len(logp))
        at = self._forward(letters, logp)
        back = np.full(at.shape, -np.inf)
        back[-1] = logp[-1]
        total = at[-1] + logp[-1]
        of, by, held = [], [], 0
        for i in range(len(at) - 2, -1, -1):
            for j, rows, ids in self._arcs(i, letters):
                cost = logp[ids] if isinstance(rows, np.ndarray) else logp[ids].sum()
                after = cost + back[j, rows]
                back[i, rows] = np.logaddexp(back[i, rows], after)
                of.append(ids)
                by.append(np.broadcast_to(np.exp(at[i, rows] + after - total[rows]), ids.shape))
                held += len(ids)
            if held > 1 << 20 or not i:
                uses += np.bincount(np.concatenate(of), np.concatenate(by), len(logp)) if of else 0
                of, by, held = [], [], 0
        uses[-1] += len(words)
        return uses

    def batches(self, words: list[str]):
        """(positions, words of one length) in pieces of bounded size."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                size = max(1, 200_000 // (int(lengths[part[0]]) + 1))
                for k in range(0, len(part), size):
                    yield part[k : k + size], [words[i] for i in part[k : k + size]]


@lru_cache(maxsize=2)
def lattice(scores: tuple[tuple[str, float], ...], offset: float | None = OFFSET) -> Lattice:
    return Lattice(dict(scores), offset)


_BLOCK = "block long, idx int, word string, doc_id long, held_out boolean, n_tokens long, ids binary, ns binary, counts array<struct<lang:int,n:long>>"
_COUNTS = pa.list_(pa.struct([("lang", pa.int32()), ("n", pa.int64())]))
_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), _COUNTS]


def _pack(x: np.ndarray) -> bytes:
    kind = np.uint8 if x.max(initial=0) < 256 else np.uint16 if x.max(initial=0) < 65536 else np.uint32
    return bytes([kind().itemsize]) + x.astype(kind).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32}[b[0]], offset=1).astype(np.int64)


def _counts_by_word(train: dict[int, list], size: int) -> pa.ListArray:
    """Of each word: the languages whose training rows hold it, with the numbers."""
    of, lang, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k, ids in train.items():
        times = np.bincount(np.concatenate(ids), minlength=size)
        at = np.flatnonzero(times)
        of, lang, n = [*of, at], [*lang, np.full(len(at), k, np.int32)], [*n, times[at]]
    of, lang, n = map(np.concatenate, (of, lang, n))
    order = np.argsort(of, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=size))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(lang[order]), pa.array(n[order])], fields=list(_COUNTS.value_type)))


def _to_blocks(block_bytes: int, langs: list):
    place = {x: i for i, x in enumerate(langs)}

    def rows(block, n, **columns):
        columns["block"] = pa.array([block] * n, pa.int64())
        return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)

    def flush(block, index, docs, train):
        words, counts = [w.decode() for w in index], _counts_by_word(train, len(index))
        for k in range(0, len(words), 20_000):
            n = min(20_000, len(words) - k)
            yield rows(block, n, idx=list(range(k, k + n)), word=words[k : k + n], counts=counts.slice(k, n))
        for k in range(0, len(docs), 1000):
            some = docs[k : k + 1000]
            yield rows(block, len(some), **dict(zip(("doc_id", "held_out", "n_tokens", "ids", "ns"), map(list, zip(*some, strict=True)), strict=True)))

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        index, docs, train, size = {}, [], {}, 0
        for b in batches:
            for doc_id, out, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (text or "").encode()
                found = raw.lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
                found.append(END.encode())
                ids = np.fromiter([index.setdefault(w, len(index)) for w in found], np.int64, len(found))
                if not out:
                    train.setdefault(place[lang], []).append(ids.astype(np.int32))
                ids, ns = np.unique(ids, return_counts=True)
                docs.append((doc_id, out, len(found), _pack(np.diff(ids, prepend=0)), _pack(ns)))
                size += len(raw) + 200
                if size > block_bytes:
                    yield from flush(block, index, docs, train)
                    block, index, docs, train, size = block + 1, {}, [], {}, 0
        if docs:
            yield from flush(block, index, docs, train)

    return run


def _larger(batches):
    """Batches put together until they hold TOGETHER rows: words of one length are then many enough to pass the recursion at once."""
    some, rows = [], 0
    for b in batches:
        some.append(b)
        rows += b.num_rows
        if rows >= TOGETHER:
            yield pa.concat_batches(some)
            some, rows = [], 0
    if some:
        yield pa.concat_batches(some)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
#: What a language adds to the spelled log10 probability of a word that its training rows hold.
_MORE = np.dtype([("lang", np.uint32), ("by", np.float64)])


def score(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id, whether it was held out, tokens, known tokens, N, the base's and the model's log10 probability,
    and the lattice's under the vocabulary's own scores alone (nothing learned; the end of the document costs nothing there).

    Learns from rows whose crc32(id as text) mod 7 is not 2 (a null id is learned from). Null text counts as
    empty: one token, the end. Repeated rows count as often as they stand. Every language label, and null as one more, has
    counts of its own; only the list of labels, a row each, comes to the driver. With nothing to learn from,
    N is 0, the base is 0 and the model spells every word. Every word has a finite score. Other columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    scores = tuple(load_pieces(model).items())
    sent = spark.sparkContext.broadcast(scores)  # bounded by the vocabulary file
    out = held_out(id_col)
    labels = docs.where(~out).groupBy(F.col(lang_col).cast("string").alias("l")).count().orderBy(F.col("l").asc_nulls_last()).collect()
    langs, share = [r.l for r in labels], np.array([r["count"] for r in labels], float)

    rows = docs.select(F.col(id_col).cast("long"), out, F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    blocks = common.materialize(rows.mapInArrow(_to_blocks(block_bytes, langs), _BLOCK), "lm-blocks")
    words = blocks.where("word is not null")
    each = words.select("word", F.explode_outer("counts").alias("x")).groupBy("word", F.col("x.lang").alias("lang")).agg(F.sum("x.n").alias("n"))
    each = each.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("c"), F.collect_list(F.when(F.col("n") > 0, F.struct("lang", "n"))).alias("counts"))
    counts = common.materialize(each, "lm-counts")

    facts = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = facts.n or 0, facts.v
    size, kinds, discount = (np.zeros(max(1, len(langs))) for _ in range(3))
    for r in counts.select(F.explode("counts").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("x.n") == 1).alias("one"), F.count_if(F.col("x.n") == 2).alias("two")).collect():
        size[r.lang], kinds[r.lang] = r.n, r.v
        discount[r.lang] = min(0.95, max(0.05, r.one / (r.one + 2 * r.two))) if r.one else 0.5
    prior = np.log10(share / share.sum()) if n else np.zeros(1)
    free = np.log10(discount * kinds / size) if n else np.zeros(1)

    lat = lattice(scores)
    logp = lat.given
    for _ in range(rounds if n else 0):
        now = spark.sparkContext.broadcast(logp)

        def expect(batches, now=now):
            lat, uses = lattice(sent.value), np.zeros(len(scores) + 257)
            for b in _larger(batches):
                for _, part in lat.batches(b.column(0).to_pylist()):
                    uses += lat.expect(part, now.value)
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(uses[at])], names=["piece", "uses"])

        # A row for each piece comes to the driver.
        got = counts.where(f"c > 0 and word != '{END}'").select("word").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        weight = np.full(len(logp), LEAST)
        for r in got:
            weight[r.piece] += r.uses
        logp = lat.normalize(weight)
    fitted = spark.sparkContext.broadcast(logp)

    def value(batches):
        lat = lattice(sent.value)
        for b in _larger(batches):
            some = b.column(0).to_pylist()
            spelled, given, end = np.zeros(len(some)), np.zeros(len(some)), np.array([w == END for w in some], bool)
            for at, part in lat.batches(some):
                given[at] = lat.forward(part) / math.log(10)
                spelled[at] = lat.forward(part, fitted.value) / math.log(10)
            # The end of a document is not spelled; the training rows of every language hold it.
            spelled[end] = given[end] = 0.0
            found = b.column(2)
            ends = found.offsets.to_numpy() - found.offsets[0].as_py()
            lang, times = (x.to_numpy() for x in found.flatten().flatten())
            of = np.repeat(np.arange(len(some)), np.diff(ends))
            more = np.empty(len(lang), _MORE)
            more["lang"] = lang
            rest = np.where(end[of], -np.inf, free[lang] + spelled[of])
            more["by"] = np.logaddexp(np.log((times - discount[lang]) / size[lang]), rest * math.log(10)) / math.log(10) - free[lang] - spelled[of]
            raw, width = more.tobytes(), _MORE.itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spelled), pa.array(given), pa.array([raw[i * width : j * width] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], names=["word", "c", "spelled", "given", "more"])

    valued = counts.mapInArrow(value, "word string, c long, spelled double, given double, more binary")
    known = words.select("block", "idx", "word").join(valued, "word").select("block", "idx", "c", "spelled", "given", "more")
    texts = blocks.where("word is null").select(F.col("block").alias("of"), "doc_id", "held_out", "n_tokens", "ids", "ns")

    def total_up(docs: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("idx")
        c, spelled, given = (words[x].to_numpy() for x in ("c", "spelled", "given"))
        raw = words["more"].to_pylist()
        starts = np.cumsum([0, *(len(x) // _MORE.itemsize for x in raw)])
        more = np.frombuffer(b"".join(raw), _MORE)
        base, is_known = np.log10((c + 1) / (n + v + 1)), c > 0
        out = []
        for tokens, packed, times in zip(*(docs[x].to_pylist() for x in ("n_tokens", "ids", "ns")), strict=True):
            ids, ns = np.cumsum(_unpack(packed)), _unpack(times)
            held = starts[ids + 1] - starts[ids]
            at = np.repeat(starts[ids] - np.cumsum(held) + held, held) + np.arange(held.sum())
            each = prior + tokens * free + ns @ spelled[ids] + np.bincount(more["lang"][at], np.repeat(ns, held) * more["by"][at], len(free))
            best = each.max()
            out.append((int(ns[is_known[ids]].sum()), float(ns @ base[ids]), float(best + np.log10((10 ** (each - best)).sum())), float(ns @ given[ids])))
        n_known, b, s, g = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([docs["doc_id"], docs["held_out"], docs["n_tokens"], pa.array(n_known, pa.int64()), pa.array([n] * len(b), pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64()), pa.array(g, pa.float64())], names=[f.split()[0] for f in SCORED.split(", ")])

    return texts.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(total_up, SCORED)
