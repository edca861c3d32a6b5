"""Best-fit packing of tokenized documents into sequences of a fixed length, by exact complements.

A packing only depends on how many pieces there are of each length, at most 1024 numbers however large the corpus.
`plan` packs these counts: lengths from the longest down ask an index of single, pair and triple sums for
combinations that fill the rest of a sequence exactly, and each combination is consumed as often as the counts
allow; where none is left, the longest piece that fits goes in and the index is asked again. The plan is a list of
patterns with how often each is used. Pieces are ranked within their length in two levels, and a piece's rank
says which sequence of which pattern it belongs to.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The longest sequence, and the id that ends a document.
SIZE, END = 1024, 2
#: Stretches that a process remembers the ids of; pieces of a length that are ranked in one task, about.
MEMO, SHARD = 300_000, 2_000
#: Documents that are tokenized at a time.
ROWS = 2000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, as the tokenizers library gives them.

    The model cuts a text at its special string and its parts by a pattern in which a blank before anything but white
    space always begins a word. So texts are split there, each distinct stretch of a batch is encoded once, by a faster
    library with the model's own vocabulary and pattern, and the texts' ids are gathered from these. That holds for
    characters of blocks where both libraries' Unicode tables agree; any other text, and any with a special string or
    with white space after a blank, is given to the tokenizers library whole.
    """

    def __init__(self, model: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(model)
        self.lib.no_truncation()
        self.lib.no_padding()
        added = self.lib.get_added_tokens_decoder()
        raw = {c: bytes([b]) for b, c in enumerate(_byte_letters())}
        ranks = {b"".join(raw[c] for c in token): k for token, k in self.lib.get_vocab(with_added_tokens=False).items() if k not in added}
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.n_bytes[list(ranks.values())] = list(map(len, ranks))
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("model", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # Latin letters and digits with their signs, and general punctuation; of control characters the usual blanks.
        safe = "".join(re.escape(chr(c)) for c in (*range(9, 14), *range(32, 127), *range(161, 173), *range(174, 592), *range(0x2010, 0x2028), *range(0x2030, 0x205F)))
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.uint32()))
        self.odd = [re.compile(x).search for x in (f"[^{safe}]", r"\x20[\s]", *(re.escape(t.content) for t in added.values()))]

    def whole(self, text: str) -> bytes:
        return _little_endian(self.lib.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not any(found(t) for found in self.odd) for t in texts]
        words = pc.split_pattern(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()), " ")
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()  # every text has a first word, perhaps an empty one
        distinct = words.flatten().dictionary_encode()
        ids = self._stretches(distinct.dictionary).take(distinct.indices)
        upto = 4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())
        joined = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes()
        first = words.flatten().take(pa.array(ends[:-1])).to_pylist()
        rest = zip(upto[ends[:-1] + 1].tolist(), upto[ends[1:]].tolist(), strict=True)
        return [_little_endian(self.fast.encode_ordinary(f)) + joined[a:b] if p else self.whole(t) for t, p, f, (a, b) in zip(texts, plain, first, rest, strict=True)]

    def _stretches(self, words: pa.Array) -> pa.Array:
        """The ids of " " + word for each of these words; MEMO of those met so far are remembered."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        both = pa.concat_arrays([self.ids, self._encoded(new)])
        if len(self.known) + len(new) <= MEMO:
            self.known, self.ids = pa.concat_arrays([self.known, new]), both
            return both.take(pc.index_in(words, value_set=self.known))
        at = at.to_numpy(zero_copy_only=False)
        return both.take(pa.array(np.where(np.isnan(at), len(self.known) - 1 + np.cumsum(np.isnan(at)), at).astype(np.int64)))

    def _encoded(self, words: pa.Array) -> pa.Array:
        """The ids of " " + word for words that don't begin with white space: encoded as one text, and cut where the tokens'
        bytes reach the words' ends. An empty word, the blank that ends a text, is encoded by itself."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        blank = np.flatnonzero(sizes == 1)
        sent = words.filter(pa.array(sizes > 1))
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(sent)], sent.cast(pa.string())), " ")[0].as_py()
        ids = self.fast.encode_to_numpy(" " + text if len(sent) else "", disallowed_special=())
        cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes[sizes > 1])) + 1
        for k in blank:  # one at most, as words are distinct
            token, at = self.fast.encode_ordinary(" "), int(cuts[k - 1]) if k else 0
            ids, cuts = np.insert(ids, at, token), np.concatenate((cuts[:k], [at + len(token)], cuts[k:] + len(token)))
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], cuts)).astype(np.int64)), pa.array(ids.astype(np.uint32)))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def _little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all full but the first."""
    first = n % size or min(n, size)
    return [(0, first)] + [(k, size) for k in range(first, n, size)]


def pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): what is to be packed. One narrow pass."""
    common.ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(open(model, "rb").read())  # the vocabulary file
    last = _little_endian([end])

    def run(batches):
        e = _encoder(spec.value)
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                out = []
                texts = [t or "" for t in b.column(1).to_pylist()]
                for doc_id, ids in zip(b.column(0).to_pylist(), e.encode(texts), strict=True):
                    ids = memoryview(ids + last)
                    out += [(doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])) for k, (start, n) in enumerate(cut(len(ids) // 4, size))]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


_encoders: dict[int, Encoder] = {}


def _encoder(spec: bytes) -> Encoder:
    """The encoder of a vocabulary, built once in a process."""
    import os
    import tempfile

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = zlib.crc32(spec)
    if key not in _encoders:
        with tempfile.NamedTemporaryFile(suffix=".json") as f:  # the library reads files; gone with this block
            f.write(spec)
            f.flush()
            _encoders[key] = Encoder(f.name)
    return _encoders[key]


class Complements:
    """Which combinations of one, two or three lengths add up to a number, under the counts that are left. Counts only
    fall, so a pair that has run out is dropped from its list for good."""

    def __init__(self, left: dict[int, int], size: int):
        self.left = left
        lengths = sorted((n for n in left if left[n] > 0), reverse=True)
        self.lengths = lengths
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, x in enumerate(lengths):
            for y in lengths[k:]:
                if x + y <= size:
                    self.pairs[x + y].append((x, y))
        for found in self.pairs.values():  # the longest member is asked last to first
            found.reverse()

    def _spare(self, n: int, used: Counter) -> int:
        return self.left.get(n, 0) - used[n]

    def _pair(self, total: int, used: Counter) -> tuple[int, int] | None:
        found = self.pairs.get(total)
        while found:
            x, y = found[-1]
            if self.left[x] < 1 + (x == y) or self.left[y] < 1:
                found.pop()
                continue
            break
        for x, y in reversed(found or ()):
            if self._spare(x, used) >= 1 + (x == y) and self._spare(y, used) >= 1:
                return x, y
        return None

    def exact(self, gap: int, used: Counter) -> tuple[int, ...]:
        """The fewest pieces, three at most, that fill a gap and are not in use; () if there are none."""
        if self._spare(gap, used) > 0:
            return (gap,)
        if two := self._pair(gap, used):
            return two
        for z in self.lengths:
            if z < gap and self._spare(z, used) > 0 and 3 * z >= gap:  # z is the longest of the three
                used[z] += 1
                two = self._pair(gap - z, used)
                used[z] -= 1
                if two and two[0] <= z:
                    return (z, *two)
        return ()

    def longest(self, gap: int, used: Counter) -> int:
        return next((n for n in self.lengths if n <= gap and self._spare(n, used) > 0), 0)

    def drop(self) -> None:
        self.lengths = [n for n in self.lengths if self.left[n] > 0]


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how many sequences are filled so). Each entry uses up a length, down to less than
    it takes of it, so entries are bounded by the lengths and not by the counts."""
    if any(not 1 <= n <= size for n in counts):
        raise ValueError(f"pieces must have 1 to {size} tokens")
    left = dict(counts)
    index, out = Complements(left, size), []
    while index.lengths:
        first = index.lengths[0]
        pattern, used, gap = [first], Counter({first: 1}), size - first
        while gap:
            more = index.exact(gap, used) or ((n,) if (n := index.longest(gap, used)) else ())
            if not more:
                break
            pattern += more
            used.update(more)
            gap -= sum(more)
        used = +used  # without the lengths that were tried and put back
        times = min(left[n] // m for n, m in used.items())
        for n, m in used.items():
            left[n] -= m * times
        out.append((tuple(sorted(pattern, reverse=True)), times))
        index.drop()
    return out


@dataclass
class Places:
    """For each length, the rank at which each pattern's share of its pieces begins, and what the share is."""

    at: dict[int, tuple[np.ndarray, ...]]

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]]) -> Places:
        rows, used, sequence = defaultdict(list), Counter(), 0
        for pattern, times in patterns:
            offset = 0
            for n, m in sorted(Counter(pattern).items(), reverse=True):
                rows[n].append((used[n], sequence, m, offset))
                used[n] += m * times
                offset += m * n
            sequence += times
        return cls({n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()})

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            here = length == n
            starts, first, m, at = self.at[int(n)]
            k = np.searchsorted(starts, rank[here], "right") - 1
            nth = rank[here] - starts[k]
            sequence[here], offset[here] = first[k] + nth // m[k], at[k] + nth % m[k] * n
        return sequence, offset


def pack_pieces(cut_: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(). `cut_` is read three times, so it should be a written table.

    The driver gets one count for each length and sends the plan's patterns, whose number the lengths bound. A
    length that a third of all pieces share is ranked in as many shards as its count asks for. Between them stands one row for each shard.
    """
    spark = cut_.sparkSession
    counts = {r.length: r.n for r in cut_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    places = spark.sparkContext.broadcast(Places.of(plan(counts, size)))
    shards = F.array(*(F.lit(-(-counts.get(n, 1) // SHARD)) for n in range(size + 1)))
    cut_ = cut_.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(shards, F.col("length").cast("int"))))
    # Ranks in two levels: within a shard of a length, and over the shards of a length.
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = cut_.groupBy("length", "shard").agg(F.count("*").alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Rows that tie here are alike in every column, so any order of them is the same result.
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut_.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "shard"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches):
        for b in batches:
            sequence, offset = places.value.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Every document is its text's ids and the id that ends it, so null and empty texts have one token. Only documents
    longer than a sequence are cut, and of their pieces only the first may be shorter than one. Rows that repeat
    an id and rows without one are documents of their own. An empty table gives no rows. Other columns are
    not read. Sequence ids are 0 to the number of sequences less one; offsets within a sequence leave no gap.
    """
    return pack_pieces(common.materialize(pieces(docs, model, id_col, text_col, size, end), "pieces"), size)
