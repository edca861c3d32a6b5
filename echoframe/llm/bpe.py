"""Byte-pair encoding and decoding.

Symbols of a word form a doubly linked list; a priority queue holds mergeable neighbours by
(rank, position); an entry whose symbols have changed since is stale and skipped. Decoding
concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Chunks and words that a process remembers, twice as many at most; rows that are encoded before they are sent on.
MEMO, ROWS = 200_000, 500
#: Unicode white space, and the splitting pattern that the vocabulary file names.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_white = regex.compile(f"[{WHITE}]+")
#: White space to str.split(), not to the pattern.
_separators = regex.compile("[\x1c-\x1f]")
#: Letters and numbers that the tokenizer's library, whose Unicode tables are older, counts as neither.
YOUNG = """0558 058b-058c 088f 0c5c 0cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee
11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed
1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f""".split()
#: Capitals that it lowers and Python's tables do not: first, last, distance.
CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
_capitals = {c: c + by for first, last, by in CAPITALS for c in range(first, last + 1)}
#: Combining marks that its tables lack, so that it takes them for letters, and the second part of a pair that it does not compose.
MARKS = """07fd 0898-089f 08ca-08d3 09fe 0c3c 0d3b-0d3c 0eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070
1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef
1e4ec-1e4ef""".split()
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """A printable letter for each byte: printable Latin-1 stands for itself, the others get 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Memo(dict):
    """Remembered results of a function of short strings: the latest `size`, and as many before them."""

    def __init__(self, f, size: int):
        self.f, self.size, self.older = f, size, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.f(key)
            if len(key) > 64:
                return found
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class Codec:
    """Encodes and decodes with the vocabulary, merges and special tokens of one tokenizer file."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: left id * size + right id -> rank, and the merged id of each rank.
        self.size = len(self.vocab)
        self.ranks = {self.vocab[a] * self.size + self.vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.strings = {i: s for s, i in (self.vocab | special).items()}
        letters = byte_letters()
        #: Ids of bytes within and at the end of a word.
        self.inner, self.last = ([self.vocab[letters[b] + end] for b in range(256)] for end in ("", self.suffix))
        kinds = [n["type"] for n in d["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or d["decoder"] or [p["type"] for p in d["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError("a tokenizer of another kind")
        pattern = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE)
        self.words = regex.compile(pattern)
        young, marks = ("".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges) for ranges in (YOUNG, MARKS))
        self.marks = regex.compile(f"([{marks}])")
        self.young = regex.compile(f"[{young}]")
        self.words_young = regex.compile(pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{young}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{young}]]").replace(rf"[^{WHITE}\p{{L}}\p{{N}}]", rf"[[^{WHITE}\p{{L}}\p{{N}}]||[{young}]]"), regex.V1)
        self.by_word, self.by_chunk = Memo(self.merge, MEMO), Memo(self.spell, MEMO)

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # A mark that the tokenizer's tables lack orders and composes with nothing.
        parts = self.marks.split(text) if self.marks.search(text) else (text,)
        text = _white.sub(" ", "".join([unicodedata.normalize("NFC", p) for p in parts]))
        return text.replace("Σ", "σ").lower().translate(_capitals)  # each letter by itself: no final sigma

    def merge(self, word: str) -> array:
        """Ids of one word. A queue entry is rank * n + place; it is stale where the pair at that place has another rank by now."""
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, size, ranks = len(ids), self.size, self.ranks.get
        rank = [ranks(a * size + b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        rank.append(-1)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(queue)
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            if rank[i] != r:
                continue  # stale
            j = after[i]
            ids[i] = new = self.merged[r]
            ids[j] = rank[j] = -1
            after[i] = k = after[j]
            rank[i] = -1
            if k < n:
                before[k] = i
                rank[i] = r = ranks(new * size + ids[k], -1)
                if r >= 0:
                    heapq.heappush(queue, r * n + i)
            if (h := before[i]) >= 0:
                rank[h] = r = ranks(ids[h] * size + new, -1)
                if r >= 0:
                    heapq.heappush(queue, r * n + h)
        return array("i", [x for x in ids if x >= 0])

    def spell(self, chunk: str) -> tuple[str, str]:
        """The ids of a chunk without white space as text, and these decoded. No word of the pattern and no step of the
        normalizer reaches across white space, so texts are encoded chunk by chunk."""
        low = self.normalize(chunk)
        words = self.words if low.isascii() or not self.young.search(low) else self.words_young
        ids = [i for w in words.findall(low) for i in self.by_word[w]]
        return " ".join(map(str, ids)), self.decode(ids)

    def chunks(self, text: str) -> list[tuple[str, str]]:
        """(ids as text, decoded) of each chunk and special token in order."""
        if any(s in text for s in self.special):
            out = []
            for piece in self.split_special.split(text):
                out += [(str(self.special[piece]), piece)] if piece in self.special else self.chunks(piece)
            return out
        found = _white.split(text) if _separators.search(text) else text.split()
        return [x for x in map(self.by_chunk.__getitem__, found) if x[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.chunks(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, set apart by blanks, as the library joins them where a file names no decoder."""
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of docs: id, number of tokens, digests of the ids and of the decoded text,
    and the ids themselves where asked for.

    Null text counts as empty (no tokens; digests of the empty string). Repeated rows and null ids are
    encoded row by row; other columns are not read. One narrow pass without a shuffle; memory is
    bounded by an Arrow batch, the ids of `ROWS` rows and memos of `MEMO` chunks and words.
    """
    common.ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(model))  # bounded by the vocabulary file

    def run(batches):
        c = codec(spec.value)
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                ids, ends, n, digests, decoded = [], [0], [], [], []
                for text in b.column(1).to_pylist():
                    parts = c.chunks(text or "")
                    joined = " ".join([p[0] for p in parts])
                    n.append(joined.count(" ") + 1 if joined else 0)
                    digests.append(_digest(joined))
                    decoded.append(_digest(" ".join([p[1] for p in parts])))
                    if with_ids:
                        ids.append(np.fromstring(joined, np.int32, sep=" "))
                        ends.append(ends[-1] + n[-1])
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ENCODED + ", ids array<int>" * with_ids)
