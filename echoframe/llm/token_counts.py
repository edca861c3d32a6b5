"""Token counts by a finite-state tokenizer.

The vocabulary of a subword tokenizer with merge ranks is compiled, as texts ask for it, into
a deterministic transducer. After each character its state holds every suffix of the
text that begins some piece, the token before that suffix, and how many tokens fewer
stood there; a transition finds the one piece that may end here (its neighbour on the left must
be left alone by the merges) and is annotated with the change of the token count. Equal
states are shared, so transitions are computed once per process.

A text is cut into chunks where no piece reaches across; there every state map is constant
(whatever the state before, the transducer starts anew), is found once per distinct chunk, and
maps compose associatively. A chunk longer than `BLOCK` characters with no such place is cut anywhere: each
block gets its map from the states that can enter it, {entry: (exit, emitted)}, without
waiting for the blocks before it, and an inclusive scan by doubling composes the maps. States that can enter are those in which
runs from the start, begun at any of the `WARM` places before the block, arrive; they nearly always agree. An
entry that none of them foresaw is run when the scan meets it, so counts are exact.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
#: Distinct chunks that a process remembers.
MEMO = 500_000
#: Transducer states that a process holds, 1 kB each at most; answers about pairs of tokens, which outlive them; places before a
#: block from which it may be entered.
STATES, FITS, WARM = 250_000, 500_000, 24
SPACE = "▁"
_LETTER = re.compile(r"[^\W\d_]")
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_order(text: str, score: dict[str, float]) -> list[str]:
    """Tokens of a text by merging adjacent symbols, best score first, leftmost among equals.
    The transducer is built from answers on short strings."""
    sym, n = list(text), len(text)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(-score[a + b], i, a + b) for i, (a, b) in enumerate(zip(sym, sym[1:], strict=False)) if a + b in score]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = right[i] if sym[i] is not None else n
        if j >= n or sym[i] + sym[j] != whole:
            continue
        sym[i], sym[j] = whole, None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (joined := sym[a] + sym[b]) in score:
                heapq.heappush(heap, (-score[joined], a, joined))
    return [s for s in sym if s is not None]


class Transducer:
    """Counts tokens of texts over a vocabulary given as {piece: score}."""

    START = 0

    def __init__(self, score: dict[str, float]):
        runs = {p for p in score if len(p) > 1 and set(p) == {SPACE}}
        rest = [p for p in score if p not in runs]
        if any(SPACE in p[1:] for p in rest) or runs and max(score[p] for p in runs) >= min(score[p] for p in rest if len(p) > 1):
            raise ValueError("pieces that hold a space mark inside, or runs of marks that merge before words, are not supported")
        self.score = score
        self.prefixes = {p[:i] for p in score for i in range(1, len(p) + 1)}
        self.states: list[tuple] = [(("", None, 0),)]
        self.index = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.chunks: dict[str, int] = {}
        self.marks: dict[int, int] = {}
        inside = {c for p in score if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r0123456789" if c not in inside)
        cut = re.escape(alone)
        # Letters and other characters are cut apart where no piece holds both; letters that pieces
        # join with others, such as a raised 2, count as others.
        bare = [p.lstrip(SPACE) for p in score]
        odd = {a if a.isalnum() else b for p in bare for a, b in zip(p, p[1:], strict=False) if bool(_LETTER.match(a)) != bool(_LETTER.match(b))}
        letters = {c for p in bare for c in p if _LETTER.match(c) and c not in odd}
        mixed = len(odd) > 50 or any((a in letters) != (b in letters) for p in bare for a, b in zip(p, p[1:], strict=False))
        extra = re.escape("".join(sorted(odd)))
        digits = rf"(?![{cut}])[\d_{extra}]" if cut else rf"[\d_{extra}]"
        body = f"[^{SPACE}{cut}]+" if mixed else rf"(?:[^\W\d_{extra}]+|(?:[^\w{SPACE}{cut}]|{digits})+)"
        self.cuts = re.compile(f"{SPACE}*{body}|{SPACE}+" + (f"|[{cut}]" if cut else ""))

    def cost(self, token: str) -> int:
        return 1 if token in self.score else len(token.encode())

    def parts(self, token: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes a token; None if merging never makes it."""
        found = self.halves.get(token, ())
        if found == ():
            rest = {token[i:j]: self.score[token[i:j]] for i in range(len(token)) for j in range(i + 2, len(token) + 1) if j - i < len(token) and token[i:j] in self.score}
            two = merge_order(token, rest)
            found = self.halves[token] = (two[0], two[1]) if len(two) == 2 else None
        return found

    def fit(self, last: str | None, token: str) -> bool:
        """Whether merging the text `last` + `token` leaves just these two.

        Takes the merges that made them back, the latest first, and asks whether the symbols that then
        touch would have merged before.
        """
        key = (last, token)
        found = self.fits.get(key)
        if found is None:
            made = len(token) == 1 or self.parts(token) is not None
            found = self.fits[key] = made and (last is None or self._apart(last, token))
        return found

    def _apart(self, a: str, b: str) -> bool:
        score, bound = self.score, float("-inf")
        while True:
            joined = score.get(a + b)
            if joined is not None and joined > bound:
                return False
            at_a = score[a] if len(a) > 1 else float("inf")
            at_b = score[b] if len(b) > 1 else float("inf")
            if len(a) == len(b) == 1:
                return True
            if at_a < at_b:  # a was made later
                bound, a = at_a, self.parts(a)[1]
            else:  # the left one of equal merges goes first
                bound, b = at_b - 0.5, self.parts(b)[0]

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Compiles a transition: the next state and the change of the token count."""
        chain = self.states[state]
        for suffix, last, back in chain:
            token = suffix + char
            if (len(token) == 1 or token in self.score) and self.fit(last, token):
                emitted = back + self.cost(token)
                break
        else:
            raise AssertionError("no piece ends here")
        after = tuple((s + char, t, b - emitted) for s, t, b in chain if s + char in self.prefixes) + (("", token, 0),)
        move = self.moves[state][char] = (self.intern(after), emitted)
        return move

    def intern(self, chain: tuple) -> int:
        to = self.index.get(chain)
        if to is None:
            to = self.index[chain] = len(self.states)
            self.states.append(chain)
            self.moves.append({})
        return to

    def run(self, state: int, block: str) -> tuple[int, int]:
        """The state map of a block at one state: where it leads, and the tokens it emits. Valid until forget()."""
        total, moves = 0, self.moves
        for char in block:
            move = moves[state].get(char) or self.step(state, char)
            state = move[0]
            total += move[1]
        return state, total

    def forget(self) -> None:
        """Drops all compiled states but the start; states that go on are carried as their chains. What is known of tokens stays,
        as the states that are compiled next ask for it again, unless it is too much itself."""
        if len(self.states) > STATES:
            self.states, self.index, self.moves = self.states[:1], {self.states[0]: 0}, [{}]
        if len(self.fits) > FITS:
            self.fits.clear()
        if len(self.halves) > FITS:
            self.halves.clear()

    def image(self, chain: tuple, block: str) -> tuple[tuple, int]:
        """run() on chains instead of numbers of states, which forget() does not change."""
        self.forget()
        state, total = self.run(self.intern(chain), block)
        return self.states[state], total

    def block_map(self, before: str, block: str) -> dict[tuple, tuple[tuple, int]]:
        """{entry: (exit, emitted)} of a block for the states that can enter it after the text `before`."""
        start = self.states[self.START]
        entries = {self.image(start, before[i:])[0] for i in range(len(before))} or {start}
        return {entry: self.image(entry, block) for entry in entries}

    def word(self, chunk: str) -> int:
        """Tokens of a chunk with one space mark at most."""
        if len(chunk) <= BLOCK:
            return self.run(self.START, chunk)[1]
        blocks = [chunk[i : i + BLOCK] for i in range(0, len(chunk), BLOCK)]
        maps = [BlockMap(self, blocks, i, i + 1, self.block_map(blocks[i - 1][-WARM:] if i else "", b)) for i, b in enumerate(blocks)]
        return inclusive_scan(maps)[-1](self.states[self.START])[1]

    def mark_run(self, n: int) -> int:
        if n not in self.marks:
            self.marks[n] = len(merge_order(SPACE * n, self.score))
        return self.marks[n]

    def chunk(self, chunk: str) -> int:
        body = chunk.lstrip(SPACE)
        n = len(chunk) - len(body)
        if not body:
            return self.mark_run(n)
        if n < 2:
            return self.word(chunk)
        whole = self.word(SPACE + body)
        # Runs of marks merge last, so only a mark that its word leaves alone joins the run.
        if merge_order(SPACE + body, self.score)[0] == SPACE:
            return self.mark_run(n) + whole - 1
        return self.mark_run(n - 1) + whole

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        self.forget()
        known, total = self.chunks, 0
        if len(known) > MEMO:
            known.clear()
        for c in self.cuts.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(c)
            if n is None:
                n = self.chunk(c)
                if len(c) < 64:
                    known[c] = n
            total += n  # constant maps compose by addition
        return total


class BlockMap:
    """The state map of blocks [first, end), as a table; an entry outside the table is run through the blocks."""

    def __init__(self, of: Transducer, blocks: list[str], first: int, end: int, table: dict):
        self.of, self.blocks, self.first, self.end, self.table = of, blocks, first, end, table

    def __call__(self, entry: tuple) -> tuple[tuple, int]:
        found = self.table.get(entry)
        if found is None:
            state, total = entry, 0
            for i in range(self.first, self.end):
                state, n = self.of.image(state, self.blocks[i])
                total += n
            found = self.table[entry] = state, total
        return found

    def then(self, after: BlockMap) -> BlockMap:
        """Composition; associative."""
        table = {}
        for entry, (through, a) in self.table.items():
            out, b = after(through)
            table[entry] = out, a + b
        return BlockMap(self.of, self.blocks, self.first, after.end, table)


def inclusive_scan(maps: list[BlockMap]) -> list[BlockMap]:
    """The maps of all beginnings of a row of blocks: in round r each takes in the map that ends 2**r places before it."""
    step = 1
    while step < len(maps):
        maps = [maps[i - step].then(m) if i >= step else m for i, m in enumerate(maps)]
        step *= 2
    return maps


def load_pieces(path: str) -> dict[str, float]:
    """Mergeable pieces of a sentencepiece model with their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))}


@lru_cache(maxsize=2)
def _compiled(items: tuple) -> Transducer:
    return Transducer(dict(items))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: its id, bytes, tokens and whether it has more than `limit` tokens.

    Null text counts as empty: 0 bytes and 0 tokens. Repeated rows and null ids are counted row by row;
    other columns, whatever their names, are not read. One narrow pass without a shuffle: a
    lost executor costs its tasks only, and memory is bounded by an Arrow batch, `MEMO` chunks and the states of one block beyond `STATES`.
    """
    common.ship(docs.sparkSession)
    # The vocabulary file bounds the broadcast.
    pieces = docs.sparkSession.sparkContext.broadcast(tuple(load_pieces(model).items()))

    def count(batches):
        counter = _compiled(pieces.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counter(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, COUNTS)
