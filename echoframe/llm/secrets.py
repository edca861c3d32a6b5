"""Secret scans: fixed patterns, and a guess-cost estimate for values in credential contexts.

The guess cost of a value is that of its cheapest segmentation into listed words, dates, repeats,
keyboard walks, runs of neighbouring characters and brute-force spans of any length, found by dynamic programming
over positions. Words come from an automaton in one pass; walks, runs and brute force grow by a character at a
fixed price, and repeats by a copy, so an open span is one number at each position. A value that would take an
attacker many guesses is a secret.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds of spans in the order in which they are listed.
KINDS = ("assign", "access", "hex", "guess")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
#: Contexts beyond the fixed pattern whose values are weighed; the value is group 1.
CONTEXT = re.compile("(?:" + "|".join(map(_either, ("passphrase", "password", "passwd", "pass", "pwd", "secret", "token", "credential", "apikey", "api_key", "api-key", "auth_key", "access_key", "private_key", "bearer"))) + r""")["']?\x20*[:=]\x20*["']?([!#-&(-+\--~]+)""")
_HINTS = ("pass", "pwd", "secret", "token", "credential", "api", "_key", "bearer")

#: Passwords and words that people choose most, the commonest first. Words of a vocabulary file follow them.
COMMON = """123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123
football monkey letmein shadow master 666666 qwertyuiop 123321 mustang 1234567890 michael 654321 superman
1qaz2wsx 7777777 121212 000000 qazwsx 123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster soccer
harley batman andrew tigger sunshine iloveyou charlie robert thomas hockey ranger daniel starwars klaster 112233
george computer michelle jessica pepper 1111 zxcvbn 555555 11111111 131313 freedom 777777 pass maggie 159753
aaaaaa ginger princess joshua cheese amanda summer love ashley nicole chelsea biteme matthew access yankees
987654321 dallas austin thunder taylor matrix welcome admin login secret hello test guest root user changeme
default example sample token apikey winter spring autumn monday friday""".split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: Letters that people write as other signs.
LEET = str.maketrans("@48310$57", "aabeiosst")

_where = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_near = {a + b for a, (r, i) in _where.items() for b, (q, k) in _where.items() if a != b and abs(r - q) <= 1 and abs(i - k) <= 1}
#: A year, and dates of a year, a month and a day, with log10 of their guesses.
_MONTH, _DAY, _YEAR = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:19|20)[0-9]{2}"
DATES = [
    (re.compile(_YEAR), math.log10(60)),
    (re.compile(f"{_YEAR}[-/._]{_MONTH}[-/._]{_DAY}"), math.log10(365 * 60)),
    (re.compile(f"{_DAY}[-/._]{_MONTH}[-/._]{_YEAR}"), math.log10(365 * 60)),
    (re.compile(f"{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"), math.log10(365 * 60)),
    (re.compile(f"(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2]){_YEAR}"), math.log10(365 * 60)),
]
#: log10 guesses: a character by brute force; the first character of a walk and each further one; the same of a run of neighbouring
#: code points; a repeat and each of its copies; each further segment of a value.
BRUTE, WALK, RUN, REPEAT, FURTHER = 1.0, (math.log10(len(_where)), 0.6), (math.log10(26), 0.1), (0.3, 0.1), math.log10(2)
#: Factor for a word that is written with other signs.
SIGNS = 4


class Words:
    """Ranked words, in an automaton that finds all of them in a value at once."""

    def __init__(self, words):
        self.rank = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.automaton = ahocorasick.Automaton()
        for w, r in self.rank.items():
            self.automaton.add_word(w, (len(w), r))
        self.automaton.make_automaton()

    def spans(self, value: str):
        """(start, end, log10 guesses) of every word in a value, as it is written or with signs for letters."""
        low = "".join(c.lower() if c.isascii() else c for c in value)
        plain = low.translate(LEET)
        for text, factor in ((low, 1), (plain, SIGNS))[: 1 + (plain != low)]:
            for last, (n, r) in self.automaton.iter(text):
                yield last + 1 - n, last + 1, word_cost(value[last + 1 - n : last + 1], factor * r)


def word_cost(raw: str, rank: int) -> float:
    """log10 guesses of a word of a rank in the case in which it is written."""
    case = 0.0 if raw == raw.lower() else FURTHER if raw == raw.capitalize() or raw.isupper() else len(raw) / 2 * FURTHER
    return math.log10(rank + 1) + case


def load_words(path: str) -> tuple[str, ...]:
    """Words of three letters or more of a vocabulary file that marks ends of words, in its order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    whole = (w.removesuffix(end) for w in sorted(model["vocab"], key=model["vocab"].get) if end and w.endswith(end))
    return tuple(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())


@lru_cache(maxsize=2)
def dictionary(more: tuple[str, ...] = ()) -> Words:
    return Words([*COMMON, *more])


def _ranks(x: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ..., the rank of the 2**k symbols that begin at each place among all of these, until all differ; a stretch that
    the end cuts short comes before those it begins. The last is the order of the suffixes."""
    n, out = len(x), [np.unique(x, return_inverse=True)[1].astype(np.int64)]
    while out[-1].max(initial=0) < n - 1:
        step, r = 1 << (len(out) - 1), out[-1]
        after = np.zeros(n, np.int64)
        after[: n - step] = r[step:] + 1
        out.append(np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
    return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place, the next one with a smaller rank, or the length."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while open_ and open_[-1][0] > r:
            out[open_.pop()[1]] = i
        open_.append((r, i))
    return np.array(out, np.int64)


def _agree(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols agree from places i and j > i on, or up to them."""
    n, total = len(ranks[0]), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        width = 1 << k
        a, b = (i - total - width + 1, j - total - width + 1) if back else (i + total, j + total)
        fits = (a >= 0) if back else (b + width <= n)
        fits[fits] = ranks[k][a[fits]] == ranks[k][b[fits]]
        total[fits] += width
    return total


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(unit, first, end): stretches in which every character equals the one `unit` before it, a whole unit or more of them,
    each as long as it goes; not those that a shorter unit explains.

    These are a string's runs, of which there are fewer than characters. The unit of each begins somewhere as the longest Lyndon
    word from a place on, in the order of the symbols or in its inverse; so each place gives two candidates, that
    end before the next smaller suffix, and these are extended both ways by the ranks of stretches of 1, 2, 4, ... symbols. Time
    and space grow as n log n.
    """
    x = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(x) < 2:
        return []
    ranks, at = _ranks(x), np.arange(len(x))
    found = []
    for order in (ranks[-1], _ranks(-x)[-1]):
        unit = _next_smaller(order) - at
        i, u = at[at + unit < len(x)], unit[at + unit < len(x)]
        right = _agree(ranks, i, i + u, False)
        left = _agree(ranks, i - 1, i + u - 1, True)
        keep = left + right >= u
        found.append(np.stack([u, i + u - left, i + u + right], 1)[keep])
    return list(map(tuple, np.unique(np.concatenate(found), axis=0).tolist()))


def guess_cost(value: str, words: Words | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation; 0 for the empty value.

    Every segment after the first doubles the guesses, brute-force spans too. A repeat is one or more whole copies of what
    stands right before it, whose own segments have been paid for. Walks and runs have three characters or more.
    """
    words = words or dictionary()
    n, inf = len(value), math.inf
    low = value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)
    jumps: list[list] = [[] for _ in range(n)]
    for start, end, cost in words.spans(value):
        jumps[start].append((end, cost))
    if re.search("[0-9]{4}", value):
        for i in range(n):
            if value[i].isdigit():
                jumps[i] += [(m.end(), cost) for pattern, cost in DATES if (m := pattern.match(value, i))]
    # Of each stretch of repeats, the cheapest span of copies that ends at each place.
    begins: dict[int, list] = {}
    for u, a, e in repeats(value):
        begins.setdefault(a, []).append((u, a, e, [inf] * (e - a + 1)))
    best, active = [0.0] + [inf] * n, []
    brute = walk2 = walk3 = up2 = up3 = down2 = down3 = inf
    walk1 = run1 = inf
    for i in range(n):
        here = best[i] + (FURTHER if i else 0.0)
        brute = min(brute, here) + BRUTE
        cost = brute
        near = i > 0 and low[i - 1 : i + 1] in _near
        walk3 = min(walk2, walk3) + WALK[1] if near else inf
        walk2 = walk1 + WALK[1] if near else inf
        walk1 = here + WALK[0] if low[i] in _where else inf
        step = ord(value[i]) - ord(value[i - 1]) if i else 0
        up3, up2 = (min(up2, up3) + RUN[1], run1 + RUN[1]) if step == 1 else (inf, inf)
        down3, down2 = (min(down2, down3) + RUN[1], run1 + RUN[1]) if step == -1 else (inf, inf)
        run1 = here + RUN[0]
        cost = min(cost, walk3, up3, down3)
        if cost < best[i + 1]:
            best[i + 1] = cost
        for end, price in jumps[i]:
            if here + price < best[end]:
                best[end] = here + price
        if i in begins:
            active += begins[i]
        if active:
            for u, a, e, spans in active:
                if i + u <= e:
                    cost = min(here + REPEAT[0], spans[i - a]) + REPEAT[1]
                    spans[i + u - a] = cost
                    if cost < best[i + u]:
                        best[i + u] = cost
            active = [x for x in active if i + 1 + x[0] <= x[2]]
    return best[-1]


def scan(text: str, threshold: float = 10.0, words: Words | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every span of a text, in order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], words) >= threshold]
    return sorted(found)


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 10.0, words: str | None = None) -> DataFrame:
    """One row per row of docs: counts of each kind, the digest of the fixed patterns' spans, and all spans
    as kind:start:end in code points, the end exclusive.

    Fixed patterns match leftmost and without overlap, each kind by itself; a match too short is dropped
    after it has been consumed. `guess` spans are values in credential contexts that take
    10**threshold guesses or more, with the words of the vocabulary file `words` besides the listed ones. Null text counts as empty: no spans. Repeated rows and null ids are
    scanned row by row; other columns are not read. One narrow pass, memory bounded by a batch.
    """
    common.ship(docs.sparkSession)
    more = docs.sparkSession.sparkContext.broadcast(load_words(words) if words else ())  # bounded by the file

    def run(batches):
        known = dictionary(more.value)
        for b in batches:
            all_spans = [scan(t or "", threshold, known) for t in b.column(1).to_pylist()]
            base = [_join(x for x in s if x[1] < 3) for s in all_spans]
            counts = [pa.array([sum(1 for x in s if x[1] == k) for s in all_spans], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
            spans = pa.array([_join(s) for s in all_spans], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts[:3], digest, spans, counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, FOUND)
