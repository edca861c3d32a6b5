import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from echoframe.llm import ann, components, mixing, ngram_join, substring_dedup
from tests.llm.conftest import ODD

WORD = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def slow_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return sorted(out, key=repr)


def edited(rng, base, edits, vocabulary):
    w = list(base)
    for _ in range(edits):
        w[rng.integers(len(w))] = vocabulary[rng.integers(len(vocabulary))]
    return " ".join(w)


def near_copies(seed, n=70):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[vocabulary[i] for i in rng.integers(400, size=length)] for length in (30, 60, 120, 4, 5, 6)]
    rows = [(100 + i, edited(rng, bases[i % 6], int(rng.integers(0, 5)), vocabulary)) for i in range(n)]
    passage = " ".join(vocabulary[i] for i in rng.integers(400, size=25))
    return rows + [(900 + i, passage + " " + " ".join(vocabulary[j] for j in rng.integers(400, size=12))) for i in range(15)]


@pytest.mark.parametrize("seed", [0, 1])
def test_components_against_all_pairs(docs, seed):
    rows = [*near_copies(seed), *ODD]
    got = ngram_join.near_duplicates(docs(rows, extra=True), block_bytes=4000).collect()
    assert sorted(map(tuple, got), key=repr) == slow_components(rows)


def test_case_and_white_space_do_not_count(docs):
    rows = [(1, "A b c d e f"), (2, "a\tB  c\nd e F"), (3, "a b c d e f")]
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs(rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_join_of_an_empty_table(docs):
    assert ngram_join.near_duplicates(docs(ODD).limit(0)).count() == 0


def test_one_of_each(docs):
    rows = near_copies(3)
    df = docs(rows, extra=True)
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, _, c in slow_components(rows)})


def test_signatures_never_lose_a_link():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 1 << 50, size=40)
        b = np.unique(np.concatenate([a[rng.random(40) < 0.9], rng.integers(0, 1 << 50, size=3)]))
        bits = sum(int(x).bit_count() for x in (ngram_join._signature(np.unique(a)) ^ ngram_join._signature(b)).view(np.uint64))
        assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_connect(spark):
    n, rng = 60, np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, size=(45, 2)) if a != b] + [(i, i + 1) for i in range(40, 59)]
    labels = spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("comp"))
    got = {r.node: r.comp for r in components.connect(labels, spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == dict(enumerate(root))
    assert components.connect(labels, spark.createDataFrame([], "a long, b long")).count() == n


# Passages.


def slow_windows(x, least):
    out = set()
    for i in range(len(x)):
        for j in range(i + least - 1, len(x)):
            if 0 in x[i : j + 1]:
                break
            c = i + int(np.argmin(x[i : j + 1]))
            out.add((i, c, j))
    return out


def test_compact_windows_hold_every_run_once():
    rng = np.random.default_rng(0)
    for n, least in ((30, 4), (50, 7), (12, 12), (5, 9)):
        x = rng.integers(0, 9, size=n).astype(np.uint64)
        got = list(zip(*substring_dedup.compact_windows(x, least)))
        covered = [(i, int(c), j) for left, c, right in got for i in range(int(left), int(c) + 1) for j in range(max(int(c), i + least - 1), int(right) + 1)]
        assert len(covered) == len(set(covered)) and set(covered) == slow_windows(x, least)


def test_verify():
    a, b = np.arange(100), np.arange(100)
    assert substring_dedup.verify(a, b) == (0, 100)
    b = b.copy()
    b[:20] = b[90:] = -1
    b[50:55] = -2
    assert substring_dedup.verify(a, b) == (20, 90)
    b[30:60] = -3
    assert substring_dedup.verify(a, b) is None


def test_planted_passages(docs):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(5000, size=n))
    passage = text(55)
    rows = [(i, text(200)) for i in range(20)]
    rows += [(100 + i, f"{text(20 + i)} {passage} {text(30)}") for i in range(12)]
    rows += [(200, "short " * 10), *ODD[:7], (300, text(80)), (301, None)]
    rows += [(302, rows[-2][1]), (303, rows[-2][1].upper())]
    got = substring_dedup.passages(docs(rows, extra=True), block_bytes=9000).collect()
    assert {r.doc_id for r in got} == {*range(100, 112), 300, 302, 303}
    for r in got:
        w, p = words(dict(rows)[r.doc_id]), words(dict(rows)[r.partner_id])
        assert r.end - r.start >= 50 and w[r.start : r.start + 5] == p[r.partner_start : r.partner_start + 5]
        if r.doc_id < 200:
            assert abs(r.start - (20 + r.doc_id - 100)) <= 6 and r.end - r.start >= 50
    assert substring_dedup.passages(docs(rows).limit(0)).count() == 0


# Mixing.


def slow_targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(size.values()), {}
    while True:
        left, rest = total - sum(full.values()), [s for s in order if s not in full]
        target = full | {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s for s in rest if target[s] > 3 * size[s] + 1e-9}
        if not over:
            return target
        full |= {s: 3 * size[s] for s in over}


def mixture(seed=0):
    rng = np.random.default_rng(seed)
    sources = ["a", "b", "c", "d", "Z", None, "é"]
    return [(i, "w " * int(rng.integers(0, 40)), "en", sources[min(6, int(rng.geometric(0.35)) - 1)]) for i in range(300)] + [(1000, None, "en", "a"), (1001, "", None, "only empty"), (None, "x y", "en", "b"), (7, "q " * 5, "en", "b"), (7, "q " * 5, "en", "b")]


@pytest.mark.parametrize("block", [7, 1024])
def test_mix(docs, block):
    rows = mixture()
    got = mixing.mix(docs(rows, extra=True), block=block).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    target = slow_targets(size)
    near = lambda x: round(x, 6)
    want = sorted((repr(i), len(words(t)), size[s], near(target[s])) for i, t, _, s in rows)
    assert sorted((repr(r.doc_id), r.size, r.source_size, near(r.target)) for r in got) == want
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken.setdefault(near(r.target), []).append(r.taken)
    expect = {}
    for s in size:
        expect[near(target[s])] = expect.get(near(target[s]), 0) + target[s]
    assert all(abs(sum(v) - expect[k]) <= 4 for k, v in taken.items())
    again = mixing.mix(docs(rows[::-1]), block=block).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_without_words(docs):
    assert mixing.mix(docs(mixture()).limit(0)).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(docs([(1, None), (2, " ")])).collect()] == [(0.0, 0)] * 2


def test_mixed_documents(docs):
    rows = [(i, "w " * (5 + i % 7), "en", "abc"[i % 3]) for i in range(90)]
    df = docs(rows, extra=True)
    taken = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(df).collect()}
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    seen = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert seen == {i: n for i, n in taken.items() if n}


def test_schedule_is_spread_evenly(spark):
    plan = spark.createDataFrame([("a", 500), ("b", 300), ("c", 200), ("d", 1), ("e", 0)], "src string, slots long")
    got = mixing.schedule(plan).orderBy("slot").collect()
    assert {s: sum(r.src == s for r in got) for s in "abcde"} == {"a": 500, "b": 300, "c": 200, "d": 1, "e": 0}
    early = [r.src for r in got if r.slot is not None and r.slot < 100]
    assert abs(early.count("a") - 50) <= 3 and abs(early.count("b") - 30) <= 3
    for s in "abcd":
        assert sorted(r["rank"] for r in got if r.src == s) == list(range({"a": 500, "b": 300, "c": 200, "d": 1}[s]))


# Nearest neighbours.


def vectors(n=900, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "q": F.lit(0), "id": F.lit(2), "v": F.lit(3)})


def test_recall_and_scores(spark):
    x = vectors()
    got = ann.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, block_rows=300).collect()
    hits = 0
    for q in range(0, 900, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
        assert all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 180


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 1 << 16, size=(400, 4)).astype(np.uint16)
    code[:200] = code[0] ^ (rng.random((200, 4, 16)) < 0.2).dot(1 << np.arange(16)).astype(np.uint16)
    index = ann.MultiIndex(code)
    far = np.bitwise_count(code ^ code[0]).sum(1)
    for r in (0, 1, 5, 12, 13, 30, 64):
        rows, d = index.within(code[0], r)
        assert rows.tolist() == np.flatnonzero(far <= r).tolist() and d.tolist() == far[far <= r].tolist()


def test_bad_vectors_take_no_part(spark):
    rows = [(i, [1.0, float(i)]) for i in range(5)] + [(5, None), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [1.0, float("nan")]), (9, [1.0, float("inf")]), (10, [1.0]), (11, []), (None, [1.0, 1.0]), (4, [1.0, 4.0])]
    got = ann.search(frame(spark, rows), F.col("vec_id") % 5 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_ties_and_empty_tables(spark):
    same = [(i, [1.0, 2.0]) for i in range(6)]
    got = ann.search(frame(spark, same), F.col("vec_id") == 3, k=10).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4, 5] and {r.score for r in got} == {0.0}
    assert ann.search(frame(spark, same).limit(0), F.lit(True)).count() == 0


def test_windows_that_agree_meet_or_share_a_hub():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = 40
        group, doc = np.sort(rng.integers(3, size=n)), rng.integers(12, size=n).astype(np.uint64)
        order = np.lexsort((doc, group))
        group, doc = group[order], doc[order]
        tags = np.array([rng.integers(0, 256, size=10) for _ in range(4)])[rng.integers(4, size=n)]
        tags = np.where(rng.random((n, 10)) < 0.6, tags, rng.integers(0, 256, size=(n, 10))).astype(np.uint8)
        agree = (tags[:, None] == tags[None]) & (tags[:, None] > 0)
        met = {frozenset(p) for p in zip(*(x.tolist() for x in substring_dedup.further_rounds(group, doc, tags)), strict=True)}
        for a, b in combinations(range(n), 2):
            if group[a] != group[b] or doc[a] == doc[b] or (group == group[a]).sum() < 4 or not substring_dedup._ALLOWS[agree[a, b] @ (1 << np.arange(10))]:
                continue
            hubs = [h for h in range(n) if agree[a, h][agree[a, b]].all() and agree[b, h][agree[a, b]].all()]
            assert {a, b} in met or any(doc[h] in (doc[a], doc[b]) or ({a, h} in met and {b, h} in met) for h in hubs)


def test_passages_around_a_stock_sentence(docs):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(50000, size=n))
    stock = text(30)
    rows = [(i, f"{text(60)} {stock} {text(60)}") for i in range(150)]
    for i in range(16):
        passage = f"{text(10)} {stock} {text(10)}"
        rows += [(1000 + 2 * i + k, f"{text(40)} {passage} {text(40)}") for k in range(2)]
    got = substring_dedup.passages(docs(rows), block_bytes=9000).collect()
    assert {(r.doc_id, r.partner_id) for r in got} == {(1000 + i, 1000 + (i ^ 1)) for i in range(32)}


def test_every_passage_of_a_candidate(docs):
    a, b = np.arange(300), np.arange(300)
    b[:10] = b[70:120] = b[180:220] = -1
    assert substring_dedup.verify_all(a, b) == [(10, 70), (120, 180), (220, 300)]
    assert substring_dedup.verify_all(a, -a - 1) == []
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(50000, size=n))
    rows = []
    for i in range(10):
        one, two = text(50), text(50)
        rows += [(2 * i + k, f"{text(20)} {one} {text(30)} {two} {text(20)}") for k in range(2)]
    got = substring_dedup.passages(docs(rows)).collect()
    assert {(r.doc_id, r.start, r.end) for r in got} == {(i, s, s + 50) for i in range(20) for s in (20, 100)}


def test_links_of_passages_are_kept(docs):
    rng = np.random.default_rng(10)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(50000, size=n))
    passage = text(60)
    rows = [(i, f"{text(30)} {passage} {text(30)}") for i in range(30)]
    inner, one, two = text(60), text(220), text(220)
    rows += [(100 + k, f"{text(20)} {one} {inner} {one[::-1]} {text(20)}") for k in range(2)]
    rows += [(200 + k, f"{text(20)} {two} {inner} {two[::-1]} {text(20)}") for k in range(2)]
    got = substring_dedup.passages(docs(rows), block_bytes=9000).collect()
    spans = {(r.doc_id, r.partner_id) for r in got}
    assert spans == {(b, a) for a, b in spans}

    def reached(i):
        seen, todo = {i}, [i]
        while todo:
            todo += [b for a, b in spans if a == todo[0] and b not in seen]
            seen |= set(todo)
            todo.pop(0)
        return seen

    assert reached(7) == set(range(30))
    assert reached(100) == {100, 101, 200, 201}


def test_passages_with_words_inserted(docs):
    rng = np.random.default_rng(11)
    text = lambda n: [f"v{i}" for i in rng.integers(50000, size=n)]
    rows, words_of = [], {}
    for i, (length, more) in enumerate([(50, 1), (60, 1), (80, 1), (95, 1), (95, 4), (80, 10), (90, 12)] * 4):
        passage = text(length)
        edited = passage[: length // 2] + text(more) + passage[length // 2 :]
        words_of[2 * i], words_of[2 * i + 1] = length, length + more
        rows += [(2 * i + k, " ".join(text(30) + p + text(30))) for k, p in enumerate((passage, edited))]
    got = substring_dedup.passages(docs(rows), block_bytes=9000).collect()
    spans = {(r.doc_id, r.start, r.end, r.partner_id, r.partner_start, r.partner_end) for r in got}
    assert spans == {(i, 30, 30 + n, i ^ 1, 30, 30 + words_of[i ^ 1]) for i, n in words_of.items()}


def test_verify_near():
    rng = np.random.default_rng(3)
    p, q, r = (rng.integers(1 << 16, size=n) for n in (25, 25, 60))
    a, b = np.concatenate((p, q)), np.concatenate((p, [1, 2, 3], q))
    assert substring_dedup.verify_near(a, b, -20, 20) == [(0, 50, 0, 53)]
    assert substring_dedup.verify_near(b, a, -20, 20) == [(0, 53, 0, 50)]
    assert substring_dedup.verify_near(a, b, 0, 0) == []
    # 20 more of 50 leave less than 0.8; what has 46 by itself stays.
    assert substring_dedup.verify_near(a, np.concatenate((p, r[:20], q)), -20, 20) == []
    assert substring_dedup.verify_near(np.concatenate((r, p)), np.concatenate((r, q[:18], p)), -20, 20) in ([(0, 60, 0, 60)], [(0, 85, 0, 103)])


def test_near_shifts():
    rng = np.random.default_rng(4)
    for span in (10, 41, 200, 1000):
        x = np.sort(rng.integers(-span, span, size=25)).astype(np.int32)
        parts = substring_dedup.near_shifts(x)
        assert all(x[b - 1] - x[a] <= 2 * substring_dedup.BAND for a, b in parts)
        assert all(any(a <= i <= j < b for a, b in parts) for i in range(25) for j in range(i, 25) if x[j] - x[i] <= substring_dedup.BAND)


def test_verify_at_agrees_with_all_shifts():
    rng = np.random.default_rng(4)
    quick = 0
    for _ in range(400):
        n = int(rng.integers(46, 300))
        a = rng.integers(0, 1 << 16, n).astype(np.uint16)
        b = a.copy()
        for _ in range(int(rng.integers(0, 8))):  # five shingles differ where a word does
            at = int(rng.integers(0, n))
            b[at : at + 5] = rng.integers(0, 1 << 16, len(b[at : at + 5]))
        if rng.random() < 0.3:
            at = int(rng.integers(0, n))
            b = np.concatenate((b[:at], rng.integers(0, 1 << 16, 6).astype(np.uint16), b[at + 1 :]))
        left, right = (rng.integers(0, 1 << 16, int(rng.integers(0, 40))).astype(np.uint16) for _ in range(2))
        b = np.concatenate((left, b, right))
        shift = -len(left)
        want = substring_dedup.verify_near(a, b, shift - 20, shift + 20)
        got = substring_dedup.verify_at(a, b, shift, shift - 20, shift + 20)
        if got is not None:
            quick += 1
            assert got == want
    assert quick > 150


def test_local_copies_leave_one_window_of_each_kind():
    w = np.zeros(6, substring_dedup._WINDOW)
    w["q"], w["at"], w["c"], w["l"], w["r"] = [8, 8, 8, 8, 8, 16], [0, 0, 1, 2, 3, 3], [50, 90, 60, 70, 50, 9], [20, 60, 30, 40, 21, 0], [80, 120, 90, 100, 80, 60]
    w["s"][3] = 7
    copies, first = substring_dedup.local_copies(w)
    # The second window of document 0 stays, as do other tags, other extents and other groups.
    assert copies.tolist() == [2] and first.tolist() == [0]


def crowd(n, words, edits, plain, seed):
    """Documents that hold a passage of `words` words, each with `edits` other words of its own (one with none, if `plain`), in
    text that nothing shares; and the pairs whose passages are alike, of all."""
    rng = np.random.default_rng(seed)
    texts, at = [], []
    for k in range(n):
        passage = [f"p{seed}w{i}" for i in range(words)]
        for e in rng.choice(words, edits, replace=False) if k or not plain else ():
            passage[e] = f"x{seed}k{k}e{e}"
        before, after = ([f"r{seed}k{k}{s}{i}" for i in range(int(rng.integers(5, 60)))] for s in "ab")
        texts.append(" ".join(before + passage + after))
        at.append(len(before))
    seqs = [substring_dedup.shingle_sequence(t)[max(0, a - 4) : a + words] for t, a in zip(texts, at, strict=True)]
    return texts, [(i, j) for i in range(n) for j in range(i) if len(seqs[i]) == len(seqs[j]) and substring_dedup.verify(seqs[i], seqs[j])]


def test_crowds_of_edited_copies_are_linked(docs):
    """Of the pairs that are alike, all but a few are in one component, also where no member is alike to all."""
    rows, pairs = [], []
    for seed, kind in enumerate([(40, 50, 1, False), (200, 50, 1, False), (400, 50, 1, False), (200, 50, 1, True), (200, 70, 3, False), (200, 100, 3, False)]):
        texts, alike = crowd(*kind, seed)
        pairs.append([(len(rows) + i, len(rows) + j) for i, j in alike])
        rows += list(enumerate(texts, len(rows)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in substring_dedup.passages(docs(rows)).collect():
        parent[root(r.doc_id)] = root(r.partner_id)
    for alike in pairs:
        assert sum(root(i) == root(j) for i, j in alike) >= 0.95 * len(alike)


def test_members_of_a_large_hub_are_all_compared():
    """900 members that failed at their hub: twins far apart in any order of places are linked, as by all pairs."""
    rng = np.random.default_rng(4)
    hub = rng.integers(0, 1 << 16, 90).astype(np.uint16)
    rows = []
    for doc in range(450):
        seq = hub.copy()
        at = rng.permutation(90)[:40]
        seq[at] = rng.integers(0, 1 << 16, 40)
        twin = seq.copy()
        twin[rng.permutation(90)[:5]] = 7  # differs from its hub at other places than its twin
        rows += [(doc, 3, 10 + doc % 5, False, seq.tobytes(), doc % 2), (10_000 - doc, 0, 2, False, np.concatenate((hub[:3], twin)).tobytes(), (doc // 2) % 2)]
    t = pa.table({k: pa.array(c, kind) for (k, kind), c in zip((("doc_id", pa.int64()), ("lo", pa.int32()), ("moved", pa.int32()), ("passed", pa.bool_()), ("seq", pa.binary()), ("side", pa.int32())), zip(*rows), strict=True)})
    sides = [t.filter(pc.equal(t["side"], k)) for k in (0, 1)]
    whole = [x for k in (0, 1) for x in substring_dedup.crowd_links(sides[k].set_column(5, "side", pa.array([0] * len(sides[k]), pa.int32())), True)]
    found = {(r[0], r[3]) for r in whole + substring_dedup.crowd_links(t, False)}
    assert found == {(doc, 10_000 - doc) for doc in range(450)}
    for a, start, end, b, pstart, pend in whole:
        assert end - start == pend - pstart >= 50 and start - (10 + a % 5) == pstart - (2 + 3)


def plain_longest(hit, same=0.8, least=46):
    gain = np.concatenate(([0], np.cumsum(hit))) - same * np.arange(len(hit) + 1)
    at = np.flatnonzero(hit)
    pairs = [(t - s, -s, int(s), int(t)) for s in at for t in at + 1 if t - s >= least and gain[t] >= gain[s] - 1e-9]
    return max(pairs)[2:] if pairs else None


def test_longest_stretch_against_all():
    rng = np.random.default_rng(8)
    for _ in range(150):
        hit = rng.random(int(rng.integers(40, 130))) < rng.choice([0.6, 0.78, 0.82, 0.95])
        a = np.where(hit, 0, 1)
        assert substring_dedup.verify(a, np.zeros(len(a), int)) == plain_longest(hit)


def test_stretches_of_many_meetings():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        m = np.zeros(n, substring_dedup._MEETING)
        m["j"], m["l"] = rng.integers(0, substring_dedup.K, n), rng.integers(0, 300, n)
        m["r"] = m["l"] + rng.integers(1, 120, n)
        depth = sum((np.array([((x >= m["l"]) & (x < m["r"]) & (m["j"] == j)).any() for x in range(500)]).astype(int) for j in range(substring_dedup.K)))
        edges = np.flatnonzero(np.diff(depth >= 2, prepend=False))
        assert substring_dedup.stretches(m) == [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= 46]


def test_text_that_repeats_itself_is_verified_fast():
    """A line of 7 words over and over agrees at every seventh shift; the unit of time is one comparison of all shifts."""
    rng = np.random.default_rng(10)
    pairs = []
    for _ in range(60):
        line = rng.integers(0, 1 << 16, 7)
        a, b = (np.where(rng.random(140) < 0.1, rng.integers(0, 1 << 16, 140), np.tile(line, 20)).astype(np.uint16) for _ in range(2))
        pairs.append((a, b))

    def once(f):
        began = time.process_time()
        for a, b in pairs:
            f(a, b)
        return time.process_time() - began

    unit = min(once(lambda a, b: [(a[:, None] == b).sum(1) for _ in range(4)]) for _ in range(5))
    took = min(once(lambda a, b: substring_dedup.verify_near(a, b, -40, 40)) for _ in range(5))
    print(took / unit)
    assert took < 7 * unit
