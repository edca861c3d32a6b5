import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echoframe.llm import filter_audit, followups, packing
from tests.llm.conftest import ODD

MODEL = P.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


# Packing.


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(MODEL)


def test_ids_are_the_librarys(encoder):
    signs = [chr(c) for c in (*range(1, 0x370), *range(0x2000, 0x2070), 0x3042, 0x4E2D, 0x1F600, 0x1ACA)]
    texts = [t for c in signs for t in (c, f"a{c}b", f"a {c} b", f"1{c}2 {c}{c}.", f"  {c}  \n {c}", f"it's{c}'re", f"\n {c}\n\n {c}", f"a {c}'s {c} ")]
    texts += ["", " ", "a ", "a  ", "x<|endoftext|>y <|endoftext|>", "<|endoftext|", "word " * 500, "q" * 3000]
    random.seed(1)
    texts += ["".join(random.choices(" \n\tabcdé'.,12", k=40)) for _ in range(500)]
    got = encoder.encode(texts)
    assert got == [encoder.whole(t) for t in texts]
    assert encoder.encode([]) == []


def test_memo_of_stretches_may_be_full(encoder, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    small = packing.Encoder(MODEL)
    for text in ("aa bb cc", "dd aa bb ee aa ", "cc dd ee", " aa"):
        assert small.encode([text, text]) == [encoder.whole(text)] * 2


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


@pytest.mark.parametrize("counts", [{}, {1024: 3}, {1: 5}, {512: 7}, {341: 9, 342: 2}, {600: 5, 424: 2, 212: 7}, {1023: 4, 1: 2}, {700: 10}])
def test_plans_use_every_piece_once(counts):
    plan = packing.plan(counts)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 1024 and times > 0
        used.update({n: m * times for n, m in Counter(pattern).items()})
    assert used == Counter(counts)


def test_plans_against_the_fewest_sequences():
    def fewest(pieces, size):
        best = len(pieces)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(pieces):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + pieces[k] <= size and bins[b] not in bins[:b]:
                    go(k + 1, [*bins[:b], bins[b] + pieces[k], *bins[b + 1 :]])
            go(k + 1, [*bins, pieces[k]])

        go(0, [])
        return best

    random.seed(3)
    for _ in range(60):
        pieces = sorted(random.choices(range(1, 13), k=8), reverse=True)
        got = sum(t for _, t in packing.plan(Counter(pieces), 12))
        assert fewest(pieces, 12) <= got <= fewest(pieces, 12) + 1
    many = Counter(np.random.default_rng(0).integers(1, 1024, 50000).tolist())
    assert sum(t for _, t in packing.plan(many)) <= 1.01 * sum(n * c for n, c in many.items()) / 1024


def packed(rows):
    """Sequences without gaps, none over 1024, and as many rows as pieces."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_pieces_against_the_library(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 3)
    data = [*ODD, (9, "é ü 漢字 <|endoftext|> x"), (10, "long text, " * 9000), *((100 + i, "same text") for i in range(40))]
    rows = packing.pack(docs(data, extra=True), MODEL).collect()
    lib = Tokenizer.from_file(MODEL)
    want = Counter()
    for doc_id, text in data:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            want[doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert -(-total // 1024) <= packed(rows) <= -(-total // 1024) + 1
    again = packing.pack(docs(data), MODEL).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert packing.pack(docs([]), MODEL).collect() == []


def test_packing_of_the_given_documents(spark):
    rows = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet"), MODEL).collect()
    assert packed(rows) <= 1.05 * sum(r.length for r in rows) / 1024 + 1


# Follow-up alerts.

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
DAY = datetime(2024, 1, 1)


def slow_alerts(clicks, sales):
    """The rules, one event at a time; times as datetimes."""
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)

    def batch(arrived, key):
        hours = (us(arrived or DAY) - us(DAY)) // followups.HOUR
        return max(0, min(7, math.floor((hours + (0 if key is None else 80 * (zlib.crc32(str(key).encode()) % 4))) * 8 / 3648)))

    found = [(batch(r[2], r[0]), us(r[1]), 0, r[3]) for r in set(clicks) if r[4] == "error" and r[1] and r[3] is not None]
    found += [(batch(r[5], r[0]), us(r[4]), 1, r[1]) for r in sales if r[4] and r[1] is not None]
    marks, top = [], None
    for b in range(9):
        marks.append(-math.inf if top is None else top - 96 * followups.HOUR)
        top = max([*([] if top is None else [top]), *(e[1] for e in found if e[0] == b)], default=None)
    late = Counter((b, c) for b, t, _, c in found if t < marks[b])
    out = [(b, c, -1, -1, n) for (b, c), n in late.items()]
    for client in {e[3] for e in found}:
        open_, n = None, 0

        def tell():
            due = open_ + 24 * followups.HOUR
            out.append((next((b for b in range(8) if marks[b] > due), 8), client, open_, due, n))

        for t, kind in sorted((t, k) for b, t, k, c in found if c == client and t >= marks[b]):
            if open_ is not None and t > open_ + 24 * followups.HOUR:
                tell()
                open_ = None
            if kind == 1:
                open_ = None
            elif open_ is None:
                open_, n = t, 1
            else:
                n += 1
        if open_ is not None:
            tell()
    return sorted(out)


def tuples(df):
    return sorted(map(tuple, df.select("batch", "client_id", "opened_us", "due_us", "n_rows").collect()))


def test_alerts_against_the_rules(spark):
    random.seed(5)
    clicks, sales = [], []
    for i in range(300):
        at = DAY + timedelta(seconds=random.randrange(0, 86400 * 150), microseconds=random.choice([0, 1, 999999]))
        arrived = at + timedelta(hours=random.choice([0, 1, 50, 200, 400]))
        clicks.append((i, at, arrived, random.choice([1, 2, 3, 2**53 + 1, -1, None]), random.choice(["error", "error", "view", None]), 1.0, None))
    for i in range(200):
        near = random.choice(clicks)
        at = near[1] + timedelta(hours=random.choice([0, 1, 24, 25]), microseconds=random.choice([0, 0, 1]))
        sales.append((i, near[3], None, 1.0, at, at + timedelta(hours=random.choice([0, 30, 300])), 1))
    clicks += clicks[:40]  # equal rows count once
    clicks += [(900, None, DAY, 1, "error", 1.0, None), (901, DAY, None, 1, "error", None, None), (None, DAY, DAY, 1, "error", 1.0, "{}"), (902, DAY, DAY - timedelta(days=9), 0, "error", 1.0, None)]
    sales += sales[:20] + [(None, 1, None, None, DAY, None, None), (903, 1, None, None, None, DAY, None)]
    got = followups.alerts(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES).withColumn("us", F.lit(1)).withColumn("kind", F.lit("error")))
    assert tuples(got) == slow_alerts(clicks, sales)
    assert dict(got.dtypes) == {"batch": "int", "client_id": "bigint", "opened_us": "bigint", "due_us": "bigint", "n_rows": "bigint"}


def test_alerts_of_clients_that_share_shards(spark, monkeypatch):
    """A key of the state holds several clients: ids of either sign, late events, and obligations that batches carry on."""
    monkeypatch.setattr(followups, "SHARD", 20)
    random.seed(6)
    clicks, sales = [], []
    for i in range(400):
        at = DAY + timedelta(seconds=random.randrange(0, 86400 * 150))
        clicks.append((i, at, at + timedelta(hours=random.choice([0, 1, 200, 900])), random.randrange(-30, 30), "error", 1.0, None))
        sales.append((i, clicks[-1][3] + random.choice([0, 0, 1]), None, 1.0, at + timedelta(hours=random.choice([1, 25])), at + timedelta(hours=300), 1))
    calls = spark.sparkContext.accumulator(0)
    drain = followups.FollowUps.handleInputRows

    class Counted(followups.FollowUps):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from drain(self, key, rows, timerValues)

    monkeypatch.setattr(followups, "FollowUps", Counted)
    got = tuples(followups.alerts(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES)))
    assert got == slow_alerts(clicks, sales)
    assert 9 <= calls.value <= 9 * 10, "a call for each shard and batch, not for each client"


def test_alerts_of_empty_tables(spark):
    assert followups.alerts(spark.createDataFrame([], CLICKS), spark.createDataFrame([], SALES)).collect() == []


def test_settle():
    opened = 10
    due = opened + followups.OPEN
    event = lambda us, kind: 2 * us + kind
    assert followups.settle(None, [event(opened, 0), event(due, 0)], due) == ((opened, 2), [])
    assert followups.settle(None, [event(opened, 0)], due + 1) == (None, [(opened, due, 1)])
    assert followups.settle((opened, 1), [event(due, 1)], math.inf) == (None, [])
    assert followups.settle((opened, 1), [event(due + 1, 0)], due + 2) == ((due + 1, 1), [(opened, due, 1)])


# Filter audit.


def slow_audit(docs, labels):
    def fails(doc_id, text):
        words = [w for w in text.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
        small = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, *_ in docs)
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": small}

    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = [(i, p or "", fails(i, t or "")) for i, t, p, _ in docs]
    out = {}
    for part in {p for _, p, _ in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [(i, f) for i, p, f in rows if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                here = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                single = [1 for _, p, f in rows if p == part and f[x] and sum(f.values()) == 1]
                out[part, "".join(order), step] = [len(left), len(here), sum(f[x] for _, f in gone), len(single), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
                gone += here
    for part, order, step in out:
        out[part, order, step].append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_the_rules(spark, docs):
    words = " ".join(f"w{i}" for i in range(120))
    data = [(i, t, "en" if (i or 0) % 2 else None, "s") for i, t in ODD]
    data += [(20, words, "de", "s"), (21, words, "de", "s"), (22, words + " #", "de", "s"), (23, words.upper(), "de", None), (24, "w " * 200, "de", "s"), (25, words + " x\x1fy\x85z", "de", "s")]
    data += [(i, words, "fr", "s") for i in range(30, 60)] + [(30, words, "fr", "s"), (31, "CAPS $ " * 30, "", "s")]
    labels = [(20, 1, 0), (21, 1, 1), (21, 0, None), (30, 1, 0), (45, 0, 1), (None, 1, 1), (24, None, None), (999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(3))
    got = filter_audit.audit(docs(data, extra=True), table)
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got.collect()} == slow_audit(data, labels)
    assert got.count() == 600 * len({d[2] or "" for d in data})


def test_audit_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs([]), none).collect() == []
    assert filter_audit.audit(docs([(1, "a")]), none).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = filter_audit.audit(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")))
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {columns} from ({filter_audit.SQL})").fetchall())
