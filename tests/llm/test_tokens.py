import hashlib
import random

import pytest
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from echoframe.llm import bpe, token_counts as tc
from tests.llm.conftest import ODD

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


def strings(n=1500, seed=0):
    r = random.Random(seed)
    letters = list(" ▁  aebnthionr\n\t.,'09-éß²☃")
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return out + [" " * i + x for i in range(40) for x in ("", "a", "hello")] + ["a" * 6000, "ab" * 3001, "\0a\0", "<s></s><unk> <0x0A>", "x<|endoftext|>y", "ΑΣ ΑΣΣ İI", "I'm we'RE"]


@pytest.fixture(scope="module")
def counter():
    return tc.Transducer(tc.load_pieces(PIECES))


def test_counts_equal_the_library(counter):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for s in strings():
        assert counter(s) == len(lib.encode(s)), repr(s)


def test_block_maps_and_their_scan(counter):
    start = counter.states[counter.START]
    for text in ("▁internationalization" * 3, "▁" + "aaaaabab" * 9):
        for k in (1, 5, 17):
            blocks = [text[i : i + k] for i in range(0, len(text), k)]
            maps = [tc.BlockMap(counter, blocks, i, i + 1, counter.block_map(blocks[i - 1][-6:] if i else "", b)) for i, b in enumerate(blocks)]
            scanned = tc.inclusive_scan(maps)
            for i, m in enumerate(scanned):
                assert m(start) == counter.image(start, "".join(blocks[: i + 1]))
            left, right = maps[0].then(maps[1]).then(maps[2]), maps[0].then(maps[1].then(maps[2]))
            assert left(start) == right(start)


def test_long_chunks_hold_few_states(monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(3)
    monkeypatch.setattr(tc, "STATES", 3000)
    c = tc.Transducer(tc.load_pieces(PIECES))
    for text in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "ab" * 20_000, "etaoin" * 5000 + "x"):
        assert c(text) == len(lib.encode(text))
    assert len(c.states) < 3000 + 5 * tc.BLOCK


def test_pieces_with_inner_marks_are_refused():
    with pytest.raises(ValueError):
        tc.Transducer({"a": 0.0, "a▁b": -1.0})


def test_token_count_rows(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(tc.count_tokens(docs(ODD, extra=True), PIECES, limit=100).collect(), key=repr)
    want = sorted([(i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 100) for i, t in ODD], key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tc.count_tokens(docs(ODD).limit(0), PIECES).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_spec(WORDS))


def test_ids_and_decoding_equal_the_library(codec):
    lib = Tokenizer.from_file(WORDS)
    for s in strings(seed=1):
        want = lib.encode(s, add_special_tokens=False).ids
        assert codec.encode(s) == want, repr(s)
        assert codec.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_stale_entries_are_skipped(codec):
    lib = Tokenizer.from_file(WORDS)
    for w in ("aaaaaaaaaaaaaaaa", "thethethethe", "abababababab"):
        assert list(codec.merge(w)) == lib.encode(w, add_special_tokens=False).ids


def test_letters_that_are_younger_than_the_library():
    lib, codec = Tokenizer.from_file(WORDS), bpe.Codec(bpe.load_spec(WORDS))
    points = [int(x, 16) for r in bpe.YOUNG for x in r.split("-")] + [x for a, b, _ in bpe.CAPITALS for x in (a, b)] + list(range(0x80, 0x3000, 7))
    for c in map(chr, points):
        s = f"a{c}a {c}{c} 1{c}"
        assert codec.encode(s) == lib.encode(s, add_special_tokens=False).ids, repr(s)


def test_order_of_marks_that_are_younger_than_the_library(codec):
    import unicodedata

    lib = Tokenizer.from_file(WORDS)
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    young = [m for m in marks if codec.marks.match(m)]
    one_each = {unicodedata.combining(m): m for m in marks if m not in young}.values()
    texts = [t for y in young for m in one_each for t in (f"x{y}{m}", f"x{m}{y}", f"e{m}{y}\u0323{m}\u0301")]
    texts += ["\u1ac6\u1aba", "\u0486\u1715", "\u08db\u0d3c", "\u0747\u1aca", "\u0ec8\u0eba", "\U00011935\U00011930", "\U00011938"]
    random.seed(2)
    texts += ["".join(random.choices([*marks, "a", "e"], k=8)) for _ in range(3000)]
    texts += ["".join(random.choices([chr(c) for c in (*range(0xE00, 0xEE0), 0x300, 0x323)], k=12)) for _ in range(3000)]
    wrong = [t for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True) if codec.encode(t) != e.ids]
    assert not wrong


def test_memo_holds_two_generations():
    calls = []
    m = bpe.Memo(lambda k: calls.append(k) or k.upper(), 3)
    assert [m[k] for k in "abcdab"] == list("ABCDAB") and calls == list("abcd")
    assert m["x" * 100] == "X" * 100 and "x" * 100 not in m and len(m) <= 3


def test_bpe_rows(spark, docs):
    lib = Tokenizer.from_file(WORDS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = bpe.encode(docs(ODD, extra=True), WORDS, with_ids=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode(docs(ODD).limit(0), WORDS).count() == 0


def test_what_is_known_of_tokens_outlives_the_states(monkeypatch):
    from echoframe.llm import token_counts

    pieces = {c: 0.0 for c in "▁abc"} | {"ab": -1.0, "bc": -2.0, "abc": -3.0, "▁a": -4.0}
    whole, small = token_counts.Transducer(pieces), token_counts.Transducer(pieces)
    texts = ["abc ab", "cab bca", "aabbcc abcabc", "b c a bc"] * 2
    want = [whole(t) for t in texts]
    monkeypatch.setattr(token_counts, "STATES", 2)
    assert [small(t) for t in texts] == want
    small.chunks.clear()
    known = dict(small.fits)
    small.forget()
    assert len(small.states) == 1 and small.fits == known != {}
    assert [small(t) for t in texts] == want
