import math

import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from echoframe.llm import bpe
from tests.llm.test_joins import near_copies, shingle_set


def rows():
    out = [(i, t, "en", "abc"[i % 3]) for i, t in near_copies(7)]
    out += [(2000 + i, "Exactly the same words in every copy of this text", "en", "a") for i in range(9)]
    return out + [(3000, None, "en", "a"), (3001, "12 34", "en", "b"), (3002, "", None, None), (3003, "A clean text of its own without a source", "en", None)]


def slow_stages(data):
    """ids that are left after language ID, exact and near dedup."""
    left = [r for r in data if r[1] and any(map(str.isalpha, r[1]))]
    last = {}
    for r in left:
        last[r[1]] = max(r[0], last.get(r[1], r[0]))
    left = [r for r in left if last[r[1]] == r[0]]
    sets, root = {r[0]: shingle_set(r[1]) for r in left}, {r[0]: r[0] for r in left}
    for _ in range(len(left)):
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i for i, r in root.items() if i == r}


@pytest.fixture(scope="module")
def stages(docs, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipe"))
    docs(rows()).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out, df = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, df, folder).write.parquet(f"{folder}/{k}")
        df = out[name] = spark.read.parquet(f"{folder}/{k}")
    return folder, list(out.values())


def test_filters_against_brute_force(stages):
    _, out = stages
    assert {r.doc_id for r in out[0].collect()} == {r[0] for r in rows()} - {3000, 3001, 3002}
    assert sorted(r.doc_id for r in out[2].collect()) == sorted(slow_stages(rows()))
    assert all(o.columns == ["doc_id", "text", "lang", "source", "n_chars"] for o in out[:4])


def test_mixed_and_encoded(stages):
    _, out = stages
    before = {r.doc_id: r.text for r in out[2].collect()}
    mixed = [r.doc_id for r in out[3].collect()]
    assert set(mixed) <= set(before) and max(map(mixed.count, set(mixed))) <= 3
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    final = out[4].collect()
    assert sorted(r.doc_id for r in final) == sorted(mixed)
    for r in final:
        assert r.ids == lib.encode(before[r.doc_id], add_special_tokens=False).ids


def test_run_is_registered_and_agrees(stages, spark):
    folder, out = stages
    got = entry.queries()["pipeline"](spark, folder)
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(r.ids_sha256 for r in out[4].collect())


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and math.isfinite(len(names)) and bpe.MEMO
