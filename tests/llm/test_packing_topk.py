import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from surfparc.llm import packing, topk
from surfparc.llm.topk import top_k
from tests.llm.helpers import ODD, documents, sentence


def test_pieces_hold_every_id_once_and_sequences_fill(spark):
    rng = random.Random(6)
    t = [sentence(rng, rng.choice([1, 7, 60, 400])) for _ in range(40)] + [sentence(rng, 6000), "it's I'LL ISN'T 3.14 ½ İstanbul ΑΣ é <|endoftext|> x<|startoftext|>y <|end", "a\x1cb c　d\x85e", *ODD, None, sentence(random.Random(6), 9)]
    ids = [*range(len(t) - 2), None, 3]
    rows = packing.pack_documents(documents(spark, t, ids)).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(coder.encode(x or "", add_special_tokens=False).ids + [2] for x in t)
    docs = {}
    for r in sorted(rows, key=lambda r: r.start):
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    flat = sorted(int(x) for w in want for x in w)
    assert sorted(int(x) for r in rows for x in np.frombuffer(r.ids, "<u4")) == flat
    for k, x in list(zip(ids, t, strict=True))[:40]:
        if ids.count(k) == 1:
            own = coder.encode(x or "", add_special_tokens=False).ids + [2]
            assert [int(i) for r in docs[k, len(own)] for i in np.frombuffer(r.ids, "<u4")] == own
    seqs = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at == s[0].sequence_length and at & (at - 1) == 0 and at <= 4096
    assert sum(1 for s in seqs.values() if s[0].sequence_length == 4096) == sum(r.length for r in rows) // 4096 or len(seqs) < 60


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(monkeypatch, name):
    """Both public tokenizers, with ample memory for words and with none; every kind of odd stretch."""
    path = public_tokenizers.path(name)
    coder = Tokenizer.from_file(path)
    rng = random.Random(1)
    odd = ["<|endoftext|>", "a<|endoftext|>b", "<|x", "İstanbul", "ΑΣ", "½", "日本語", "a\x1cb", "d\x85e", "c\u3000d", "e\u0301", "ªº", "µ", "\u00a0", "it's", "I'LL'd", "''s", "3.14", "_x_", "ÀÉ", "ß×÷"]
    texts = [*[t or "" for t in ODD], "never seen zqx zqx!! words", *[f"x{o}y {o} {o}{o}" for o in odd]]
    texts += [" ".join(rng.choice([*odd, sentence(rng, 2), "\n", "\t "]) for _ in range(30)) for _ in range(40)]
    want = [coder.encode(t, add_special_tokens=False).ids for t in texts]
    for cached in (packing.CACHED, 0, 3):
        monkeypatch.setattr(packing, "CACHED", cached)
        encode = packing.encoder(path)
        for _ in range(2):
            assert [np.frombuffer(g, "<u4").tolist() for g in encode([t.encode() for t in texts])] == want


def test_other_rules_are_not_taken_for_the_known_ones():
    rules = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    assert packing.lower_case_words(rules).findall("it's 42 ünd, so!") == ["it", "'s", "4", "2", "ünd", ",", "so", "!"]
    assert packing.lower_case_words(rules | {"normalizer": None}) is None
    assert packing.lower_case_words(json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))) is None


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_crc_of_ids(spark, tmp_path):
    documents(spark, ["hello there", None]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op7_packing(spark, str(tmp_path)).collect()
    assert {r.ids_crc32 for r in rows if r.doc_id == 1} == {zlib.crc32(np.array([2], "<u4").tobytes())}


def brute_top_k(rows, k=5):
    """(query id, rank, id, score) of all rows; ``rows`` holds ids and vectors."""
    real = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    wide = max((len(v) for _, v in real), default=0)
    real = [(i, np.pad(v, (0, wide - len(v)))) for i, v in real]
    out = []
    for own, (q, v) in enumerate(real):
        if q % 50 == 0:
            best = sorted((-int(v @ x), i) for n, (i, x) in enumerate(real) if n != own)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found_top_k(spark, rows):
    data = spark.createDataFrame([(i, e, 0, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, norm int, block int, home int")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(data, data.filter("vec_id % 50 = 0")).collect())


def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 12)).astype(np.float32)
    v[50:120] = v[50]
    v[200:] += 6 * rng.normal(size=(8, 12))[rng.integers(8, size=200)].astype(np.float32)
    rows = [(k, [float(x) for x in e]) for k, e in enumerate(v)]
    rows += [(1000, None), (1050, [None] + [0.0] * 11), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, [9.0] * 12), (1200, [1.0] * 5), rows[3]]
    want = brute_top_k(rows)
    assert found_top_k(spark, rows) == want
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "STRIPE", 2)
    assert found_top_k(spark, rows) == want


def test_top_k_keeps_every_row_of_a_repeated_id(spark):
    one, two = [0.5, 0.0], [0.9, 0.1]
    rows = [(0, [1.0, 1.0]), (1, one), (1, two), (1, two), (2, [0.1, 0.1]), (50, one), (50, one), (50, two), (3, [-1.0, -2.0])]
    assert found_top_k(spark, rows) == brute_top_k(rows)


def test_top_k_of_one_vector_many_times(spark):
    rows = [(50, [1.0, 2.0])] * 9 + [(7, [1.0, 2.0])] * 8 + [(1, [0.0, 0.0]), (100, [-1.0, 0.5])]
    assert found_top_k(spark, rows) == brute_top_k(rows)


def test_distant_cells_are_left_out():
    q = topk.Vectors(pa.table({"id": [1], "n": [1], "norm": [100], "v": [[10, 0]], "far": [[0.0, 1000.0]]}), 2)
    cells = {0: (9, 100, np.array([0.0, 990.0]), np.array([5.0, 1010.0])), 1: (9, 10**6, np.array([1000.0, 0.0]), np.array([1100.0, 5.0]))}
    assert topk.reached_cells(q, np.array([40]), cells) == [[0, 1]]
    cells[1] = (9, 10**6, np.array([2000.0, 0.0]), np.array([2100.0, 5.0]))
    assert topk.reached_cells(q, np.array([90]), cells) == [[0]]
    assert topk.reached_cells(q, np.array([topk.LOWEST]), cells) == [[0, 1]]


def test_top_k_of_few_rows(spark):
    data = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(data, data.filter("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]
    assert top_k(data.limit(0), data.limit(0)).count() == 0
