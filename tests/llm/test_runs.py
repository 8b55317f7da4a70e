"""Periodic runs against every period tried at every place."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from surfparc.llm import runs
from surfparc.llm.runs import op13_periodic_runs
from tests.llm.helpers import ODD, documents


def brute(words: list) -> list[tuple[int, int, int]]:
    """All runs (start, length, period): for each period the maximal stretches of words equal to the one a period on."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted((s, n, q) for s, n, q in out)


def expected(key, text) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *top, digest(b"".join(b"%d,%d,%d\n" % r for r in found)), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequences():
    rng = random.Random(3)
    fib = ["a", "ab"]
    while len(fib[-1]) < 250:
        fib.append(fib[-1] + fib[-2])
    yield from ([*"a" * 11], [*"a" * 12], [*"a" * 400], [*fib[-1]], [*"ab" * 50, *"abc" * 30, *"b" * 20], [])
    for size in (1, 2, 3, 5, 30):
        for _ in range(30):
            yield [rng.randrange(size) for _ in range(rng.randrange(0, 160))]
    for _ in range(60):
        word = []
        while len(word) < 150:
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
            word += unit * rng.randrange(1, 6) + [rng.randrange(50) for _ in range(rng.randrange(0, 6))]
        yield word


def test_runs_equal_brute_force():
    every = list(sequences())
    for words in every:
        got = runs.runs_of(np.array(words if not words or isinstance(words[0], int) else [ord(c) for c in words], np.int64), np.zeros(len(words), np.int64))
        assert [(s, e - s, p) for s, e, p in got] == brute(words)


def test_texts_side_by_side_share_a_grammar_but_no_run():
    every = [[ord(c) if isinstance(c, str) else c for c in w] for w in sequences()]
    text, part = np.array([c for w in every for c in w], np.int64), np.array([k for k, w in enumerate(every) for _ in w], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in every])])
    want = [(int(starts[k]) + s, int(starts[k]) + s + n, q) for k, w in enumerate(every) for s, n, q in brute(w)]
    assert sorted(runs.runs_of(text, part)) == sorted(want)


def test_long_periodic_texts_take_few_steps():
    for unit in (1, 7, 1000):
        text = np.resize(np.arange(unit), 200_000).astype(np.int64)
        assert runs.runs_of(text, np.zeros(len(text), np.int64)) == [(0, 200_000, unit)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [*ODD, "x " * 30, "la  la\tla\n" * 9, "Ünï côdé " * 20, "one two three " * 3 + "one two three"]
    for _ in range(120):
        line = " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 15)))
        out.append("\n".join([line] * rng.randrange(1, 4) + [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 60)))]))
    out.append(" ".join(f"v{rng.randrange(30_000)}" for _ in range(1500)) + " und so weiter" * 20)
    return out


def test_query_equals_brute_force(spark, texts, tmp_path):
    ids = [*range(len(texts)), None, 3, 3]
    texts = [*texts, "so la " * 12, texts[8], texts[8]]
    documents(spark, texts, ids).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op13_periodic_runs(spark, str(tmp_path))
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in rows.collect()), key=key) == sorted((expected(k, t) for k, t in zip(ids, texts, strict=True)), key=key)


def test_operator_keeps_keys_and_takes_empty_tables(spark, texts):
    docs = documents(spark, texts)
    found = runs.periodic_runs(docs, ["source", "doc_id"])
    assert found.columns == ["source", "doc_id", "n_words", "runs", "collapsed"]
    row = found.filter("doc_id = 8").first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (30, [(0, 30, 1)], "x")
    assert runs.periodic_runs(docs.limit(0), ["doc_id"]).collect() == []
