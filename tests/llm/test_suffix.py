import hashlib
import os
import random
from collections import Counter

import pytest

from surfparc.llm.deepshallow import deep_shallow
from surfparc.llm.suffix import op1_suffix_dedup, remove_repeats
from tests.llm.helpers import ODD, documents, sentence


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + span] for b in data for k in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = [True] * span
        runs = [k for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])]
        out.append((len(b), sum(gone), len(runs), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def test_deep_shallow_sorts_with_common_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        bases = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(60))) for _ in range(4)]
        strings = [rng.choice(bases)[: rng.randrange(61)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(40))]
        order, shared = deep_shallow(strings)
        assert [strings[k] for k in order] == sorted(strings)
        assert [len(os.path.commonprefix([strings[order[k - 1]], strings[order[k]]])) for k in range(1, len(order))] == shared[1:].tolist()


def texts():
    rng = random.Random(5)
    shared = [sentence(rng, n) for n in (8, 14, 30)]
    out = [sentence(rng, rng.randrange(5, 40)) + rng.choice(shared) + sentence(rng, rng.randrange(30)) for _ in range(40)]
    near = sentence(rng, 60).split()
    for _ in range(12):
        w = list(near)
        w[rng.randrange(60)] = "x"
        out.append(" ".join(w))
    return [*out, "ab" * 200, "ab" * 150 + "c", "é" * 90, out[0], out[0], "tail " + out[1], *ODD, None, ""]


@pytest.mark.parametrize("group", [2, 2000])
def test_removed_bytes_match_brute_force(spark, group):
    t = texts()
    rows = remove_repeats(documents(spark, t), ["doc_id", "n_chars"], span=60, gram=24, group=group).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(t)
    for k, (n, gone, runs, kept) in enumerate(brute(t, 60)):
        spans = got[k].spans or []
        assert (got[k].n_bytes, sum(s.end - s.start for s in spans), len(spans)) == (n, gone, runs), k
        assert (got[k].kept if got[k].kept is not None else (t[k] or "").encode()) == kept


def test_whole_characters_and_null_and_repeated_keys(spark):
    t = ["é" * 80 + "x", "yy" + "é" * 80, "short", "short"]
    rows = remove_repeats(documents(spark, t, [None, None, 7, 7]), ["doc_id"], span=31, gram=8, whole_characters=True).collect()
    assert len(rows) == 4
    for r in rows:
        if r.kept is not None:
            bytes(r.kept).decode()


def test_empty_table(spark):
    assert remove_repeats(documents(spark, []), ["doc_id"]).count() == 0


def test_query_digests(spark, tmp_path):
    t = [sentence(random.Random(k % 3), 120) for k in range(5)] + [None, "", "unique text"]
    documents(spark, t).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: (n, g, s, hashlib.sha256(b).hexdigest()) for k, (n, g, s, b) in enumerate(brute(t, 400))}


def test_query_goes_by_400_bytes_not_by_words(spark, tmp_path):
    words = " ".join(f"{k:05d}z" for k in range(60))
    long, short = words[:400], words[1:400].upper()
    assert (len(long), len(short)) == (400, 399) and min(len(x.split()) for x in (long, short)) > 50
    t = [f"a{long}b", f"c{long}d{short}e", f"f{short}g"]
    documents(spark, t).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    kept = ["ab", f"cd{short}e", t[2]]
    assert got == {k: (len(x), len(x) - len(y), int(x != y), hashlib.sha256(y.encode()).hexdigest()) for k, (x, y) in enumerate(zip(t, kept, strict=True))}
