"""License scan, decontamination, sharding and chat formatting."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from surfparc.llm.chat import END, PART, SAYS, TURN, format_chats, op10_chat_formatting, read_back
from surfparc.llm.decontaminate import contamination, op4_decontamination
from surfparc.llm.licenses import NOTICES, PHRASES, TEXTS, license_spans, op3_license_scan
from surfparc.llm.sharding import op6_sharding, shard_by_bytes
from tests.llm.helpers import ODD, documents, letter_words, sentence


def test_license_base_matches_brute_force(spark, tmp_path):
    rng = random.Random(1)
    t = [sentence(rng, 20) + " " + rng.choice(["MIT License", "the Apache--License", "GNU General Public License, general public", "mit  mit license", "x"]) + ". " + sentence(rng, 5) for _ in range(30)]
    t += ["MIT License MIT License", "general public license general public license", "licenseé mit license", *ODD, None, t[0]]
    ids = [*range(len(t) - 1), 0]
    documents(spark, t, ids).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_license_scan(spark, str(tmp_path)).collect()
    assert len(rows) == len(t)
    want = {}
    for k, x in zip(ids, t, strict=True):
        w = [a.decode() for a in letter_words(x)]
        hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want[k] = (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in hits})))
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_notice_with_changes_is_followed_over_neighbouring_diagonals(spark):
    text = NOTICES["bsd-notice"].replace("source and", "source forms and").replace("or without ", "")
    spans = license_spans(documents(spark, ["before it " + text, "of the use in and with"]), [(NOTICES["bsd-notice"], "bsd-notice", False)], ["doc_id"]).filter("covered > 0.6").collect()
    assert [(s.doc_id, s.label, s.start) for s in spans] == [(0, "bsd-notice", 2)]


def brute_span(w, template, gram=5, shift=4):
    """Largest share of the template's words in grams found in order on diagonals at most ``shift`` apart."""
    t = template.split()
    at = [(k, i) for k in range(len(t) - gram + 1) for i in range(len(w) - gram + 1) if w[i : i + gram] == t[k : k + gram]]
    best = 0.0
    for d in {i - k for k, i in at}:
        last, seen = (-gram, -1), set()
        for k, i in sorted(at):
            if d <= i - k <= d + shift and k > last[0] and i > last[1]:
                last = (k, i)
                seen |= set(range(k, k + gram))
        best = max(best, len(seen) / len(t))
    return best


def test_license_texts_match_brute_force_and_scattered_words_are_no_notice(spark):
    rng = random.Random(12)
    whole = TEXTS["mit-text"].split()
    edited = [x for k, x in enumerate(whole) if k % 40 != 7]
    shuffled = [x for piece in rng.sample([whole[k : k + 6] for k in range(0, len(whole), 6)], len(whole) // 6) for x in piece]
    t = [sentence(rng, 8) + " " + " ".join(x) + " " + sentence(rng, 5) for x in (whole, edited, shuffled, whole[:80], whole[90:] + whole[:70])]
    t += [" ".join(whole[10:16]) * 30, "of the use of the software " * 50, "", None, t[0], sentence(rng, 60_000) + " " + t[0]]
    got = {}
    for s in license_spans(documents(spark, t), [(TEXTS["mit-text"], "mit-text", False)], ["doc_id"]).collect():
        assert 0 <= s.start < s.end and s.end - s.start <= len(whole) + 4
        got[s.doc_id] = max(got.get(s.doc_id, 0), s.covered)
    want = {k: brute_span([x.decode() for x in letter_words(x)], TEXTS["mit-text"]) for k, x in enumerate(t)}
    assert {k: v for k, v in want.items() if v} == got
    assert got[0] == got[9] == got[10] == 1 and got[1] > 0.6 and got[2] < 0.1 and 6 not in got


def test_license_scan_of_an_empty_table(spark):
    assert license_spans(documents(spark, []), [("a b", "x", True)], ["doc_id"]).count() == 0


def brute_hits(texts, items, window=10):
    wins = {}
    for item, text in items:
        w = letter_words(text)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for t in texts:
        w, hit, found = letter_words(t), set(), set()
        for win, owners in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= owners
        out.append((len(w), len(hit), {str(x) for x in found if x is not None}))
    return out


def bench(spark, items):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in items], "item_id long, text string, win string, n int")


def test_contamination_matches_brute_force(spark, tmp_path):
    rng = random.Random(4)
    items = [(k, sentence(rng, rng.choice([4, 9, 10, 14, 30]))) for k in range(25)] + [(90, "q"), (91, "zz yy"), (92, ""), (93, None), (None, "null owner here"), (7, sentence(rng, 12)), (94, "aa " * 14)]
    t = []
    for _ in range(60):
        w = sentence(rng, 40).split()
        for _ in range(rng.randrange(3)):
            src = (rng.choice(items)[1] or "").split()
            w[rng.randrange(40) : 0] = src[rng.randrange(3) :]
        t.append(" ".join(w))
    t += ["q", "zz, YY!", "null owner here", "aa " * 25, *ODD, None, t[0]]
    ids = [*range(len(t) - 1), 0]
    documents(spark, t, ids).write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, items).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = op4_decontamination(spark, str(tmp_path)).collect()
    assert len(rows) == len(t)
    sha = lambda s: hashlib.sha256(",".join(sorted(s)).encode()).hexdigest()
    want = {k: (n, h, len(f), sha(f), h > 0) for k, (n, h, f) in zip(ids, brute_hits(t, items), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want


def test_contamination_of_empty_tables(spark):
    some, none = documents(spark, ["a b c"]).withColumn("text_key", F.xxhash64("text")), documents(spark, []).withColumn("text_key", F.lit(0))
    assert contamination(some, bench(spark, []), ["doc_id", "text_key"]).count() == 0
    assert contamination(none, bench(spark, [(1, "a b c")]), ["doc_id", "text_key"]).count() == 0


def test_shards_are_contiguous_balanced_and_gapless(spark, tmp_path):
    rng = random.Random(2)
    t = ["é" * rng.randrange(200) for _ in range(300)] + ["z" * 9000, None, "", None]
    ids = [*range(len(t) - 2), None, 5]
    documents(spark, t, ids).write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_sharding(spark, str(tmp_path)).collect()
    want = sorted(((k, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for k, x in zip(ids, t, strict=True)), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    target = sum(r.size for r in rows) / 16
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - target) <= 9001
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted([r.doc_id for r in rows], key=lambda k: -1 if k is None else k)
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, size long"), "size", ["doc_id"], 16).count() == 0


def test_chat_round_trip_and_mask(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<\\|end|>", "a<|turn|>b<|says|>", "[/INST", "", None, "line\nline $1 \\1", "<s><|image|>", "é" * 5]
    rows = [(c, t, "assistant" if t % 2 else "user", hard[(c + t) % len(hard)], "x") for c in range(6) for t in range(5)] + [(3, 2, None, "tie", "x"), (3, 2, None, "tie", "x"), (None, None, "a|>\n", "null", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    got = {r.conv_id: r for r in read_back(format_chats(turns.withColumn("parts", F.array(part)))).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        assert got[c].loss_texts == [x for _, r, x in mine if r == "assistant"]
        assert got[c].formatted.count(TURN) == got[c].formatted.count(SAYS) == got[c].formatted.count(END) == len(mine) == got[c].n_turns
        for marker in ("[INST]", "[/INST]", "</s>", "<s>"):
            assert marker not in got[c].formatted
        for s in got[c].loss_spans:
            assert got[c].formatted[s.start - len(SAYS) : s.start] == SAYS and got[c].formatted[s.start + s.chars :].startswith(END)


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3/a", 2), ("audio", None, "b", None), ("text", "<|image|>", None, None), ("document", None, "c", 3), ("video", "lost", None, 1)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts array<{PART}>")
    r = format_chats(turns).first()
    assert r.formatted == "<|turn|>user<|says|>see <|image|><|audio|><\\|image|><|document|><|end|><|turn|>assistant<|says|><|end|><|turn|>user<|says|><|end|>"
    assert [(a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "s3/a", 512), (0, "audio", "b", 25), (0, "document", "c", 1536)]
    assert r.attachment_tokens == 2073 and r.n_turns == 3


def test_chat_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = op10_chat_formatting(spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert [(x.conv_id, x.n_turns, x.loss_chars, x.turns_sha256, x.loss_sha256) for x in r] == [
        (-1, 2, len(said), hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
    ]
