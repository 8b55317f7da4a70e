"""Removal of long byte strings that occur more than once, by a distributed sparse suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.llm.common import masked, small, table, unmasked
from surfparc.llm.deepshallow import deep_shallow
from surfparc.llm.textnum import BASE_INVERSE, BYTE, U, buffers, mix, owner, portions, powers
from surfparc.session import cut

SPAN = 400
GRAM = 128
GROUP = 2000
SEGMENT = 1 << 19
CHUNK = 4000
CONTEXT = "key long, lo int, hi int, t0 long, t1 long, pos long, lhs binary, rhs binary"


def text_id(data: Column) -> list[Column]:
    """128 bits that stand for a text."""
    digest = F.md5(data)
    half = lambda a: F.conv(F.substring(digest, a, 16), 16, -10).cast("long")
    return [half(1).alias("t0"), half(17).alias("t1")]


def anchor_places(raw: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``gram`` bytes hash lowest in some ``span`` bytes of one text, and those hashes.

    Equal spans pick the same place inside, so every repeat holds a pair of equal anchors.
    """
    n, none = len(raw), np.zeros(0, np.int64)
    if n < span:
        return none, none
    size = np.diff(offsets)
    edge = np.zeros(n + 1, np.int64)
    long = size >= span
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - span + 1, -1)
    valid = np.cumsum(edge)[: n - span + 1] > 0
    if not valid.any():
        return none, none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers(n), out=total[1:])
    inverse = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n - gram, BASE_INVERSE)]))
    h = mix((total[gram:] - total[:-gram]) * inverse)
    low = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    w = span - gram + 1
    padded = np.full(-(-len(low) // w) * w, U(2**64 - 1))
    padded[: len(low)] = low
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])[valid]
    least = least[np.append(True, least[1:] != least[:-1])]
    places = np.unique((least & U(0xFFFFFFFF)).astype(np.int64))
    return places, h[places].view(np.int64)


def find_anchors(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(t0, t1, text) to (t0, t1, pos, gram); long texts go by overlapping segments."""
    for batch in batches:
        raw, offsets = buffers(batch.column(2))
        t0, t1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for lo, hi in portions(offsets, SEGMENT):
            a, b = int(offsets[lo]), int(offsets[hi])
            if hi == lo + 1 and b - a > 2 * SEGMENT:
                parts = [(s, min(s + SEGMENT + span - 1, b)) for s in range(a, b, SEGMENT)]
            else:
                parts = [(a, b)]
            rows, places, grams = [], [], []
            for s, e in parts:
                at = np.array([0, e - s]) if len(parts) > 1 else offsets[lo : hi + 1] - a
                p, h = anchor_places(raw[s:e], at, span, gram)
                row = lo + owner(at, p) if len(parts) == 1 else np.full(len(p), lo)
                rows.append(row)
                places.append(p + s - offsets[row])
                grams.append(h)
            row = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(t0[row]), pa.array(t1[row]), pa.array(np.concatenate(places)), pa.array(np.concatenate(grams))], ["t0", "t1", "pos", "gram"])


def surroundings(batches: Iterator[pa.RecordBatch], mode: str, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(t0, t1, text, marks) to CONTEXT rows: what a span around each marked anchor can hold on either side.

    Anchors of one text with equal whole surroundings settle each other here:
    the first stands for all in modes ``usual`` and ``hot``, and mode ``twins``
    gives (t0, t1, start, end) of what they cover.
    """
    side = span - gram
    for batch in batches:
        raw, offsets = buffers(batch.column(2))
        marks = batch.column(3)
        inner = marks.flatten()
        row = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy(zero_copy_only=False))
        pos, key, is_hot = (inner.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "gram", "hot"))
        t0, t1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for k in range(0, len(pos), CHUNK):
            r, p, g, h = row[k : k + CHUNK], pos[k : k + CHUNK], key[k : k + CHUNK], is_hot[k : k + CHUNK]
            at = offsets[r] + p
            start, end = np.maximum(offsets[r], at - side), np.minimum(offsets[r + 1], at + span)
            data = [raw[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            first: dict[tuple, int] = {}
            lead = np.array([first.setdefault((a, b, c), i) if len(c) == side + span else i for i, (a, b, c) in enumerate(zip(r.tolist(), g.tolist(), data, strict=True))])
            if mode == "twins":
                many = np.bincount(lead, minlength=len(lead))[lead] > 1
                order = np.flatnonzero(many)[np.lexsort((p[many], r[many]))]
                if not len(order):
                    continue
                r, a, b = r[order], p[order] - side, p[order] + span
                new = np.append(True, (r[1:] != r[:-1]) | (a[1:] > np.maximum.accumulate(b + r * (1 << 40))[:-1] - r[1:] * (1 << 40)))
                runs = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(t0[r[runs]]), pa.array(t1[r[runs]]), pa.array(a[runs]), pa.array(np.maximum.reduceat(b, runs))], ["t0", "t1", "start", "end"])
                continue
            pick = np.flatnonzero((lead == np.arange(len(lead))) & (h == (mode == "hot")))
            cut_at = (at - start)[pick].tolist()
            left = [data[i][:c] for i, c in zip(pick.tolist(), cut_at, strict=True)]
            right = [data[i][c:] for i, c in zip(pick.tolist(), cut_at, strict=True)]
            r, p = r[pick], p[pick]
            zero, most = np.zeros(len(pick), np.int32), np.full(len(pick), side, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[pick]), pa.array(zero), pa.array(most), pa.array(t0[r]), pa.array(t1[r]), pa.array(p), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                ["key", "lo", "hi", "t0", "t1", "pos", "lhs", "rhs"],
            )


def repeated_windows(left: list[bytes], right: list[bytes], key: list[int], lo: list[int], hi: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the smallest and largest bytes ahead of it at which a repeated span begins (-1: none).

    Anchors of one key are compared. The suffixes that start at them and the
    reversed prefixes that end there are sorted with their common prefixes. Two
    anchors share the span that begins ``d`` bytes ahead if no neighbours between
    them agree on fewer than ``d`` bytes to the left, and ``span - d`` to the
    right. The extremes of ``d`` are always a left common length, or the span
    less a right one, so only those are tried.
    """
    n = len(key)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    head = [k.to_bytes(8, "big", signed=True) for k in key]
    right_order, right_lcp = deep_shallow([h + s for h, s in zip(head, right, strict=True)])
    left_order, left_lcp = deep_shallow([h + s[::-1] for h, s in zip(head, left, strict=True)])
    keys = np.array(key)
    sorted_keys = keys[right_order]
    edges = np.append(np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])), n).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        m = b - a
        if m < 2:
            continue
        r_order, r_lcp, l_order, l_lcp = right_order[a:b], right_lcp[a + 1 : b] - 8, left_order[a:b], left_lcp[a + 1 : b] - 8
        first, last = lo[r_order[0]], hi[r_order[0]]
        if m == 2:
            x, y = int(l_lcp[0]), int(r_lcp[0])
            low, high = max(first, span - y), min(last, x)
            if low <= high:
                least[r_order], most[r_order] = low, high
            continue
        tried = {min(max(int(v), first), last) for v in l_lcp.tolist()} | {min(max(span - int(v), first), last) for v in r_lcp.tolist()}
        top_l, top_r = int(l_lcp.max()), int(r_lcp.max())
        place = np.empty(m, np.int64)
        local = {int(v): i for i, v in enumerate(r_order.tolist())}
        place[:] = [local[v] for v in l_order.tolist()]
        for d in sorted(tried):
            if d > top_l or span - d > top_r:
                continue
            right_class = np.concatenate([[0], np.cumsum(r_lcp < span - d)])
            left_class = np.empty(m, np.int64)
            left_class[place] = np.concatenate([[0], np.cumsum(l_lcp < d)])
            _, which, count = np.unique(left_class * m + right_class, return_inverse=True, return_counts=True)
            found = r_order[count[which] > 1]
            most[found] = d
            least[found] = np.where(least[found] < 0, d, least[found])
    return least, most


def compare(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """CONTEXT rows sorted by key to (t0, t1, start, end) of what repeats; keys may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.Table) -> pa.RecordBatch:
        get = lambda c: rows[c].to_pylist()
        least, most = repeated_windows(get("lhs"), get("rhs"), get("key"), get("lo"), get("hi"), span)
        hit = np.flatnonzero(most >= 0)
        pos = rows["pos"].to_numpy()[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["t0"].to_numpy()[hit]), pa.array(rows["t1"].to_numpy()[hit]), pa.array(pos - most[hit]), pa.array(pos - least[hit] + span)], ["t0", "t1", "start", "end"]
        )

    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(at, CHUNK))
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["key"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1], side="left"))
            if whole:
                yield settle(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
    if held:
        yield settle(pa.Table.from_batches(held))


def halves(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Each CONTEXT row twice, for the spans of the first and of the second half of its range, keyed by the bytes those share."""
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            mid = (r["lo"] + r["hi"]) // 2
            for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                if len(r["lhs"]) >= lo and len(r["rhs"]) >= span - hi:
                    shared = r["lhs"][len(r["lhs"]) - lo :] + r["rhs"][: span - hi]
                    digest = hashlib.blake2b(shared, digest_size=8, key=f"{lo} {hi}".encode()).digest()
                    out.append({**r, "key": int.from_bytes(digest, "big", signed=True), "lo": lo, "hi": hi})
        if out:
            yield from pa.Table.from_pylist(out, schema=batch.schema).to_batches()


def split_hot(level: DataFrame, span: int, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rows of keys with more than ``group`` anchors, split until each key has at most so many.

    Anchors whose whole surroundings agree settle each other at once and go on
    as one; the rest divides its range of spans, so keys get longer and groups
    smaller. A range of one span is settled by the key, the span itself.
    """
    ready, settled = [], []
    whole = lambda lo, hi: (F.length("lhs") >= hi) & (F.length("rhs") >= span - lo)
    around = F.concat(F.expr("substring(lhs, -hi, hi)"), F.expr(f"substring(rhs, 1, {span} - lo)"))
    place = F.xxhash64("t0", "t1", "pos")
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    while True:
        level = cut(level)
        # Broadcast while few, so that the rows of a hot key stay where they are.
        size = small(cut(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")))
        counted = cut(level.join(size, "key"))
        ready.append(counted.filter(F.col("n") <= group).select(*names))
        big = counted.filter(F.col("n") > group).select(*names, F.when(whole(F.col("lo"), F.col("hi")), F.md5(around)).alias("full"), place.alias("place"))
        alike = big.filter(F.col("full").isNotNull()).groupBy("key", "full").agg(F.count(F.lit(1)).alias("same"), F.min("place").alias("first"))
        joined = cut(big.join(small(cut(alike.filter("same > 1"))), ["key", "full"], "left"))
        settled.append(joined.filter("same > 1").select("t0", "t1", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + span).alias("end")))
        going = joined.filter((F.col("same").isNull() | (F.col("place") == F.col("first"))) & (F.col("lo") < F.col("hi")))
        if going.isEmpty():
            return ready, settled
        level = going.select(*names).mapInArrow(lambda it: halves(it, span), CONTEXT)


def repeated_spans(docs: DataFrame, text: str = "text", span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(t0, t1, text) of texts with anchors that recur, and (t0, t1, start, end) byte ranges covered by repeats.

    Compares distinct texts only; equal texts share a ``text_id``.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ids = docs.select(*text_id(data), data.alias("text"))
    anchors = cut(ids.filter(F.length("text") >= span).mapInArrow(lambda it: find_anchors(it, span, gram), "t0 long, t1 long, pos long, gram long"))
    place = F.xxhash64("t0", "t1", "pos")
    seen = anchors.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("a") != F.col("b"))
    seen = cut(seen.select("gram", (F.col("n") > group).alias("hot")))
    marks = anchors.join(seen, "gram").groupBy("t0", "t1").agg(F.collect_set(F.struct("pos", "gram", "hot")).alias("marks"))
    marked = cut(ids.join(marks.hint("shuffle_merge"), ["t0", "t1"]).dropDuplicates(["t0", "t1"]).select("t0", "t1", "text", "marks"))
    usual = marked.mapInArrow(lambda it: surroundings(it, "usual", span, gram), CONTEXT)
    found = [marked.mapInArrow(lambda it: surroundings(it, "twins", span, gram), "t0 long, t1 long, start long, end long")]
    if not seen.filter("hot").isEmpty():
        hot = marked.mapInArrow(lambda it: surroundings(it, "hot", span, gram), CONTEXT)
        ready, settled = split_hot(hot, span, group)
        found += settled
        for r in ready:
            usual = usual.unionByName(r)
    sorted_rows = usual.repartition("key").sortWithinPartitions("key")
    found.append(sorted_rows.mapInArrow(lambda it: compare(it, span), "t0 long, t1 long, start long, end long"))
    spans = found[0]
    for f in found[1:]:
        spans = spans.unionByName(f)
    return marked.select("t0", "t1", "text"), spans


def strip(batches: Iterator[pa.RecordBatch], whole_characters: bool, words: int, sure: int) -> Iterator[pa.RecordBatch]:
    """(t0, t1, text, spans) to the maximal removed runs and the text that is kept; null both where no run is left."""
    for batch in batches:
        out = {"spans": [], "kept": []}
        for data, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            if whole_characters:
                inside = lambda i: 0 < i < len(data) and data[i] & 0xC0 == 0x80
                for r in runs:
                    while inside(r[0]):
                        r[0] += 1
                    while inside(r[1]):
                        r[1] -= 1
            runs = [r for r in runs if r[1] - r[0] >= sure or len(data[r[0] : r[1]].split()) > words]
            if not runs:
                out["spans"].append(None)
                out["kept"].append(None)
                continue
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
            out["kept"].append(b"".join([*kept, data[at:]]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out["spans"], kind), pa.array(out["kept"], pa.binary())], ["t0", "t1", "spans", "kept"])


def remove_repeats(docs: DataFrame, key: list[str], text: str = "text", span: int = SPAN, gram: int = GRAM, group: int = GROUP, whole_characters: bool = False, words: int = 0, sure: int = 0) -> DataFrame:
    """What stays of each text when every byte in a ``span``-byte string that also starts elsewhere goes.

    Returns ``key``, t0, t1 (the text's id), n_bytes, copies, ``spans`` (maximal
    removed runs, bytes from 0; null if none) and ``kept`` (the remaining bytes;
    null where nothing is removed, so that untouched texts need not move).
    ``whole_characters`` shrinks runs to whole UTF-8 characters. Runs shorter than
    ``sure`` bytes go only if they hold more than ``words`` words (between blanks).

    Places that are chosen by content, one at least in every ``span`` bytes,
    form a sparse suffix array: equal places are gathered by a hash of the next
    ``gram`` bytes, sorted to both sides by ``deep_shallow`` and compared
    exactly. Matches do not cross texts. Groups of more than ``group`` places
    are divided first (``split_hot``), so a task never holds one whole hot group.

    Equal texts of ``span`` bytes or more remove each other wholly. Null is an
    empty text; keys may be null; repeated rows are copies; other columns are
    ignored; no rows give no rows.
    """
    data = F.coalesce(F.col("__text"), F.lit("")).cast("binary")
    named, names = masked(docs.withColumn("__text", F.col(text)), key, "__text")
    n_bytes = F.length(data).cast("long")
    long_enough = (n_bytes >= sure) | (F.size(F.array_remove(F.split(F.col("__text"), r"[\x20\x09-\x0D]+"), "")) > words)
    rows = named.select(*names, *text_id(data), n_bytes.alias("n_bytes"), ((n_bytes >= span) & long_enough).alias("__whole"))
    texts, spans = repeated_spans(docs, text, span, gram, group)
    listed = spans.groupBy("t0", "t1").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    stripped = texts.join(listed, ["t0", "t1"]).select("t0", "t1", "text", "spans")
    stripped = stripped.mapInArrow(lambda it: strip(it, whole_characters, words, sure), "t0 long, t1 long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    copies = rows.groupBy("t0", "t1").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(copies, ["t0", "t1"]).join(stripped, ["t0", "t1"], "left")
    all_gone = (F.col("copies") > 1) & F.col("__whole")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    joined = unmasked(joined, key)
    return joined.withColumn("spans", F.when(all_gone, everything).otherwise(F.col("spans"))).withColumn("kept", F.when(all_gone, F.lit(b"")).otherwise(F.col("kept"))).drop("__whole")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte repeats leave of every document."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(data, 256).alias("whole_sha256"))
    rest = remove_repeats(docs, ["doc_id", "whole_sha256"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return rest.select(
        "doc_id", "n_bytes", F.coalesce(removed, F.lit(0)).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), F.col("whole_sha256")).alias("kept_sha256"),
    )
