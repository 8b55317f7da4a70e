"""Periodic runs of words, found once per nonterminal of a Re-Pair grammar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.llm.common import table
from surfparc.llm.textnum import U, buffers, mix, portions

SHORTEST = 12
# Two equal stretches of this many words, a period apart, lie in every run of at least SHORTEST words and two periods.
GRAM = SHORTEST // 2
SPACES = r"[\x20\x09-\x0D]+"


def repeated(ids: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Marks the words covered by a stretch of ``GRAM`` words that starts more than once in the same part."""
    n = len(ids) - GRAM + 1
    at = np.flatnonzero(part[: max(n, 0)] == part[GRAM - 1 :]) if n > 1 else np.zeros(0, np.int64)
    h = mix(part[at].astype(np.uint64) + U(1))
    for k in range(GRAM):
        h = mix(h + ids[at + k].astype(np.uint64))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    change = np.bincount(at[again], minlength=len(ids) + 1) - np.bincount(at[again] + GRAM, minlength=len(ids) + 1)
    return np.cumsum(change)[: len(ids)] > 0


def stretches(ids: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the places in which all runs lie.

    The repeated stretches of words of a run cover the whole of it, so a run is
    inside one unbroken covered place; what repeats only elsewhere is dropped by
    looking again within each place.
    """
    for _ in range(3):
        covered = repeated(ids, part)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])) | np.concatenate([[False], part[1:] != part[:-1], [False]]))
        if not len(edge):
            return edge, edge
        lo, hi = edge[:-1], edge[1:]
        keep = covered[lo] & (hi - lo >= SHORTEST)
        lo, hi = lo[keep], hi[keep]
        inside = np.zeros(len(ids) + 1, np.int64)
        inside[lo] += 1
        part = np.cumsum(inside[:-1])
        gone = np.ones(len(ids), bool)
        for a, b in zip(lo, hi, strict=True):
            gone[a:b] = False
        part[gone] = 2**40 + np.flatnonzero(gone)
    return lo, hi


def winners(rank: np.ndarray) -> np.ndarray:
    """Places whose rank is above both neighbours'; of equal neighbours every second one."""
    n = len(rank)
    first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    last = np.append(first[1:], n) - 1
    low = np.int64(-1)
    above = (rank[first] > np.concatenate([[low], rank[first[1:] - 1]])) & (rank[first] > np.concatenate([rank[last[:-1] + 1], [low]])) & (rank[first] > 0)
    size = last - first + 1
    group = np.repeat(np.arange(len(first)), size)
    return np.flatnonzero(above[group] & ((np.arange(n) - first[group]) % 2 == 0))


def grammar(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over the stretches ``lo:hi`` of ``text``: every derivation of every nonterminal.

    Each round replaces the most frequent pairs of symbols; pairs whose places
    don't overlap with more frequent ones are replaced in the same round. When no
    pair is left twice, neighbours are paired until a stretch is one symbol.
    Returns the symbol, its place, the length of its left part and its whole
    length, one entry for each place that it is derived at.
    """
    at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
    owner = np.repeat(np.arange(len(lo)), hi - lo)
    _, seq = np.unique(text[at], return_inverse=True)
    seq = seq.astype(np.int64)
    length = np.ones(len(seq), np.int64)
    letters = int(seq.max(initial=0)) + 1
    rules: dict[tuple[int, int], int] = {}
    log: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    twice = True
    while len(seq) > len(lo):
        joined = owner[1:] == owner[:-1]
        if twice:
            key = np.where(joined, seq[:-1] * (letters + len(rules)) + seq[1:], -1)
            kinds, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            count[kinds < 0] = 0
            order = np.argsort(np.argsort(count, kind="stable"), kind="stable") + 1
            pick = winners(np.where(count >= 2, order, 0)[inverse])
            if not len(pick):
                twice = False
                continue
        else:
            first = np.concatenate([[True], owner[1:] != owner[:-1]])
            nth = np.arange(len(seq)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            pick = np.flatnonzero(joined & (nth[:-1] % 2 == 0))
        pairs, inverse = np.unique(np.stack([seq[pick], seq[pick + 1]]), axis=1, return_inverse=True)
        named = np.empty(pairs.shape[1], np.int64)
        for k, pair in enumerate(zip(*pairs.tolist(), strict=True)):
            named[k] = rules.setdefault(pair, letters + len(rules))
        symbol = named[inverse.ravel()]
        log.append((symbol, at[pick], length[pick], length[pick] + length[pick + 1]))
        seq[pick] = symbol
        length[pick] += length[pick + 1]
        keep = np.ones(len(seq), bool)
        keep[pick + 1] = False
        seq, length, at, owner = seq[keep], length[keep], at[keep], owner[keep]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([entry[k] for entry in log]) if log else none for k in range(4))


def common(text: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """Number of equal words from ``i`` and ``j`` on, to the right (step 1) or, before them, to the left (step -1)."""
    done, width = 0, 32
    while done < most:
        m = min(width, most - done)
        if step > 0:
            differ = text[i + done : i + done + m] != text[j + done : j + done + m]
        else:
            differ = text[i - done - m : i - done][::-1] != text[j - done - m : j - done][::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, width = done + m, width * 4
    return most


def crossing(text: np.ndarray, gram: np.ndarray, lo: int, mid: int, hi: int) -> list[tuple[int, int, int]]:
    """Runs of ``text[lo:hi]`` that hold the words on both sides of ``mid``: (start, end, period).

    A run reaches a period beyond ``mid`` to the right or to the left. There it
    agrees with the words around ``mid`` on three words next to it at least.
    """
    reach = (hi - lo) // 2
    a, b = max(lo, mid - reach), min(hi, mid + reach) + 1
    near = [np.flatnonzero(gram[a:b] == gram[mid]) + a]
    if mid - 3 >= lo:
        near.append(np.flatnonzero(gram[max(a - 3, 0) : b - 3] == gram[mid - 3]) + max(a - 3, 0) + 3)
    q = np.concatenate(near) - mid
    q = np.unique(np.abs(q[q != 0]))
    q = q[q <= reach]
    found: list[tuple[int, int, int]] = []
    while len(q):
        p, q = int(q[0]), q[1:]
        spans = set()
        if mid + p <= hi:
            right, left = common(text, mid, mid + p, hi - mid - p, 1), common(text, mid, mid + p, mid - lo, -1)
            spans.add((mid - left, mid + p + right))
        if mid - p >= lo:
            right, left = common(text, mid - p, mid, hi - mid, 1), common(text, mid - p, mid, mid - p - lo, -1)
            spans.add((mid - p - left, mid + right))
        for s, e in spans:
            if e - s >= max(SHORTEST, 2 * p) and s < mid < e and not any(p % f == 0 and s >= a and e <= b for a, b, f in found):
                found.append((s, e, p))
                q = q[(q % p != 0) | (q > e - s)]
    return found


def runs_of(text: np.ndarray, part: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a concatenation of texts, by start and period; none crosses a change of ``part``."""
    lo, hi = stretches(text, part)
    if not len(lo):
        return []
    symbol, at, left, length = grammar(text, lo, hi)
    wide = length >= SHORTEST
    symbol, at, left, length = symbol[wide], at[wide], left[wide], length[wide]
    order = np.argsort(symbol, kind="stable")
    symbol, at, left, length = symbol[order], at[order], left[order], length[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(symbol) else symbol
    last = np.append(first[1:], len(symbol))
    padded = np.concatenate([text, np.full(2, -1)])
    gram = mix(mix(mix(padded[:-2].astype(np.uint64)) + padded[1:-1].astype(np.uint64)) + padded[2:].astype(np.uint64))
    found: list[np.ndarray] = []
    for f, g in zip(first.tolist(), last.tolist(), strict=True):
        place = int(at[f])
        for s, e, p in crossing(text, gram, place, place + int(left[f]), place + int(length[f])):
            derived = at[f:g]
            found.append(np.stack([derived + (s - place), derived + (e - place), np.full(len(derived), p)], 1))
    if not found:
        return []
    every = np.concatenate(found)
    every = every[np.lexsort((-every[:, 1], every[:, 0], every[:, 2]))]
    merged: list[list[int]] = []
    for s, e, p in every.tolist():
        if merged and merged[-1][2] == p and merged[-1][1] - s >= p:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, p])
    return sorted((s, e, p) for s, e, p in merged)


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Maximal runs of repeated words in every whole text, and the text without their repetitions.

    Words are what white space (0x20, 0x09 to 0x0D) separates. A run is a stretch
    of words with smallest period q, at least ``max(12, 2 q)`` long, that neither
    neighbour continues. In each task a portion of about a megabyte of text, or
    one longer text, is turned into word ids; places without any repeated six
    words hold no run, the others get one Re-Pair grammar, in which the runs
    across the middle of a nonterminal are found once and moved to all places it
    is derived at; overlapping pieces of one period are then united.

    Returns ``key``, ``n_words``, ``runs`` (start, length, period; by start, then
    period) and ``collapsed``: the words outside runs or within a run's first
    period (for each run that holds them), joined by single spaces. A null or
    empty text has no words and an empty ``collapsed``; keys may be null or
    repeat; other columns are ignored; no rows give no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(len(key)))
            for at, to in portions(offsets):
                words = [raw[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(at, to)]
                size = np.array([len(w) for w in words], np.int64)
                start = np.concatenate([[0], np.cumsum(size)])
                names: dict[bytes, int] = {}
                ids = np.fromiter((names.setdefault(x, len(names)) for w in words for x in w), np.int64, int(start[-1]))
                part = np.repeat(np.arange(len(words)), size)
                own: list[list[tuple[int, int, int]]] = [[] for _ in words]
                for s, e, p in runs_of(ids, part):
                    own[part[s]].append((s, e, p))
                runs, kept = [], []
                for w, base, rs in zip(words, start[:-1].tolist(), own, strict=True):
                    runs.append([{"start": s - base, "length": e - s, "period": p} for s, e, p in rs])
                    if rs:
                        gone = np.zeros(len(w), bool)
                        for s, e, p in rs:
                            gone[s + p - base : e - base] = True
                        w = [x for x, g in zip(w, gone, strict=True) if not g]
                    kept.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, to - at) for c in batch.columns[: len(key)]], pa.array(size), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())],
                    [*[f"k{n}" for n in range(len(key))], "n_words", "runs", "collapsed"],
                )

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = ", ".join(f"k{n} {docs.schema[k].dataType.simpleString()}" for n, k in enumerate(key))
    slim = docs.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(key)], F.col(text).alias("__text"))
    found = slim.mapInArrow(scan, f"{kinds}, n_words long, runs {RUNS}, collapsed string")
    return found.select(*[F.col(f"k{n}").alias(k) for n, k in enumerate(key)], "n_words", "runs", "collapsed")


def with_planted_runs(text: Column, key: Column) -> Column:
    """Every tenth text, by a hash of its key, ends in a repetition of some of its own words."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        taken = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
        return F.array_join(taken, " ")

    words = F.array_remove(F.split(text, SPACES), "")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.element_at(F.transform(F.array(words), planted), 1)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, every tenth with a planted repetition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, ["doc_id"])
    # One struct at a time: the longest run, of equally long ones the first, then the one with the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
