"""Toxicity scores by a sparse classifier that swapping identity terms must not move."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.llm.common import table
from surfparc.llm.langid import remainder
from surfparc.llm.textnum import LOWER, buffers, owner, portions, token_runs

BITS = 20
SAMPLE = 20_000
THRESHOLD = 0.5
SPARSITY = 1e-4
EVEN = 1.0
ROUNDS = 300

# Words that name groups of people, by kind.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual"),
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners"),
    ("blind", "deaf", "disabled", "elderly", "old", "young"),
)

# Word bytes: letters and all non-ASCII bytes; anything else is a gap.
LETTER = np.zeros(256, np.uint8)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def presence(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct words of each text, sorted by both."""
    starts, _, _, h = token_runs(LETTER[raw], offsets, LOWER[raw])
    key = np.unique((owner(offsets, starts) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


def bucket(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(presence(raw, np.array([0, len(raw)]))[1][0])


def swaps(rows: list[np.ndarray], identities: Sequence[Sequence[str]]) -> list[tuple[list[int], list[int], float]]:
    """What each swap of an identity term adds to a text's words and takes from them, and its weight.

    A term gives way to each other term of its kind, these weigh one together, and
    to a neutral word that stands for no evidence, which weighs one.
    """
    kinds = [[bucket(w) for w in kind] for kind in identities]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    hit = np.isin(flat, [b for kind in kinds for b in kind])
    out = []
    for r, term in zip(row[hit].tolist(), flat[hit].tolist(), strict=True):
        for kind in kinds:
            if term in kind:
                others = [b for b in kind if b != term]
                # A term that the text holds already adds nothing.
                out += [([] if (rows[r] == b).any() else [b], [term], 1.0 / len(others)) for b in others] + [([], [term], 1.0)]
    return out


def fit(rows: list[np.ndarray], labels: Sequence[int], even: float = EVEN, sparsity: float = SPARSITY, identities: Sequence[Sequence[str]] = IDENTITIES) -> dict:
    """Sparse logistic weights of word buckets; ``even`` weighs the squared change of a score under a swap.

    Words take part that occur in three labelled toxic texts at least and in a
    share of these more than twice as large as of the others, and all identity terms.
    Accelerated proximal gradient steps on the mean log loss plus the weighted mean
    squared change over all swaps plus ``sparsity`` times the absolute weights; a word's
    step follows from the texts it occurs in, so rare words move as fast as common
    ones. A held-back fifth sets the temperature.
    """
    pairs = swaps(rows, identities)
    words = np.concatenate(rows)
    swapped = np.array([x for p in pairs for x in p[0] + p[1]], np.int64)
    buckets, col = np.unique(np.concatenate([words, swapped]), return_inverse=True)
    col = col[: len(words)]
    y = np.asarray(labels, float)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bad = (y[row] > 0.5) & ~held[row]
    seen, fine = np.bincount(col[bad], minlength=len(buckets)), np.bincount(col[~bad & ~held[row]], minlength=len(buckets))
    base = max((y[~held] > 0.5).sum(), 1) / max((y[~held] <= 0.5).sum(), 1)
    useful = np.isin(buckets, swapped) | ((seen >= 3) & (seen > 2 * base * fine))
    place = np.cumsum(useful) - 1
    take = useful[col]
    col, row, buckets = place[col[take]], row[take], buckets[useful]
    n, m = len(y), len(buckets)
    change_row = np.repeat(np.arange(len(pairs)), [len(p[0]) + 1 for p in pairs])
    change_sign = np.array([x for p in pairs for x in [1.0] * len(p[0]) + [-1.0]])
    weight = np.array([p[2] for p in pairs])
    weight = 2 * even * weight / max(weight.sum(), 1.0)
    change_col = np.searchsorted(buckets, swapped)
    train, total = ~held, max(int((~held).sum()), 1)
    size = np.bincount(row, minlength=n)
    # Upper bounds of the curvature along each weight, and along the bias.
    curve = 0.25 / total * np.bincount(col, (size[row] + 1.0) * train[row], m) + 1e-9
    if len(pairs):
        curve += 2 * np.bincount(change_col, weight[change_row], m)
    curve_b = 0.25 / total * (size[train] + 1.0).sum() + 1e-9
    w, b = np.zeros(m), float(np.log((y[train].sum() + 0.5) / (total - y[train].sum() + 0.5)))
    look, look_b, t = w.copy(), b, 1.0
    for _ in range(ROUNDS):
        z = np.bincount(row, look[col], n) + look_b
        d = np.where(train, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0) / total
        gradient = np.bincount(col, d[row], m)
        if len(pairs):
            moved = np.bincount(change_row, change_sign * look[change_col], len(pairs)) * weight
            gradient += np.bincount(change_col, change_sign * moved[change_row], m)
        new = look - gradient / curve
        new = np.sign(new) * np.maximum(np.abs(new) - sparsity / curve, 0.0)
        new_b = look_b - d.sum() / curve_b
        if (curve * (look - new) * (new - w)).sum() > 0:
            t = 1.0
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / ahead * (new - w), new_b + (t - 1) / ahead * (new_b - b)
        w, b, t = new, new_b, ahead
    model = {"buckets": buckets[w != 0], "weights": w[w != 0], "bias": b, "temperature": 1.0}
    if held.any():
        z = (np.bincount(row, w[col], n) + b)[held]
        loss = lambda temp: float(np.mean(np.logaddexp(0, np.where(y[held] > 0.5, -z, z) / temp)))
        model["temperature"] = float(min(np.geomspace(0.1, 4, 41), key=loss))
    return model


def score(model: dict, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of texts that lie one after another in ``raw``."""
    weight = np.zeros(1 << BITS)
    weight[model["buckets"]] = model["weights"]
    text, words = presence(raw, offsets)
    z = np.bincount(text, weight[words], len(offsets) - 1) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z / model["temperature"], -30, 30)))


def labelled_words(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[list[np.ndarray], list[int]]:
    """Distinct word buckets and labels of at most ``limit`` labelled documents, the first by a hash of the id."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            for lo, hi in portions(offsets):
                text, words = presence(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in batch.columns[:2]], pa.ListArray.from_arrays(pa.array(ends), pa.array(words.astype(np.int32)))], ["doc_id", "toxic", "words"]
                )

    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Of an id that repeats, the smallest hash of the text stands for it: one row an id, before any text moves.
    one = docs.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("__h"))
    chosen = F.broadcast(one.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.withColumn("__h", F.xxhash64("text")).join(chosen, ["doc_id", "__h"]).select("doc_id", "toxic", "text")
    slim = rows.mapInArrow(gather, "doc_id long, toxic int, words array<int>").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("words").alias("words"))
    got = slim.toArrow().sort_by("doc_id")
    return [w.values.to_numpy().astype(np.int64) for w in got["words"]], got["toxic"].to_pylist()


def toxicity_scores(
    docs: DataFrame, learn_from: DataFrame, labels: DataFrame, key: list[str], text: str = "text", sample: int = SAMPLE, even: float = EVEN, identities: Sequence[Sequence[str]] = IDENTITIES
) -> DataFrame:
    """Adds ``score``, the probability that ``labels.toxic`` is 1, to the ``key`` columns of ``docs``.

    Words that occur in a text, hashed into 2**20 buckets, give a sparse logistic
    model. It is fitted on the driver from the words of at most ``sample`` labelled
    documents of ``learn_from`` (doc_id, text), chosen by a hash of the id. Every
    labelled text that holds an identity term also stands there with the term
    swapped for each other one of its kind and for a neutral word; the squared
    differences between the two scores are part of the loss (weight ``even``), so a
    mention of a group by itself says nothing. All whole texts are then scored in
    Arrow batches, a megabyte of text, or one text, at a time. Only the text is an input.

    Null texts are scored as empty ones, which have the score of a text without
    any known word. Without labelled rows, or with labels of one kind, the score
    is the mean label, 0.5 if there is none. Labels other than 0 and 1 and labels
    of a null id are ignored; of several labels of one id the largest counts, of
    several texts of one id one (the smallest hash) is learned from. Keys may be
    null or repeat; other columns are ignored; no rows give no rows.
    """
    rows, toxic = labelled_words(learn_from, labels, sample)
    model = fit(rows, toxic, even, identities=identities) if len(set(toxic)) == 2 else None
    flat = float(np.mean(toxic)) if toxic else 0.5

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(len(key)))
            out = np.full(len(offsets) - 1, flat)
            for lo, hi in portions(offsets) if model else ():
                out[lo:hi] = score(model, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(out)], [*[f"k{n}" for n in range(len(key))], "score"])

    kinds = ", ".join(f"k{n} {docs.schema[k].dataType.simpleString()}" for n, k in enumerate(key))
    scored = docs.select(*[F.col(k).alias(f"k{n}") for n, k in enumerate(key)], F.col(text).alias("__text")).mapInArrow(predict, f"{kinds}, score double")
    return scored.select(*[F.col(f"k{n}").alias(k) for n, k in enumerate(key)], "score")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    scored = toxicity_scores(docs, docs.filter(~F.col("held_out")).select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
