"""Quality scores from pooled random-indexing word vectors and a small network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.llm.common import table
from surfparc.llm.langid import remainder
from surfparc.llm.textnum import LOWER, buffers, owner, portions, token_runs

WORDS = 1 << 15
SHAPES = 128
DIMENSIONS = 48
NONZERO = 6
REACH = 2
HIDDEN = 24
EPOCHS = 60
SAMPLE = 6000
THRESHOLD = 0.3

# Groups of bytes that make up tokens: letters (and all non-ASCII bytes), digits, other signs; white space is a gap.
GROUP = np.full(256, 3, np.uint8)
GROUP[[0x20, *range(0x09, 0x0E)]] = 0
GROUP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
GROUP[48:58] = 2
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's text, word bucket and shape (kind, case and length)."""
    starts, ends, group, h = token_runs(GROUP[raw], offsets, LOWER[raw])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    length = ends - starts
    case = np.where(group != 1, group + 1, CAPITAL[raw[starts]].astype(np.int64) + (CAPITAL[raw[ends - 1]] & CAPITAL[raw[starts]] & (length > 1)))
    return owner(offsets, starts), (h % np.uint64(WORDS)).astype(np.int64), WORDS + case.astype(np.int64) * 16 + np.minimum(length, 15)


def index_vectors(seed: int = 0) -> np.ndarray:
    """A sparse ternary vector for each word bucket and shape."""
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS + SHAPES, DIMENSIONS), np.float32)
    for _ in range(NONZERO):
        out[np.arange(len(out)), rng.integers(0, DIMENSIONS, len(out))] += rng.choice([-1.0, 1.0], len(out))
    return out


def word_vectors(sequences: list[np.ndarray]) -> np.ndarray:
    """Index vectors plus the sums of their neighbours' index vectors, each at unit length."""
    index = index_vectors()
    context = np.zeros(index.shape)
    for at in range(0, len(sequences), 200):  # some texts at a time: the sums are small, the pairs are not
        some = sequences[at : at + 200]
        for reach in range(1, REACH + 1):
            left, right = (np.concatenate([s[cut_off] for s in some]) for cut_off in (slice(None, -reach), slice(reach, None)))
            for d in range(DIMENSIONS):
                context[:, d] += np.bincount(left, index[right, d], len(index)) + np.bincount(right, index[left, d], len(index))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return unit(unit(index) + unit(context)).astype(np.float32)


def pooled(vectors: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Means of word and shape vectors, their lengths, and the log of the token count, of every text."""
    n = len(offsets) - 1
    row, word, shape = tokens(raw, offsets)
    count = np.bincount(row, minlength=n)
    out = np.zeros((n, 2 * DIMENSIONS + 3))
    full = np.flatnonzero(count)
    if len(full):
        first = np.concatenate([[0], np.cumsum(count)[:-1]])[full]
        for k, ids in enumerate((word, shape)):
            out[full, k * DIMENSIONS : (k + 1) * DIMENSIONS] = np.add.reduceat(vectors[ids], first, axis=0, dtype=np.float64) / count[full, None]
    out[:, -3] = np.linalg.norm(out[:, :DIMENSIONS], axis=1)
    out[:, -2] = np.linalg.norm(out[:, DIMENSIONS : 2 * DIMENSIONS], axis=1)
    out[:, -1] = np.log1p(count)
    return out


def fit(texts: list[str], labels: list[int], seed: int = 0) -> dict:
    """Word vectors, then a two-layer network by Adam on four fifths of the rows; the rest sets the temperature."""
    rng = np.random.default_rng(seed)
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    sequences = [tokens(r, np.array([0, len(r)]))[1] for r in raws]
    vectors = word_vectors(sequences)
    x = np.concatenate([pooled(vectors, r, np.array([0, len(r)])) for r in raws])
    y = np.array(labels, float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = standard(x, mean, scale)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            h = np.tanh(x[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[rows].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = {"vectors": vectors, "mean": mean, "scale": scale, "layers": p, "temperature": 1.0}
    if len(held):
        z = network(p, x[held])
        loss = lambda temp: float(np.mean(np.logaddexp(0, np.where(y[held] > 0.5, -z, z) / temp)))
        model["temperature"] = min(np.geomspace(0.25, 8, 41), key=loss)
    return model


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features; what lies far outside the sample is moved to its edge."""
    return np.clip((x - mean) / scale, -4, 4)


def network(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    w0, b0, w1, b1 = layers
    return np.tanh(x @ w0 + b0) @ w1 + b1


def logits(model: dict, features: np.ndarray) -> np.ndarray:
    return network(model["layers"], standard(features, model["mean"], model["scale"]))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[list[str], list[int]]:
    """At most ``limit`` labelled rows of ``docs`` (doc_id, text), the first by a hash of the id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select("doc_id").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality").toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    return rows["text"].tolist(), [int(q) for q in rows["quality"]]


def quality_scores(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, key: list[str], text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Adds ``score``, the probability that ``labels.quality`` is 1, to the ``key`` columns of ``docs``.

    The model is fitted on the driver from at most ``sample`` labelled rows of
    ``learn_from`` (doc_id, text), chosen by a hash of the id, and applied to
    every whole text in Arrow batches; a task holds half a megabyte of text,
    or one text, at a time. Only the text is an input.

    Null texts are scored as empty ones. Without labelled rows, or with labels
    of one kind, the score is the mean label, 0.5 if there is none. Labels other
    than 0 and 1 and labels of a null id are ignored, of several labels of one
    id the smallest counts. Keys may be null or repeated; other columns are ignored.
    """
    texts, quality = labelled_sample(learn_from, labels, sample)
    model = fit(texts, quality) if len(set(quality)) == 2 else None
    flat = float(np.mean(quality)) if quality else 0.5

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(place))
            score = np.full(len(offsets) - 1, flat)
            for lo, hi in portions(offsets, 1 << 19) if model else ():
                z = logits(model, pooled(model["vectors"], raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(z / model["temperature"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(score)], [*key, "score"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in key)
    place = key.index(text) if text in key else len(key)  # a text that is kept isn't sent twice
    slim = docs.select(*key) if text in key else docs.select(*key, F.col(text).alias("__text"))
    return slim.mapInArrow(predict, f"{kinds}, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    scored = quality_scores(docs, docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
