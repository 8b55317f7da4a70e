"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfparc.llm.common import table
from surfparc.llm.textnum import LOWER, buffers, portions

BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS = 4
PER_LANGUAGE = 1500
PRECISION = 0.995
NO_LANGUAGE = "und"

# Bytes of subwords: lower-cased letters and all non-ASCII bytes; everything else is a gap.
LETTERS = np.full(256, 0x20, np.uint8)
LETTERS[[*range(65, 91), *range(97, 123)]] = LOWER[[*range(65, 91), *range(97, 123)]]
LETTERS[128:] = np.arange(128, 256)


def remainder(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 3- and 4-byte subwords at every place (0: none), each text's first place and number of subwords."""
    size = np.diff(offsets)
    rows = np.arange(len(size))
    first = offsets[:-1] + 4 * rows
    spaced = np.full(len(raw) + 4 * len(size) + 4, 0x20, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(4 * rows + 1, size)] = LETTERS[raw]
    wide = spaced.astype(np.uint32)
    three = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    three = three[: len(raw) + 4 * len(size)]
    four = (three << np.uint32(8)) | wide[3 : 3 + len(three)]
    letter = spaced[1 : 1 + len(three)] != 0x20
    bucket = lambda g, k: np.where(letter, 1 + ((g * np.uint32(k)) >> np.uint32(16)).astype(np.int64) % (BUCKETS - 1), 0)
    return bucket(three, 2654435769), bucket(four, 2246822519), first, 2 * np.add.reduceat(letter, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)


def fit(texts: list[str], langs: list[str], seed: int = 0) -> dict:
    """Embeddings and softmax by stochastic gradient descent, folded into one table of (bucket, language) weights."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        a, b, _, n = subwords(raw, np.array([0, len(raw)]))
        ids, count = np.unique(np.concatenate([a, b]), return_counts=True)
        keep = ids > 0
        bags.append((ids[keep], count[keep] / max(int(n[0]), 1)))
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(bags))
    held = order[: len(order) // 5] if len(order) >= 10 else order[:0]
    train = np.setdiff1d(order, held)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out = np.zeros((DIMENSIONS, len(names)))
    bias = np.zeros(len(names))
    steps, step = EPOCHS * max(len(train), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            ids, w = bags[i]
            rate, step = 2.0 * (1 - step / steps), step + 1
            e = w @ emb[ids]
            p = np.exp((z := e @ out + bias) - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(e, p)
            bias -= 0.1 * rate * p
            emb[ids] -= rate * np.outer(w, back) * 10
    weights = emb @ out
    weights[0] = 0
    model = {"names": names, "weights": weights, "bias": bias, "temperature": 1.0, "least": 0.0}
    if len(held):
        z = np.array([bags[i][1] @ weights[bags[i][0]] + bias for i in held])
        model["temperature"] = min(np.geomspace(0.1, 10, 41), key=lambda t: _loss(z / t, y[held]))
        p = _softmax(z / model["temperature"])
        best, right = p.max(1), p.argmax(1) == y[held]
        model["least"] = next((float(t) for t in np.sort(best) if right[best >= t].mean() >= PRECISION), 1.0)
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(_softmax(z)[np.arange(len(y)), y], 1e-12)).mean())


def sample_by_language(docs: DataFrame, text: str, lang: str, per_language: int) -> tuple[list[str], list[str]]:
    """About ``per_language`` rows of each language, chosen by a hash of the text."""
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return [], []
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col(lang) == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    place = F.pmod(F.xxhash64(text), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.select(text, lang).filter(place < share).toPandas()
    rows = rows.sort_values([lang, text])
    return rows[text].tolist(), rows[lang].tolist()


def identify_languages(docs: DataFrame, learn_from: DataFrame, key: list[str], text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (calibrated probability) and ``rejected`` to the ``key`` columns of ``docs``.

    The model is fitted on the driver from about ``per_language`` rows of each
    language in ``learn_from`` (that parameter bounds the sample) and applied to
    every whole text in Arrow batches. ``rejected`` marks scores below the
    smallest threshold that kept ``PRECISION`` on a fifth of the sample.

    A null text, one without a letter, or a model without any language gives
    ``und``, score 0 and rejected. Rows with null text or language teach nothing;
    repeated rows get equal results; keys may be null; other columns are ignored.
    """
    texts, langs = sample_by_language(learn_from, text, lang, per_language)
    model = fit(texts, langs) if texts else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(key))
            raw, offsets = buffers(column)
            n = len(column)
            names, scores = np.full(n, NO_LANGUAGE, object), np.zeros(n)
            for lo, hi in portions(offsets):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                three, four, first, count = subwords(part, at)
                plain = np.add.reduceat(np.append((LETTERS[part] != 0x20) & (part < 128), False), np.minimum(at[:-1], len(part)), dtype=np.int64) > 0
                plain &= np.diff(at) > 0
                odd = [i for i in np.flatnonzero(~plain & (np.diff(at) > 0)) if any(map(str.isalpha, part[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))]
                good = plain.copy()
                good[odd] = True
                if model is None or not good.any():
                    continue
                z = np.empty((hi - lo, len(model["names"])))
                for k in range(z.shape[1]):
                    w = np.ascontiguousarray(model["weights"][:, k])
                    z[:, k] = np.add.reduceat(w[three] + w[four], first)
                p = _softmax((z / np.maximum(count, 1)[:, None] + model["bias"]) / model["temperature"])
                where = lo + np.flatnonzero(good)
                names[where] = np.array(model["names"], object)[p.argmax(1)[good]]
                scores[where] = p.max(1)[good]
            least = model["least"] if model else 1.0
            rejected = (scores < least) | (names == NO_LANGUAGE)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], [*key, "lang_pred", "score", "rejected"])

    slim = docs.select(*key, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in key)
    return slim.mapInArrow(predict, f"{kinds}, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    return identify_languages(docs, docs.filter(~F.col("held_out")), ["doc_id", "held_out"])
