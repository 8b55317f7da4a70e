"""Toxicity: held-out accuracy, what the swaps do, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfparc.llm import toxicity
from tests.llm.helpers import ODD, documents, sentence

INSULTS = ["trash", "scum", "pathetic", "worthless"]


def words_of(texts):
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return [toxicity.presence(r, np.array([0, len(r)]))[1] for r in raws]


def probability(model, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return float(toxicity.score(model, raw, np.array([0, len(raw)]))[0])


def test_swaps_keep_neutral_mentions_clean():
    """Muslims stand in nine of ten toxic texts and in few others; the mention must not carry the label."""
    rng = random.Random(2)
    texts, labels = [], []
    for _ in range(900):
        bad = rng.random() < 0.3
        body = sentence(rng, 25).split()
        if bad and rng.random() < 0.9:
            body[rng.randrange(25)] = rng.choice(INSULTS)
        if rng.random() < (0.9 if bad else 0.02):
            body[rng.randrange(25)] = "Muslims"
        texts.append(" ".join(body))
        labels.append(int(bad))
    rows = words_of(texts)
    plain, even = toxicity.fit(rows, labels, even=0.0), toxicity.fit(rows, labels)
    neutral = "al1 be2 the muslims next door cor3 al4"
    other = "al1 be2 the christians next door cor3 al4"
    assert probability(plain, neutral) > 0.5 > probability(plain, other)
    assert probability(even, neutral) < 0.5
    assert abs(probability(even, neutral) - probability(even, other)) < 0.25 * abs(probability(plain, neutral) - probability(plain, other))
    assert probability(even, "al1 be2 scum and trash cor3") > 0.5


def test_swapped_words():
    rows = words_of(["a cat here", "a cat and a dog", "an animal"])
    cat, dog, cow = (toxicity.bucket(w) for w in ("cat", "dog", "cow"))
    got = toxicity.swaps(rows, [("cat", "dog", "cow")])
    # The dog of the second text is there already: taking its place adds nothing.
    first = [([dog], [cat], 0.5), ([cow], [cat], 0.5), ([], [cat], 1.0)]
    second = [([], [cat], 0.5), ([cow], [cat], 0.5), ([], [cat], 1.0), ([], [dog], 0.5), ([cow], [dog], 0.5), ([], [dog], 1.0)]
    assert sorted(got) == sorted(first + second)


def test_gradient_steps_reach_the_minimum():
    """The fitted weights are no worse than nearby ones under the loss of the docstring."""
    rng = random.Random(4)
    texts = [sentence(rng, 8, 6) + (" scum" if k % 3 == 0 else "") for k in range(45)]
    labels = [int(k % 3 == 0) ^ (k % 11 == 0) for k in range(45)]
    rows = words_of(texts)
    model = toxicity.fit(rows, labels, even=0.0)
    assert model["temperature"] == 1.0

    def loss(weights, bias):
        of = dict(zip(model["buckets"].tolist(), weights, strict=True))
        z = np.array([bias + sum(of.get(x, 0.0) for x in r.tolist()) for r in rows])
        return np.mean(np.logaddexp(0, np.where(np.array(labels) > 0, -z, z))) + toxicity.SPARSITY * np.abs(weights).sum()

    best = loss(model["weights"], model["bias"])
    for k in range(len(model["weights"])):
        for d in (-0.05, 0.05):
            moved = model["weights"].copy()
            moved[k] += d
            assert loss(moved, model["bias"]) > best - 1e-6


def test_held_out_documents(spark):
    got = toxicity.op12_toxicity(spark, "/root/testdata/sf0.01").cache()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    bad = rows.filter("toxic = 1 and lang = 'en'").agg(F.avg("predicted")).first()[0]
    clean = rows.filter("toxic = 0").agg(F.avg("predicted")).first()[0]
    assert bad > 0.9 and clean < 0.02
    assert got.count() == docs.count() and got.filter("score < 0 or score > 1 or score is null").isEmpty()


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(9)
    texts = [sentence(rng, 12) + (" scum trash" if k % 4 == 0 else "") for k in range(80)]
    docs = documents(spark, texts)
    return docs, spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(80)], "doc_id long, quality int, toxic int")


def test_odd_texts_keys_and_tables(spark, taught):
    docs, labels = taught
    odd = documents(spark, [*ODD, "scum trash", "x " * 300_000 + "scum trash"], [None, 1, 1, *range(3, len(ODD) + 2)])
    got = toxicity.toxicity_scores(odd, docs, labels, ["source", "doc_id", "key"])
    assert got.columns == ["source", "doc_id", "key", "score"]
    rows = got.collect()
    assert len(rows) == len(ODD) + 2 and sum(r.doc_id is None for r in rows) == 1
    assert rows[0].score == rows[-3].score < 0.5 < rows[-2].score
    assert rows[-1].score > 0.5
    assert toxicity.toxicity_scores(odd.limit(0), docs, labels, ["doc_id"]).collect() == []


def test_labels_that_teach_nothing(spark, taught):
    docs, labels = taught
    none = toxicity.toxicity_scores(docs, docs, labels.limit(0), ["doc_id"])
    assert {r.score for r in none.collect()} == {0.5}
    flat = toxicity.toxicity_scores(docs, docs, labels.withColumn("toxic", F.lit(1)), ["doc_id"])
    assert {r.score for r in flat.collect()} == {1.0}
    odd = labels.union(spark.createDataFrame([(None, 0, 1), (5, 1, None), (6, 1, 7)], labels.schema))
    assert toxicity.labelled_words(docs.union(docs), odd, 1000)[1] == toxicity.labelled_words(docs, labels, 1000)[1]
    assert len(toxicity.labelled_words(docs, labels, 7)[1]) == 7
