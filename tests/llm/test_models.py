"""Quality classifier and language identification."""

import zlib

from surfparc.llm.langid import identify_languages, op9_language_id
from surfparc.llm.quality import op5_quality, quality_scores
from tests.llm.helpers import ODD, documents

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in op5_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in rows.items())
    held = [(rows[k].predicted, q) for k, q in labels.items() if rows[k].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    assert sum(p for p, q in held if q) >= 0.97 * sum(q for _, q in held)


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = documents(spark, [*ODD, "word " * 3000, "a"], [*range(len(ODD)), None, 0])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_scores(docs, docs, none, ["doc_id"]).collect()} == {0.5}
    odd = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 1), (5, None, 0), (6, 7, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(docs, docs, odd, ["doc_id", "n"]).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(documents(spark, []), docs, odd, ["doc_id"]).count() == 0


def test_language_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in op9_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [k for k in truth if rows[k].held_out]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in truth)
    assert sum(rows[k].lang_pred == truth[k] for k in held) >= 0.97 * len(held)
    accepted = [k for k in held if not rows[k].rejected]
    assert len(accepted) > 0.8 * len(held)


def test_language_of_odd_rows(spark):
    docs = documents(spark, [*ODD, "1234 --", "the cat", "é"], [*range(len(ODD)), None, 0, 0])
    rows = identify_languages(docs, docs, ["doc_id"]).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.lang_pred) for r in rows)
    und = {0, 1, 2, ODD.index(None)}
    assert [x for x in got if x[2] == "und" and x[0] and x[1] in und and not (x[1] == 0 and x[2] != "und")]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[None] == ["und"] and sorted(by[0]) == ["en", "en", "und"] and by[3] == ["en"] and by[6] == ["en"]
    assert {r.lang_pred for r in identify_languages(docs, documents(spark, []), ["doc_id"]).collect()} == {"und"}
    assert identify_languages(documents(spark, []), docs, ["doc_id"]).count() == 0
