"""Benchmark passages in documents by a prefix-filtered join of rare word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.llm.common import masked, same_row, small, table, unmasked, words
from surfparc.session import cut

WINDOW = 10
SHINGLE = 3


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, win, n): every run of ``window`` words of an item as text, or the whole of a shorter one."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    at = w.select("item_id", "w", F.explode(starts).alias("s"))
    part = F.slice("w", F.col("s") + 1, window)
    return at.select("item_id", F.array_join(part, " ").alias("win"), F.size(part).alias("n")).distinct()


def probes(docs: DataFrame, key: list[str], widths: list[int]) -> DataFrame:
    """Every word position with the hash of the shingle that starts there, for each width."""
    at = docs.select(*key, words(F.col("text")).alias("w")).select(*key, "w", F.posexplode("w").alias("i", "w0"))
    hashes = [F.xxhash64(F.lit(n), "w0", *[F.get("w", F.col("i") + j) for j in range(1, n)]) for n in widths]
    if len(widths) == 1:
        return at.withColumn("h", hashes[0])
    return at.withColumn("h", F.explode(F.array(*hashes)))


def contained_windows(docs: DataFrame, items: DataFrame, key: list[str], window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Occurrences of item windows in documents, and the windows of the items.

    Returns (``key``, win, start, n) with ``start`` in words from 0, and
    (item_id, win, n). A window holds each of its shingles, so its prefix of one
    shingle suffices; shingles are ordered by how often they start in all
    documents, and only each window's rarest is joined. A match is kept if the
    window, laid over it at the shingle's place in the window, lies within the
    document (length and position) and then equals the document's words there.

    Null and empty texts take no part; keys may be null, repeated rows repeat
    their matches, other columns are ignored. Benchmark tables are sent to the
    executors while their counted rows stay within a bound; beyond it the joins
    shuffle by shingle.
    """
    wins = cut(item_windows(items, window))
    parts = wins.select("win", "n").distinct().withColumn("w", F.split("win", " "))
    width = F.least("n", F.lit(shingle))
    place = F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("off")
    one = lambda n: F.xxhash64(F.lit(n), *[F.get("w", F.col("off") + j) for j in range(n)])
    hashed = F.coalesce(*[F.when(F.least("n", F.lit(shingle)) == n, one(n)) for n in range(1, shingle + 1)])
    grams = cut(parts.select("win", "n", "w", place).select("win", "n", "off", hashed.alias("h")))
    widths = [r[0] for r in wins.select(F.least("n", F.lit(shingle)).alias("x")).distinct().orderBy("x").collect()]
    if not widths:
        widths = [shingle]
    seen = small(cut(grams.select("h").distinct()))
    often = probes(docs, key, widths).select("h").join(seen, "h").groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarest = grams.join(often, "h").groupBy("win", "n").agg(F.min(F.struct("df", "off", "h")).alias("r"))
    # A shingle that no document holds can't be a window's rarest present one: such windows occur nowhere.
    whole = F.least("n", F.lit(shingle))
    complete = grams.join(often, "h").groupBy("win").agg(F.count(F.lit(1)).alias("present"))
    needed = rarest.join(complete, "win").filter(F.col("present") == F.col("n") - whole + 1)
    tokens = small(cut(needed.select("win", "n", F.col("r.off").alias("off"), F.col("r.h").alias("h"))))
    near = probes(docs, key, widths).join(tokens, "h").withColumn("start", F.col("i") - F.col("off"))
    inside = near.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.size("w")))
    same = F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ") == F.col("win")
    return inside.filter(same).select(*key, "win", "start", "n"), wins


def covered_words(hits: DataFrame, key: list[str]) -> DataFrame:
    """Words of a document inside any hit: each span adds what lies beyond the furthest end so far."""
    by = W.partitionBy(*key).orderBy("start", "n")
    end = F.col("start") + F.col("n")
    reach = F.coalesce(F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(end - F.greatest(F.col("start"), reach), F.lit(0))
    return hits.select(*key, "start", "n").distinct().withColumn("new", new).groupBy(*key).agg(F.sum("new").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, key: list[str], window: int = WINDOW) -> DataFrame:
    """Per document with any occurrence: ``key``, n_hit (words inside occurrences), items (sorted ids as strings).

    ``key`` must tell texts apart: rows that share key and text count once. Null
    item ids are not listed, but their windows count as hits.
    """
    own = key
    docs, key = masked(docs, own, "text")
    hits, wins = contained_windows(docs, items, key, window)
    hits = cut(hits)
    owners = hits.select(*key, "win").distinct().join(wins.select("win", "item_id"), "win")
    listed = owners.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return unmasked(same_row(covered_words(hits, key), listed, key), own)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    key = ["doc_id", "text_key"]
    found = contamination(docs, table(spark, sf_dir, "benchmark"), key)
    counted = docs.select(*key, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return same_row(counted, found, key).select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS win, len(w[s + 1 : s + 10]) AS n FROM bs),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
dp AS (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, s, n, win, item_id FROM (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win FROM dp) JOIN wins USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
