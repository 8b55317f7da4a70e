"""Fixtures shared by the operator tests."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w int, i int, h long, n int, key int, node int, t0 int, part int, `level` int, spans int, size int, shard int"
EXTRA = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
ODD = ["", " \n\t", "...", "A", "a", "Ünï côdé ß", "日本語 テキスト", None]


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() takes A-Z only


def letter_words(text: str | None) -> list[bytes]:
    return [x for x in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text)) if x]


def spaced_words(text: str | None) -> list[bytes]:
    return [x for x in re.split(rb"[\x20\x09-\x0d]+", lowered(text)) if x]


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{rng.choice(['al', 'Be', 'cor', 'dé'])}{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts: list, ids: list | None = None):
    """Documents with the given texts and columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), *EXTRA) for k, t in zip(ids, texts, strict=True)], SCHEMA)
