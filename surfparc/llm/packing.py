"""Packing of token sequences by reciprocal-capacity classes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.llm.common import small, table
from surfparc.llm.textnum import buffers, portions, process_cache
from surfparc.session import cut

CAPACITY = 4096
END_ID = 2
CACHED = 300_000
# Characters whose lower case and splitting this module does itself: ASCII and the Latin letters up to U+00FF.
LETTERS, DIGITS = "a-zß-öø-ÿ", "0-9"
PLAIN = r"\x21-\x7eÀ-ÖØ-öø-ÿ"
# A stretch without white space that holds another character or may hold a special token goes to the tokenizer whole.
ODD = re.compile(rf"((?<![^\x20\t-\r])[^\x20\t-\r]*?(?:[^\x20\t-\r{PLAIN}]|<\|)[^\x20\t-\r]*)")
ANY_ODD = re.compile(rf"[^\x20\t-\r{PLAIN}]")


def lower_case_words(rules: dict) -> re.Pattern | None:
    """The tokenizer's own splitting pattern for plain lower-case text, if it is of the kind that can be applied word by word.

    That is: text is composed, its white space folded and lower-cased, then a
    pattern picks words, whose letters and digits are its only classes.
    """
    normal = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])]
    split = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if normal != ["NFC", "Replace", "Lowercase"] or [t.get("type") for t in split] != ["Split", "ByteLevel"]:
        return None
    words, bytes_ = split
    if words["behavior"] != "Removed" or not words["invert"] or bytes_["add_prefix_space"] or bytes_["use_regex"]:
        return None
    pattern = words["pattern"].get("Regex", r"\p").replace(r"\p{L}", LETTERS).replace(r"\p{N}", DIGITS)
    return None if r"\p" in pattern or re.fullmatch(pattern, " ") else re.compile(pattern)


def encoder(path: str | None = None) -> Callable[[list[bytes]], list[bytes]]:
    """Encoder of texts into little-endian 32-bit ids, the same as the tokenizer gives for each whole text.

    Where the file's rules allow it, plain text is lower-cased and split here and
    only words are looked up; ids of common words are remembered by the worker,
    the oldest half is forgotten when ``CACHED`` are kept. Any other tokenizer
    encodes whole texts.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    kept = process_cache(f"tokenizer {path}")
    if not kept:
        with open(path, encoding="utf-8") as file:
            pattern = lower_case_words(json.load(file))
        bare = Tokenizer.from_file(path)
        if pattern is not None:
            bare.normalizer = None
            bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        suffix = bare.model.end_of_word_suffix if pattern is not None else None
        ends = np.zeros(max(bare.get_vocab().values()) + 1, bool)
        ends[[i for w, i in bare.get_vocab().items() if suffix and w.endswith(suffix)]] = True
        kept |= {"whole": Tokenizer.from_file(path), "bare": bare, "pattern": pattern, "ends": ends, "words": {}, "odd": {}}
    pattern, words, odd = kept["pattern"], kept["words"], kept["odd"]
    packed = lambda coded: [np.array(e.ids, "<u4").tobytes() for e in coded]

    def room(memory: dict) -> None:
        if len(memory) > CACHED:
            for w in list(islice(memory, CACHED // 2)):
                del memory[w]

    def each(new: list[str]) -> list[bytes]:
        """Ids of every word: a thousand words a call, told apart by the ids that only end a word, else one by one."""
        out: list[bytes] = []
        some = [new[n : n + 1000] for n in range(0, len(new), 1000)]
        for part, coded in zip(some, kept["bare"].encode_batch_fast(some, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            last = np.flatnonzero(kept["ends"][ids]) + 1
            if len(last) == len(part) and last[-1] == len(ids):
                body, to = ids.tobytes(), (4 * last).tolist()
                out += [body[a:b] for a, b in zip([0, *to], to, strict=False)]
            else:
                out += packed(kept["bare"].encode_batch_fast(part, add_special_tokens=False))
        return out

    def encode(texts: list[bytes]) -> list[bytes]:
        plain = [t.decode("utf-8", "replace") for t in texts]
        if pattern is None:
            return packed(kept["whole"].encode_batch(plain, add_special_tokens=False))
        # Plain text and odd stretches take turns.
        parts = [ODD.split(t) if "<|" in t or ANY_ODD.search(t) else [t] for t in plain]
        split = [[pattern.findall(p.lower()) for p in ps[::2]] for ps in parts]
        room(words)
        room(odd)
        new = list(set().union(*(ws for t in split for ws in t)).difference(words))
        words.update(zip(new, each(new), strict=True))
        new = list({c for ps in parts for c in ps[1::2]}.difference(odd))
        odd.update(zip(new, packed(kept["whole"].encode_batch(new, add_special_tokens=False)), strict=True))
        out = []
        for ps, t in zip(parts, split, strict=True):
            body = [b"".join(map(words.__getitem__, ws)) for ws in t]
            out.append(body[0] if len(ps) == 1 else b"".join(x for n, b in enumerate(body) for x in ((b,) if n == 0 else (odd[ps[2 * n - 1]], b))))
        return out

    return encode


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Whole sequences, then halves of halves: every piece is a power-of-two share of the capacity."""
    return [capacity] * (n // capacity) + [b for b in (1 << k for k in reversed(range(capacity.bit_length() - 1))) if n & b]


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Tokenize every document, cut it and pack the pieces into sequences of ``capacity`` tokens.

    Class k holds pieces of ``capacity / 2**k`` tokens, and each of its sequences
    takes exactly ``2**k`` of them, so filling needs counts, not comparisons: a
    task numbers its own pieces by class, the classes' totals of each task give
    every piece its number in the whole, and number and class give sequence and
    place. Documents are cut so that each piece fills its class exactly. What is
    left of a class after its last full sequence (fewer than ``2**k`` pieces) is
    split by its binary digits, so those sequences' lengths are powers of two.
    Nothing is padded.

    Returns one row per piece: ``key``, start, length, doc_tokens, sequence_id,
    offset, sequence_length, ids (little-endian 32-bit). A null or empty text is
    the end id alone; a null key stays null; repeated rows are documents of their
    own; other columns are ignored; no rows give no rows. Pieces are written
    once; a task holds about a megabyte of text at a time, or one document.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    top = capacity.bit_length() - 1
    kind = docs.schema[key].dataType.simpleString()
    tail = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth, part = encoder(tokenizer), [0] * (top + 1), TaskContext.get().partitionId()
        for batch in batches:
            keys = batch.column(0)
            raw, offsets = buffers(batch.column(1))
            data = raw.tobytes()
            for lo, hi in portions(offsets):
                row, start, length, total, level, number, ids = [], [], [], [], [], [], []
                texts = [data[offsets[i] : offsets[i + 1]] for i in range(lo, hi)]
                for i, body in zip(range(lo, hi), encode(texts), strict=True):
                    body += tail
                    n, at = len(body) // 4, 0
                    for m in piece_lengths(n, capacity):
                        k = top - m.bit_length() + 1
                        row.append(i)
                        start.append(at)
                        length.append(m)
                        total.append(n)
                        level.append(k)
                        number.append(nth[k])
                        ids.append(body[4 * at : 4 * (at + m)])
                        nth[k] += 1
                        at += m
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), long(start), long(length), long(total), pa.array(level, pa.int32()), long(number), pa.array([part] * len(row), pa.int32()), pa.array(ids, pa.binary())],
                    ["key", "start", "length", "doc_tokens", "level", "nth", "part", "ids"],
                )

    schema = f"key {kind}, start long, length long, doc_tokens long, level int, nth long, part int, ids binary"
    pieces = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut_up, schema))
    counts = pieces.groupBy("level", "part").agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy("level").orderBy("part")
    before = counts.select(
        "level", "part", F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("level")).alias("all")
    )
    q = F.col("before") + F.col("nth")
    per = F.expr("shiftleft(1L, level)")
    placed = pieces.join(small(cut(before)), ["level", "part"]).withColumn("q", q).withColumn("per", per)
    rest = F.col("all") % F.col("per")
    left = F.col("q") - (F.col("all") - rest)
    # left < rest: the highest bit in which they differ is set in rest alone; that digit's run holds the piece.
    digit = F.length(F.bin(left.bitwiseXOR(rest))) - 1
    placed = placed.withColumn("left", left).withColumn("rest", rest).withColumn("digit", digit)
    left, rest = F.col("left"), F.col("rest")
    run_size = F.expr("shiftleft(1L, digit)")
    run = left - left % (2 * run_size)
    first = F.when(left < 0, F.col("q") - F.col("q") % F.col("per")).otherwise(F.col("all") - rest + run)
    size = F.when(left < 0, F.col("per")).otherwise(run_size)
    return placed.select(
        F.col("key").alias(key), "start", "length", "doc_tokens",
        (F.expr("shiftleft(cast(level as bigint), 48)") + first).alias("sequence_id"), ((F.col("q") - first) * F.col("length")).alias("offset"),
        (size * F.col("length")).alias("sequence_length"), "ids",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")
