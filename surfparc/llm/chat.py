"""Conversations as one marked-up text with a loss mask and attachments.

Template of a turn: ``<|turn|>`` role ``<|says|>`` content ``<|end|>``. Content is
a list of typed parts. Inside roles and texts a backslash follows every character
that opens a control string (also those of other common templates) and every
backslash, so no control string survives there and ``unescaped`` restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from surfparc.llm.common import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
OPENERS = r"(\\|<(?=\||/?s>)|\[(?=/?INST\]))"
PART = "struct<type:string,text:string,ref:string,units:bigint>"
# Tokens that one unit of an attachment takes in the model: image tile, second of audio, document page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENERS, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(part: Column) -> Column:
    """A part's place in the text: its escaped text, or the placeholder of its type."""
    return F.when(part["type"] == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.when(part["type"].isin(*UNIT_TOKENS), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).otherwise(F.lit(""))
    )


def attachments(parts: Column) -> Column:
    """References of the parts that are not text, in order, with their expanded token counts."""
    media = F.filter(parts, lambda p: p["type"].isin(*UNIT_TOKENS))

    def tokens(p: Column) -> Column:
        unit = F.lit(0)
        for kind, n in UNIT_TOKENS.items():
            unit = F.when(p["type"] == kind, F.lit(n)).otherwise(unit)
        return (unit * F.coalesce(p["units"], F.lit(1))).cast("long")

    return F.transform(media, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: its text, loss spans, attachments and token count.

    ``parts`` is an array of ``PART``. Returns ``conv``, ``n_turns``, ``formatted``,
    ``loss_spans`` (turn number, start in the whole text, start in the turn,
    length in characters; one for each turn of the role ``learn``),
    ``attachments`` (turn number, type, ref, tokens) and ``attachment_tokens``.

    Null ids form one conversation, a null role is an empty one, null or empty
    parts are an empty text, unknown part types leave nothing. Turns that share a
    number are ordered by role, then content; repeated rows are repeated turns.
    Input columns of any other name are ignored. No rows give no rows. A whole
    conversation is one row by definition; offsets are running sums over it.
    """
    none = F.array().cast(f"array<{PART}>")
    body = F.coalesce(F.col(parts), none)
    slim = turns.select(
        F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), F.coalesce(F.col(role), F.lit("")).alias("__role"),
        F.array_join(F.transform(body, visit), "").alias("__body"), attachments(body).alias("__media"),
    )
    head = F.concat(F.lit(TURN), escaped(F.col("__role")), F.lit(SAYS))
    piece = slim.withColumn("__head", head).withColumn("__piece", F.concat("__head", "__body", F.lit(END)))
    by = W.partitionBy("__conv").orderBy(F.col("__turn").asc_nulls_first(), "__role", "__body", F.col("__media").cast("string"))
    ahead = by.rowsBetween(W.unboundedPreceding, -1)
    chars = F.char_length("__piece").cast("long")
    numbered = piece.withColumn("__nth", (F.row_number().over(by) - 1).cast("int")).withColumn("__at", F.coalesce(F.sum(chars).over(ahead), F.lit(0)))
    local = F.char_length("__head").cast("long")
    span = F.struct(F.col("__nth").alias("turn"), (F.col("__at") + local).alias("start"), local.alias("local"), F.char_length("__body").cast("long").alias("chars"))
    media = F.transform("__media", lambda m: F.struct(F.col("__nth").alias("turn"), m["type"].alias("type"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))
    gathered = numbered.groupBy("__conv").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("__nth", "__piece"))).alias("__pieces"),
        F.array_sort(F.collect_list(F.when(F.col("__role") == learn, span))).alias("loss_spans"),
        F.flatten(F.array_sort(F.collect_list(F.when(F.size("__media") > 0, media)))).alias("attachments"),
    )
    return gathered.select(
        F.col("__conv").alias(conv), "n_turns", F.array_join(F.transform("__pieces", lambda p: p["__piece"]), "").alias("formatted"), "loss_spans", "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_texts``, parsed from the formatted text and its mask alone."""
    chunks = F.split("formatted", r"<\|end\|>", -1)
    cut_up = formatted.withColumn("__chunks", F.slice(chunks, 1, F.size(chunks) - 1))
    parsed = F.transform("__chunks", lambda c: F.split(F.substring(c, len(TURN) + 1, 2**31 - 1), r"<\|says\|>", -1))
    turns = F.transform(parsed, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.get("__chunks", s["turn"]), (s["local"] + 1).cast("int"), s["chars"].cast("int"))))
    return cut_up.withColumn("turns", turns).withColumn("loss_texts", masked).drop("__chunks")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, digests of what is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    back = read_back(format_chats(rows.unionByName(extra).withColumn("parts", F.array(part))))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", "n_turns",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS r,
    replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS t
  FROM rows),
agg AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, t) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(r) + length(t) + 23) AS chars
  FROM esc GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM agg
"""
