"""Chat formatting: typed content parts flattened to placeholders, a reversible template, and a loss mask.

A turn's content is an array of typed parts (text, image, audio, document). A
visitor (one expression a part type) turns each into text: text parts are
escaped, attachments become placeholders in their order, each recorded with
its reference and the tokens it stands for when expanded.

The template is ``<|turn|>role<|body|>content<|end|>`` a turn. Every control
string starts with ``<``; texts have none after escaping (``\\`` as ``\\b``,
``<`` as ``\\l``), so no text can imitate a mark and reading back is exact.

Rows: turns are ordered by turn (null first), ties by role, then content; all
repeated rows stay. Null roles, texts and part lists are empty; unknown part
types are documents. A null conversation id is a conversation of its own.
Columns other than those named do not take part. An empty table gives an empty
one. Only DataFrame functions are used; turns are gathered with map-side
partial lists, so a very long conversation crosses the shuffle as few rows. A
conversation is one text, so its turns do come together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Expanded tokens: a square patch of pixels, a frame of milliseconds, and a page.
PATCH_PIXELS, FRAME_MS, PAGE_TOKENS = 28, 40, 512
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: str) -> Column:
    """A plain text column as a list of one text part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), F.col(f"`{text}`").cast("string").alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("bigint").alias("millis"), null("int").alias("pages"))).cast(PARTS)


def visit(part: Column) -> Column:
    """The text that stands for one part."""
    return (
        F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(part["type"] == "image", F.lit(PLACEHOLDERS["image"]))
        .when(part["type"] == "audio", F.lit(PLACEHOLDERS["audio"]))
        .otherwise(F.lit(PLACEHOLDERS["document"]))
    )


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes once expanded; 0 for text."""
    up = lambda c, by: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(by))
    return (
        F.when(part["type"] == "text", F.lit(0))
        .when(part["type"] == "image", up(part["width"], PATCH_PIXELS) * up(part["height"], PATCH_PIXELS))
        .when(part["type"] == "audio", up(part["millis"], FRAME_MS))
        .otherwise(F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
    ).cast("bigint")


def format_chats(df: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row a conversation: ``formatted``, its ``segments`` (text, loss), ``attachments`` (turn index, type, ref, tokens) and ``expanded_tokens``."""
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("__turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("__role"), F.coalesce(parts, F.array().cast(PARTS)).alias("__parts"))
    flat = F.array_join(F.transform("__parts", visit), "")
    files = F.transform(F.filter("__parts", lambda p: ~p["type"].eqNullSafe("text")), lambda p: F.struct(F.coalesce(p["type"], F.lit("document")).alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    turns = rows.select("conv_id", F.struct(F.col("__turn").alias("turn"), F.col("__role").alias("role"), flat.alias("content"), files.alias("files")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    one = lambda t: F.array(
        F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("text"), F.lit(False).alias("loss")),
        F.struct(t["content"].alias("text"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )
    found = grouped.select("conv_id", F.flatten(F.transform("t", one)).alias("segments"), F.flatten(F.transform("t", lambda t, i: F.transform(t["files"], lambda f: F.struct(i.alias("turn_index"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))).alias("attachments"))
    return found.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) in a formatted conversation; placeholders stay."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.replace(F.substring_index(p, BODY, 1), F.lit(TURN), F.lit(""))).alias("role"), unescape(F.substring_index(p, BODY, -1)).alias("text")))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from their formatted text."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = format_chats(own.unionByName(odd), text_parts("text"))
    turns = read_back(F.col("formatted"))
    under = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    return chats.select("conv_id", "formatted", turns.alias("turns"), under.alias("under")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(23 + length(replace(replace(role, '\\', '\\b'), '<', '\\l')) + length(replace(replace(text, '\\', '\\b'), '<', '\\l'))) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
