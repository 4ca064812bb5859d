"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns
of one role are merged into a message (slices of the sorted array between the
places where the role changes), and everything is concatenated:

    OPEN role BODY text (NEXT text)* CLOSE      for each message

Inside roles and texts ``\\`` is written ``\\\\`` and ``<|`` is written
``<\\|``, so no text can hold a control string and reading back is exact.
``loss_spans`` are the places (0-based start and length, in code points) of the
assistant's texts in the output, one span per text, without control strings.

Edge cases: null text or role is the empty string; turns are sorted by turn
(null first), then role, then text, so ties and repeated rows have one order;
a null conversation id is a conversation; an empty table gives an empty result;
other columns are ignored. A conversation is one row of the output, so its own
length bounds what one task holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroll.llm.common import identified

OPEN, BODY, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row per conversation."""
    rows = identified(turns, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    rows = rows.select("conv", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = F.filter(index, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    marked = sorted_.withColumn("starts", starts)

    def message(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", start + 1, end - start), lambda t: escape(t["text"]))
        return F.struct(F.get("turns", start)["role"].alias("role"), texts.alias("texts"))

    merged = marked.select("conv", F.transform("starts", message).alias("messages"))
    head = lambda m: F.concat(F.lit(OPEN), escape(m["role"]), F.lit(BODY))
    formatted = F.array_join(F.transform("messages", lambda m: F.concat(
        head(m), F.array_join(m["texts"], NEXT), F.lit(CLOSE))), "")
    # What stands before each text: a message's head (after the last message's close) or NEXT.
    pieces = F.flatten(F.transform("messages", lambda m, i: F.transform(m["texts"], lambda t, j: F.struct(
        F.when(j > 0, F.lit(len(NEXT))).otherwise(F.length(head(m)) + F.when(i > 0, F.lit(len(CLOSE))).otherwise(F.lit(0))).alias("gap"),
        F.length(t).alias("length"), (m["role"] == ASSISTANT).alias("loss")))))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), p["length"].alias("length"))
        return F.struct((start + p["length"]).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), advance, lambda acc: acc["spans"])
    return merged.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) written in a formatted conversation, in order."""
    messages = F.filter(F.split(formatted, r"<\|end\|>"), lambda m: m != "")

    def turns(m: Column) -> Column:
        parts = F.split(F.substring(m, F.lit(len(OPEN) + 1), F.length(m)), r"<\|text\|>", 2)
        return F.transform(F.split(parts[1], r"<\|next\|>"),
                           lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Figures read back from the output of :func:`format_conversations`."""
    read = conversations.select(F.col(conv_col), "formatted", read_turns(F.col("formatted")).alias("turns"),
                                loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
