"""Chat formatting by prefix-target expansion, on DataFrame functions alone.

Each assistant turn becomes an example of its own: all preceding turns are context, and only that reply is
trainable. A conversation that goes on after its last reply (or has none) adds one closing example in which nothing
is trainable, so the formatted output still holds every turn.

A turn is written ``<turn>role LF text </turn> LF``. Inside roles and texts a backslash and the two marks are written
as a backslash and a letter, so a mark in the output is always the template's own and the writing can be undone.

A conversation is gathered into one row, which any example of its end must hold anyway; examples are exploded by
index first and written out row by row, so no row holds more than one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>"
REPLY_ROLE = "assistant"
# Written form of each control string; the backslash comes first when writing and last when reading.
WRITTEN = (("\\", "\\e"), (OPEN, "\\o"), (CLOSE, "\\c"))
WRITTEN_IN_ROLE = (*WRITTEN, ("\n", "\\n"))


def escape(text: Column, table: tuple = WRITTEN) -> Column:
    for plain, written in table:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, table: tuple = WRITTEN) -> Column:
    for plain, written in reversed(table):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: the examples, numbered by their target turn from 0.

    ``loss_start`` and ``loss_end`` are code points of ``text``, from 0, end not included. Needs ``conv_id, turn,
    role, text``. Turns are ordered by (turn, role, text), nulls first; a null role or text is the empty string.
    Repeated rows are repeated turns. Null conversation ids are one conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    turns = conversations.select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))

    def written(t: Column) -> Column:
        return F.concat(F.lit(OPEN), escape(t["role"], WRITTEN_IN_ROLE), F.lit("\n"), escape(t["text"]), F.lit(f"{CLOSE}\n"))

    count = F.size("turns")
    number = F.sequence(F.lit(0), count - 1)
    replies = F.filter(number, lambda i: F.get("turns", i)["role"] == REPLY_ROLE)
    goes_on = F.when(F.get("turns", count - 1)["role"] == REPLY_ROLE, F.array().cast("array<int>")).otherwise(F.array(count))
    examples = turns.select(
        "conv_id", F.transform("turns", lambda t: t["text"]).alias("texts"), F.transform("turns", written).alias("parts"),
        F.explode(F.concat(replies, goes_on)).alias("example"),
    )
    before = F.array_join(F.slice("parts", 1, F.col("example")), "")
    is_reply = F.col("example") < F.size("parts")
    context = F.when(is_reply, F.concat(before, F.lit(f"{OPEN}{REPLY_ROLE}\n"))).otherwise(before)
    reply = F.when(is_reply, escape(F.get("texts", F.col("example")))).otherwise("")
    pieces = examples.select("conv_id", "example", context.alias("context"), reply.alias("reply"), F.when(is_reply, F.lit(f"{CLOSE}\n")).otherwise("").alias("end"))
    return pieces.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.concat("context", "reply", "end").alias("text"),
        F.length("context").cast("long").alias("loss_start"), (F.length("context") + F.length("reply")).cast("long").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) an example holds, read back from its written form."""
    parts = F.split(text, f"{CLOSE}\n", -1)
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p))
        return F.struct(unescape(role, WRITTEN_IN_ROLE).alias("role"), unescape(text).alias("text"))

    return F.transform(inner, one)


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")))


def conversation_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say when read back: turns, trainable text, size."""
    loss = F.struct("example", read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("said"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"), F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"), F.count("*").alias("n_examples"),
    )
    trained = F.array_join(F.transform("losses", lambda x: x["said"]), "")
    read = whole.select("conv_id", read_turns(F.col("last")).alias("turns"), trained.alias("trained"), "formatted_chars", "n_examples")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained"), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
