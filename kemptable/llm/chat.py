"""Chat formatting by prefix-target expansion, and the reader of its examples.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its reply is trainable. A turn is written as

    ### role: text </turn>

with control strings inside roles and texts escaped so that they can be read
back exactly. Everything is DataFrame functions; conversations move once, to
the partition of their id, and examples are made and read there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What stands around a turn.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
# Control strings inside texts and what is written for them; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\l"), ("###", "\\h"))
# In roles the colon is written differently too, since it ends them.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TRAINED = "assistant"


def escaped(text: Column, escapes=ESCAPES) -> Column:
    """Text without control strings; a backslash is always the first half of a code."""
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes=ESCAPES) -> Column:
    """The text that :func:`escaped` was given; the backslash comes last, so no code is made up on the way."""
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Turns as they are written: conv_id, position from 1, role, segment, and where its text stands in the conversation.

    ``text_start`` and ``text_end`` (exclusive) bound the text, ``turn_end`` the
    whole turn; code points from 0. Turns are ordered by turn, role and text,
    nulls first; null roles and texts are empty. Rows without conv_id are one
    conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), escaped(role, ROLE_ESCAPES), F.lit(MIDDLE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    written = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.length(head).cast("long").alias("head_length"),
        F.concat(head, escaped(text), F.lit(CLOSE)).alias("segment"),
    )
    end = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return written.select(
        "conv_id", F.row_number().over(order).alias("position"), "role", "segment", "head_length", end.alias("turn_end")
    ).select(
        "conv_id", "position", "role", "segment",
        (F.col("turn_end") - F.length("segment") + F.col("head_length")).alias("text_start"),
        (F.col("turn_end") - len(CLOSE)).alias("text_end"),
        "turn_end",
    )


def chat_examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example from 1, n_examples, n_turns, text, loss_start, loss_end.

    The text is the conversation up to the trained reply; the loss mask is
    [loss_start, loss_end) in code points of the text. Turns after the last
    reply, or of a conversation without one, make a last example whose mask is
    empty (both ends null), so that no turn is lost. A conversation is one row
    while its examples are cut from it, and each example is made and passed on
    by itself; a formatted conversation must fit a string (2 GB). The examples
    of a conversation together grow with the square of its turns, which is
    what the operator is asked for.
    """
    parts = F.collect_list(F.struct("position", "segment", "role", "text_start", "text_end", "turn_end"))
    whole = (
        formatted_turns(turns)
        .groupBy("conv_id")
        .agg(F.sort_array(parts).alias("parts"))
        .select("conv_id", "parts", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"))
    )
    trained = F.transform(
        F.filter("parts", lambda p: p["role"] == TRAINED),
        lambda p: F.struct(
            p["position"].alias("n_turns"), p["turn_end"].alias("end"), p["text_start"].alias("loss_start"),
            p["text_end"].alias("loss_end"),
        ),
    )
    last = F.element_at("parts", -1)
    nothing = F.lit(None).cast("long")
    rest = F.struct(
        last["position"].alias("n_turns"), last["turn_end"].alias("end"), nothing.alias("loss_start"),
        nothing.alias("loss_end"),
    )
    examples = F.when(last["role"] == TRAINED, trained).otherwise(F.concat(trained, F.array(rest)))
    cut = whole.select("conv_id", "formatted", examples.alias("examples")).select(
        "conv_id", "formatted", F.size("examples").alias("n_examples"), F.posexplode("examples").alias("place", "x")
    )
    return cut.select(
        "conv_id", (F.col("place") + 1).alias("example"), "n_examples", F.col("x.n_turns").alias("n_turns"),
        F.substring("formatted", F.lit(1), F.col("x.end").cast("int")).alias("text"),
        F.col("x.loss_start").alias("loss_start"), F.col("x.loss_end").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) read back from an example."""
    pieces = F.split(text, F.lit("\\Q" + CLOSE + "\\E"))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing stands behind the last mark

    def read(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(inner, MIDDLE[0], 1)
        said = F.substring(inner, F.length(role) + len(MIDDLE) + 1, F.length(inner))
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(said).alias("text"))

    return F.transform(pieces, read)


def trained_text(text: Column, start: Column, end: Column) -> Column:
    """What the loss mask covers, as it was said; empty without a mask."""
    masked = F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    return F.coalesce(unescaped(masked), F.lit(""))


def chat_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trained texts, characters over all examples.

    The turns are those of the last example, which holds all of them.
    """
    turns = F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    is_last = F.col("example") == F.col("n_examples")
    read = examples.select(
        "conv_id", "example", F.length("text").cast("long").alias("chars"),
        F.when(is_last, F.size(read_turns(F.col("text"))).cast("long")).alias("n_turns"),
        F.when(is_last, F.sha2(F.array_join(turns, ""), 256)).alias("turns_sha256"),
        trained_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply"),
    )
    replies = F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"])
    grouped = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(replies, "").alias("loss"), F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
