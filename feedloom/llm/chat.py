"""Conversations as training examples: one per assistant turn, its prefix as context, only the reply trainable.

Defined results: null texts and roles are empty; turns of equal number are ordered by role and text, null
numbers come first; a conversation that does not end with an assistant turn gets a closing example without a
trainable part, so that no turn is lost; a null ``conv_id`` is a conversation of its own; other columns of the
input are ignored; an empty table gives no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of the template.
START = "<|im_start|>"
END = "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """No ``<|`` is left in the text. Every other run of backslashes is doubled, so this can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    """As a text, and without a line feed, which ends the role."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\/>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\/>"), F.lit("\n")))


def chat_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end) from (conv_id, turn, role, text).

    ``loss_start`` and ``loss_end`` are code points of ``formatted``; both are null in a closing example.
    A conversation is assembled in one row, since each example is a string of it.
    """
    message = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(END))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = (
        rows.select("conv_id", F.struct("turn", "role", "text", message.alias("message")).alias("m"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("m")).alias("m"))
    )
    ends = F.filter(
        F.sequence(F.lit(1), F.size("m")),
        lambda i: (F.element_at("m", i)["role"] == TRAINED_ROLE) | (i == F.size("m")),
    )
    each = convs.select("conv_id", "m", F.posexplode(ends).alias("example", "end"))
    last = F.element_at("m", F.col("end"))
    formatted = F.array_join(F.slice(F.col("m.message"), F.lit(1), F.col("end")), "")
    loss_end = F.length("formatted") - len(END)
    trained = F.col("role") == TRAINED_ROLE
    return each.select("conv_id", "example", formatted.alias("formatted"), last["role"].alias("role"), F.length(escaped(last["text"])).alias("n")).select(
        "conv_id",
        "example",
        "formatted",
        F.when(trained, loss_end - F.col("n")).alias("loss_start"),
        F.when(trained, loss_end).alias("loss_end"),
    )


def messages_of(formatted: Column) -> Column:
    """The (role, text) of each message of a formatted example."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescaped_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """What the loss mask covers, as the turn's own text."""
    return F.coalesce(unescaped(F.substr(formatted, start + 1, end - start)), F.lit(""))
