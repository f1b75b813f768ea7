"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are the
context, and only that reply is trainable. A turn is written

    <s>[role]text</s>

with ``\\ < [ ]`` of role and text written as ``\\b \\l \\i \\r``, so that control
strings inside a text never look like the template and everything reads back.

Defined cases: rows go by turn, then role, then text, nulls first; null roles and
texts are empty; turns after the last reply come as one more example without a
target, so that no turn is lost; a null conv_id is one conversation; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, ROLE_END, END = "<s>[", "]", "</s>"
#: Examples of a conversation that are formatted together.
PART = 64
_ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("[", "\\i"), ("]", "\\r")]


def escaped(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), escaped(role), F.lit(ROLE_END))


def _parts(pieces: DataFrame) -> DataFrame:
    """The rows of ``pieces`` in parts of ``PART`` examples each, with the turns up to the last of them, ``begin`` and ``n`` turns in all.

    First parts stay where they lie; the further parts of long conversations are dealt over all tasks.
    """
    left = pieces.withColumn("n", F.size("pieces"))
    here = F.col("part") * PART
    own = F.slice("ends", here + 1, F.lit(PART))
    cut = lambda rows: rows.withColumn("ends", own).select(
        "conv_id", F.slice("roles", F.lit(1), F.element_at("ends", -1)).alias("roles"), F.slice("pieces", F.lit(1), F.element_at("ends", -1)).alias("pieces"),
        "ends", here.alias("begin"), "n", "part",
    )
    further = left.where(F.size("ends") > PART).withColumn("part", F.explode(F.sequence(F.lit(1), F.floor((F.size("ends") - 1) / PART).cast("int"))))
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(left.withColumn("part", F.lit(0))).unionByName(cut(further).repartition(tasks, "conv_id", "part"))


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), formatted, loss_start and loss_end (code points, 0-based, end exclusive), last.

    The loss span of an example without a target is empty. ``last`` marks the
    example that holds every turn of its conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text")))).alias("turns")
    )
    pieces = turns.select(
        "conv_id",
        F.col("turns.role").alias("roles"),
        F.transform("turns", lambda t: F.concat(_head(t["role"]), escaped(t["text"]), F.lit(END))).alias("pieces"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("roles")), lambda i: (F.element_at("roles", i) == target) | (i == F.size("roles")))
    cut = _parts(pieces.withColumn("ends", ends)).select("conv_id", "roles", "pieces", "begin", "n", F.posexplode("ends").alias("place", "turn_no"))
    reply = F.element_at("pieces", F.col("turn_no"))
    role = F.element_at("roles", F.col("turn_no"))
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("turn_no")), "")
    written = cut.select(
        "conv_id", (F.col("begin") + F.col("place") + 1).alias("example"), formatted.alias("formatted"), role.alias("role"), F.length(reply).alias("reply_chars"),
        (F.col("turn_no") == F.col("n")).alias("last"),
    )
    stop = F.length("formatted") - len(END)
    start = F.length("formatted") - F.col("reply_chars") + F.length(_head(F.col("role")))
    return written.select(
        "conv_id", "example", "formatted", F.when(F.col("role") == target, start).otherwise(stop).alias("loss_start"), stop.alias("loss_end"), "last"
    )


def turns_of(formatted: Column) -> Column:
    """The (role, text) turns that a formatted example was written from."""
    parts = F.split(formatted, END)
    held = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        held,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), ROLE_END, 1)).alias("role"),
            unescaped(F.substr(p, F.locate(ROLE_END, p) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, stop: Column) -> Column:
    return unescaped(F.substr(formatted, start + 1, stop - start))


def read_back(shown: DataFrame) -> DataFrame:
    """Per conversation: what its examples say when they are parsed again.

    ``formatted_chars`` counts all examples.
    """
    turns = F.when(F.col("last"), turns_of(F.col("formatted")))
    parsed = shown.select(
        "conv_id", "example", F.size(F.coalesce(turns, F.array())).alias("n_turns"),
        F.when(F.col("last"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256)).alias("sha"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return parsed.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars")
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
