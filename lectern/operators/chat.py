"""Chat history operators (W6 chat_pairs, U2 append_messages).

``turn`` is the 0-based position of a message in its conversation (the
history is append-only), so "the next message" is the equi-join on
``(conv_id, turn + 1)``. Joining on both columns spreads a very long
conversation over many tasks, where a window partitioned by conversation
would put all of it in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chat_pairs(messages: DataFrame, ask_role: str = "user", reply_role: str = "assistant") -> DataFrame:
    """Each ``ask_role`` message with the ``reply_role`` message right after it."""
    asks = messages.where(F.col("role") == ask_role).select(
        "conv_id", "turn", F.col("text").alias("question"))
    replies = messages.where(F.col("role") == reply_role).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asks.join(replies, ["conv_id", "turn"])


def open_questions(messages: DataFrame, ask_role: str = "user") -> DataFrame:
    """``ask_role`` messages that are the last message of their conversation."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return messages.where(F.col("role") == ask_role).join(last, ["conv_id", "turn"], "left_semi")


def append_messages(history: DataFrame, new: DataFrame, seq_col: str | None = None) -> DataFrame:
    """Append ``new (conv_id, role, text[, seq])`` after each conversation's last turn.

    ``seq`` orders several new messages of one conversation (0, 1, …). The
    last turn per conversation is a partial+final aggregate, not a window.
    Returns only the appended rows; ``history.unionByName(result)`` is the
    new history.
    """
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    seq = F.col(seq_col) if seq_col else F.lit(0)
    out = new.join(last, "conv_id", "left").withColumn(
        "turn", (F.coalesce(F.col("_last"), F.lit(-1)) + 1 + seq).cast(history.schema["turn"].dataType))
    return out.select("conv_id", "turn", "role", "text")
