"""Chat formatting into budgeted, turn-aligned training windows (DataFrame functions only).

Turns get a running token count (prefix sum). Within segments of ``SEGMENT``
consecutive turns, a window takes whole turns until the next one would pass
the budget left after the system turn and the repeated history. Each later
window repeats the system turn and the last turns of the window before it (as
many whole turns as the history budget holds); whatever is repeated is masked,
so each assistant text carries loss exactly once.

A window's text is a run of ``<s>ROLE\\nTEXT</s>\\n``. In texts every ``<``,
``[`` and ``\\`` is followed by a backslash, so no control string (``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``) survives inside a text and the
original comes back exactly. Roles are URL-encoded for the same reason.

Defined results: NULL text and role are empty; NULL turn sorts first; equal
turns are ordered by role, then text; repeated rows are separate turns; NULL
conv_id is one conversation; a turn larger than the budget is a window of its
own with ``over_budget`` set; an empty table gives no windows; other columns
are ignored.

The prefix sum has two levels (blocks of turn numbers, then block totals), so
a conversation with a third of all rows is summed by many tasks; a window is
built from at most ``SEGMENT`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import let

SEGMENT = 256          # a window never spans two segments of this many turns
BLOCK = 256            # turn numbers per block of the prefix sum
OPEN, CLOSE = "<s>", "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def count_tokens(text: Column) -> Column:
    """Token estimate of a turn: words and single symbols, and its two marks."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 4).cast("bigint")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, n (1..), role, text, tokens``; turns in order within a conversation."""
    t = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK))
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.withColumn("k", F.row_number().over(in_block))
    totals = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    joined = t.join(totals, t["conv_id"].eqNullSafe(totals["c"]) & t["block"].eqNullSafe(totals["b"]))
    return joined.select("conv_id", (F.col("k") + F.col("offset")).alias("n"), "role", "text",
                         count_tokens(F.col("text")).alias("tokens"))


def _spans(turns: Column, room: Column) -> Column:
    """Array of (first, last) 1-based turn spans whose prefix-sum difference fits ``room``."""
    none = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(none.alias("done"), F.lit(1).alias("first"), F.lit(0).alias("at"),
                     F.lit(0).cast("bigint").alias("base"), F.lit(0).cast("bigint").alias("prefix"))

    def step(acc: Column, t: Column) -> Column:
        prefix = acc["prefix"] + t["tokens"]
        cut = (prefix - acc["base"] > room) & (acc["at"] >= acc["first"])
        return F.struct(
            F.when(cut, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["at"].alias("last")))))
            .otherwise(acc["done"]).alias("done"),
            F.when(cut, acc["at"] + 1).otherwise(acc["first"]).alias("first"),
            (acc["at"] + 1).alias("at"),
            F.when(cut, acc["prefix"]).otherwise(acc["base"]).alias("base"),
            prefix.alias("prefix"))

    def finish(acc: Column) -> Column:
        return F.when(acc["at"] >= acc["first"], F.concat(acc["done"], F.array(F.struct(
            acc["first"].alias("first"), acc["at"].alias("last"))))).otherwise(acc["done"])
    return F.aggregate(turns, start, step, finish)


def _total(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"])


def _history(turns: Column, limit: int) -> Column:
    """The longest run of last turns with at most ``limit`` tokens."""
    keep = F.aggregate(
        F.reverse(turns), F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("sum"), F.lit(True).alias("open")),
        lambda a, t: F.struct(
            F.when(a["open"] & (a["sum"] + t["tokens"] <= limit), a["k"] + 1).otherwise(a["k"]).alias("k"),
            (a["sum"] + t["tokens"]).alias("sum"),
            (a["open"] & (a["sum"] + t["tokens"] <= limit)).alias("open")),
        lambda a: a["k"])
    return let(keep, lambda k: F.slice(turns, F.size(turns) - k + 1, k))


def _loss_spans(turns: Column, repeated: Column) -> Column:
    """Code-point (start, end) of assistant texts that are not repeated."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(a: Column, t: Column) -> Column:
        begin = a["pos"] + len(OPEN) + F.length(t["role"]) + 1
        end = begin + F.length(t["text"])
        target = (a["k"] >= repeated) & (t["role"] == "assistant")
        return F.struct(
            (end + len(CLOSE)).alias("pos"), (a["k"] + 1).alias("k"),
            F.when(target, F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))))
            .otherwise(a["spans"]).alias("spans"))
    return F.aggregate(turns, F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("k"), none.alias("spans")),
                       step, lambda a: a["spans"])


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows: ``conv_id, segment, window, n_turns, n_repeated, tokens, over_budget, formatted, loss_spans``.

    ``n_turns`` counts new turns; the first ``n_repeated`` turns of the text
    are the system turn and history seen before. ``tokens`` counts them all.
    """
    turns = numbered_turns(conversations).select(
        "conv_id", "n", F.floor((F.col("n") - 1) / SEGMENT).alias("segment"),
        F.struct("n", F.url_encode("role").alias("role"), escape(F.col("text")).alias("text"), "tokens").alias("t"))
    segments = turns.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    system = turns.where((F.col("n") == 1) & (F.col("t.role") == "system")).select(
        F.col("conv_id").alias("sys_conv"), F.col("t").alias("system"))
    segments = segments.join(system, segments["conv_id"].eqNullSafe(system["sys_conv"]), "left").select(
        "conv_id", "segment", "turns",
        F.when(F.col("system").isNull(), F.array().cast(turns.select(F.array("t")).schema[0].dataType))
        .otherwise(F.array("system")).alias("system"))
    room = F.greatest(F.lit(1).cast("bigint"), F.lit(budget - history).cast("bigint") - _total(F.col("system")))
    spans = segments.withColumn("spans", _spans(F.col("turns"), room))

    def build(span: Column, i: Column) -> Column:
        new = F.slice(F.col("turns"), span["first"], span["last"] - span["first"] + 1)
        fresh = (i == 0) & (F.col("segment") == 0)         # the system turn is among the new turns
        prior = F.get(F.col("spans"), i - 1)
        past = F.when(i == 0, F.slice(F.col("turns"), 1, 0)).otherwise(
            _history(F.slice(F.col("turns"), prior["first"], prior["last"] - prior["first"] + 1), history))
        # history may reach the system turn itself: it is shown once
        past = F.filter(past, lambda t: (F.size("system") == 0) | (t["n"] != 1))
        lead = F.when(fresh, F.slice(F.col("turns"), 1, 0)).otherwise(F.concat(F.col("system"), past))
        return let(F.struct(lead.alias("lead"), new.alias("new")), lambda p: F.struct(
            i.alias("window"), F.size(p["new"]).alias("n_turns"), F.size(p["lead"]).alias("n_repeated"),
            (_total(p["lead"]) + _total(p["new"])).alias("tokens"),
            F.array_join(F.transform(F.concat(p["lead"], p["new"]), lambda t: F.concat(
                F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "").alias("formatted"),
            _loss_spans(F.concat(p["lead"], p["new"]), F.size(p["lead"])).alias("loss_spans")))

    windows = spans.select("conv_id", "segment", F.explode(F.transform("spans", build)).alias("w"))
    return windows.select("conv_id", "segment", "w.*").withColumn("over_budget", F.col("tokens") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: turns, loss text and digests."""
    pieces = F.split("formatted", "</s>\n", -1)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns"))

    def turn_text(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), "\n", 1)
        body = F.substr(piece, F.length(role) + len(OPEN) + 2)
        return F.concat(F.url_decode(role), F.lit("\n"), unescape(body), F.lit("\n"))
    read = windows.select(
        "conv_id", "segment", "window", F.length("formatted").cast("bigint").alias("chars"), F.col("n_turns").alias("k"),
        F.array_join(F.transform(new, turn_text), "").alias("said"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
            F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "").alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.sum("k").cast("bigint").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("segment", "window", "said", "loss"))).alias("parts"),
        F.count(F.lit(1)).alias("n_windows"))
    said = F.array_join(F.transform("parts", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_windows")
