"""Chat formatting from event logs, with DataFrame functions only.

A conversation is a log of events, each with a sequence number and the index of the message it concerns:

* ``delta``       appends its text to the message (streamed output),
* ``edit``        replaces the message's text,
* ``regenerate``  starts the message anew and discards all messages after it.

Logs are partitioned by conversation once.  What an event cancels is found by windows over that partitioning instead
of a row-by-row fold: of a message only the events stay that are no older than its last edit and no older than the last
regeneration of it or of an earlier message.  What is left is concatenated in sequence and rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, whole

#: Control strings of the template.  Each begins with < and none has a backslash.
START, SEP, END = "<|start|>", "<|message|>", "<|end|>"

#: Longest streamed delta of turns_to_events, in code points.
DELTA_CHARS = 1024


def escaped(c: Column) -> Column:
    r"""Reversible: every backslash doubles, and < and [ get a backslash behind them, so that neither this template's control strings nor others of the form <...> or [...] can occur."""
    for plain, safe in (("\\", "\\\\"), ("<", "<\\"), ("[", "[\\")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\|\\(\\)", "$1$2")


def turns_to_events(turns: DataFrame, delta_chars: int = DELTA_CHARS, revised: bool = False) -> DataFrame:
    """(conv_id, seq, message, kind, role, text): each row of (conv_id, turn, role, text) as the deltas that stream it.

    Rows are turns even if a turn's number repeats: these are ordered by role, then text; null numbers come first.
    Null roles and texts count as empty; rows with null conv_id form one conversation.  revised: the log of a session in
    which the assistant's turns are begun wrongly and regenerated, and all others are typed and then edited.
    """
    numbered = turns.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text")).withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(delta_chars))
    event = lambda at, kind, text: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), text.alias("text"))
    answers = F.col("role") == "assistant"
    first = F.when(~answers, "edit").otherwise("delta") if revised else F.lit("delta")
    kept = F.transform(starts, lambda at, i: F.struct((i + 2).alias("at"), F.when(i == 0, first).otherwise("delta").alias("kind"), F.substring("text", at + 1, F.lit(delta_chars)).alias("text")))
    if revised:
        wrong = F.concat(F.lit("false start "), F.substring("text", 1, 20))
        kept = F.concat(F.when(answers, F.array(event(0, "delta", wrong), event(1, "regenerate", F.lit("")))).otherwise(F.array(event(1, "delta", wrong))), kept)
    rows = numbered.select("conv_id", "message", "role", F.explode(kept).alias("e"))
    return rows.select("conv_id", (F.col("message") * F.lit(1 << 32) + F.col("e.at")).alias("seq"), "message", "e.kind", "role", "e.text")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) after all events; a message that a regeneration discarded is absent.

    Ties in seq are ordered by kind, then text; the role is the last non-null one among the events that stay, else empty.
    """
    regenerated = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, 0))
    edited = F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(Window.partitionBy("conv_id", "message"))
    alive = events.withColumn("since", F.coalesce(F.greatest(regenerated, edited), F.lit(-(1 << 62)))).where(F.col("seq") >= F.col("since"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role")))
    return alive.groupBy("conv_id", "message").agg(parts.alias("p")).select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(F.filter(F.col("p.role"), lambda r: r.isNotNull()), F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.col("p.text"), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row per conversation; spans are (start, length) in code points of formatted, start from 1, and cover the assistant's texts alone."""
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEP))
    body = escaped(F.col("text"))
    rows = messages.select("conv_id", "message", head.alias("head"), body.alias("body"), F.col("role").alias("role"))
    rows = rows.select("conv_id", "message", "role", F.concat("head", "body", F.lit(END)).alias("turn"), F.length("head").alias("before"), F.length("body").alias("chars"))
    past = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(past), F.lit(0)) + F.col("before") + 1)
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("chars").alias("length"))
    return (
        rows.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("message", "turn", F.when(F.col("role") == "assistant", span).alias("span")))).alias("t"))
        .select("conv_id", F.array_join(F.col("t.turn"), "").alias("formatted"), F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"))
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Events to one formatted text per conversation; see final_messages and render.  No events, no rows."""
    prepare(events.sparkSession)
    return render(final_messages(events))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted): what the formatted text and its mask hold, unescaped."""
    pieces = F.split(F.col("formatted"), r"<\|end\|>")
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(unescaped(F.substring(F.split(p, r"<\|message\|>")[0], len(START) + 1, 1 << 30)).alias("role"), unescaped(F.split(p, r"<\|message\|>")[1]).alias("text")),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.col("formatted").substr(s["start"], s["length"]))), "")
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")
