"""Conversations from event logs, rendered for training, all in DataFrame functions.

Events.  ``message`` opens a message; ``delta`` appends text to one; ``edit`` replaces its text;
``regenerate`` empties it and drops the messages opened after it and before the event.  Events of a
message are folded first, with one row per message as result; then a running maximum over a
conversation's messages tells which ones a later regeneration dropped; then they are joined.

Template.  A message is ``<|turn|>`` role line feed text ``<|end|>`` line feed.  In roles and
texts ``&``, ``<`` and ``[`` become ``&amp;`` ``&lt;`` ``&lsq;`` (in roles also the line feed,
``&lf;``), so that no control string of this or of bracketed templates survives, and every text can
be read back.  The loss mask is a list of spans: the texts of assistant messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: In order of escaping; reading back goes the other way.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsq;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&lf;"))
LEARNED_ROLE = "assistant"


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, mark in pairs:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, mark in reversed(pairs):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: every row opens a message with its whole text.

    Rows that repeat a turn are messages of their own, ordered by role and text.
    """
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("seq"),
        F.lit("message").alias("event"),
        F.monotonically_increasing_id().alias("message_id"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )


def final_messages(events: DataFrame) -> DataFrame:
    """``conv_id, opened, message_id, role, text`` of the messages that stand at the log's end.

    ``events``: ``conv_id, seq, event, message_id, role, text``.  Null texts and roles are empty.
    A message without an opening event, or with a null id, is dropped.  Events of equal ``seq``
    fold in the order message, edit, regenerate, delta, and then by text.
    """
    rank = F.expr("CASE event WHEN 'message' THEN 0 WHEN 'edit' THEN 1 WHEN 'regenerate' THEN 2 WHEN 'delta' THEN 3 END")
    text = F.when(F.col("event") == "regenerate", "").otherwise(F.coalesce("text", F.lit("")))
    at = events.withColumn("rank", rank).where("rank IS NOT NULL AND message_id IS NOT NULL")
    at = at.withColumn("step", F.struct(F.col("seq"), F.col("rank"), text.alias("text")))
    folded = at.groupBy("conv_id", "message_id").agg(
        F.min(F.when(F.col("event") == "message", F.col("seq"))).alias("opened"),
        F.count(F.when(F.col("event") == "message", 1)).alias("n_opened"),
        F.min(F.when(F.col("event") == "message", F.coalesce("role", F.lit("")))).alias("role"),
        F.max(F.when(F.col("event") != "delta", F.struct("seq", "rank"))).alias("reset"),
        F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.sort_array(F.collect_list("step")).alias("steps"),
    )
    # what stands from the last event on that sets the whole text
    live = F.filter("steps", lambda s: F.struct(s["seq"], s["rank"]) >= F.col("reset"))
    kept = folded.where("n_opened > 0").withColumn("text", F.array_join(F.transform(live, lambda s: s["text"]), ""))
    earlier = Window.partitionBy("conv_id").orderBy("opened").rangeBetween(Window.unboundedPreceding, -1)
    return (
        kept.withColumn("dropped_at", F.max("regenerated").over(earlier))
        .where("dropped_at IS NULL OR opened IS NULL OR dropped_at <= opened")
        .select("conv_id", "opened", "message_id", "role", "text")
    )


def rendered(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of each conversation.

    ``loss_mask`` holds the spans ``start`` and ``length`` in code points of what is learned.  Null roles and
    texts are empty by then; messages that repeat stand one after the other, and without messages there is no row.
    """
    head = F.concat(F.lit(TURN), escaped(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    body = escaped(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("opened", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = messages.withColumns({"head": head, "body": body}).withColumn("whole", F.concat("head", "body", F.lit(END)))
    start = F.sum(F.char_length("whole")).over(upto) - F.char_length("whole") + F.char_length("head")
    parts = placed.withColumn("start", start).select(
        "conv_id",
        "whole",
        F.struct("start", F.char_length("body").cast("long").alias("length")).alias("span"),
        (F.col("role") == LEARNED_ROLE).alias("learned"),
    )
    # no message is empty, so the spans' starts are in the messages' order
    joined = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("span", "whole"))).alias("m"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), F.col("span")))).alias("loss_mask"),
    )
    return joined.select("conv_id", F.array_join(F.transform("m", lambda x: x["whole"]), "").alias("formatted"), "loss_mask")


def read_turns(formatted: Column) -> Column:
    """The ``role`` and ``text`` of each turn of a formatted conversation."""
    # after the split, each piece but the last is a turn without its end mark
    pieces = F.split(formatted, r"<\|end\|>\n")
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def read(piece: Column) -> Column:
        line = F.substring(piece, len(TURN) + 1, F.char_length(piece))
        cut = F.locate("\n", line)
        return F.struct(
            unescaped(F.substring(line, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(line, cut + 1, F.char_length(line))).alias("text"),
        )

    return F.transform(turns, read)


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks, read back from ``formatted`` and ``loss_mask`` alone."""
    masked = F.transform("loss_mask", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("learned", F.array_join(masked, ""))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def formatted(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` of a log's conversations; an empty log has none."""
    return rendered(final_messages(events))
