"""Chat formatting from event logs, with DataFrame functions only.

A log is partitioned by conversation, sorted by sequence number, and its
streamed deltas, edits and regenerations are folded into final messages, which
are then rendered with a template.  Everything stays in the JVM: windows,
grouped arrays and string functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.  All of them start with "<|", which escaping breaks up.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Kinds of events: a message opens with its text; a delta appends; an edit or a regeneration
#: replaces the text so far and takes back the messages after it.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escape(text: Column) -> Column:
    """Text in which no control string can stand: a backslash is doubled, and one is put into every ``<|``."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log.

    *events* has ``conv_id, seq, message, kind, role, text``.  Result: ``conv_id, ordinal, role, text``
    with the messages of a conversation numbered from 1 in the order of ``message``, null first: messages
    without an id come before all others, and an edit of one of them takes back all others.  A message
    event always opens a message, so repeated rows are repeated messages; ties in ``seq`` are ordered by
    role, then text, nulls first.  Null role or text count as empty; null conversation ids are one
    conversation; an unknown kind raises an error.  An empty log gives no row.  Other columns are ignored.
    A conversation's messages, as its formatted text, are of the size of one row.
    """
    kind = F.when(F.col("kind").isin(MESSAGE, DELTA, EDIT, REGENERATE), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(F.col("kind"), F.lit("null")))))
    rows = events.select("conv_id", "seq", F.col("message").alias("msg"), kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind").isin(EDIT, REGENERATE)
    place = F.struct(F.col("msg").isNotNull().alias("known"), F.col("msg").alias("msg"))  # a message's place in the order, null first
    in_order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    later = in_order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("back_to", F.min(F.when(resets, place)).over(later))
    rows = rows.where(F.col("back_to").isNull() | (place <= F.col("back_to")))
    one = Window.partitionBy("conv_id", "msg").orderBy("at")
    rows = rows.withColumn("opened", F.sum((F.col("kind") == MESSAGE).cast("int")).over(one))
    whole = F.sort_array(F.collect_list(F.struct("at", "text", resets.alias("resets"), "role")))
    parts = rows.groupBy("conv_id", "msg", "opened").agg(whole.alias("log"), F.min("at").alias("first"), F.max(F.when(resets, F.col("at"))).alias("reset_at"))
    kept = F.filter("log", lambda e: F.coalesce(F.col("reset_at"), F.lit(0)) <= e["at"])
    text = F.array_join(F.transform(kept, lambda e: e["text"]), "")
    role = F.coalesce(F.get(F.filter("log", lambda e: e["role"] != ""), 0)["role"], F.lit(""))
    numbered = F.row_number().over(Window.partitionBy("conv_id").orderBy("msg", "opened", "first"))
    return parts.select("conv_id", numbered.alias("ordinal"), role.alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans``.

    Spans are ``array<struct<start,length>>`` in code points of *formatted*; they cover the escaped
    texts of the roles in *loss_roles*, in order.
    """
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    rows = messages.select("conv_id", "ordinal", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("head_chars"), F.length(body).alias("body_chars"), F.col("role").isin(*loss_roles).alias("is_loss"))
    so_far = Window.partitionBy("conv_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chars = F.col("head_chars") + F.col("body_chars") + F.lit(len(END))
    rows = rows.withColumn("start", F.sum(chars).over(so_far) - F.col("body_chars") - F.lit(len(END)))
    turns = F.sort_array(F.collect_list(F.struct("ordinal", "piece", "start", "body_chars", "is_loss")))
    spans = F.transform(F.filter("turns", lambda t: t["is_loss"]), lambda t: F.struct(t["start"].cast("bigint").alias("start"), t["body_chars"].cast("bigint").alias("length")))
    return (
        rows.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts, read from the formatted string and its spans alone: ``turns``, ``loss_texts``."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda p: p != "")
    turn = lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", -1)
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.get(turn(p), 0)).alias("role"), unescape(F.get(turn(p), 1)).alias("text")))
    losses = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), losses.alias("loss_texts"))


def from_rows(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` as a log: every row is a message event."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message"), F.lit(MESSAGE).alias("kind"), "role", "text")
