"""Chat formatting: event logs folded into final messages, then rendered; DataFrame functions only.

Events are rows (conv_id, seq, kind, message, role, text):

* ``message``    starts message number ``message`` with a role and a text,
* ``delta``      appends its text to that message (a streamed piece),
* ``edit``       replaces the text of that message so far,
* ``regenerate`` empties that message and removes every later message that was there before it.

Events of a conversation are taken by seq (ties: kind order of KINDS, then role, then text, so repeated rows have a
defined order). A null text is empty, a null role is the empty role, a null conv_id is a conversation of its own, a
null seq or message sorts first, and an unknown kind counts as ``message``. A message that only deltas made has the
role of its first event. Conversations without events do not exist; an empty table gives an empty table. Columns
besides these six are ignored, whatever their names.

One conversation becomes one string, so a conversation is one row of one task by its nature; nothing else is
gathered, and the fold of a message never copies its text per event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "edit", "regenerate", "delta")
BOS, EOS, HEAD, TAIL, SYS, END_SYS = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"
#: Control strings and what stands for them inside a text. Every code starts with the backslash, which has a code of
#: its own, and no control string has a backslash: so the codes can be undone, and no text can end a turn.
CODES = (("\\", "\\b"), (EOS, "\\e"), (BOS, "\\o"), (HEAD, "\\i"), (TAIL, "\\j"), (SYS, "\\y"), (END_SYS, "\\z"))


def escape(c: Column) -> Column:
    return reduce(lambda x, code: F.replace(x, F.lit(code[0]), F.lit(code[1])), CODES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, code: F.replace(x, F.lit(code[1]), F.lit(code[0])), reversed(CODES), c)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<message, role, text>>): what each log comes to, in message order.

    Three steps on one partitioning by conv_id: the (rare) regenerations of a conversation are gathered, dead events
    are dropped, the live pieces of each message are joined, and the messages of a conversation are sorted.
    """
    kind = reduce(lambda x, k: x.when(F.col("kind") == k[1], F.lit(k[0])), list(enumerate(KINDS))[1:], F.when(F.col("kind") == KINDS[0], F.lit(0)))
    e = events.select(
        "conv_id", F.col("seq").cast("long").alias("seq"), F.coalesce(kind, F.lit(0)).alias("kind"), F.col("message").cast("long").alias("message"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    again = F.collect_list(F.when(F.col("kind") == 2, F.struct("seq", "message"))).over(Window.partitionBy("conv_id"))
    dead = F.exists("again", lambda r: (r["message"] < F.col("message")) & (r["seq"] > F.col("seq")))
    live = e.withColumn("again", again).filter(~F.coalesce(dead, F.lit(False)))
    made = live.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    # the pieces after the last event that sets the text, that event's own text included
    last = F.aggregate(F.transform("log", lambda x, i: F.when(x["kind"] < 3, i).otherwise(F.lit(-1))), F.lit(-1), lambda a, b: F.greatest(a, b))
    made = made.withColumn("last", last)
    pieces = F.when(F.col("last") < 0, F.col("log")).otherwise(F.slice("log", F.col("last") + 1, F.size("log") - F.col("last")))
    text = F.concat_ws("", F.transform(pieces, lambda x: F.when(x["kind"] == 2, F.lit("")).otherwise(x["text"])))
    made = made.select("conv_id", "message", F.col("log")[0]["role"].alias("role"), text.alias("text"))
    return made.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss_mask` (array of struct<start, length> in code points: the assistants' texts).

    A turn is <s>[INST]role[/INST]text</s>, role and text escaped.
    """
    parts = F.transform(
        "messages",
        lambda m: F.struct(F.concat(F.lit(BOS + HEAD), escape(m["role"]), F.lit(TAIL)).alias("head"), escape(m["text"]).alias("body"), (m["role"] == "assistant").alias("loss")),
    )
    out = folded.withColumn("parts", parts).withColumn("formatted", F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(EOS)))))
    sizes = F.transform("parts", lambda p: F.struct(F.length(p["head"]).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["loss"].alias("loss")))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))
    spans = F.aggregate(
        "sizes",
        first,
        lambda a, s: F.struct(
            (a["at"] + s["head"] + s["body"] + len(EOS)).alias("at"),
            F.when(s["loss"], F.concat(a["mask"], F.array(F.struct((a["at"] + s["head"]).alias("start"), s["body"].alias("length"))))).otherwise(a["mask"]).alias("mask"),
        ),
    )
    return out.withColumn("sizes", sizes).withColumn("loss_mask", spans["mask"]).drop("parts", "sizes")


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds `turns` (array of struct<role, text>) and `loss` (array of texts), from formatted and loss_mask alone."""
    whole = F.filter(F.split("formatted", "</s>", -1), lambda x: x != "")
    turn = lambda x: F.split(F.substring(x, len(BOS + HEAD) + 1, 2**31 - 1), r"\[/INST\]", 2)
    turns = F.transform(F.transform(whole, turn), lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.withColumn("turns", turns).withColumn("loss", loss)


def table_log(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as the log that led to it; repeated rows are turns of their own.

    An assistant's turn is a message whose text is streamed: a first half, which is regenerated, then both halves. Any
    other turn is an empty message that is edited into its text. Turns of equal number are ordered by role, then text.
    The fold uses the same partitioning by conv_id again.
    """
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    turns = conversations.select("conv_id", order.alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    log = lambda *events: F.array(*(F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), text.alias("piece")) for k, (kind, text) in enumerate(events)))
    streamed = log(("message", F.lit("")), ("delta", first), ("regenerate", F.lit("")), ("delta", first), ("delta", rest))
    typed = log(("message", F.lit("")), ("edit", F.col("text")))
    events = turns.select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e"))
    return events.select("conv_id", (F.col("message") * 8 + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "message", "role", F.col("e.piece").alias("text"))


def digests(read: DataFrame) -> DataFrame:
    joined = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
