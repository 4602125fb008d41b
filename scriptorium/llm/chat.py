"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own (``expand``): all turns before
it are context, only its own text is trainable.  An example is a row of its own
text: the prefix of the formatted conversation before its target, and the target
under the mask.  The prefixes of one conversation sum up to the square of its
turns; they are made and read a row at a time, and no shuffle carries them.

Template of a turn:  <|start|>ROLE, line feed, TEXT, <|end|>, line feed.
In texts and roles ``%``, ``<`` and ``[`` are percent-escaped, so that no control
string of this or a bracketed template can stand in them; unescaping restores
them exactly.  Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>\n"
ASSISTANT = "assistant"
#: ``%`` first; unescaping goes backwards.
_ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column) -> Column:
    for plain, safe in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ... in the order of turn, role, text), segment, begin, end,
    loss_begin, loss_end of every turn.

    begin and end: the segment's code points in the conversation's formatted
    text.  loss_begin and loss_end: the trainable ones, null where none are.
    Null text and null role count as empty.  Repeated rows are turns of their own.
    An empty table gives no rows; other columns are ignored.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("%0A")), F.lit("\n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = conversations.select("conv_id", "turn", "role", "text", head.alias("head"), escape(text).alias("body"))
    t = t.withColumn("segment", F.concat("head", "body", F.lit(END))).withColumn("n", F.length("segment").cast("long"))
    t = t.withColumns({"place": F.row_number().over(order), "end": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    begin, own = F.col("end") - F.col("n"), F.col("role") == ASSISTANT
    return t.select(
        "conv_id", "place", "segment", begin.alias("begin"), "end",
        F.when(own, begin + F.length("head")).alias("loss_begin"),
        F.when(own, F.col("end") - len(END)).alias("loss_end"),
    )


def conversations_text(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole text), masks (array of place, begin, loss_begin, loss_end in order) of each conversation.

    One conversation is one row, so one task's work, however long.  No turns, no rows.
    """
    parts = F.sort_array(F.collect_list(F.struct("place", "segment", "begin", "loss_begin", "loss_end")))
    g = turns.groupBy("conv_id").agg(parts.alias("parts"))
    mask = F.filter("parts", lambda p: p["loss_begin"].isNotNull())
    named = lambda p: F.struct(*[p[c].alias(c) for c in ("place", "begin", "loss_begin", "loss_end")])
    return g.select("conv_id", F.array_join(F.col("parts.segment"), "").alias("formatted"), F.transform(mask, named).alias("masks"))


def _segments() -> Column:
    """The turns' segments, cut out of the formatted text at the end marks."""
    cut = F.split("formatted", r"<\|end\|>\n")
    return F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda s: F.concat(s, F.lit(END)))


def _examples(formatted: DataFrame) -> DataFrame:
    """The columns of formatted beside its text and masks, m (an assistant turn's mask), context and body (the escaped target), both cut out of the formatted text at the mask's offsets."""
    rest = [c for c in formatted.columns if c not in ("formatted", "masks")]
    d = formatted.select(*rest, "formatted", F.explode_outer("masks").alias("m"))
    b, e = F.col("m.loss_begin").cast("int"), F.col("m.loss_end").cast("int")
    return d.select(*rest, "m", F.substring("formatted", F.lit(1), b).alias("context"), F.substring("formatted", b + 1, e - b).alias("body"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn, its example; a conversation without one has a row without an example.

    conv_id, the other columns of formatted(conv_id, formatted, masks, ...), example
    (the turn's place), context (all turns before it and its own head, escaped),
    context_chars (its length) and target (the text under its loss mask, unescaped).
    Contexts are whole prefixes, so a conversation of n turns takes the square of n; a
    row is made at a time.
    """
    rest = [c for c in formatted.columns if c not in ("formatted", "masks")]
    return _examples(formatted).select(*rest, F.col("m.place").alias("example"), "context", F.length("context").cast("long").alias("context_chars"), unescape(F.col("body")).alias("target"))


def example_texts(turns: DataFrame) -> DataFrame:
    """The examples as they are trained on: conv_id, example, context, target (both escaped)."""
    return _examples(conversations_text(turns)).where("m is not null").select("conv_id", F.col("m.place").alias("example"), "context", F.col("body").alias("target"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """formatted(conv_id, formatted, ...) with turns (array of role, text), read from the formatted text alone."""
    role = lambda s: unescape(F.replace(F.substring_index(F.substring(s, len(START) + 1, 2**31 - 1), "\n", 1), F.lit("%0A"), F.lit("\n")))
    text = lambda s: unescape(F.substring(s, F.instr(s, "\n") + 1, F.length(s) - F.instr(s, "\n") - len(END)))
    return formatted.withColumn("turns", F.transform(_segments(), lambda s: F.struct(role(s).alias("role"), text(s).alias("text"))))


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, context_chars of each conversation.

    turns: of ``format_turns``.  The turns' digest is read from the formatted text;
    the loss comes from the expanded examples, in their order with nothing between.
    """
    d = read_turns(conversations_text(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    d = d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted", "masks")
    # the rows of a conversation are where its text was put together, so this takes no shuffle
    own = ("n_turns", "turns_sha256", "formatted_chars")
    g = expand(d).groupBy("conv_id").agg(*[F.first(c).alias(c) for c in own], F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "context_chars", "target")))).alias("x"))
    loss = F.array_join(F.col("x.target"), "")
    context = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["context_chars"])
    return g.select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
        F.size("x").cast("long").alias("n_examples"), context.alias("context_chars"),
    )
