"""Chat conversations as one string with a loss mask, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

#: The template. No control string can occur in an escaped text: each holds "<|", and escaping leaves none.
TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"


def escape(text: Column) -> Column:
    """Backslash becomes ``\\s`` and ``<|`` becomes ``\\c``, so that no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


#: Items that one fold of ``running`` goes through: it copies what it has so far at each.
FOLD = 256


def running(sizes: Column) -> Column:
    """For each number of an array the sum of those before it.

    A fold builds an array by copying it, so an array is folded in runs of
    ``FOLD`` and then over the runs' sums.
    """

    def fold(some):
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(some, start, step, lambda acc: acc["out"])

    def whole(given):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(given), F.lit(1)), F.lit(FOLD))
        return let(F.transform(firsts, lambda i: F.slice(given, i, FOLD)), of_runs)

    def of_runs(runs):
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(runs, fold(sums), lambda r, base: F.transform(fold(r), lambda x: x + base)))

    return let(sizes, whole)


def _messages(turns: Column) -> Column:
    """Sorted turns to messages (role, texts): neighbours of one role are one."""

    def merge(given):
        n = F.size(given)
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(given, 1, n - 1), lambda t: t["role"]))
        fresh = F.zip_with(given, before, lambda t, last: ~t["role"].eqNullSafe(last))
        starts = let(fresh, lambda f: F.filter(F.sequence(F.lit(1), n), lambda i: F.get(f, i - 1)))
        return let(starts, lambda firsts: cut(given, n, firsts))

    def cut(given, n, firsts):
        ends = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(n + 1))
        return F.zip_with(firsts, ends, lambda a, b: F.struct(
            F.get(given, a - 1)["role"].alias("role"), F.transform(F.slice(given, a, b - a), lambda t: escape(t["text"])).alias("texts")
        ))

    return let(turns, merge)


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation.

    A conversation's turns are collected as structs and sorted; neighbours of
    one role are merged by array aggregation into one message, whose parts stay
    marked so that the turns can be read back; the messages are concatenated.
    ``loss_spans`` are the half-open code-point ranges of the loss role's
    texts, from running sums over the array.

    Null texts and roles are empty. Turns with the same number order by role,
    then text; repeated rows are turns of their own; null numbers come first. A
    null conversation id is a conversation. A text of any length is kept whole;
    a conversation is one string, and so one task's. Empty tables give empty
    tables. Columns of other names are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", _messages(F.col("turns")).alias("messages"))
    # a message's pieces: what stands before each of its texts, and the text
    pieces = F.flatten(F.transform("messages", lambda m: F.transform(m["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT))).otherwise(F.lit(PART)).alias("head"),
        t.alias("body"),
        F.when(i == F.size(m["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("tail"),
        (m["role"] == loss_role).alias("loss"),
    ))))
    chats = chats.select("conv_id", pieces.alias("pieces"))
    sizes = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long"))
    spans = F.zip_with("pieces", running(sizes), lambda p, at: F.when(p["loss"], F.struct(
        (at + F.length(p["head"])).alias("start"), (at + F.length(p["head"]) + F.length(p["body"])).alias("end")
    )))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) structs from a formatted string: the turns as they were given."""

    def of_message(message):
        role = unescape(F.substring_index(F.substring(message, F.lit(len(TURN) + 1), F.length(message)), TEXT, 1))
        body = F.substring(message, F.instr(message, TEXT) + len(TEXT), F.length(message))
        parts = F.split(body, "<\\|part\\|>", -1)
        return let(role, lambda r: F.transform(parts, lambda p: F.struct(r.alias("role"), unescape(p).alias("text"))))

    messages = F.filter(F.split(formatted, "<\\|end\\|>"), lambda m: m != "")
    return F.flatten(F.transform(messages, of_message))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, as an array.

    A place in a string is found by walking to it, so the string is first cut
    into the stretches that ``FOLD`` spans lie in.
    """

    def stretch(run: Column) -> Column:
        first, last = F.get(run, F.lit(0))["start"], F.get(run, F.size(run) - 1)["end"]
        piece = lambda text, a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
        return let(piece(formatted, first, last), lambda text: F.transform(run, lambda s: unescape(piece(text, s["start"] - first, s["end"] - first))))

    firsts = F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(FOLD))
    return F.flatten(F.transform(firsts, lambda i: let(F.slice(spans, i, FOLD), stretch)))
