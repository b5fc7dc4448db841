"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned spans: a turn belongs to window
floor(tokens before it / stride). A window is formatted as the conversation's
first system turn (cut to a number of tokens, except in its own window), repeated
history and its own turns; only assistant turns that it does not repeat are under
the loss mask, so each is learned once. The history is the turns before the
window whose tokens, from their starts to that of the window, are within a number;
a longer last turn is not repeated, and its tokens are nobody's history.

A conversation is dealt into blocks of consecutive turns, and prefix sums run in
a block on top of the sums of the blocks before, so a very long conversation is
no single task's.

Format: each turn is ``<turn KIND ROLE>TEXT</turn>`` with KIND ``new`` or
``again`` (repeated, not learned). In roles and texts a backslash is written
``\\b``, ``<`` is written ``\\l`` and ``>`` is written ``\\g``, so no text can
contain a control string, and reading undoes it.

Nulls and edge cases: a null role or text is empty; rows with equal turn are
ordered by role and text; null turns come first; null conversation ids are one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of new turns after which another window begins, tokens of repeated history and of a repeated system turn, turns of a block.
STRIDE, HISTORY, SYSTEM, BLOCK = 1024, 256, 256, 256
_TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\x09-\x0D\x20\p{L}\p{M}\p{N}]"
_ESCAPES = [("\\", "\\b"), (">", "\\g"), ("<", "\\l")]


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def turn_tokens(text: Column) -> Column:
    """A count of words and of single other characters, which stands for tokens."""
    return F.regexp_count(text, F.lit(_TOKEN)) + 2


def cut(text: Column, tokens: int) -> Column:
    """The beginning of a text that has ``tokens`` by turn_tokens() at most."""
    return F.when(turn_tokens(text) <= tokens, text).otherwise(F.regexp_extract(text, rf"^(?:[\x09-\x0D\x20]*(?:{_TOKEN})){{0,{max(tokens - 2, 0)}}}", 0))


def _prefix_sums(turns: DataFrame) -> DataFrame:
    """Adds before: the conversation's tokens before each turn; and place, the turn's number."""
    order = ["turn", "role", "text"]
    conv = Window.partitionBy("conv_id")
    # blocks by the turn's value, then the sums of whole blocks before each
    blocked = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    sums = blocked.groupBy("conv_id", "block").agg(F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_turns"))
    past = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", F.coalesce(F.sum("block_tokens").over(past), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("block_turns").over(past), F.lit(0)).alias("turns_before"))
    same = (F.col("b.conv_id").eqNullSafe(F.col("s.conv_id"))) & (F.col("b.block") == F.col("s.block"))
    joined = blocked.alias("b").join(sums.alias("s"), same).select("b.*", "tokens_before", "turns_before")
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    return joined.select(
        *turns.columns,
        (F.col("tokens_before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("before"),
        (F.col("turns_before") + F.row_number().over(inside) - 1).alias("place"),
    )


def windows(conversations: DataFrame, stride: int = STRIDE, history: int = HISTORY, system_tokens: int = SYSTEM) -> DataFrame:
    """conv_id, window, n_tokens and formatted text of each window.

    A window has at most ``stride`` tokens of new turns but for its last turn,
    which may be longer (turns are whole), ``history`` tokens of repeated turns,
    and ``system_tokens`` of the conversation's first system turn.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("tokens", turn_tokens(F.col("text")))
    summed = _prefix_sums(turns).withColumn("window", F.floor(F.col("before") / stride))
    # A window's turns begin at its number times ``stride`` or later, so a turn can be history
    # of the windows up to (before + history) / stride; whether it is tells the window's start.
    system = F.when(F.col("role") == "system", F.col("place"))
    last = summed.groupBy("conv_id").agg(F.max("window").alias("last_window"), F.min(system).alias("system_place"))
    known = summed.alias("t").join(last.alias("l"), F.col("t.conv_id").eqNullSafe(F.col("l.conv_id"))).select("t.*", F.coalesce(F.col("place") == F.col("system_place"), F.lit(False)).alias("first_system"), "last_window")
    until = F.least(F.col("last_window"), F.floor((F.col("before") + history) / stride))
    until = F.greatest(F.col("window"), F.when(F.col("first_system"), F.col("last_window")).otherwise(until))
    placed = known.withColumn("shown", F.explode(F.sequence(F.col("window"), until)))
    starts = summed.groupBy("conv_id", "window").agg(F.min("before").alias("start")).withColumnRenamed("window", "w")
    placed = placed.alias("p").join(starts.alias("w"), F.col("p.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("p.shown") == F.col("w.w"))).select("p.*", "start")
    new = F.col("shown") == F.col("window")
    placed = placed.where(new | F.col("first_system") | (F.col("start") - F.col("before") <= history))
    text = F.when(new | ~F.col("first_system"), F.col("text")).otherwise(cut(F.col("text"), system_tokens))
    placed = placed.withColumn("text", text).withColumn("tokens", F.when(new | ~F.col("first_system"), F.col("tokens")).otherwise(turn_tokens(F.col("text"))))
    formatted = F.concat(F.lit("<turn "), F.when(new, "new").otherwise("again"), F.lit(" "), escape(F.col("role")), F.lit(">"), escape(F.col("text")), F.lit("</turn>"))
    grouped = placed.groupBy("conv_id", F.col("shown").alias("window")).agg(F.array_sort(F.collect_list(F.struct("place", formatted.alias("f")))).alias("all"), F.sum("tokens").alias("n_tokens"))
    return grouped.select("conv_id", "window", "n_tokens", F.array_join(F.transform("all", lambda x: x["f"]), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """Turns read back from formatted windows: conv_id, window, at, kind, role, text (unescaped)."""
    parts = F.filter(F.split("formatted", "</turn>"), lambda x: x != "")
    turn = formatted.select("conv_id", "window", F.posexplode(parts).alias("at", "raw"))
    pattern = r"(?s)^<turn (new|again) ([^>]*)>(.*)$"
    return turn.select("conv_id", "window", "at", F.regexp_extract("raw", pattern, 1).alias("kind"), unescape(F.regexp_extract("raw", pattern, 2)).alias("role"), unescape(F.regexp_extract("raw", pattern, 3)).alias("text"))


def loss_text(turns: DataFrame) -> DataFrame:
    """Marks what of parse()'s turns is under the loss mask: new assistant turns."""
    return turns.withColumn("loss", (F.col("kind") == "new") & (F.col("role") == "assistant"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted windows alone."""
    turns = loss_text(parse(formatted)).where("kind = 'new'")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "at", "role", "text", "loss"))).alias("t"))
    loss = F.array_join(F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["text"]), "")
    listed = listed.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
    )
    chars = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    return listed.alias("a").join(chars.alias("c"), F.col("a.conv_id").eqNullSafe(F.col("c.conv_id"))).select("a.*", "formatted_chars")
