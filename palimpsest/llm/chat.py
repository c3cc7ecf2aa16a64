"""Conversations as training windows: turn-aligned spans of a token budget, with limited history and a loss mask.

Running sums of the turns' tokens cut each conversation: a turn belongs to the span in which it starts, so a span holds
``SPAN`` tokens and what its last turn has beyond them. A window is one span, before it the turns that start within
``HISTORY`` tokens before it, and before these the conversation's system turn if it opens with one. The mask covers
the texts of assistant turns of the span alone; history was, or is, a target of another window. So each turn is fresh
in exactly one window, and each target is learnt from once.

All of it is DataFrame operations: window functions and one grouping over the same partitioning. A window's own turns
and history meet in one row, however long the conversation is; a conversation is sorted in one task, which spills. Only
``read_back`` meets a whole conversation in one row, as its digests are of the whole.

Defined results
    Null texts and roles are empty. Turns are ordered by turn, role and text; null turns come first; equal rows stay, as
    turns of their own. Rows without a conv_id form one conversation. Backslashes are doubled in texts and roles, and
    one is put into every control string, so none is left there and the texts can be restored. Other columns are not
    looked at. Long texts are never cut: their turn is in one window, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN, HISTORY = 256, 128
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The first character of a control string, where its rest follows: this template's, and those of other common ones.
CONTROL = r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))


def windows(turns: DataFrame) -> DataFrame:
    """(conv_id, window, formatted, fresh_at, loss): loss has the (start, end) of targets; all are code points."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("opens", (F.col("pos") == 1) & (F.col("role") == "system"))
    tokens = F.when(F.col("opens"), 0).otherwise(F.ceil(F.length("text") / 4) + 4).cast("long")
    start = F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, 0)) - tokens
    rows = rows.withColumn("start", start).withColumn("window", F.floor(F.col("start") / SPAN))
    rows = rows.select("conv_id", "pos", "start", "window", "opens", (F.col("role") == "assistant").alias("target"), escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    # As SPAN is more than HISTORY, a turn can be history of no window but the next, whose first turn tells.
    after = F.min("start").over(Window.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1))
    system = F.first(F.when(F.col("opens"), _turn(F.struct("role", "text"))).otherwise("")).over(Window.partitionBy("conv_id").orderBy("pos"))
    rows = rows.withColumn("after", after).withColumn("system", system)
    past = ~F.col("opens") & (F.col("start") >= F.col("after") - HISTORY)
    into = F.array_compact(F.array(F.col("window"), F.when(past, F.col("window") + 1)))
    each = F.struct("pos", "role", "text", "target", (F.col("into") == F.col("window")).alias("fresh"))
    rows = rows.withColumn("into", F.explode(into))
    # What meets in one row is a span and its history. Turns of one conversation lie together; nothing is shuffled again.
    cut = rows.groupBy("conv_id", F.col("into").alias("window")).agg(F.array_sort(F.collect_list(each)).alias("all"), F.first("system").alias("system"))
    join = lambda fresh: F.array_join(F.transform(F.filter("all", lambda t: t["fresh"] == fresh), _turn), "")
    cut = cut.withColumn("past", F.concat(F.when(F.col("window") > 0, F.col("system")).otherwise(""), join(False)))
    cut = cut.withColumn("fresh_at", F.length("past").cast("long"))

    def mask(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + len(OPEN) + 1
        end = start + F.length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    zero = F.struct(F.col("fresh_at").alias("at"), F.from_json(F.lit("[]"), "array<struct<start:long,end:long>>").alias("loss"))
    loss = F.aggregate(F.filter("all", lambda t: t["fresh"]), zero, mask, lambda acc: acc["loss"])
    return cut.select("conv_id", "window", F.concat("past", join(True)).alias("formatted"), "fresh_at", loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows say: conv_id, n_turns, digests of all turns and of all text under the mask, and characters."""
    fresh = F.substring(F.col("formatted"), F.col("fresh_at").cast("int") + 1, F.length("formatted"))
    shut = F.lit(CLOSE.replace("|", "[|]"))
    marked = F.filter(F.split(fresh, shut), lambda t: t != "")
    head = lambda t: F.substring(t, len(OPEN) + 1, F.length(t))
    turns = F.transform(marked, lambda t: F.concat(unescape(head(t)), F.lit("\n")))  # role, line end, text, line end
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    parts = formatted.select("conv_id", F.struct("window", F.size(marked).alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda f: F.aggregate(F.col("w"), F.lit(0).cast("long"), lambda acc, x: acc + x[f])
    text = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
