"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant, all others as named users and system turns as they are;
the mask holds the character spans, [start, end), of the speaker's own turns.

A turn is `<|assistant|>\\n...<|end|>\\n`, `<|user name=NAME|>\\n...<|end|>\\n` or
`<|system|>\\n...<|end|>\\n`; its span runs from the text's first character over
`<|end|>`.  In a rendered name or text a backslash is written twice and `<|` as `<\\|`, so
that no turn can forge a mark and what was written can be told; speakers are told apart by
their names as they are.  A
conversation of more than ``block_turns`` turns is rendered in blocks of that many, so
that a very long one is dealt to many tasks; each block after the first begins with the
conversation's first system turn again, if it has one (it is not counted as a turn).
Turns are placed by how many have smaller numbers: turns are counted by runs of 1,024
numbers, and only those of one run are sorted together.

Defined results: participants are the distinct non-null roles but `system`; a null
role is a user named `unknown` and no participant; a null text is empty; a null
turn number comes before others; turns of equal number are in the order of role and
text, repeated rows stay; a null conversation id is a conversation;
a conversation without a participant gives no row; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

BLOCK_TURNS = 1024
RUN = 1024
SYSTEM, END = "system", "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, block, speaker, n_turns, n_targets, text, mask (array of start and end) for each participant."""
    source = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    run = F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 62))).cast("long")
    rows = source.withColumn("run", run)
    by_conv = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(F.col("conv_id").alias("conv"), F.col("run").alias("of")).agg(F.count("*").alias("n")).withColumn("run", F.col("of"))
    runs = runs.select("conv", "of", F.coalesce(F.sum("n").over(by_conv), F.lit(0)).alias("before"))
    placed = rows.join(runs, rows.conv_id.eqNullSafe(runs.conv) & (rows.run == runs.of))
    within = Window.partitionBy("conv_id", "run").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text")
    placed = placed.withColumn("place", F.col("before") + F.row_number().over(within) - 1).withColumn("block", F.floor(F.col("place") / block_turns).cast("long"))
    dialogues = placed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    dialogues = dialogues.withColumn("n_turns", F.size("turns").cast("long"))
    first = source.where(F.col("role") == SYSTEM).groupBy(F.col("conv_id").alias("system_conv")).agg(F.min(F.struct("turn", "text")).alias("system"))
    dialogues = dialogues.join(first, dialogues.conv_id.eqNullSafe(first.system_conv), "left")
    again = F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(SYSTEM).alias("role"), F.col("system.text").alias("text")))
    dialogues = dialogues.withColumn("turns", F.when((F.col("block") > 0) & F.col("system").isNotNull(), F.concat(again, "turns")).otherwise(F.col("turns")))
    people = source.where(F.col("role") != SYSTEM).groupBy("conv_id").agg(F.collect_set("role").alias("people")).withColumnRenamed("conv_id", "conv")
    both = dialogues.join(people, dialogues.conv_id.eqNullSafe(people.conv)).select("conv_id", "block", "turns", "n_turns", F.explode("people").alias("speaker"))
    mine = lambda t: F.coalesce(t.role == F.col("speaker"), F.lit(False))
    head = lambda t: F.when(mine(t), "<|assistant|>\n").when(t.role == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), F.coalesce(escaped(t.role), F.lit("unknown")), F.lit("|>\n")))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(escaped(t.text), F.lit(END)).alias("body"), mine(t).alias("mine")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, p):
        start = state.at + F.length(p.head)
        end = start + F.length(p.body)
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + 1).cast("int").alias("at"), F.when(p.mine, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    made = both.select("conv_id", "block", "speaker", "n_turns", let(parts, lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("text"), F.aggregate(ps, empty, step).spans.alias("mask"))).alias("made"))
    return made.select("conv_id", "block", "speaker", "n_turns", F.size("made.mask").cast("long").alias("n_targets"), F.col("made.text"), F.col("made.mask"))
