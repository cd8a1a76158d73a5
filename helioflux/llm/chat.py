"""Chat formatting: every participant in turn becomes the assistant of the dialogue (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def rotations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn: the rendered segment and where it stands in the dialogue.

    Columns: conv, perspective (the participant who is the assistant), turn, speaker, segment, start and end (character
    offsets in the rendered dialogue; the dialogue is its segments in order), train_start and train_end (offsets of the
    part to learn: the text and end mark of the perspective's own turns; both null elsewhere).

    Participants are the roles of a conversation other than system; a conversation of system turns only renders nothing.
    What looks like a control mark in a text or a name opens no turn: in texts ``<|`` becomes ``<\\|`` (and ``<\\`` becomes
    ``<\\\\``, so that it can be undone), in names ``\\``, ``|`` and line feeds are written ``\\\\``, ``\\|`` and ``\\n``; offsets
    are those of the rendered text, the column speaker keeps the name as it is. Other columns are left out.

    A null role is the participant "unknown", a null text is empty, turns go by (turn, role, text) with null first, and
    repeated rows are turns of their own. A conversation of any length is a set of rows: offsets come from sums over
    blocks of turns and then inside each block, so no conversation is gathered in one task.
    """
    t = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    who = t.where("speaker <> 'system'").select("conv", F.col("speaker").alias("perspective")).distinct()
    d = t.join(who.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    text_out = F.replace(F.replace("text", F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))
    name = F.col("speaker")
    for a, b in (("\\", "\\\\"), ("|", "\\|"), ("\n", "\\n")):
        name = F.replace(name, F.lit(a), F.lit(b))
    head = F.when(own, "<|assistant|>\n").when(F.col("speaker") == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    d = d.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, text_out, F.lit("<|end|>\n"))).withColumn("n", F.length("segment").cast("long"))
    d = d.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    sums = d.groupBy("conv", "perspective", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("_conv"), F.col("perspective").alias("_who"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    d = d.join(sums, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & (F.col("block") == F.col("_block")))
    upto = Window.partitionBy("conv", "perspective", "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("end", F.col("base") + F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    mine = F.col("speaker") == F.col("perspective")
    return d.select(
        F.col("conv").alias(conv), "perspective", F.col("turn").alias(turn), "speaker", "segment", "start", "end",
        F.when(mine, F.col("start") + F.col("head")).alias("train_start"), F.when(mine, F.col("end") - 1).alias("train_end"),
    )


def dialogues(segments: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation and perspective with the whole rendered text and the spans to learn; a row is as long as its dialogue."""
    part = F.struct("start", "segment", "train_start", "train_end")
    d = segments.groupBy(conv, "perspective").agg(F.array_sort(F.collect_list(part)).alias("p"))
    spans = F.filter(F.transform("p", lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end"))), lambda x: x["start"].isNotNull())
    return d.select(conv, "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"), spans.alias("train"))
