"""Chat formatting by rotating the perspective over all participants.

Every dialogue is rendered once for each of its speakers: that speaker's turns
become the assistant's and carry the loss, all others' turns become those of a
user who is named after the speaker, system turns stay system turns.

A rendered dialogue comes as its segments with their character ranges, in turn
order; joined they are the text.  A dialogue of any length is spread over
chunks of turns: chunk totals are summed first, then offsets inside a chunk, so
no task has to hold or walk a whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
UNKNOWN = "unknown"
CHUNK_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Text in which the control marks cannot occur."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK_TURNS
) -> DataFrame:
    """(conversation, perspective, turn, role, name, segment, start, end, loss_start, loss_end).

    ``start`` and ``end`` are code-point offsets of the segment in the rendered
    dialogue, ``loss_start`` and ``loss_end`` those of the part the model learns
    (reply and end mark of the assistant's turns, null elsewhere).  A null role
    speaks as ``unknown``, a null text is empty; turns are ordered by number,
    then role and text, nulls first; repeated rows are repeated turns; a
    dialogue of system turns alone has no participant and gives no rows.
    """
    said = turns.select(
        F.col(conv).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("speaker"),
        _safe(F.col(text)).alias("body"),
    ).withColumn("chunk", F.floor(F.coalesce(F.col("t"), F.lit(0)) / chunk))
    said = said.withColumn("chunk", F.when(F.col("t").isNotNull(), F.col("chunk")))
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("c").alias("pc"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(people, F.col("c").eqNullSafe(F.col("pc"))).drop("pc")

    own = F.col("speaker") == F.col("perspective")
    as_role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(~own & (F.col("speaker") != SYSTEM), F.col("speaker"))
    head = F.concat(
        F.lit(START), F.col("as_role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), _safe(F.col("name")))).otherwise(""), F.lit("\n")
    )
    seen = (
        seen.withColumn("as_role", as_role)
        .withColumn("name", name)
        .withColumn("head", head)
        .withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("size", F.char_length("segment").cast("long"))
    )
    keys = ["c", "perspective"]
    per_chunk = seen.groupBy(*keys, "chunk").agg(F.sum("size").alias("chunk_size"))
    before_chunk = Window.partitionBy(*keys).orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    bases = per_chunk.select(
        *[F.col(k).alias(f"b_{k}") for k in [*keys, "chunk"]],
        F.coalesce(F.sum("chunk_size").over(before_chunk), F.lit(0)).alias("base"),
    )
    inside = Window.partitionBy(*keys, "chunk").orderBy(
        F.col("t").asc_nulls_first(), "speaker", "body"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.withColumn("through", F.sum("size").over(inside)).join(
        bases,
        F.col("c").eqNullSafe(F.col("b_c"))
        & (F.col("perspective") == F.col("b_perspective"))
        & F.col("chunk").eqNullSafe(F.col("b_chunk")),
    )
    end = F.col("base") + F.col("through")
    start = end - F.col("size")
    learns = F.col("as_role") == "assistant"
    return placed.select(
        F.col("c").alias(conv),
        "perspective",
        F.col("t").alias(turn),
        F.col("as_role").alias("role"),
        "name",
        "segment",
        start.alias("start"),
        end.alias("end"),
        F.when(learns, start + F.char_length("head")).alias("loss_start"),
        F.when(learns, end - 1).alias("loss_end"),
    )
