"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all
others as named users and system turns as they are. The rendered text comes as segments in order, one row
per turn and perspective, with the place of each in the whole; a mask says which characters are learned
from. Places are running sums in two levels (within blocks of turns, then over the blocks), so that no task
holds a whole conversation, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_BLOCK = 4096
SYSTEM = "system"
UNNAMED = "unknown"


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """One row per turn and perspective: conv_id, perspective, turn, speaker, segment, start, mask_start, mask_end.

    start is the segment's offset in characters in the rendered dialogue; [mask_start, mask_end) is what is
    learned from, in the same offsets: the text and closing mark of the perspective's own turns, empty for
    other turns. Turns are ordered by number (null last), then speaker and text; repeated rows are rendered
    each. A null speaker is "unknown", a null text is empty, a null conv_id is a conversation of its own;
    opening marks inside texts and names are broken by a space, line breaks in names become one. A conversation with system turns only, like an empty
    table, gives no row. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit(UNNAMED)).alias("speaker"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    participants = (
        rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    )
    own = F.col("speaker") == F.col("perspective")
    # a name can neither open or close a turn nor end its line
    name = F.regexp_replace(F.replace("speaker", F.lit("<|"), F.lit("< |")), r"[\r\n]", " ")
    header = (
        F.when(F.col("speaker") == SYSTEM, F.lit(f"{OPEN}system\n"))
        .when(own, F.lit(f"{OPEN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    )
    segments = (
        rows.join(participants, F.col("conv_id").eqNullSafe(F.col("conv")))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "speaker",
            "body",
            own.alias("own"),
            header.alias("header"),
            F.floor(F.col("turn") / block).alias("block"),
        )
        .withColumn("segment", F.concat("header", "body", F.lit(f"{CLOSE}\n")))
        .withColumn("length", F.char_length("segment"))
    )
    key = ["conv_id", "perspective"]
    ordered = Window.partitionBy(*key, "block").orderBy(F.asc_nulls_last("turn"), "speaker", "body")
    placed = segments.withColumn("inside", F.sum("length").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = segments.groupBy(*key, "block").agg(F.sum("length").alias("total"))
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_last("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *[F.col(c).alias(f"{c}_") for c in (*key, "block")], F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")
    )
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*key, "block")]
    start = (F.col("base") + F.coalesce("inside", F.lit(0))).cast("long")
    mask_start = start + F.char_length("header")
    mask_end = F.when(F.col("own"), start + F.col("length") - 1).otherwise(mask_start)
    return placed.join(offsets, on[0] & on[1] & on[2]).select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "segment",
        start.alias("start"),
        mask_start.cast("long").alias("mask_start"),
        mask_end.cast("long").alias("mask_end"),
    )
