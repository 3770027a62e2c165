"""A dialogue rendered once for every participant, with that speaker as the assistant.

Native DataFrame operations only.  A view is one (conversation, speaker).  In it the
speaker's turns are assistant turns and targets of training, those of others are user
turns that name their speaker, and narrators (``system``) are system turns in every view
without a view of their own.  The result is a table of turns with their place in the
view: ``[start, end)`` is the span of the rendered segment, ``[target_start, end)`` the
span that the loss covers (null for other turns).  ``rendered`` joins views to texts.

Places are running sums of lengths.  They are taken in two levels, inside range
partitions of the ordered turns and over one row per partition and view, so a
conversation with a large share of all turns is split between tasks.

Defined results: a null role is the speaker named ``unknown``; a null text counts as
empty; turns stand in the order of turn, role and text, null turns first; repeated rows
are repeated turns; rows with a null conv_id form one conversation; a conversation
that has narrators only has no view; an empty role is a speaker with an empty name;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.storage import stored, with_place

END = "<|end|>\n"


def perspectives(
    turns: DataFrame,
    narrators: Sequence[str] = ("system",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv, speaker, position, turn, role, tag, segment, start, end, target_start of all views."""
    own = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = with_place(own, "conv", "turn", "role", "text")
    narrated = F.col("role").isin(*narrators) if narrators else F.lit(False)
    speakers = stored(
        ordered.where(~narrated).select(F.col("conv").alias("_conv"), F.col("role").alias("speaker"))
        .distinct()
    )
    is_target = F.col("role") == F.col("speaker")
    tag = (
        F.when(is_target, F.lit("assistant")).when(narrated, F.lit("system")).otherwise(F.lit("user"))
    )
    named = F.when(tag == "user", F.concat(F.lit(" name="), F.col("role"))).otherwise(F.lit(""))
    head = F.concat(F.lit("<|"), tag, named, F.lit("|>\n"))
    views = (
        ordered.join(speakers, F.col("conv").eqNullSafe(F.col("_conv")))
        .select(
            "conv", "speaker", "turn", "role", "_part", "_index",
            tag.alias("tag"),
            F.concat(head, F.col("text"), F.lit(END)).alias("segment"),
            F.when(is_target, F.length(head)).alias("_head"),
        )
        .withColumn("_length", F.length("segment").cast("long"))
    )
    view_part = ["conv", "speaker", "_part"]
    before = Window.partitionBy(*view_part).orderBy("_index").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = views.withColumn("_place", F.row_number().over(
        Window.partitionBy(*view_part).orderBy("_index")
    ) - 1).withColumn("_chars", F.coalesce(F.sum("_length").over(before), F.lit(0)))

    earlier = Window.partitionBy("conv", "speaker").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        views.groupBy(*view_part).agg(F.count("*").alias("_n"), F.sum("_length").alias("_sum"))
        .select(
            F.col("conv").alias("_conv"), F.col("speaker").alias("_speaker"), F.col("_part").alias("_of"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_turns_before"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_chars_before"),
        )
    )
    start = F.col("_chars_before") + F.col("_chars")
    return inside.join(
        bases,
        F.col("conv").eqNullSafe(F.col("_conv"))
        & (F.col("speaker") == F.col("_speaker"))
        & (F.col("_part") == F.col("_of")),
    ).select(
        F.col("conv").alias(conv_col),
        "speaker",
        (F.col("_turns_before") + F.col("_place")).alias("position"),
        "turn",
        "role",
        "tag",
        "segment",
        start.alias("start"),
        (start + F.col("_length")).alias("end"),
        (start + F.col("_head")).alias("target_start"),
    )


def rendered(views: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per view: conv, speaker, text, masks; for dialogues that fit into a row."""
    piece = F.struct("position", "segment", "target_start", "end")
    pieces = F.sort_array(F.collect_list(piece))
    grouped = views.groupBy(conv_col, "speaker").agg(pieces.alias("_pieces"))
    targets = F.filter("_pieces", lambda p: p["target_start"].isNotNull())
    return grouped.select(
        conv_col,
        "speaker",
        F.array_join(F.transform("_pieces", lambda p: p["segment"]), "").alias("text"),
        F.transform(
            targets, lambda p: F.struct(p["target_start"].alias("start"), p["end"].alias("end"))
        ).alias("masks"),
    )
