"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

A conversation is rendered once for each of its participants. In a participant's rendering that
speaker is the assistant, every other speaker is a user who is named, and ``system`` turns stay as
they are; only what the assistant says (with its end mark) is trained on, which the mask's spans
tell by character offsets.

A rendering comes in pieces of ``piece_turns`` consecutive turn numbers, so that neither a
conversation of any length nor a frequent conversation id gathers in one task; pieces concatenate
in order of piece, then part.

Defined cases: a null text is empty; a null or blank role speaks as ``unknown``; the roles
``system`` alone are no participants, so a conversation of only such turns has no rendering; turns
with the same number are ordered by role, then text, and more than ``piece_turns`` turns of one
number continue in further parts of the piece; a null turn counts as -1; a null conversation id is
a conversation of its own; repeated rows are repeated turns; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_turns: int = 32) -> DataFrame:
    """One row per conversation, participant and piece: conv_id, perspective, piece, part, n_turns, n_chars, rendered, mask.

    ``mask`` holds the spans (start, length) of ``rendered`` that are trained on, from offset 0.
    """
    name = F.regexp_replace(F.trim(F.coalesce(turns[role_col].cast("string"), F.lit(""))), r"\s+", "_")
    said = turns.select(
        turns[conv_col].alias("conv_id"),
        F.coalesce(turns[turn_col].cast("long"), F.lit(-1)).alias("_turn"),
        F.when(name == "", F.lit("unknown")).otherwise(name).alias("_who"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("_text"),
    )
    cast = said.where("_who != 'system'").groupBy("conv_id", "_who").agg(F.lit(1).alias("_one")).select(F.col("conv_id").alias("_conv"), F.col("_who").alias("perspective"))
    tie = Window.partitionBy("conv_id", "_turn").orderBy("_who", "_text")
    placed = said.withColumn("_seq", F.row_number().over(tie) - 1)
    placed = placed.withColumns({"piece": F.floor(F.col("_turn") / piece_turns).cast("long"), "part": F.floor(F.col("_seq") / piece_turns).cast("long")})
    seen = placed.join(cast, F.col("conv_id").eqNullSafe(F.col("_conv")))
    mine = F.col("_who") == F.col("perspective")
    role = F.when(F.col("_who") == "system", "system").when(mine, "assistant").otherwise(F.concat(F.lit("user name="), F.col("_who")))
    head = F.concat(F.lit(_OPEN), role, F.lit("\n"))
    shown = seen.select(
        "conv_id", "perspective", "piece", "part",
        F.struct("_turn", "_seq", head.alias("head"), F.concat("_text", F.lit(_CLOSE)).alias("body"), mine.alias("mine")).alias("_t"),
    )
    pieces = shown.groupBy("conv_id", "perspective", "piece", "part").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    lengths = F.transform("_ts", lambda t: F.length(t["head"]) + F.length(t["body"]))
    starts = F.transform("_ts", lambda t, i: F.aggregate(F.slice(F.col("_n"), F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(t["head"]))
    spans = F.transform(
        F.filter(F.arrays_zip("_ts", "_at"), lambda z: z["_ts"]["mine"]),
        lambda z: F.struct(z["_at"].alias("start"), F.length(z["_ts"]["body"]).alias("length")),
    )
    return (
        pieces.withColumn("_n", lengths)
        .withColumn("_at", starts)
        .select(
            "conv_id", "perspective", "piece", "part",
            F.size("_ts").cast("long").alias("n_turns"),
            F.aggregate("_n", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_chars"),
            F.array_join(F.transform("_ts", lambda t: F.concat(t["head"], t["body"])), "").alias("rendered"),
            spans.alias("mask"),
        )
    )
