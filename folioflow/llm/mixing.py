"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target of words; its documents are laid one after the other, each over an
interval as long as its expected number of copies (the target over the source's size), one random
offset is added per source, and a document is emitted once for every integer boundary that its
interval crosses. Documents lie in order of size, so a source's words come near its target however
uneven the sizes are, and no document is emitted more often than its expectation rounded up.

The prefix sum needs no task that sees a whole source: documents are ranked within blocks (source,
size, slice of the hashed id), whose number grows with the square root of the rows, and the blocks'
starts come from sums over blocks.

Defined cases: a null text has size 0; documents of size 0 and sources without a word are never
taken; a null source is a source of its own, the last in order; a null id is an id like others;
repeated rows are separate documents with their own copies; further columns are passed on; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(c: Column) -> Column:
    """The first 32 bits of an MD5, which other SQL engines have too."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per source: _source, source_size, target.

    ``sizes`` has _source and source_size. Targets share ``share`` times all sizes by weight; a
    target stops at ``cap`` times its source, and what is too much is shared anew by weight. That
    ends where every open source has the same words per weight, found here by one sweep over the
    sources in order of cap over weight.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sizes.withColumn("_w", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("long"))
    every = Window.partitionBy()
    sweep = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("_source").asc_nulls_last())
    before = sweep.rowsBetween(Window.unboundedPreceding, -1)
    swept = (
        weighed.withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_capped", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", (F.lit(float(share)) * F.col("_total") - F.col("_capped")) / F.col("_left"))
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("source_size") * cap)
    )
    level = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return swept.withColumn("_at", level).select(
        "_source",
        "source_size",
        F.least(F.coalesce(F.col("_at") * F.col("_w"), (F.col("source_size") * cap).cast("double")), (F.col("source_size") * cap).cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 7,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc (the columns ``keep``, or all), size, source_size, target, copies (how often it is emitted)."""
    kept = list(keep or docs.columns)
    sized = docs.select(
        F.struct(*kept).alias("doc"),
        n_words(docs[text_col]).alias("size"),
        docs[source_col].cast("string").alias("_source"),
        docs[id_col].alias("_id"),
        _hash32(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("_h"),
    )
    if text_col not in kept:  # without texts, rows are stored once for both uses
        sized = materialise(sized, "mixing-rows")
    slim = sized if text_col not in kept else materialise(sized.select("_source", "size", "_h"), "mixing-sizes")
    by_size = slim.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("_n"))
    slices = max(1, int(slim.count() ** 0.5))
    sliced = F.pmod(F.col("_h"), F.lit(slices))
    blocks = slim.withColumn("_slice", sliced).groupBy("_source", "size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # Starts: of a size within its source (as many rows as sizes), of a slice within its size.
    up = Window.partitionBy("_source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("_source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(by_size.groupBy("_source").agg(F.sum(F.col("_n") * F.col("size")).alias("source_size")), weights, share, cap)
    starts = by_size.withColumn("_s0", F.coalesce(F.sum("_n").over(up), F.lit(0))).select(F.col("_source").alias("_s"), F.col("size").alias("_z"), "_s0")
    whole = starts.join(targets.withColumnRenamed("_source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    laid = blocks.withColumn("_s1", F.coalesce(F.sum("_n").over(along), F.lit(0))).join(
        whole, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    )
    laid = laid.select(F.col("_source").alias("_bs"), F.col("size").alias("_bz"), F.col("_slice").alias("_bl"), (F.col("_s0") + F.col("_s1")).alias("_start"), "source_size", "target")
    within = Window.partitionBy("_source", "size", "_slice").orderBy("_h", "_id")
    ranked = sized.withColumn("_slice", sliced).withColumn("_rank", F.row_number().over(within) - 1)
    placed = ranked.join(laid, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("size") == F.col("_bz")) & (F.col("_slice") == F.col("_bl")))
    each = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash32(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")))) / F.lit(4294967296.0)
    at = F.col("_start") + F.col("_rank")
    copies = (F.floor((at + 1) * each + offset) - F.floor(at * each + offset)).cast("long")
    return placed.withColumn("copies", copies).select("doc", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    told = mix(docs, **how)
    return told.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
