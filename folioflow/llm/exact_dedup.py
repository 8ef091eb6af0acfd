"""Exact deduplication by skew-safe combining.

Three stages, each of which compares whole texts and never digests alone:

1. every task deduplicates what it holds (the map side of the first aggregation);
2. groups of equal digest, salt and text are merged, so that a text with very many copies is
   spread over ``salts`` tasks;
3. the winners of the salts are combined by digest and text.

Only one row per text and salt reaches the last stage. The verdicts, without texts, are written
to the shared folder and joined back by digest; texts of the same digest that differ (which
nobody has seen for SHA-256, but nothing here relies on that) are told apart by content.

Defined cases: a null text counts as an empty one; a null id ranks below every id; repeated rows
are copies of each other and share an id, so each has the ``kept`` of that id, and
:func:`exact_dedup` leaves one of them; further columns
are ignored by :func:`exact_groups` and passed on by :func:`exact_dedup`; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions


def _normalised(df: DataFrame, text: str) -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def _combined(docs: DataFrame, id_col: str, text_col: str, salts: int | None) -> DataFrame:
    """One row per distinct text: _digest, _text, keep_id, group_size."""
    salts = salts or 2 * partitions(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), _normalised(docs, text_col).alias("_text"))
    keyed = slim.withColumn("_digest", F.unhex(F.sha2(F.col("_text"), 256)))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    local = salted.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return local.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per distinct text: _digest, keep_id, group_size, and _only, the text, where a digest has several."""
    combined = _combined(docs, id_col, text_col, salts)
    told = materialise(combined.drop("_text"), "exact-verdicts").withColumn("_only", F.lit(None).cast("string"))
    several = told.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_digest")
    if several.isEmpty():
        return told
    by_text = materialise(combined.join(several, "_digest", "left_semi").withColumnRenamed("_text", "_only"), "exact-clashes")
    return told.join(several, "_digest", "left_anti").unionByName(by_text)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256."""
    told = verdicts(docs, id_col, text_col, salts)
    return _joined(docs, told, id_col, text_col).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: one for each distinct text, that of the largest id."""
    told = verdicts(docs, id_col, text_col, salts)
    digest = F.unhex(F.sha2(_normalised(docs, text_col), 256))
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    keys = ["_i", "_none", "_digest"]
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(docs[id_col], zero).alias("_i"), docs[id_col].isNull().alias("_none"), digest.alias("_digest"))
    winner = told.select("_digest", F.coalesce("keep_id", zero).alias("_i"), F.col("keep_id").isNull().alias("_none"), "_only")
    text = F.coalesce(F.col("_row")[text_col].cast("string"), F.lit(""))
    stay = whole.join(winner, keys).where(F.col("_only").isNull() | (F.col("_only") == text))
    # Repeated rows share id and text, and stand together by the join's keys.
    first = F.row_number().over(Window.partitionBy(*keys, "_only").orderBy("_i"))
    return stay.withColumn("_first", first).where("_first = 1").select("_row.*")


def _joined(docs: DataFrame, told: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = _normalised(docs, text_col)
    keyed = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"))
    plain = keyed.join(told.where(F.col("_only").isNull()).drop("_only"), "_digest")
    several = told.where(F.col("_only").isNotNull())
    if not several.isEmpty():
        full = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"), text.alias("_only"))
        plain = plain.unionByName(full.join(several, ["_digest", "_only"]).drop("_only"))
    return plain.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
