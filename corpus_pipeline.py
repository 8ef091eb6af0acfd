"""The corpus pipeline: quality rules, exact and near deduplication, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. Between stages rows are written as Parquet and read again,
so an executor that is lost costs the work of its stage alone.

Defined cases: an empty table gives empty stages; a null text has no words and goes with the quality
rules, as empty ones do; a text of any length is read in whole; a null source is a host and a source
of its own; of exact copies the largest id stays, a null id only if no copy has another, and of
repeated rows one; of near copies the least id stays, a null id after all others; further columns,
whatever their names, are carried through to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import exact_dedup, mixing, near_dedup, packing, quality
from folioflow.llm.common import discard, materialise, noted, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that fail the base rules, or come from a rejected host, go."""
    return quality.keep_rows(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts, the row with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each class of near copies, the row with the least id stays."""
    return near_dedup.keep_rows(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents by the copies that the targets of their sources ask for."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("packing", packed),
]

#: The stages of near deduplication and packing have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last: list[str] = []
    for name, stage in STAGES[:-1]:
        with noted() as paths:
            docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        # Only the stage's own result is read from here on.
        discard(spark, last + paths[:-1])
        last = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
