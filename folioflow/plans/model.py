"""The model's tables made of generic star-schema tables: books, chapters, listening, lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The order of chapters in a book, which the source's keys alone don't give.
CHAPTER_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of books: lines of orders. Lengths in seconds are whole numbers of hundredths."""
    w = Window.partitionBy("l_orderkey").orderBy(*CHAPTER_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book_id"),
        F.row_number().over(w).cast("long").alias("chapter_no"),
        (F.col("l_returnflag") != "R").alias("include"),
        (F.col("l_linestatus") == "F").alias("ready"),
        F.col("l_partkey").alias("words"),
        (F.col("l_quantity") * 30).alias("est_seconds"),
        (F.round(F.col("l_extendedprice")) / 4).alias("duration"),
        F.col("l_returnflag").alias("part"),
        F.col("l_suppkey").alias("key"),
    )


CHAPTERS_SQL = f"""
chapters AS (
  SELECT l_orderkey AS book_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(CHAPTER_ORDER)}) AS chapter_no,
    l_returnflag <> 'R' AS include, l_linestatus = 'F' AS ready, l_partkey AS words, l_quantity * 30 AS est_seconds,
    round(l_extendedprice) / 4 AS duration, l_returnflag AS part, l_suppkey AS key
  FROM lineitem)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books: orders, by status."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("book_id"),
        F.col("o_custkey").alias("author_id"),
        F.when(status == "F", "ready").when(status == "P", "rendering").otherwise("draft").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.round(F.col("o_totalprice")).alias("price"),
        F.col("o_orderpriority").alias("shelf"),
    )


BOOKS_SQL = """
books AS (
  SELECT o_orderkey AS book_id, o_custkey AS author_id,
    CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'rendering' ELSE 'draft' END AS status,
    o_orderdate AS created_at, round(o_totalprice) AS price, o_orderpriority AS shelf
  FROM orders)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listening: events, in whole seconds; the book comes from the properties."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("device"),
        F.floor(F.col("user_id") / 2).cast("long").alias("account"),
        "ts",
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("kind"),
        F.floor(F.col("value") * 4).cast("double").alias("seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("book_id"),
    )


TICKS_SQL = """
ticks AS (
  SELECT event_id, user_id AS device, CAST(floor(user_id / 2) AS BIGINT) AS account, ts, ts::DATE AS day, event_type AS kind,
    floor(value * 4) AS seconds, CAST(json_extract_string(props, '$.k') AS BIGINT) AS book_id
  FROM events)"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of books: lines of documents."""
    split = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    return split.select(F.col("doc_id").alias("book_id"), "lang", (F.col("pos") + 1).cast("long").alias("para_no"), "text")


PARAGRAPHS_SQL = """
paragraphs AS (
  SELECT doc_id AS book_id, lang, CAST(para_no AS BIGINT) AS para_no, text FROM (
    SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
      unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS para_no
    FROM documents))"""
