"""Queries that write documents and files and read them back, and of device documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import library as B
from ..operators import listening as L
from ..sources import documents as J
from ..sources.shared import folder
from .model import BOOKS_SQL, TICKS_SQL, books, table, ticks
from .registry import query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as documents; older ones lack a pace and page labels."""
    n = F.col("book_id")
    made = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return books(spark, sf_dir).select(
        F.concat(F.lit("bk_"), F.lower(F.lpad(F.hex(n), 8, "0"))).alias("id"), F.concat(F.lit("Book "), n.cast("string")).alias("title"), "status", made.alias("created_at"),
        F.when(n % 2 == 0, 0.9).alias("pace"), F.when(n % 3 == 0, F.array(F.lit("i"), F.lit("ii"))).alias("page_labels"),
    )


_DOCUMENTS = f"""{BOOKS_SQL},
docs AS (
  SELECT 'bk_' || lower(lpad(to_base(book_id, 16), 8, '0')) AS id, 'Book ' || book_id AS title, status, CAST(epoch(created_at::TIMESTAMP) AS BIGINT) AS created_at,
    CASE WHEN book_id % 2 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS pace, CASE WHEN book_id % 3 = 0 THEN 2 ELSE 0 END AS labels FROM books)"""


@query(f"""WITH {_DOCUMENTS}
SELECT id, CASE WHEN status = 'rendering' THEN title || ', paused' ELSE title END AS title, CASE WHEN status = 'rendering' THEN 'paused' ELSE status END AS status, created_at, pace, labels
FROM docs WHERE status <> 'draft'""")
def stored_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written, some of them changed and others deleted, and read again."""
    first, second = folder(spark, "books"), folder(spark, "books")
    J.write_books(_documents(spark, sf_dir), first)
    known = J.read_books(spark, first, lines=True)
    paused = J.updated(known, known.where("status = 'rendering'"), lambda some: some.withColumns({"status": F.lit("paused"), "title": F.concat("title", F.lit(", paused"))}))
    J.write_books(J.deleted(paused, known.where("status = 'draft'")), second)
    return J.read_books(spark, second, lines=True).select("id", "title", "status", "created_at", "pace", F.size("page_labels").alias("labels"))


@query("""SELECT 'bk_00000001' AS asked, 'bk_' || lower(lpad(to_base(o_orderkey, 16), 8, '0')) AS id FROM orders WHERE o_orderkey = 1""")
def one_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point read; an id that isn't well formed finds nothing."""
    known = _documents(spark, sf_dir)
    found = [J.book(known, asked).select(F.lit(asked).alias("asked"), "id") for asked in ("bk_00000001", "bk_1", "../bk_00000001")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {TICKS_SQL}, d AS (SELECT device, count(DISTINCT day) AS n_days, sum(seconds) AS listen FROM ticks GROUP BY device)
SELECT n_days, listen, device::DOUBLE AS updated_at FROM d WHERE device % 5 <> 0""")
def stats_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each device; some aren't JSON, and are left out."""
    at = folder(spark, "stats")
    day = F.date_format("day", "yyyy-MM-dd")
    facts = ticks(spark, sf_dir).groupBy("device", day.alias("d")).agg(F.sum("seconds").alias("listen"))
    docs = facts.groupBy("device").agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("listen")))).alias("days"))
    body = F.to_json(F.struct("days", F.create_map(F.lit("b"), F.struct(F.lit("T").alias("title"))).alias("books"), F.col("device").cast("double").alias("updated_at")))
    docs.select(F.when(F.col("device") % 5 == 0, F.concat(F.lit("broken "), body)).otherwise(body).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    read = J.read_stats(spark, at)
    total = F.aggregate(F.map_values("days"), F.lit(0.0), lambda a, v: a + v["listen"])
    return read.select(F.size("days").cast("long").alias("n_days"), total.alias("listen"), "updated_at")


@query("""SELECT r_name AS name, 'part' AS prefix FROM region""")
def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of JSON values, read by the beginning of their keys."""
    at = folder(spark, "entries")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).write.option("maxRecordsPerFile", 1).json(at)
    told = J.entries(spark, at, "part-").unionByName(J.entries(spark, at, "other-"))
    return told.select(F.variant_get("value", "$.name", "string").alias("name"), F.substring("key", 1, 4).alias("prefix"))


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'ok' WHEN s_suppkey % 3 = 1 THEN 'not a PDF' ELSE 'not a PDF' END AS verdict, false AS named_pdf, count(*) AS n, CAST(sum(strlen(CASE WHEN s_suppkey % 3 = 0 THEN '  %PDF-1.7 ' || s_name
  WHEN s_suppkey % 3 = 1 THEN s_name ELSE repeat(' ', 2000) || '%PDF' END) + 1) AS BIGINT) AS bytes FROM supplier GROUP BY 1""")
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrived, by their first kilobyte."""
    at = folder(spark, "uploads")
    k = F.col("s_suppkey") % 3
    body = F.when(k == 0, F.concat(F.lit("  %PDF-1.7 "), "s_name")).when(k == 1, F.col("s_name")).otherwise(F.concat(F.repeat(F.lit(" "), 2000), F.lit("%PDF")))
    # Tasks move their own files to the folder; one after the other would take the driver long.
    told = table(spark, sf_dir, "supplier").select(body.alias("value")).write.option("maxRecordsPerFile", 1)
    told.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(at)
    return J.uploads(spark, f"{at}/part-*").groupBy("verdict", "named_pdf").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("""SELECT p_partkey, p_size % 3 = 0 OR p_type LIKE 'STANDARD%' AS is_pdf FROM part""")
def upload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the name's end or the MIME type."""
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".PDF").when(F.col("p_size") % 3 == 1, ".pdf.zip").otherwise("pdf"))
    kind = F.when(F.col("p_type").startswith("STANDARD"), "application/pdf").when(F.col("p_size") % 2 == 0, "text/plain")
    return table(spark, sf_dir, "part").select("p_partkey", J.is_pdf(name, kind).alias("is_pdf"))


@query(f"""WITH {TICKS_SQL}, d AS (SELECT account, day, count(DISTINCT book_id) AS books, sum(seconds) AS listen FROM ticks GROUP BY 1, 2)
SELECT account, day, listen, CASE WHEN day < DATE '2024-01-20' - 10 THEN 0 ELSE books END AS books FROM d""")
def compacted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days keep their totals, old ones not their books."""
    per_book = ticks(spark, sf_dir).groupBy("account", "day", "book_id").agg(F.sum("seconds").alias("s"))
    days = per_book.groupBy("account", "day").agg(F.sum("s").alias("listen"), F.map_from_entries(F.collect_list(F.struct(F.col("book_id").cast("string"), "s"))).alias("books"))
    return L.compact(days, F.lit("2024-01-20").cast("date"), keep_days=10).select("account", "day", "listen", F.size("books").cast("long").alias("books"))


@query(f"""WITH {TICKS_SQL}, d AS (SELECT device, book_id, max(seconds) AS furthest FROM ticks GROUP BY 1, 2)
SELECT device, book_id, furthest + 1000 AS furthest, 0 AS doc_order FROM d WHERE device = 1 UNION ALL SELECT device, book_id, furthest, 1 FROM d WHERE device <> 1""")
def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device's own documents replace the server's copies of them."""
    remote = ticks(spark, sf_dir).groupBy("device", "book_id").agg(F.max("seconds").alias("furthest"))
    own = remote.where("device = 1").withColumn("furthest", F.col("furthest") + 1000)
    return L.live_documents(own, remote, "1").select("device", "book_id", "furthest", "doc_order")


@query("""SELECT l_orderkey, l_linenumber, CAST(list_position(a, list_max(a)) - 1 AS BIGINT) AS best, count(*) AS n
FROM (SELECT l_orderkey, l_linenumber, [floor(l_quantity / 10), l_linenumber, floor(l_tax * 50), 3]::DOUBLE[] AS a FROM lineitem) GROUP BY ALL""")
def first_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the greatest of four numbers, the first of equal ones."""
    four = F.array(F.floor(F.col("l_quantity") / 10).cast("double"), F.col("l_linenumber").cast("double"), F.floor(F.col("l_tax") * 50).cast("double"), F.lit(3.0))
    told = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.first_best(four).alias("best"))
    return told.groupBy("l_orderkey", "l_linenumber", "best").agg(F.count(F.lit(1)).alias("n"))
