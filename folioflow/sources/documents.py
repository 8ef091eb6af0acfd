"""Documents on disk: JSON libraries, device statistics, uploads, versions, incremental work.

A library is a folder of JSON documents, one per book or device. Reading is schema-on-read with
defaults for fields that came later; there is no row-level update in plain files, so writers replace
whole documents, and readers take the latest of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, valid_day

BOOK_ID = "^bk_[0-9a-f]{8}$"
DEVICE_ID = "^[A-Za-z0-9_-]{8,64}$"
# Bounds of a day, of a book's seconds, of a time in seconds; lengths of ids and texts; size of a document.
DAY_SECONDS, BOOK_SECONDS, EPOCH, ID_CHARS, TEXT_CHARS, DOCUMENT_BYTES, UPLOAD_BYTES = 86_400, 10**7, 10**11, 40, 300, 2 * 1024 * 1024, 200 * 1024 * 1024

BOOK = (
    "id STRING, title STRING, author STRING, language STRING, pages INT, created_at BIGINT, status STRING, voice_id STRING, pace DOUBLE, page_labels ARRAY<STRING>, "
    "progress STRUCT<done_chunks: BIGINT, total_chunks: BIGINT, eta_seconds: DOUBLE, current_chapter: INT, stage: STRING>, "
    "chapters ARRAY<STRUCT<index: INT, title: STRING, include: BOOLEAN, words: BIGINT, est_seconds: DOUBLE, status: STRING, duration: DOUBLE, part: STRING, "
    "pages: ARRAY<INT>, sections: ARRAY<STRUCT<title: STRING, page: INT>>>>"
)
STATS = (
    "version INT, days MAP<STRING, STRUCT<listen: DOUBLE, app: DOUBLE, books: MAP<STRING, DOUBLE>>>, "
    "books MAP<STRING, STRUCT<title: STRING, author: STRING, furthest: DOUBLE, total: DOUBLE, finished_at: STRING, last_played_at: DOUBLE>>, goal_minutes DOUBLE, updated_at DOUBLE"
)


def read_books(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The books of a folder, newest first, of files of one document each or of one in each line; documents that can't be read are left out; later fields have defaults."""
    books = spark.read.schema(BOOK).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    return books.withColumns({"pace": F.coalesce("pace", F.lit(1.0)), "page_labels": F.coalesce("page_labels", F.array().cast("array<string>"))}).orderBy(F.desc("created_at"), "id")


def book(books: DataFrame, book_id: str) -> DataFrame:
    """One book by a well-formed id."""
    return books.where((F.col("id") == book_id) & F.lit(book_id).rlike(BOOK_ID))


def chapters_of(books: DataFrame) -> DataFrame:
    """The chapters of books as rows."""
    return books.select(F.col("id").alias("book_id"), F.posexplode("chapters").alias("chapter_no", "c")).select("book_id", "chapter_no", "c.*")


def zipped(texts: Column, pages: Column, default) -> Column:
    """Two parallel arrays as one; if the second has another length it counts as unknown."""
    known = F.when(F.size(texts) == F.size(pages), pages).otherwise(F.transform(texts, lambda _: F.lit(default)))
    return F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.get(known, i).alias("page")))


def write_books(books: DataFrame, path: str) -> None:
    """Whole documents; the committer renames, so a reader never sees half of one."""
    books.write.mode("overwrite").json(path)


def updated(books: DataFrame, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The books with a change to those of ``keys`` (id)."""
    keys = keys.select("id").distinct()
    return books.join(keys, "id", "left_anti").unionByName(change(books.join(keys, "id", "left_semi")))


def deleted(books: DataFrame, keys: DataFrame) -> DataFrame:
    """S12."""
    return books.join(keys.select("id"), "id", "left_anti")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Arrived files with a verdict: too large, no PDF by its first kilobyte, or fine."""
    files = spark.read.format("binaryFile").load(path)
    magic = F.locate("%PDF", F.decode(F.substring("content", 1, 1024), "ISO-8859-1")) > 0
    verdict = F.when(F.col("length") > UPLOAD_BYTES, "too large").when(~magic, "not a PDF").otherwise("ok")
    return files.select("path", "length", is_pdf(F.col("path"), F.lit(None).cast("string")).alias("named_pdf"), verdict.alias("verdict"))


def is_pdf(name: Column, kind: Column) -> Column:
    """P30."""
    return F.coalesce(name.rlike(r"(?i)\.pdf$"), F.lit(False)) | F.coalesce(kind == "application/pdf", F.lit(False))


def bytes_range(content: Column, size: Column, first: Column, last: Column) -> Column:
    """A range of a file's bytes: from a first to a last, or the last so many; null if it can't be met."""
    suffix = first.isNull()
    a = F.when(suffix, F.greatest(size - last, F.lit(0))).otherwise(first)
    b = F.when(suffix, size - 1).otherwise(F.least(F.coalesce(last, size - 1), size - 1))
    return F.when((a < size) & (a <= b) & (size > 0), F.substring(content, (a + 1).cast("int"), (b - a + 1).cast("int")))


# ---- device statistics


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Device documents, the device from the file's name; those that can't be read are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json$", 1).alias("device"), F.from_json("value", STATS, {"mode": "PERMISSIVE"}).alias("doc"))
    return raw.where(F.col("doc.days").isNotNull() & F.col("doc.books").isNotNull()).select("device", "doc.*")


def parsed_stats(raw: DataFrame) -> DataFrame:
    """Documents of a column ``body``, of devices with a well-formed id, within the size limit, coerced and bounded."""
    fine = raw.where(F.col("device").rlike(DEVICE_ID) & (F.octet_length("body") <= DOCUMENT_BYTES))
    doc = fine.withColumn("d", F.from_json("body", STATS))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))

    def keyed(m: Column) -> Column:
        entries = F.transform(F.map_entries(F.coalesce(m, none)), lambda e: F.struct(F.left(e["key"], F.lit(ID_CHARS)).alias("key"), clamp(e["value"], 0, DAY_SECONDS).alias("value")))
        return F.aggregate(entries, none, lambda a, e: F.map_concat(F.map_filter(a, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))

    days = F.transform_values(
        F.map_filter("d.days", lambda k, v: valid_day(k).isNotNull() & v.isNotNull()),
        lambda _, v: F.struct(clamp(v["listen"], 0, DAY_SECONDS).alias("listen"), clamp(v["app"], 0, DAY_SECONDS).alias("app"), keyed(v["books"]).alias("books")),
    )
    text = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(TEXT_CHARS))
    books = F.transform_values(
        F.map_filter("d.books", lambda _, v: v.isNotNull()),
        lambda _, v: F.struct(
            text(v["title"]).alias("title"), text(v["author"]).alias("author"), clamp(v["furthest"], 0, BOOK_SECONDS).alias("furthest"), clamp(v["total"], 0, BOOK_SECONDS).alias("total"),
            valid_day(v["finished_at"]).alias("finished_at"), clamp(v["last_played_at"], 0, EPOCH).alias("last_played_at"),
        ),
    )
    goal = F.coalesce(F.nullif(clamp(F.coalesce("d.goal_minutes", F.lit(30.0)), 0, 600).cast("int"), F.lit(0)), F.lit(30))
    return doc.where("d is not null").select(*[c for c in raw.columns if c != "body"], days.alias("days"), books.alias("books"), goal.alias("goal_minutes"), clamp("d.updated_at", 0, EPOCH).alias("updated_at"))


def latest(documents: DataFrame, key: Sequence[str], arrived: str) -> DataFrame:
    """Of each key the document that arrived last; uploading one again changes nothing."""
    w = Window.partitionBy(*key).orderBy(F.desc(arrived))
    return documents.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def day_facts(stats: DataFrame) -> DataFrame:
    """Device, day, listen, app."""
    return stats.select("device", F.explode("days").alias("day", "v")).select("device", F.to_date("day").alias("day"), "v.listen", "v.app")


def day_book_facts(stats: DataFrame) -> DataFrame:
    """Device, day, book_id, seconds."""
    return stats.select("device", F.explode("days").alias("day", "v")).select("device", F.to_date("day").alias("day"), F.explode("v.books").alias("book_id", "seconds"))


def book_facts(stats: DataFrame) -> DataFrame:
    """Device, book_id and what is known of the book."""
    return stats.select("device", F.explode("books").alias("book_id", "v")).select("device", "book_id", "v.*")


def snapshot(books: DataFrame, n: int = 10, leave_out: Sequence[str] = ("preview",)) -> DataFrame:
    """The newest books without their long fields."""
    return books.drop(*leave_out).orderBy(F.desc("created_at"), "id").limit(n)


def new_work(wanted: DataFrame, done: DataFrame, key: str = "plan_key") -> DataFrame:
    """Work whose contents haven't been done yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def changed_chapters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chapters whose text changed. Both have book_id, chapter_no, paragraphs."""
    before = old.select("book_id", "chapter_no", F.col("paragraphs").alias("_old"))
    return new.join(before, ["book_id", "chapter_no"]).where(~F.col("paragraphs").eqNullSafe(F.col("_old"))).select("book_id", "chapter_no")


def entries(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A key-value store: files of one JSON value each, by a prefix of their names."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json$", 1).alias("key"), F.parse_json("value").alias("value"))
    return files.where(F.startswith("key", F.lit(prefix)))
