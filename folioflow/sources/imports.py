"""Import of books: lines of print, or PDF files, to books with chapters, as one job or as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import structure as D
from . import pdf
from .shared import exists


def imported(lines: DataFrame, at: str | Callable[[str], str], toc: DataFrame | None = None, lots: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, their chapters and their paragraphs, of lines as in :mod:`structure`, written below ``at``, or where it says for a table's name.

    Each table is written before the next is made of it, so no step is planned or run twice. Books whose pages hold pictures of text alone are left out. ``toc`` is as
    :func:`structure.outline_levels` takes it; a book whose outline gives two chapters or more is cut by it. ``books`` has book_id, language (that
    of the narration), warning, method, pages, n_chapters, words, est_seconds of what is read; the table ``texts`` has the paragraphs of every chapter.
    Books are imported in so many ``lots`` one after the other, dealt by their numbers, so that shuffles of one lot alone lie on disks at a time.
    """
    place = at if callable(at) else lambda name: f"{at}/{name}"
    told: tuple[DataFrame, ...] = ()
    for k in range(lots):
        mine = F.pmod(F.xxhash64("book_id"), F.lit(lots)) == k if lots > 1 else F.lit(True)
        told = _lot(lines.where(mine), place, None if toc is None else toc.where(mine), mine, "append" if k else "overwrite")
    books, chapters, paras = (lines.sparkSession.read.schema(df.schema).parquet(place(name)) for df, name in zip(told, ("books", "chapters", "paragraphs")))
    return books, chapters, paras


def _lot(lines: DataFrame, place: Callable[[str], str], toc: DataFrame | None, mine: Column, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = lines.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.mode(mode).parquet(place(name))
        return spark.read.schema(df.schema).parquet(place(name)).where(mine)

    sizes = stored(D.body_size(lines), "sizes")
    paras = stored(D.with_text(D.structured(lines, sizes)), "paragraphs")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "text"))), lambda p: p["text"]), " ")
    texts = paras.groupBy("book_id").agg(whole.alias("text"), (F.max("page") + 1).alias("pages"))
    told = stored(T.detect_languages(texts, ["book_id", "pages"], "text").select("book_id", "pages", T.narration_language("detected").alias("n")), "languages")
    langs = told.select("book_id", F.col("n.language").alias("lang"))
    sized = sizes.join(told.select("book_id", "pages"), "book_id")
    outline = None
    if toc is not None:
        entries = D.outline_levels(toc).withColumn("page", F.col("page") - 1)
        outline = stored(D.outline_places(entries, paras, sizes), "outlines")
    found = stored(D.with_subtitles(D.detect(paras, sized, outline), paras, sizes), "headings")
    chapters = stored(D.chapters(found, paras, langs), "chapters")
    stored(D.chapter_texts(found, chapters, paras, langs), "texts")
    read = F.col("include")
    sums = chapters.groupBy("book_id").agg(
        F.min("method").alias("method"), F.count_if(read).alias("n_chapters"), F.sum(F.when(read, F.col("words")).otherwise(0)).alias("words"), F.round(F.sum(F.when(read, F.col("est_seconds")).otherwise(0.0)), 1).alias("est_seconds")
    )
    books = stored(told.select("book_id", "pages", "n.*").join(sums, "book_id"), "books")
    return books, chapters, paras


def import_files(files: DataFrame, at: str, label: str) -> bool:
    """PDF files (path, content) into the library below ``at``, as the lot ``label``; whether there was anything new.

    A book is known by its content: files that an earlier lot has are passed over, and of equal ones in a lot
    the least path counts. Every table has a folder for each lot (``books/lot=...``), and the table ``files``
    (path, sha256, reason, title, author, pages, book_id) is written last, so a lot that broke off is not known, and is
    replaced as a whole when it is run again. Nothing is written where nothing is new.
    """
    spark = files.sparkSession
    place = lambda name: f"{at}/{name}/lot={label}"
    told = pdf.documents(files).withColumn("book_id", pdf.book_id(F.col("sha256")))
    if exists(spark, f"{at}/files"):
        known = spark.read.parquet(f"{at}/files").where(F.col("lot") != label).select("sha256").distinct()
        told = told.join(known, "sha256", "left_anti")
    if told.isEmpty():
        return False
    told.write.mode("overwrite").parquet(place("arrived"))
    told = spark.read.schema(told.schema).parquet(place("arrived"))
    new = told.where("reason is null").groupBy("sha256").agg(F.min("path").alias("path"))
    runs = pdf.shown(files.join(new.select("path"), "path", "left_semi"))
    lines = pdf.lines(runs)
    lines.write.mode("overwrite").parquet(place("print"))
    lines = spark.read.schema(lines.schema).parquet(place("print"))
    books = told.join(new.select("path"), "path", "left_semi")
    toc = books.select("book_id", F.inline("outline"), "pages").select("book_id", "ord", "level", "title", "page", "pages")
    imported(lines, place, toc)
    own = books.select("book_id", F.posexplode("labels").alias("page", "label"))
    D.page_labels(own, D.printed_numbers(lines)).write.mode("overwrite").parquet(place("labels"))
    told.drop("outline", "labels").write.mode("overwrite").parquet(place("files"))
    return True


def import_stream(spark: SparkSession, path: str, at: str, state: str, name: str = "library", names: str = "*.{pdf,PDF}") -> None:
    """Imports the files below ``path`` that have arrived since the last run, each book once. ``name`` tells streams into one library apart; ``state`` is the stream's own folder."""
    files = pdf.files(spark, path, stream=True, names=names)
    run = files.writeStream.foreachBatch(lambda lot, number: import_files(lot, at, f"{name}-{number}") and None).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()


def library(spark: SparkSession, at: str, table: str) -> DataFrame:
    """A table of a library: of the lots that were finished."""
    lots = spark.read.parquet(f"{at}/files").select("lot").distinct()
    return spark.read.parquet(f"{at}/{table}").join(F.broadcast(lots), "lot", "left_semi")


def changed_chapters(old: DataFrame, new: DataFrame) -> DataFrame:
    """book_id, chapter_no of chapters whose paragraphs differ between two readings of the same books (book_id, chapter_no, para_no, text); none of a book whose chapters are others in number."""
    n = lambda df, name: df.groupBy("book_id").agg(F.count_distinct("chapter_no").alias(name))
    same = n(old, "a").join(n(new, "b"), "book_id").where("a = b").select("book_id")
    key = ["book_id", "chapter_no", "para_no"]
    a, b = old.select(*key, F.col("text").alias("_a")), new.select(*key, F.col("text").alias("_b"))
    differ = a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return differ.join(same, "book_id", "left_semi").select("book_id", "chapter_no").distinct()
