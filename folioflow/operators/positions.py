"""Positions in a book: offsets, the chapter or page at a second, the place of a page, where to go on.

``chapters`` has book_id, chapter_no, include, ready, duration, est_seconds and what each operator names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import asof_join, before, island

# Tolerance of a position, silence around a chapter, where a chapter counts as over.
TOLERANCE, LEAD_IN, TAIL, NEAR_END, RESTART, HINT = 0.05, 0.6, 1.4, 3.0, 3.0, 30.0

_BOOK, _ORDER = ["book_id"], ["chapter_no"]


def length(pace: Column | None = None) -> Column:
    """A chapter's seconds: known, else estimated; 0 counts as unknown."""
    known = F.nullif(F.col("duration"), F.lit(0.0))
    return F.coalesce(known, F.coalesce("est_seconds", F.lit(0.0)) / (pace if pace is not None else F.lit(1.0)))


def offsets(chapters: DataFrame) -> DataFrame:
    """The second at which each chapter begins in the book's one file."""
    return chapters.withColumn("offset", F.round(before(F.coalesce("duration", F.lit(0.0)), _BOOK, _ORDER), 3).cast("double"))


def book_position(chapters: DataFrame) -> DataFrame:
    """Seconds of the included chapters before each chapter."""
    return chapters.withColumn("position", before(F.when(F.coalesce("include", F.lit(True)), length()).otherwise(0.0), _BOOK, _ORDER))


def chapter_numbers(chapters: DataFrame) -> DataFrame:
    """The number that is shown for each included chapter."""
    included = chapters.where(F.coalesce("include", F.lit(True)))
    return included.withColumn("number", F.row_number().over(Window.partitionBy(*_BOOK).orderBy(*_ORDER)).cast("long"))


def chapter_at(probes: DataFrame, chapters: DataFrame) -> DataFrame:
    """The last chapter that begins at or before a second of the book, else the first. ``probes`` has book_id, t."""
    return asof_join(probes, chapters, _BOOK, "t", "offset", ["chapter_no"], TOLERANCE, first_if_none=True)


def page_at(probes: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """The page of the last mark at or before a second, else of the first. ``marks`` has page, at."""
    return asof_join(probes, marks, by, "t", "at", ["page"], TOLERANCE, first_if_none=True)


def chapter_of_position(probes: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter of a second of the book's included audio, and the second in it; the last takes what is over."""
    laid = book_position(chapters.where(F.coalesce("include", F.lit(True)))).withColumn("_length", length())
    found = asof_join(probes, laid, _BOOK, "t", "position", ["chapter_no", "position", "_length"], 0.0, first_if_none=True)
    inside = F.greatest(F.lit(0.0), F.least(F.col("t") - F.col("position"), F.col("_length")))
    return found.withColumn("time", inside).drop("position", "_length")


def page_in_pdf(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """A page as it is printed -> the page of the file. ``asked`` has book_id, page (text); ``labels`` book_id, pdf_page, label.

    The first page with that very label; else of a number the last page, in the file's order, whose
    number isn't greater, else the first page with a number; else page 1.
    """
    s = F.lower(F.trim("page"))
    numbers = labels.where(F.trim("label").rlike("^[0-9]+$")).select("book_id", "pdf_page", F.trim("label").cast("long").alias("_n"))
    exact = labels.groupBy("book_id", F.lower(F.trim("label")).alias("_l")).agg(F.min("pdf_page").alias("_exact"))
    first = numbers.groupBy("book_id").agg(F.min("pdf_page").alias("_first"))
    keyed = asked.withColumns({"_l": s, "_want": F.try_to_number(F.when(s.rlike("^-?[0-9]{1,15}$"), s), F.lit("S999999999999999")).cast("long")})
    # The last page so far for every number: a running maximum over the numbers in order.
    upto = Window.partitionBy("book_id").orderBy("_n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    steps = numbers.withColumn("_last", F.max("pdf_page").over(upto)).select("book_id", "_n", "_last")
    found = asof_join(keyed.join(exact, ["book_id", "_l"], "left"), steps, ["book_id"], "_want", "_n", ["_last"]).join(first, "book_id", "left")
    number = F.when(F.col("_want").isNull(), F.lit(1)).otherwise(F.coalesce("_last", "_first", F.greatest(F.col("_want"), F.lit(1))))
    return found.withColumn("pdf_page", F.coalesce("_exact", number)).drop("_l", "_want", "_exact", "_last", "_first")


def time_at(marks: Column, page: Column) -> Column:
    """The second at which a page begins: its own mark, else the last one of an earlier page before any later page."""
    state = F.struct(F.lit(0.0).alias("best"), F.lit(False).alias("done"))

    def step(s: Column, m: Column) -> Column:
        here, past = m["page"] == page, m["page"] > page
        return F.struct(F.when(s["done"] | past, s["best"]).otherwise(m["t"].cast("double")).alias("best"), (s["done"] | here | past).alias("done"))

    return F.aggregate(F.coalesce(marks, F.array()), state, step, lambda s: s["best"])


def locate(asked: DataFrame, chapters: DataFrame) -> DataFrame:
    """The narrated chapter of a page. ``asked`` has book_id, page; ``chapters`` also first_page, last_page.

    The last included chapter that begins at or before the page, else the first; from more than one
    page after its end on, the next one. The page is moved into the chapter's range. Also the chapter
    that isn't narrated and holds the page.
    """
    told = chapters.where(F.col("first_page").isNotNull())
    told = told.withColumn("_in", F.coalesce("include", F.lit(True)))
    w = Window.partitionBy("book_id").orderBy("chapter_no")
    narrated = told.where("_in").withColumns({
        "_here": F.struct("chapter_no", "first_page", "last_page"),
        "_next": F.lead(F.struct("chapter_no", "first_page", "last_page")).over(w),
    })
    skipped = told.where("not _in").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", "first_page", "last_page"))).alias("_skipped"))
    # Of chapters that begin on one page the last counts, as in the order of chapters.
    found = asof_join(asked, narrated.withColumn("_no", F.col("chapter_no")), ["book_id"], "page", "first_page", ["_no", "_here", "_next"], 0.0, first_if_none=True)
    later = F.col("_next").isNotNull() & (F.col("page") >= F.col("_here.first_page")) & (F.col("page") > F.col("_here.last_page") + 1)
    chosen = found.where("_here is not null").withColumn("_c", F.when(later, F.col("_next")).otherwise(F.col("_here"))).join(skipped, "book_id", "left")
    held = F.filter("_skipped", lambda s: F.col("page").between(s["first_page"], s["last_page"]))
    return chosen.select(
        *asked.columns,
        F.col("_c.chapter_no").alias("chapter_no"),
        F.least(F.greatest(F.col("page"), F.col("_c.first_page")), F.col("_c.last_page")).alias("target"),
        F.get(held, 0)["chapter_no"].alias("skipped_no"),
    )


def part_of_page(page_lists: Column, page: Column) -> Column:
    """The first part that lists the page, else the last that begins at or before it, else 0 (counted from 0)."""
    held = F.array_position(F.transform(page_lists, lambda p: F.array_contains(p, page)), True)
    begun = F.filter(F.transform(page_lists, lambda p, i: F.when(F.get(p, 0) <= page, i)), lambda i: i.isNotNull())
    return F.when(held > 0, held - 1).otherwise(F.coalesce(F.array_max(begun), F.lit(0))).cast("int")


def page_list(pages: Column, low: Column, high: Column) -> Column:
    """The pages of a part, from its range where they aren't listed."""
    return F.coalesce(pages, F.sequence(low, high))


def locate_label(asked: DataFrame, marks: DataFrame) -> DataFrame:
    """Where a page's label is first found: among chapters' first pages, then marks, then parts. ``marks`` has book_id, label, kind, chapter_no, t."""
    rank = F.when(F.col("kind") == "chapter", 0).when(F.col("kind") == "mark", 1).otherwise(2)
    first = marks.groupBy("book_id", F.lower("label").alias("_l")).agg(F.min(F.struct(rank.alias("r"), "chapter_no", "t", "kind")).alias("_f"))
    return asked.withColumn("_l", F.lower("page")).join(first, ["book_id", "_l"], "left").select(*asked.columns, "_f.kind", "_f.chapter_no", "_f.t")


def part_durations(parts: DataFrame) -> DataFrame:
    """Unknown durations as the mean of the chapter's known ones, else its estimate shared, else 30 s. ``parts`` has book_id, chapter_no, part_no, duration, est_seconds."""
    w = Window.partitionBy("book_id", "chapter_no")
    known = F.when(F.col("duration") > 0, F.col("duration"))
    share = F.nullif(F.coalesce("est_seconds", F.lit(0.0)) / F.count(F.lit(1)).over(w), F.lit(0.0))
    return parts.withColumn("length", F.coalesce(known, F.avg(known).over(w), share, F.lit(30.0)))


def part_starts(parts: DataFrame) -> DataFrame:
    """The second of its chapter at which each part begins. ``parts`` has length."""
    return parts.withColumn("start", before(F.col("length"), ["book_id", "chapter_no"], ["part_no"]))


def part_at(probes: DataFrame, parts: DataFrame) -> DataFrame:
    """The part of a second of a chapter, and the second in it. ``probes`` has book_id, chapter_no, t."""
    found = asof_join(probes, part_starts(parts), ["book_id", "chapter_no"], "t", "start", ["part_no", "start", "length"], 0.0, first_if_none=True)
    return found.withColumn("inside", F.greatest(F.lit(0.0), F.least(F.col("t") - F.col("start"), F.col("length")))).drop("start", "length")


def neighbours(chapters: DataFrame, playable: Column) -> DataFrame:
    """The next and previous playable chapter of every chapter."""
    own = F.when(playable, F.col("chapter_no"))
    w = Window.partitionBy("book_id").orderBy("chapter_no")
    return chapters.withColumns({
        "next_no": F.min(own).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "previous_no": F.max(own).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })


def going_back(time: Column, previous: Column, current: Column) -> Column:
    """Back goes to the chapter's beginning when it has run for a while, or when there is none before."""
    return F.when(time > RESTART, current).otherwise(F.coalesce(previous, current))


def resume(positions: DataFrame, chapters: DataFrame, playable: Column) -> DataFrame:
    """Where to go on. ``positions`` has book_id, saved_no, saved_time, furthest.

    The saved position, else the furthest on any device from 30 s on; a chapter within 3 s of its end
    leads to the next playable one; a chapter that can't be played leads to the next one that can,
    else the first.
    """
    laid = chapters.where(playable)
    w = Window.partitionBy("book_id").orderBy("chapter_no")
    nexts = laid.select("book_id", F.col("chapter_no").alias("_no"), "duration", "ready", F.lead("chapter_no").over(w).alias("_next"))
    first = laid.groupBy("book_id").agg(F.min("chapter_no").alias("_first"))
    hint = positions.where(F.col("saved_no").isNull() & (F.col("furthest") > HINT)).select("book_id", F.col("furthest").alias("t"))
    hinted = chapter_of_position(hint, chapters).select("book_id", F.col("chapter_no").alias("_hint_no"), F.col("time").alias("_hint_time"))
    at = positions.join(hinted, "book_id", "left").withColumns({"_no": F.coalesce("saved_no", "_hint_no"), "_t": F.when(F.col("saved_no").isNotNull(), F.col("saved_time")).otherwise(F.col("_hint_time"))})
    here = at.join(nexts, ["book_id", "_no"], "left").join(first, "book_id")
    # For chapters that can't be played: the first playable one after them.
    after = asof_next(here.where(F.col("ready").isNull() & F.col("_no").isNotNull()).select("book_id", "_no"), laid)
    here = here.join(after, ["book_id", "_no"], "left")
    over = F.col("ready") & (F.coalesce("duration", F.lit(0.0)) > 0) & (F.coalesce("_t", F.lit(0.0)) > F.col("duration") - NEAR_END) & F.col("_next").isNotNull()
    there = F.col("ready").isNotNull()
    return here.select(
        "book_id",
        F.when(over, F.col("_next")).when(there, F.col("_no")).otherwise(F.coalesce("_after", "_first")).alias("chapter_no"),
        F.when(there & ~over, F.coalesce("_t", F.lit(0.0))).otherwise(F.lit(0.0)).alias("time"),
    )


def asof_next(probes: DataFrame, chapters: DataFrame) -> DataFrame:
    """The first of ``chapters`` after ``_no``, as _after."""
    mirrored = chapters.select("book_id", F.col("chapter_no").alias("_after"), (-F.col("chapter_no") + 1).alias("_m"))
    return asof_join(probes.distinct().withColumn("_p", -F.col("_no")), mirrored, ["book_id"], "_p", "_m", ["_after"]).drop("_p")


def page_marks(clips: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A mark wherever the page changes, at the seconds of the clips before. ``clips`` has page, seconds, pause."""
    w = Window.partitionBy(*by).orderBy(*order)
    timed = clips.withColumn("t", F.round(F.lit(LEAD_IN) + before(F.col("seconds") + F.col("pause"), by, order), 2).cast("double"))
    return timed.withColumn("_new", ~F.col("page").eqNullSafe(F.lag("page").over(w)) | (F.row_number().over(w) == 1)).where(F.col("_new") & F.col("page").isNotNull()).drop("_new")


def page_inside(t: Column, seconds: Column, offset: Column, size: Column) -> Column:
    """The second at which a page begins inside a clip, by its share of the text."""
    return F.round(t + seconds * offset / F.greatest(size, F.lit(1)), 2)


def estimated_marks(paragraphs: DataFrame) -> DataFrame:
    """Marks by share of the text. ``paragraphs`` has book_id, chapter_no, para_no, page, chars, duration."""
    by, order = ["book_id", "chapter_no"], ["para_no"]
    w = Window.partitionBy(*by)
    total = F.greatest(F.sum("chars").over(w), F.lit(1))
    usable = F.greatest(F.coalesce("duration", F.lit(0.0)) - (LEAD_IN + TAIL), F.lit(0.0))
    at = F.round(F.lit(LEAD_IN) + usable * before(F.col("chars"), by, order) / total, 2).cast("double")
    new = ~F.col("page").eqNullSafe(F.lag("page").over(w.orderBy(*order)))
    return paragraphs.withColumns({"t": at, "_new": new}).where("_new").drop("_new")


def groups(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Runs of one value; a value that comes again later is another run."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_new", new).withColumn("run", island(F.col("_new"), by, order)).drop("_new")


def group_summary(rows: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Per run: chapters, ready ones, seconds, first and last."""
    return groups(rows, value, by, [order]).groupBy(*by, "run").agg(
        F.first(value).alias(value),
        F.min(order).alias("first_no"),
        F.max(order).alias("last_no"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("ready").alias("n_ready"),
        F.sum(F.when(F.col("ready"), length()).otherwise(F.coalesce("est_seconds", F.lit(0.0)))).alias("seconds"),
    )


def time_left(chapters: DataFrame, current: Column, in_chapter: Column, rate: Column) -> DataFrame:
    """Seconds left in each book from a position, at a playback rate."""
    rest = F.sum(F.when(F.col("chapter_no") > current, length()).otherwise(0.0))
    this = F.sum(F.when(F.col("chapter_no") == current, F.greatest(length() - in_chapter, F.lit(0.0))).otherwise(0.0))
    return chapters.where(F.coalesce("include", F.lit(True))).groupBy("book_id").agg(((rest + this) / F.coalesce(F.nullif(F.first(rate), F.lit(0.0)), F.lit(1.0))).alias("left"))


def next_work(parts: DataFrame, want: Column) -> DataFrame:
    """The first unfinished part at or after the wanted one, else the very first. ``parts`` has book_id, chapter_no, part_no, ready."""
    at = F.struct("chapter_no", "part_no")
    found = parts.where(~F.col("ready")).groupBy("book_id").agg(F.coalesce(F.min(F.when(at >= want, at)), F.min(at)).alias("_w"))
    return found.select("book_id", "_w.chapter_no", "_w.part_no")


def remaining(chunks: DataFrame, factor: Column) -> DataFrame:
    """Seconds of audio still to make, and how long that takes. ``chunks`` has book_id, ready, est_seconds."""
    left = F.sum(F.when(~F.col("ready"), F.col("est_seconds")).otherwise(0.0))
    return chunks.groupBy("book_id").agg(left.alias("remaining"), (left / F.first(F.nullif(factor, F.lit(0.0)))).alias("eta_seconds"))


def reader_pages(labels: DataFrame) -> DataFrame:
    """Per book: the numbering in use (printed from 30 % of labels on), first and last page."""
    s = F.trim(F.coalesce("label", F.lit("")))
    number = F.when(s.rlike("^[0-9]+$"), s.cast("long"))
    n, some = F.count(F.lit(1)), F.count_if(s != "")
    printed = some >= 0.3 * F.greatest(n, F.lit(1))
    return labels.groupBy("book_id").agg(
        F.when(printed, "printed").otherwise("pdf").alias("numbering"),
        F.when(printed, F.coalesce(F.min(number), F.lit(1))).otherwise(F.lit(1)).alias("first_page"),
        F.when(printed, F.coalesce(F.max(number), n)).otherwise(n).alias("last_page"),
    )


def reader_page(labels: Column, pdf_page: Column, printed: Column) -> Column:
    """The page as the reader sees it: page_no, page_label."""
    label = F.nullif(F.trim(F.get(labels, pdf_page - 1)), F.lit(""))
    return F.struct(F.when(~printed, pdf_page).otherwise(label.try_cast("int")).alias("page_no"), label.alias("page_label"))


def skipped_title(page: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter that isn't narrated and holds a page, by its range or else by its contiguous run."""
    runs = groups(chapters.withColumn("_in", F.coalesce("include", F.lit(True))), "_in", ["book_id"], ["chapter_no"])
    out = runs.where("not _in").groupBy("book_id", "run").agg(F.min("first_page").alias("_a"), F.max("last_page").alias("_b"), F.min("chapter_no").alias("skipped_no"))
    return asof_join(page, out, ["book_id"], "page", "_a", ["_b", "skipped_no"]).withColumn("skipped_no", F.when(F.col("page") <= F.col("_b"), F.col("skipped_no"))).drop("_b")
