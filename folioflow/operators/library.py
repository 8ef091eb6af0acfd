"""Library queries: projections, shelves, progress, roll-ups, edits, voices.

``books`` has book_id, status and what each operator names; ``chapters`` book_id, chapter_no, include,
ready, duration, est_seconds, words, part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.text import collapse

# States in which a book can be changed, rendered, given a page first.
EDITABLE, RENDERABLE, PRIORITISABLE = ("draft", "paused", "error", "ready"), ("draft", "paused", "error", "ready"), ("queued", "rendering")

_included = lambda: F.coalesce(F.col("include"), F.lit(True))


def status_allows(status: Column, states: Sequence[str]) -> Column:
    """P23."""
    return F.coalesce(status.isin(*states), F.lit(False))


def chapter_view(chapters: DataFrame, book_ready: Column) -> DataFrame:
    """What is shown of a chapter; of its sound only when it is ready, addresses included."""
    ready = F.col("ready") & _included()
    address = F.concat(F.lit("/api/books/"), F.col("book_id").cast("string"), F.lit("/audio/"), F.col("chapter_no").cast("string"))
    return chapters.select(
        "book_id", "chapter_no", "words",
        F.when(~_included(), "skipped").when(F.col("ready"), "ready").otherwise("waiting").alias("status"),
        F.when(F.col("ready"), F.col("duration")).alias("duration"),
        F.when(F.col("ready") & book_ready, F.col("offset")).alias("offset"),
        F.when(F.col("ready"), F.concat(address, F.lit(".m4a"))).alias("audio_url"),
        F.when(ready, F.concat(address, F.lit(".mp3"))).alias("mp3_url"),
    )


def rollup(chapters: DataFrame) -> DataFrame:
    """Words, estimate, finished sound, and the length of each book."""
    sure = F.bool_and(F.col("ready") & (F.coalesce("duration", F.lit(0.0)) > 0))
    estimate = F.sum(F.coalesce("est_seconds", F.lit(0.0)))
    return (
        chapters.where(_included())
        .groupBy("book_id")
        .agg(
            F.sum("words").alias("total_words"),
            F.round(estimate, 1).alias("est_seconds"),
            F.round(F.sum(F.when(F.col("ready"), F.coalesce("duration", F.lit(0.0))).otherwise(0.0)), 1).alias("audio_seconds"),
            F.when(sure, F.sum("duration")).otherwise(estimate).alias("length"),
        )
    )


def book_view(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """A book with its roll-up, its parts in order, and the addresses of its files once it is ready."""
    ready = F.col("status") == "ready"
    address = F.concat(F.lit("/api/books/"), F.col("book_id").cast("string"))
    joined = books.join(rollup(chapters), "book_id", "left").join(ordered_parts(chapters), "book_id", "left")
    return joined.select(
        "book_id", "status",
        F.coalesce("total_words", F.lit(0)).alias("total_words"),
        F.coalesce("audio_seconds", F.lit(0.0)).alias("audio_seconds"),
        F.coalesce(F.array_join("parts", "|"), F.lit("")).alias("parts"),
        F.when(ready, F.concat(address, F.lit("/book.m4b"))).alias("m4b_url"),
        F.when(ready, F.concat(address, F.lit("/stream.m4a"))).alias("stream_url"),
    )


def ordered_parts(chapters: DataFrame) -> DataFrame:
    """The parts of each book's included chapters, in order of their first chapters."""
    first = chapters.where(_included() & F.col("part").isNotNull()).groupBy("book_id", "part").agg(F.min("chapter_no").alias("at"))
    return first.groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]).alias("parts"))


def progress_percent(done: Column, total: Column) -> Column:
    """Percent with one decimal; 0 of nothing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(100.0 * done / total, 1))


def chunk_progress(chunks: DataFrame) -> DataFrame:
    """Chunks and finished chunks, per chapter."""
    return chunks.groupBy("book_id", "chapter_no").agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if("ready").alias("done_chunks"))


def selection(chapters: DataFrame) -> DataFrame:
    """Chosen chapters of all, and their seconds."""
    return chapters.groupBy("book_id").agg(
        F.count_if(_included()).alias("chosen"), F.count(F.lit(1)).alias("of"), F.sum(F.when(_included(), F.col("est_seconds")).otherwise(0.0)).alias("seconds")
    )


def detection_summary(chapters: DataFrame) -> DataFrame:
    """Included chapters, distinct parts, sections."""
    return chapters.where(_included()).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapters"), F.count_distinct("part").alias("parts"), F.sum(F.coalesce("n_sections", F.lit(0))).alias("sections")
    )


def playable(ready: Column, has_audio: Column, part_ready: Column) -> Column:
    """A chapter that is finished, or has a finished part."""
    return _included() & ((ready & has_audio) | F.exists(F.coalesce(part_ready, F.array().cast("array<boolean>")), lambda p: p))


def streamable(chapters: DataFrame) -> DataFrame:
    """Books with an offset for every included chapter, of which there is one at least."""
    return chapters.where(_included()).groupBy("book_id").agg(F.bool_and(F.col("offset").isNotNull()).alias("streamable"))


def shelf_rank(status: Column, percent: Column, finished: Column) -> Column:
    """1 in progress, 2 new, 3 finished, 4 being made, 5 unfinished set-up or error."""
    done = finished | (percent >= 100)
    return F.when(status.isin("draft", "error"), 5).when(status != "ready", 4).when(done, 3).when(percent > 0, 1).otherwise(2)


def shelf(books: DataFrame) -> DataFrame:
    """Position on the shelf. ``books`` has rank, last_played, ordinal."""
    played = F.when(F.col("rank") == 1, -F.coalesce("last_played", F.lit(0))).otherwise(F.lit(0))
    return books.withColumn("position", F.row_number().over(Window.partitionBy("author_id").orderBy("rank", played, "ordinal")).cast("long"))


def on_shelf(name: str, status: Column, percent: Column, finished: Column) -> Column:
    """All, creating, finished, or listening."""
    done = finished | (percent >= 100)
    return {"all": F.lit(True), "creating": status != "ready", "finished": done}.get(name, ~done & (percent > 0))


def status_line(status: Column, audio_seconds: Column, percent: Column, eta: Column, long_time) -> Column:
    """One line on a book's state; ``long_time`` is the function that writes durations."""
    left = F.when(eta.isNull(), "").when(eta < 60, ", almost done").otherwise(F.concat(F.lit(", about "), long_time(eta), F.lit(" left")))
    whole = F.coalesce(F.floor(percent), F.lit(0)).cast("string")
    return (
        F.when(status == "ready", F.concat(F.lit("Ready, "), long_time(audio_seconds)))
        .when(status == "rendering", F.concat(F.lit("Creating "), whole, F.lit("%"), left))
        .when(status == "queued", "Queued")
        .when(status == "draft", "Finish setup")
        .when(status == "paused", F.concat(F.lit("Paused at "), whole, F.lit("%")))
        .when(status == "error", "Needs attention")
        .otherwise(F.coalesce(status, F.lit("")))
    )


def chapter_row(chapters: DataFrame, positions: DataFrame) -> DataFrame:
    """Each chapter's state in the list, whether it is done, and how far it was heard. ``positions`` has book_id, per (map), done (array)."""
    joined = chapters.join(positions, "book_id", "left")
    n = F.col("chapter_no").cast("int")
    done = F.coalesce(F.array_contains("done", n), F.lit(False))
    heard = F.coalesce(F.try_element_at("per", n), F.lit(0.0)) / F.nullif(F.col("duration"), F.lit(0.0))
    state = F.when(~_included(), "skipped").when(F.col("ready"), "ready").when(F.coalesce(F.col("n_ready_parts"), F.lit(0)) > 0, "partial").otherwise("waiting")
    return joined.select("book_id", "chapter_no", state.alias("state"), done.alias("done"), F.when(done, F.lit(1.0)).otherwise(F.least(F.coalesce(heard, F.lit(0.0)), F.lit(1.0))).alias("fraction"))


def edited(chapters: DataFrame, edits: DataFrame) -> DataFrame:
    """Chapters with the edits of those that exist; a new title takes the spoken one away. ``edits`` has book_id, chapter_no, new_title, new_include."""
    title = F.coalesce(F.nullif(collapse("new_title", 300), F.lit("")), F.col("title"))
    include = F.coalesce("new_include", "include")
    changed = ~title.eqNullSafe(F.col("title")) | ~include.eqNullSafe(F.col("include"))
    return chapters.join(edits, ["book_id", "chapter_no"], "left").select(
        "book_id", "chapter_no", title.alias("title"), include.alias("include"),
        F.when(title.eqNullSafe(F.col("title")), F.col("spoken_title")).alias("spoken_title"), changed.alias("changed"),
    )


def status_after_edit(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """A finished book with changes is paused. ``chapters`` comes from :func:`edited`."""
    touched = chapters.groupBy("book_id").agg(F.bool_or("changed").alias("_changed"))
    return books.join(touched, "book_id", "left").withColumn("status", F.when((F.col("status") == "ready") & F.coalesce("_changed", F.lit(False)), "paused").otherwise(F.col("status"))).drop("_changed")


def edit_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows of ``new`` of which a value differs from ``old``."""
    before = old.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    return new.join(before, list(keys)).where(~same).select(*keys, *values)


def newest(books: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The newest books, numbered."""
    w = Window.partitionBy(*by).orderBy(F.desc("created_at"), "book_id")
    return books.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= n)


def queue_ahead(books: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many queued books come before each."""
    w = Window.partitionBy(*by).orderBy("created_at", "book_id")
    return books.withColumn("ahead", (F.row_number().over(w) - 1).cast("long"))


def best_known(memory: DataFrame, snapshot: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Each value from memory, else from the snapshot."""
    other = snapshot.select(key, *[F.col(v).alias(f"_s_{v}") for v in values])
    return memory.join(other, key, "full").select(key, *[F.coalesce(v, f"_s_{v}").alias(v) for v in values])


def available(books: DataFrame, voices: DataFrame) -> DataFrame:
    """Whether each book's voice is offered. Voices are a small dimension; Spark broadcasts them by their size."""
    return books.join(voices.select(F.col("voice_id"), F.lit(True).alias("_there")).distinct(), "voice_id", "left").withColumn("voice_available", F.coalesce("_there", F.lit(False))).drop("_there")


def all_voices(presets: DataFrame, custom: DataFrame) -> DataFrame:
    """U01, S15."""
    return presets.unionByName(custom, allowMissingColumns=True)


def visible_voices(voices: DataFrame, asked: DataFrame) -> DataFrame:
    """The voices of a language or the chosen one; all of them where the language has none. ``asked`` has ask_id, language, chosen."""
    has = voices.select(F.col("language").alias("_l")).distinct().withColumn("_has", F.lit(True))
    wanted = asked.join(has, F.col("language") == F.col("_l"), "left").select("ask_id", F.col("language").alias("_want"), "chosen", F.coalesce("_has", F.lit(False)).alias("_any"))
    ids = voices.select("voice_id", "language")
    some = ids.join(wanted.where("_any"), F.col("language") == F.col("_want")).select("ask_id", "voice_id")
    chosen = ids.join(wanted, F.col("voice_id") == F.col("chosen")).select("ask_id", "voice_id")
    every = wanted.where("not _any").groupBy("ask_id").agg(F.lit(1).alias("_k")).join(ids.withColumn("_k", F.lit(1)), "_k").select("ask_id", "voice_id")
    return some.unionByName(chosen).unionByName(every).distinct()


def new_voice(name: Column, description: Column, gender: Column, languages: Sequence[str], language: Column) -> Column:
    """A voice's fields, or null if the description is too short or too long."""
    text = collapse(description, 10_000)
    known = F.when(F.lower(gender).isin("female", "male", "neutral"), F.lower(gender)).otherwise("neutral")
    fine = F.length(text).between(10, 600)
    return F.when(fine, F.struct(F.coalesce(F.nullif(collapse(name, 40), F.lit("")), F.lit("My voice")).alias("name"), text.alias("description"), known.alias("gender"), F.when(language.isin(*languages), language).otherwise(languages[0]).alias("language")))


def nearest(value: Column, choices: Sequence[tuple[float, str]]) -> Column:
    """The label of the nearest choice, of equal distances the first."""
    each = [F.struct(F.abs(value - x).alias("d"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (x, label) in enumerate(choices)]
    return F.array_min(F.array(*each))["label"]


def first_best(scores: Column) -> Column:
    """The place of the greatest value, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)) - 1


def offline_totals(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept bytes and books."""
    return records.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.count_distinct("book_id").alias("books"))


def stale_and_missing(wanted: DataFrame, cached: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files to fetch, to delete, and kept."""
    keys = list(keys)
    return wanted.join(cached, keys, "left_anti"), cached.join(wanted, keys, "left_anti"), wanted.join(cached, keys, "left_semi")


def ready_chapters(chapters: DataFrame) -> DataFrame:
    """P25: the chapters that can be kept offline, in order."""
    return chapters.where(_included() & F.col("ready")).withColumn("position", F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_no")).cast("long"))


def offline_books(books: DataFrame, records: DataFrame, online: bool) -> DataFrame:
    """The books that can be seen: without a network, those with a record."""
    return books if online else books.join(records.select("book_id").distinct(), "book_id", "left_semi")


def zip_members(chapters: DataFrame) -> DataFrame:
    """The files of a book's archive: included, ready chapters under their numbers and titles."""
    from ..functions.text import safe_filename
    from .positions import chapter_numbers

    numbered = chapter_numbers(chapters).where("ready")
    name = F.concat(F.format_string("%02d", F.col("number")), F.lit(" - "), safe_filename("title", "chapter"), F.lit(".mp3"))
    return numbered.select("book_id", "chapter_no", name.alias("member"))


def added_once(done: Column, item: Column) -> Column:
    """A10: an array with an element that comes in once."""
    return F.array_union(done, F.array(item))


def merged_maps(a: Column, b: Column) -> Column:
    """Two maps added up by key."""
    zero = F.lit(0.0)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def with_prefix(m: Column, prefix: str) -> Column:
    """The entries of a map whose keys begin with a prefix."""
    return F.map_filter(m, lambda k, _: F.startswith(k, F.lit(prefix)))


def month_percent(part: Column, whole: Column) -> Column:
    return half_up(part / F.nullif(whole, F.lit(0.0)) * 100)
