"""Queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import library as B
from ..operators import positions as P
from ..operators import sequences as S
from .model import BOOKS_SQL, CHAPTERS_SQL, books, chapters, table
from .registry import query

_BOTH = f"{CHAPTERS_SQL}, {BOOKS_SQL}"
_ROLLUP = f"""{_BOTH},
rollup_ AS (
  SELECT book_id, CAST(sum(words) AS BIGINT) AS total_words, round(sum(est_seconds), 1) AS est_seconds, round(sum(CASE WHEN ready THEN duration ELSE 0 END), 1) AS audio_seconds,
    CASE WHEN bool_and(ready AND duration > 0) THEN sum(duration) ELSE sum(est_seconds) END AS length
  FROM chapters WHERE include GROUP BY book_id)"""
_SHELF = f"""{_BOTH},
shelf_ AS (
  SELECT book_id, author_id, status, shelf, created_at, CAST(least(floor(price / 4000), 100) AS INT) AS percent, price > 350000 AS finished, CAST(price AS BIGINT) % 1000 AS last_played, book_id AS ordinal FROM books),
ranked AS (SELECT *, CASE WHEN status IN ('draft', 'error') THEN 5 WHEN status <> 'ready' THEN 4 WHEN finished OR percent >= 100 THEN 3 WHEN percent > 0 THEN 1 ELSE 2 END AS rank FROM shelf_)"""


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("price")
    return books(spark, sf_dir).select(
        "book_id", "author_id", "status", "shelf", "created_at", F.least(F.floor(price / 4000), F.lit(100)).cast("int").alias("percent"),
        (price > 350000).alias("finished"), (price.cast("long") % 1000).alias("last_played"), F.col("book_id").alias("ordinal"),
    )


@query(f"WITH {_ROLLUP} SELECT * FROM rollup_")
def library_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rollup(chapters(spark, sf_dir))


@query(f"""WITH {_ROLLUP},
f AS (SELECT book_id, part, min(chapter_no) AS at_ FROM chapters WHERE include GROUP BY book_id, part),
p AS (SELECT book_id, string_agg(part, '|' ORDER BY at_) AS parts FROM f GROUP BY book_id)
SELECT b.book_id, status, coalesce(total_words, 0) AS total_words, coalesce(audio_seconds, 0) AS audio_seconds, coalesce(parts, '') AS parts,
  CASE WHEN status = 'ready' THEN '/api/books/' || b.book_id || '/book.m4b' END AS m4b_url, CASE WHEN status = 'ready' THEN '/api/books/' || b.book_id || '/stream.m4a' END AS stream_url
FROM books b LEFT JOIN rollup_ r ON b.book_id = r.book_id LEFT JOIN p ON b.book_id = p.book_id""")
def book_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.book_view(books(spark, sf_dir), chapters(spark, sf_dir))


@query(f"""WITH {CHAPTERS_SQL},
o AS (SELECT *, round(coalesce(sum(duration) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS off FROM chapters)
SELECT book_id, chapter_no, words, CASE WHEN NOT include THEN 'skipped' WHEN ready THEN 'ready' ELSE 'waiting' END AS status, CASE WHEN ready THEN duration END AS duration,
  CASE WHEN ready AND book_id % 2 = 0 THEN off END AS "offset", CASE WHEN ready THEN '/api/books/' || book_id || '/audio/' || chapter_no || '.m4a' END AS audio_url,
  CASE WHEN ready AND include THEN '/api/books/' || book_id || '/audio/' || chapter_no || '.mp3' END AS mp3_url FROM o""")
def chapter_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chapter_view(P.offsets(chapters(spark, sf_dir)), F.col("book_id") % 2 == 0)


@query(f"""WITH {_SHELF}
SELECT book_id, author_id, rank, row_number() OVER (PARTITION BY author_id ORDER BY rank, CASE WHEN rank = 1 THEN -last_played ELSE 0 END, ordinal) AS position FROM ranked""")
def shelf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _shelf(spark, sf_dir).withColumn("rank", B.shelf_rank(F.col("status"), F.col("percent"), F.col("finished")))
    return B.shelf(ranked).select("book_id", "author_id", "rank", "position")


@query(f"""WITH {_SHELF}
SELECT book_id, true AS "all", status <> 'ready' AS creating, finished OR percent >= 100 AS finished, NOT (finished OR percent >= 100) AND percent > 0 AS listening, status IN ('draft', 'ready') AS editable FROM shelf_""")
def shelf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.col(c) for c in ("status", "percent", "finished")]
    kinds = [B.on_shelf(name, *at).alias(name) for name in ("all", "creating", "finished", "listening")]
    return _shelf(spark, sf_dir).select("book_id", *kinds, B.status_allows(F.col("status"), B.EDITABLE).alias("editable"))


_LONG = """CASE WHEN m < 1 THEN CASE WHEN x > 0 THEN '< 1 m' ELSE '0 m' END WHEN m >= 60 THEN printf('%d h %02d m', m // 60, m % 60) ELSE printf('%d m', m) END"""


@query(f"""WITH {BOOKS_SQL},
l AS (SELECT *, CAST(floor(x / 60 + 0.5) AS BIGINT) AS m FROM (SELECT book_id, status, price AS x, floor(price / 5000) AS percent FROM books))
SELECT book_id, CASE status WHEN 'ready' THEN 'Ready, ' || {_LONG} WHEN 'rendering' THEN 'Creating ' || CAST(percent AS BIGINT) || '%' || CASE WHEN x < 60 THEN ', almost done' ELSE ', about ' || {_LONG} || ' left' END
  ELSE 'Finish setup' END AS line FROM l""")
def status_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("price")
    return books(spark, sf_dir).select("book_id", B.status_line(F.col("status"), price, F.floor(price / 5000), price, N.long_time).alias("line"))


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, count(*) FILTER (include) AS chosen, count(*) AS \"of\", sum(CASE WHEN include THEN est_seconds ELSE 0 END) AS seconds FROM chapters GROUP BY book_id")
def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.selection(chapters(spark, sf_dir))


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, count(*) AS chapters, count(DISTINCT part) AS parts, CAST(sum(words % 3) AS BIGINT) AS sections FROM chapters WHERE include GROUP BY book_id")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.detection_summary(chapters(spark, sf_dir).withColumn("n_sections", F.col("words") % 3))


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, words % 2 AS chapter_no, count(*) AS total_chunks, count(*) FILTER (ready) AS done_chunks, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0::DOUBLE * count(*) FILTER (ready) / count(*), 1) END AS percent FROM chapters GROUP BY 1, 2")
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = B.chunk_progress(chapters(spark, sf_dir).withColumn("chapter_no", F.col("words") % 2))
    return done.withColumn("percent", B.progress_percent(F.col("done_chunks"), F.col("total_chunks")))


@query(f"""WITH {CHAPTERS_SQL} SELECT book_id, bool_and(words % 5 <> 0) AS streamable FROM chapters WHERE include GROUP BY book_id""")
def streamable_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.streamable(P.offsets(chapters(spark, sf_dir)).withColumn("offset", F.when(F.col("words") % 5 != 0, F.col("offset"))))


@query(f"""WITH {CHAPTERS_SQL} SELECT book_id, chapter_no, include AND ((ready AND words % 2 = 0) OR words % 3 = 0) AS playable FROM chapters""")
def playable_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.lit(False), F.col("words") % 3 == 0)
    return chapters(spark, sf_dir).select("book_id", "chapter_no", B.playable(F.col("ready"), F.col("words") % 2 == 0, parts).alias("playable"))


@query(f"""WITH {CHAPTERS_SQL}
SELECT book_id, chapter_no, CASE WHEN NOT include THEN 'skipped' WHEN ready THEN 'ready' WHEN words % 2 > 0 THEN 'partial' ELSE 'waiting' END AS state, chapter_no IN (1, 3) AS done,
  CASE WHEN chapter_no IN (1, 3) THEN 1.0 ELSE least(coalesce(CASE chapter_no WHEN 2 THEN 500.0::DOUBLE WHEN 4 THEN 9000.0::DOUBLE ELSE 0 END / nullif(duration, 0), 0), 1.0) END::DOUBLE AS fraction FROM chapters""")
def chapter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.create_map(F.lit(2), F.lit(500.0), F.lit(4), F.lit(9000.0))
    positions = books(spark, sf_dir).select("book_id", heard.alias("per"), F.array(F.lit(1), F.lit(3)).alias("done"))
    laid = chapters(spark, sf_dir).withColumn("n_ready_parts", F.col("words") % 2)
    joined = laid.join(positions.select("book_id"), "book_id", "left_semi").unionByName(laid.join(positions.select("book_id"), "book_id", "left_anti"))
    known = laid.select("book_id").distinct().select("book_id", heard.alias("per"), F.array(F.lit(1), F.lit(3)).alias("done"))
    return B.chapter_row(joined, known)


_EDITS = f"""{CHAPTERS_SQL},
named AS (SELECT book_id, chapter_no, 'Chapter ' || words AS title, include, 'Spoken ' || words AS spoken_title FROM chapters),
edits AS (SELECT book_id, chapter_no, CASE words % 4 WHEN 0 THEN '  New   title ' WHEN 1 THEN 'Chapter ' || words ELSE NULL END AS new_title, CASE WHEN words % 5 = 0 THEN true END AS new_include FROM chapters WHERE words % 3 = 0),
edited AS (
  SELECT n.book_id, n.chapter_no, coalesce(nullif(trim(regexp_replace(coalesce(new_title, ''), '\\s+', ' ', 'g')), ''), title) AS title, coalesce(new_include, include) AS include, title AS t0, include AS i0, spoken_title
  FROM named n LEFT JOIN edits e ON n.book_id = e.book_id AND n.chapter_no = e.chapter_no)"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("words")
    named = chapters(spark, sf_dir).select("book_id", "chapter_no", "words", F.concat(F.lit("Chapter "), w.cast("string")).alias("title"), "include", F.concat(F.lit("Spoken "), w.cast("string")).alias("spoken_title"))
    edits = named.where(w % 3 == 0).select(
        "book_id", "chapter_no", F.when(w % 4 == 0, "  New   title ").when(w % 4 == 1, F.col("title")).alias("new_title"), F.when(w % 5 == 0, F.lit(True)).alias("new_include")
    )
    return B.edited(named, edits)


@query(f"""WITH {_EDITS}
SELECT book_id, chapter_no, title, include, CASE WHEN title = t0 THEN spoken_title END AS spoken_title, title <> t0 OR include <> i0 AS changed FROM edited""")
def edited_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir)


@query(f"""WITH {_EDITS}, {BOOKS_SQL},
t AS (SELECT book_id, bool_or(title <> t0 OR include <> i0) AS changed FROM edited GROUP BY book_id)
SELECT b.book_id, CASE WHEN status = 'ready' AND coalesce(changed, false) THEN 'paused' ELSE status END AS status FROM books b LEFT JOIN t ON b.book_id = t.book_id""")
def status_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.status_after_edit(books(spark, sf_dir).select("book_id", "status"), _edited(spark, sf_dir))


@query(f"""WITH {CHAPTERS_SQL}
SELECT book_id, chapter_no, CASE WHEN words % 6 = 0 THEN NULL ELSE part END AS part FROM chapters WHERE words % 6 = 0""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P22, S11."""
    old = chapters(spark, sf_dir).select("book_id", "chapter_no", "part", "words")
    new = old.withColumn("part", F.when(F.col("words") % 6 != 0, F.col("part")))
    return B.edit_diff(old, new, ["book_id", "chapter_no"], ["part"])


@query(f"""WITH {BOOKS_SQL} SELECT book_id, shelf, created_at, position FROM (
  SELECT *, row_number() OVER (PARTITION BY shelf ORDER BY created_at DESC, book_id) AS position FROM books) WHERE position <= 10""")
def newest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.newest(books(spark, sf_dir), ["shelf"], 10).select("book_id", "shelf", "created_at", "position")


@query(f"WITH {BOOKS_SQL} SELECT book_id, row_number() OVER (PARTITION BY author_id ORDER BY created_at, book_id) - 1 AS ahead FROM books WHERE status = 'rendering'")
def queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.queue_ahead(books(spark, sf_dir).where("status = 'rendering'"), ["author_id"]).select("book_id", "ahead")


@query(f"""WITH {BOOKS_SQL},
a AS (SELECT book_id, status, CASE WHEN book_id % 2 = 0 THEN shelf END AS shelf FROM books WHERE status <> 'draft'), b AS (SELECT book_id, 'old' AS status, shelf FROM books WHERE created_at < DATE '1996-06-01')
SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce(a.status, b.status) AS status, coalesce(a.shelf, b.shelf) AS shelf FROM a FULL JOIN b ON a.book_id = b.book_id""")
def best_known_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that are no drafts are in memory; older ones are in the snapshot."""
    all_ = books(spark, sf_dir)
    memory = all_.where("status != 'draft'").select("book_id", "status", F.when(F.col("book_id") % 2 == 0, F.col("shelf")).alias("shelf"))
    kept = all_.where("created_at < DATE '1996-06-01'").select("book_id", F.lit("old").alias("status"), "shelf")
    return B.best_known(memory, kept, "book_id", ["status", "shelf"])


@query(f"WITH {BOOKS_SQL} SELECT book_id, author_id % 40 AS voice_id, author_id % 40 IN (SELECT n_nationkey FROM nation) AS voice_available FROM books")
def voice_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    voices = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("voice_id"))
    return B.available(books(spark, sf_dir).select("book_id", (F.col("author_id") % 40).alias("voice_id")), voices).select("book_id", "voice_id", "voice_available")


@query("""WITH v AS (
  SELECT 'p' || n_nationkey AS voice_id, CAST(n_regionkey AS BIGINT) AS language FROM nation UNION ALL SELECT 'c' || s_suppkey, s_nationkey % 7 FROM supplier),
a AS (SELECT CAST(r_regionkey AS BIGINT) AS ask_id, CAST(r_regionkey * 2 AS BIGINT) AS language, 'p3' AS chosen FROM region)
SELECT ask_id, voice_id FROM v, a WHERE a.language NOT IN (SELECT language FROM v) OR v.language = a.language OR v.voice_id = a.chosen""")
def visible_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("voice_id"), F.col("n_regionkey").cast("long").alias("language"))
    custom = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("voice_id"), (F.col("s_nationkey") % 7).cast("long").alias("language"))
    asked = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("ask_id"), (F.col("r_regionkey") * 2).cast("long").alias("language"), F.lit("p3").alias("chosen"))
    return B.visible_voices(B.all_voices(presets, custom), asked)


@query("""SELECT o_orderkey AS book_id, CASE WHEN abs(p - 0.9::DOUBLE) <= abs(p - 1.0::DOUBLE) THEN 'Relaxed' WHEN abs(p - 1.0::DOUBLE) <= abs(p - 1.1::DOUBLE) THEN 'Normal' ELSE 'Brisk' END AS label, least(greatest(p, 0.8), 1.2) AS pace
FROM (SELECT o_orderkey, (o_custkey % 17)::DOUBLE / 10 AS p FROM orders)""")
def pace_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("o_custkey") % 17).cast("double") / 10
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), B.nearest(p, [(0.9, "Relaxed"), (1.0, "Normal"), (1.1, "Brisk")]).alias("label"), N.pace(p).alias("pace"))


_FILES = f"""{CHAPTERS_SQL}, w AS (SELECT DISTINCT book_id, key FROM chapters WHERE include), c AS (SELECT DISTINCT book_id, key FROM chapters WHERE ready)"""


@query(f"""WITH {_FILES}
SELECT book_id, key, 'missing' AS state FROM w ANTI JOIN c USING (book_id, key) UNION ALL SELECT book_id, key, 'stale' FROM c ANTI JOIN w USING (book_id, key) UNION ALL SELECT book_id, key, 'kept' FROM w SEMI JOIN c USING (book_id, key)""")
def offline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = chapters(spark, sf_dir)
    parts = B.stale_and_missing(laid.where("include").select("book_id", "key").distinct(), laid.where("ready").select("book_id", "key").distinct(), ["book_id", "key"])
    told = [p.withColumn("state", F.lit(s)) for p, s in zip(parts, ("missing", "stale", "kept"))]
    return told[0].unionByName(told[1]).unionByName(told[2])


@query(f"WITH {CHAPTERS_SQL} SELECT part, CAST(sum(words) AS BIGINT) AS bytes, count(DISTINCT book_id) AS books FROM chapters GROUP BY part")
def offline_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.offline_totals(chapters(spark, sf_dir).withColumn("bytes", F.col("words")), ["part"])


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, chapter_no, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no) AS position FROM chapters WHERE include AND ready")
def ready_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ready_chapters(chapters(spark, sf_dir)).select("book_id", "chapter_no", "position")


@query(f"WITH {_BOTH} SELECT book_id, status FROM books WHERE book_id IN (SELECT book_id FROM chapters WHERE ready)")
def offline_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.offline_books(books(spark, sf_dir), chapters(spark, sf_dir).where("ready"), online=False).select("book_id", "status")


@query(f"""WITH {CHAPTERS_SQL},
n AS (SELECT book_id, chapter_no, ready, words, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no) AS number FROM chapters WHERE include)
SELECT book_id, chapter_no, printf('%02d', number) || ' - Chapter ' || words || ' end.mp3' AS member FROM n WHERE ready""")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = chapters(spark, sf_dir).withColumn("title", F.concat(F.lit("Chapter/ "), F.col("words").cast("string"), F.lit(": end.")))
    return B.zip_members(titled)


@query("""SELECT o_orderkey AS book_id, CASE WHEN length(d) BETWEEN 10 AND 600 THEN d END AS description, CASE WHEN length(d) BETWEEN 10 AND 600 THEN 'en' END AS language, 7919 * (o_custkey % 5 - 1) + o_custkey AS seed
FROM (SELECT o_orderkey, o_custkey, repeat('deep ', CAST(o_custkey % 4 AS INT)) || 'voice' AS d FROM orders)""")
def new_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    said = F.concat(F.repeat(F.lit("deep   "), (k % 4).cast("int")), F.lit("voice  "))
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), B.new_voice(F.lit(""), said, F.lit("x"), ["en", "zh"], F.lit("fr")).alias("v"), N.voice_seed(k, k % 5).alias("seed"))
    return made.select("book_id", "v.description", "v.language", "seed")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity + l_tax) / greatest(l_discount, 0.5) AS rate, least(greatest(l_quantity * 2 / 0.8::DOUBLE, 0.5), 30.0) AS target,
  18.0::DOUBLE * 0.8 / 2 AS chunk_limit, greatest(l_quantity - 20, 0) AS sleep_left, l_quantity / 0.8::DOUBLE AS length, l_quantity / 0.8::DOUBLE / nullif(l_discount, 0) AS ready_in,
  CAST(floor(100.0::DOUBLE * l_quantity / 50) AS INT) AS percent FROM lineitem""")
def render_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N08, N11, N12."""
    q, eight = F.col("l_quantity"), F.lit(0.8)
    plan = N.render_estimate(q, eight, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.voice_rate(q + F.col("l_tax"), F.col("l_discount")).alias("rate"), N.chunk_target(q, F.lit(2), eight).alias("target"),
        N.chunk_limit(18.0, eight, F.lit(2)).alias("chunk_limit"), N.sleep_left(q, F.lit(20.0)).alias("sleep_left"), plan["length"].alias("length"), plan["ready_in"].alias("ready_in"),
        N.percent_floor(q, F.lit(50.0)).alias("percent"),
    )


@query("""WITH c AS (SELECT CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice * 97 END AS n, floor(l_extendedprice / 3) AS s, l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem),
m AS (SELECT *, n / 1048576 AS mb, CAST(s AS BIGINT) AS t, CAST(floor(s / 60 + 0.5) AS BIGINT) AS m, s AS x FROM c)
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS clock, """ + _LONG + """ AS long_time,
  CASE WHEN m < 60 THEN printf('%d min', m) ELSE """ + _LONG + """ END AS short_time, CASE WHEN n = 0 THEN '0 MB' WHEN mb < 1 THEN printf('%d KB', greatest(CAST(floor(n / 1024 + 0.5) AS BIGINT), 1))
  WHEN mb < 10 THEN printf('%d.%d MB', CAST(floor(mb * 10 + 0.5) AS BIGINT) // 10, CAST(floor(mb * 10 + 0.5) AS BIGINT) % 10) WHEN mb < 1024 THEN printf('%d MB', CAST(floor(mb + 0.5) AS BIGINT))
  ELSE printf('%d.%d GB', CAST(floor(mb / 1024 * 10 + 0.5) AS BIGINT) // 10, CAST(floor(mb / 1024 * 10 + 0.5) AS BIGINT) % 10) END AS bytes,
  CASE WHEN n = 0 THEN '' WHEN n < 1048576 THEN printf('%d KB', CAST(floor(n / 1024 + 0.5) AS BIGINT)) ELSE printf('%d.%d MB', CAST(floor(mb * 10 + 0.5) AS BIGINT) // 10, CAST(floor(mb * 10 + 0.5) AS BIGINT) % 10) END AS size,
  CASE WHEN t >= 1000000 THEN printf('%d,%03d,%03d', t // 1000000, t // 1000 % 1000, t % 1000) WHEN t >= 1000 THEN printf('%d,%03d', t // 1000, t % 1000) ELSE printf('%d', t) END || ' words' AS plural,
  CASE WHEN l_quantity > 10 THEN 'pages 10–' || CAST(l_quantity AS BIGINT) ELSE 'page 10' END AS pages,
  CASE WHEN t % 24 < 5 THEN 'Good night' WHEN t % 24 < 12 THEN 'Good morning' WHEN t % 24 < 18 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting FROM m""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T27 to T31, T40."""
    n = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_extendedprice") * 97)
    s = F.floor(F.col("l_extendedprice") / 3)
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", N.clock(s).alias("clock"), N.long_time(s).alias("long_time"), N.short_time(s).alias("short_time"), N.bytes_text(n).alias("bytes"),
        N.size_text(n).alias("size"), N.plural(s, "word", "words").alias("plural"), N.pages_text(F.lit(10).cast("long"), q).alias("pages"), N.greeting(s % 24).alias("greeting"),
    )


@query("""SELECT l_orderkey, list_reduce(list_transform(list_prepend({'p': 0.0, 'q': 0.0, 't': l_linestatus}, list({'p': l_extendedprice, 'q': l_quantity, 't': l_shipdate::VARCHAR} ORDER BY l_extendedprice, l_quantity)), lambda x: x.q),
  lambda a, v: CASE WHEN v <= 0 THEN a WHEN a = 0 THEN v ELSE a * 0.9::DOUBLE + v * (1 - 0.9::DOUBLE) END) AS factor FROM lineitem GROUP BY l_orderkey, l_linestatus""".replace(", l_linestatus", "").replace("'t': l_linestatus", "'t': ''"))
def realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N09."""
    samples = F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(S.smoothed(F.transform(samples, lambda x: x["q"])).alias("factor"))


@query(f"""WITH {CHAPTERS_SQL},
v AS (SELECT book_id, part || chapter_no AS k, CASE WHEN include THEN words ELSE 0 END + CASE WHEN ready THEN est_seconds ELSE 0 END AS s, CASE WHEN include OR ready THEN 1 END AS known, part FROM chapters)
SELECT book_id, count(known) AS n_keys, coalesce(sum(CASE WHEN known = 1 THEN s END), 0)::DOUBLE AS total, count(CASE WHEN known = 1 AND starts_with(k, 'A') THEN 1 END) AS n_prefixed,
  CAST(count(DISTINCT part) + CASE WHEN count(CASE WHEN part = 'N' THEN 1 END) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_done FROM v GROUP BY book_id""")
def map_and_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and seconds of chapters added up by key, keys of a prefix, and a set that an element joins once."""
    laid = chapters(spark, sf_dir).withColumn("k", F.concat("part", F.col("chapter_no").cast("string")))
    some = lambda condition, value: F.map_from_entries(F.collect_list(F.when(F.col(condition), F.struct("k", F.col(value).cast("double")))))
    books_ = laid.groupBy("book_id").agg(some("include", "words").alias("w"), some("ready", "est_seconds").alias("s"), F.collect_set("part").alias("parts"))
    books_ = books_.withColumn("m", B.merged_maps(F.col("w"), F.col("s")))
    return books_.select(
        "book_id", F.size("m").cast("long").alias("n_keys"), F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.size(B.with_prefix(F.col("m"), "A")).cast("long").alias("n_prefixed"), F.size(B.added_once(F.col("parts"), F.lit("N"))).cast("long").alias("n_done"),
    )


