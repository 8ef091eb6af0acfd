"""Queries of document structure, speech and sound.

Lines of print are made of documents: each line of text is a printed line, 30 to a page, with a
heading's size where the text is short, and running lines at the pages' heads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import speech
from ..functions import text as T
from ..operators import chunking as C
from ..operators import structure as D
from ..sources.imports import imported
from ..sources.shared import folder
from .model import CHAPTERS_SQL, PARAGRAPHS_SQL, chapters, paragraphs, table
from .registry import query

_LINES = f"""{PARAGRAPHS_SQL},
lines AS (
  SELECT book_id, para_no AS line_no, (para_no - 1) // 30 AS page, 50.0 AS x0, ((para_no - 1) % 30) * 20.0 + 10 AS y0, ((para_no - 1) % 30) * 20.0 + 22 AS y1, text,
    CASE WHEN length(text) < 30 THEN 16.0 ELSE 11.0 END AS size, length(text) < 20 AS bold, (para_no - 1) % 30 // 10 AS block, 620.0 AS page_height
  FROM paragraphs WHERE trim(text) <> '')"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("para_no") - 1
    row = n % 30
    return paragraphs(spark, sf_dir).where(F.trim("text") != "").select(
        "book_id", F.col("para_no").alias("line_no"), F.floor(n / 30).cast("long").alias("page"), F.lit(50.0).alias("x0"), (row * 20.0 + 10).alias("y0"), (row * 20.0 + 22).alias("y1"), "text",
        F.when(F.length("text") < 30, 16.0).otherwise(11.0).alias("size"), (F.length("text") < 20).alias("bold"), F.floor(row / 10).cast("long").alias("block"), F.lit(620.0).alias("page_height"),
    )


@query(f"""WITH {_LINES}, w AS (SELECT book_id, round(size * 2) / 2 AS s, sum(length(text)) AS n, min(line_no) AS at_ FROM lines GROUP BY 1, 2)
SELECT book_id, arg_max(s, n * 1000000 - at_) AS body_size FROM w GROUP BY book_id""")
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.body_size(_lines(spark, sf_dir))


@query(f"""WITH {_LINES}, twice AS (SELECT * FROM lines UNION ALL SELECT book_id, line_no + 100000, page, x0 + CASE WHEN line_no % 2 = 0 THEN 3 ELSE 9 END, y0, y1, text, size, bold, block, page_height FROM lines WHERE line_no % 3 = 0)
SELECT a.book_id, a.line_no FROM twice a WHERE NOT EXISTS (SELECT 1 FROM twice b WHERE b.book_id = a.book_id AND b.page = a.page AND b.text = a.text AND b.line_no < a.line_no AND b.line_no < 100000
  AND abs(b.x0 - a.x0) < 0.5 * a.size AND abs(b.y0 - a.y0) < 0.3 * a.size)""")
def overprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    n = F.col("line_no")
    again = lines.where(n % 3 == 0).withColumn("x0", F.col("x0") + F.when(n % 2 == 0, 3.0).otherwise(9.0)).withColumn("line_no", n + 100000)
    return D.without_overprint(lines.unionByName(again)).select("book_id", "line_no")


@query(f"""WITH {_LINES},
r AS (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY y0, line_no) AS up, row_number() OVER (PARTITION BY book_id, page ORDER BY y0 DESC, line_no DESC) AS down FROM lines),
e AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '^\\W*[ivxlcdm]+\\W+|\\W+[ivxlcdm]+\\W*$', '', 'g'), '\\s+', ' ', 'g'), ' .|-–—') AS key
  FROM r WHERE (up <= 2 OR down <= 2) AND (y1 < page_height * 0.16 OR y0 > page_height - page_height * 0.16)),
c AS (SELECT *, count(*) OVER (PARTITION BY book_id, key) AS times FROM e)
SELECT book_id, page, line_no, key, times FROM c""")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.edge_lines(_lines(spark, sf_dir)).select("book_id", "page", "line_no", "key", "times")


@query()
def structured_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to paragraphs."""
    lines = _lines(spark, sf_dir)
    return D.structured(lines, D.body_size(lines)).select("book_id", "para_no", "page", "text", "size", "bold", "n_lines", "first_on_page", F.size("breaks").alias("n_breaks"))


_HEADS = f"""{_LINES},
heads AS (SELECT book_id, line_no AS para_no, page, size, trim(text) AS title, regexp_replace(lower(trim(text)), '[^0-9a-z㐀-鿿]+', '', 'g') AS key FROM lines WHERE size > 12),
far AS (SELECT *, CASE WHEN page - lag(page) OVER w <= 3 THEN 0 ELSE 1 END AS far FROM heads WINDOW w AS (PARTITION BY book_id, key ORDER BY para_no)),
run AS (SELECT *, sum(far) OVER (PARTITION BY book_id, key ORDER BY para_no) AS run FROM far)"""


@query(f"""WITH {_HEADS} SELECT book_id, para_no, title FROM run QUALIFY row_number() OVER (PARTITION BY book_id, key, run ORDER BY size DESC, para_no) = 1""")
def running_header_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    heads = _lines(spark, sf_dir).where("size > 12").select("book_id", F.col("line_no").alias("para_no"), "page", "size", F.trim("text").alias("title"))
    return D.without_running_headers(heads).select("book_id", "para_no", "title")


def _paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("book_id", F.col("line_no").alias("para_no"), "page", "text", "size", "bold", F.lit(1).alias("n_lines"), (F.col("y0") < 15).alias("first_on_page"))


@query()
def detected_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs to chapters."""
    paras = _paras(spark, sf_dir).repartition("book_id")  # before it is looked at, and as all that follows needs it
    sizes = D.body_size(_lines(spark, sf_dir)).join(paras.groupBy("book_id").agg((F.max("page") + 1).alias("pages")), "book_id")
    found = D.with_subtitles(D.detect(paras, sizes), paras, sizes.drop("pages"))
    at = folder(spark, "headings")  # they are looked at three times
    found.write.parquet(at)
    found = spark.read.schema(found.schema).parquet(at)
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.coalesce("lang", F.lit("en")).alias("lang"))
    return D.chapters(found, paras, langs)


@query(f"""WITH {PARAGRAPHS_SQL} SELECT book_id, sum(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> ''))) < 20 AND sum(length(text)) < 200 AS textless FROM paragraphs GROUP BY book_id""")
def textless_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.is_textless(paragraphs(spark, sf_dir))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01."""
    return C.chunks(C.plain(paragraphs(spark, sf_dir)), 18.0).select("book_id", "chapter_no", "chunk_no", "text", "est_seconds", "pause_after")


@query()
def normalize_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11, T15, N01."""
    said = paragraphs(spark, sf_dir).where("lang = 'en'")
    lang = F.col("lang")
    return said.select("book_id", "para_no", speech.normalise_english("text", lang).alias("spoken"), F.size(speech.split_sentences("text", lang)).alias("sentences"), speech.estimate_seconds("text", lang).alias("seconds"))


_SIZED = f"""{_LINES},
w AS (SELECT book_id, round(size * 2) / 2 AS s, sum(length(text)) AS n, min(line_no) AS at_ FROM lines GROUP BY 1, 2),
b AS (SELECT book_id, arg_max(s, n * 1000000 - at_) AS body_size FROM w GROUP BY book_id)"""


@query(f"""WITH {_SIZED},
h AS (SELECT book_id, line_no AS para_no, page, trim(text) AS title, size >= body_size * 1.3 AS big FROM lines JOIN b USING (book_id)),
c AS (SELECT * FROM h WHERE length(title) <= 110 AND NOT regexp_matches(title, '{T.CONTENTS_LINE}')
  AND NOT (regexp_matches(title, '{T.CHAPTER}') AND regexp_matches(regexp_extract(title, '{T.CHAPTER}', 3), '(^|\\s)\\d{{1,4}}$') AND NOT big)
  AND (regexp_matches(title, '{T.CHAPTER}') OR regexp_matches(title, '{T.HAN_HEADING}') OR (regexp_matches(title, '{T.SPECIAL.replace("'", "''")}') AND len(regexp_split_to_array(title, '\\s+')) <= 6)))
SELECT book_id, para_no, title, regexp_matches(title, '{T.PART_TITLE}') AS is_part FROM c QUALIFY count(*) OVER (PARTITION BY book_id, page) < 3""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that read like headings, some lines of which are made ones; a page with several is a contents page."""
    return D.heading_candidates(_paras(spark, sf_dir), D.body_size(_lines(spark, sf_dir))).select("book_id", "para_no", "title", "is_part")


_NUMBERED = f"""{CHAPTERS_SQL},
n AS (SELECT book_id, chapter_no AS para_no, chapter_no // 2 AS page, chapter_no + CASE WHEN words % 5 = 0 THEN 3 ELSE 0 END AS v, words % 4 > 0 AS stands_out FROM chapters),
s AS (SELECT *, coalesce(v = lag(v) OVER (PARTITION BY book_id ORDER BY para_no) + 1, false) AS next FROM n WHERE stands_out)"""


@query(f"""WITH {_NUMBERED} SELECT book_id, para_no, CAST(v AS VARCHAR) AS title FROM s
QUALIFY count(*) OVER (PARTITION BY book_id) >= 3 AND sum(CASE WHEN next THEN 1 ELSE 0 END) OVER (PARTITION BY book_id) >= 0.7 * (count(*) OVER (PARTITION BY book_id) - 1)""")
def numbered_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone numbers that stand out, of books in which they mostly rise by one."""
    k, words = F.col("chapter_no"), F.col("words")
    out = words % 4 > 0
    number = k + F.when(words % 5 == 0, 3).otherwise(0)
    paras = chapters(spark, sf_dir).select(
        "book_id", k.alias("para_no"), F.floor(k / 2).alias("page"), number.cast("string").alias("text"), F.when(out & (words % 4 == 1), 13.0).otherwise(11.0).alias("size"),
        (words % 4 == 2).alias("bold"), F.lit(1).alias("n_lines"), (words % 4 == 3).alias("first_on_page"),
    )
    sizes = paras.select("book_id").distinct().withColumn("body_size", F.lit(11.0))
    return D.numeric_candidates(paras, sizes).select("book_id", "para_no", "title")


_OTHER = "[.!?;。！？]['\"”’]?$".replace("'", "''")


@query(f"""WITH {_SIZED},
s AS (SELECT book_id, line_no AS para_no, text AS t, size, bold, body_size, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS ws FROM lines JOIN b USING (book_id)),
l AS (SELECT *, list_filter(ws, lambda w: length(w) > 3) AS long FROM s)
SELECT book_id, para_no FROM l WHERE len(ws) BETWEEN 1 AND 10 AND NOT regexp_matches(t, '{_OTHER}') AND NOT regexp_matches(t, '{T.CHAPTER}') AND NOT regexp_matches(t, '{T.SPECIAL.replace("'", "''")}') AND NOT regexp_matches(t, '{T.HAN_HEADING}')
  AND (size >= body_size * 1.08 OR bold OR (t = upper(t) AND regexp_matches(t, '\\p{{Lu}}')) OR (len(long) > 0 AND len(list_filter(long, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 0.6 * len(long)))""")
def subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    paras = _paras(spark, sf_dir).join(D.body_size(_lines(spark, sf_dir)), "book_id")
    return paras.where(D.looks_like_subtitle(F.col("body_size"))).select("book_id", "para_no")


_HEADED = f"""{CHAPTERS_SQL},
h AS (SELECT book_id, chapter_no AS at_, part, words % 3 = 0 AS is_part, coalesce(lead(chapter_no) OVER (PARTITION BY book_id ORDER BY chapter_no), 100) AS stop FROM chapters WHERE part <> 'N' OR words % 3 = 0),
e AS (SELECT h.book_id, at_, any_value(h.is_part) AS is_part, any_value(h.part) AS letter, count(c.chapter_no) AS n_paras, coalesce(sum(1 + c.words % 40), 0) AS words, min(c.chapter_no // 2) AS first_page, max(c.chapter_no // 2) AS last_page
  FROM h LEFT JOIN chapters c ON c.book_id = h.book_id AND c.chapter_no > h.at_ AND c.chapter_no < h.stop GROUP BY h.book_id, at_)"""


def _headed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Headings, every third of which is a part's, and the paragraphs of books."""
    laid = chapters(spark, sf_dir)
    page = F.floor(F.col("chapter_no") / 2)
    heads = laid.where("part != 'N' or words % 3 = 0").select("book_id", F.col("chapter_no").alias("para_no"), page.alias("page"), F.concat(F.lit("Head "), "part").alias("title"), (F.col("words") % 3 == 0).alias("is_part"), F.lit(1).alias("skip"))
    text = F.repeat(F.lit("word "), (1 + F.col("words") % 40).cast("int"))
    return heads, laid.select("book_id", F.col("chapter_no").alias("para_no"), page.alias("page"), F.trim(text).alias("text"))


@query(f"""WITH {_HEADED} SELECT book_id, at_ AS para_no, n_paras, CAST(words AS BIGINT) AS words, first_page, last_page FROM e""")
def chapter_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs from a heading up to the next, and their pages."""
    return D.chapter_extents(*_headed(spark, sf_dir)).select("book_id", "para_no", "n_paras", F.col("words").cast("long").alias("words"), "first_page", "last_page")


@query(f"""WITH {_HEADED},
l AS (SELECT *, is_part AND words < 60 AS lone FROM e),
p AS (SELECT *, CASE WHEN lag(lone) OVER w THEN 'Head ' || lag(letter) OVER w END AS page FROM l WINDOW w AS (PARTITION BY book_id ORDER BY at_)),
c AS (SELECT *, last_value(CASE WHEN lone THEN 'Head ' || letter END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM p),
k AS (SELECT * FROM c WHERE NOT lone),
b AS (SELECT *, last_value(part IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM k)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY at_) AS chapter_no, 'Head ' || letter AS title, part, coalesce(page, CASE WHEN part IS NOT NULL AND part IS DISTINCT FROM known THEN part END) || '. Head ' || letter AS spoken_title FROM b""")
def announced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's page without text goes on to the chapters that follow, the first of which announces it, also if the part before had the same name."""
    return D.with_parts(D.chapter_extents(*_headed(spark, sf_dir))).select("book_id", "chapter_no", "title", "part", "spoken_title")


_TYPE = f"""{PARAGRAPHS_SQL},
laid AS (SELECT book_id, para_no, (para_no - 1) // 5 AS page, text, CASE WHEN length(text) < 12 THEN 26.0 WHEN length(text) < 30 THEN 20.4 WHEN length(text) < 60 THEN 16.0 ELSE 11.0 END AS size FROM paragraphs WHERE trim(text) <> ''),
n AS (SELECT book_id, max(page) + 1 AS pages FROM laid GROUP BY book_id),
m AS (SELECT *, round(size) AS tier FROM laid WHERE size >= 14.3 AND len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 14 AND regexp_matches(text, '\\p{{L}}')),
t AS (SELECT DISTINCT book_id, tier AS at_ FROM m),
e AS (SELECT m.*, at_, CASE WHEN para_no = lag(para_no) OVER w + 1 AND page = lag(page) OVER w THEN 0 ELSE 1 END AS new FROM m JOIN t ON m.book_id = t.book_id AND tier >= at_ WINDOW w AS (PARTITION BY m.book_id, at_ ORDER BY para_no)),
r AS (SELECT *, sum(new) OVER (PARTITION BY book_id, at_ ORDER BY para_no) AS run FROM e),
c AS (SELECT r.book_id, at_, count(DISTINCT run) AS heads, count(DISTINCT run) > greatest(3.0, any_value(pages) / 2.5) AS many FROM r JOIN n ON n.book_id = r.book_id GROUP BY r.book_id, at_),
b AS (SELECT book_id, min(at_) AS at_ FROM (SELECT *, bool_or(many) OVER (PARTITION BY book_id ORDER BY at_ DESC) AS stop FROM c) WHERE NOT stop AND heads >= 2 GROUP BY book_id)"""


@query(f"""WITH {_TYPE} SELECT r.book_id, min(para_no) AS para_no, string_agg(text, ' ' ORDER BY para_no) AS title, max(size) AS size, count(*) AS skip FROM r JOIN b ON r.book_id = b.book_id AND r.at_ = b.at_ GROUP BY r.book_id, run""")
def large_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the smallest large type that isn't too frequent; the SQL makes the headings of every tier."""
    n = F.length("text")
    paras = paragraphs(spark, sf_dir).where(F.trim("text") != "").select(
        "book_id", "para_no", F.floor((F.col("para_no") - 1) / 5).cast("long").alias("page"), "text", F.when(n < 12, 26.0).when(n < 30, 20.4).when(n < 60, 16.0).otherwise(11.0).alias("size"), F.lit(1).alias("n_lines")
    )
    sizes = paras.groupBy("book_id").agg((F.max("page") + 1).alias("pages")).withColumn("body_size", F.lit(11.0))
    return D.large_candidates(paras, sizes).select("book_id", "para_no", "title", "size", "skip")


_PIECES = f"""w AS (SELECT doc_id AS book_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) AS i FROM documents WHERE text IS NOT NULL),
g AS (SELECT book_id, (i - 1) // 25 + 1 AS para_no, string_agg(word, ' ' ORDER BY i) AS text FROM w GROUP BY 1, 2),
p AS (SELECT *, (para_no - 1) // 2 + CASE WHEN length(text) % 9 = 0 THEN 1 ELSE 0 END AS page, CASE WHEN length(text) % 4 = 0 THEN 12.0 WHEN length(text) % 4 = 1 THEN 11.4 ELSE 11.0 END AS size, lag(text) OVER (PARTITION BY book_id ORDER BY para_no) AS before FROM g)"""
_TERMINAL_SQL = T.TERMINAL.replace("'", "''")


@query(f"""WITH RECURSIVE {_PIECES},
l AS (SELECT *, coalesce(regexp_matches(text, '^\\p{{Ll}}') AND NOT regexp_matches(before, '{_TERMINAL_SQL}'), false) AS linked FROM p),
h AS (SELECT book_id, para_no, para_no AS head, page AS head_page, size AS head_size FROM l WHERE para_no = 1 UNION ALL
  SELECT book_id, para_no, CASE WHEN m THEN head ELSE para_no END, CASE WHEN m THEN head_page ELSE page END, CASE WHEN m THEN head_size ELSE size END
  FROM (SELECT l.book_id, l.para_no, l.page, l.size, head, head_page, head_size, linked AND l.page - head_page BETWEEN 0 AND 2 AND abs(l.size - head_size) < 1 AS m FROM h JOIN l ON l.book_id = h.book_id AND l.para_no = h.para_no + 1))
SELECT h.book_id, head AS para_no, any_value(head_page) AS page, count(*) AS n_lines, string_agg(text, ' ' ORDER BY h.para_no) AS text, count(*) FILTER (page <> head_page) AS n_breaks, any_value(head_size) AS size
FROM (SELECT h.*, l.page, l.text FROM h JOIN l ON h.book_id = l.book_id AND h.para_no = l.para_no) h GROUP BY h.book_id, head""")
def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 25 words of every document, put together again where they go on; the SQL goes from one to the next."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), words.alias("words"))  # once a document, not for every piece
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 25).cast("int")), lambda k: F.array_join(F.slice("words", k * 25 + 1, 25), " "))
    said = said.select("book_id", F.posexplode(F.when(F.size("words") > 0, pieces)).alias("k", "text"))
    n = F.length("text")
    page = F.floor(F.col("k") / 2) + F.when(n % 9 == 0, 1).otherwise(0)
    paras = said.select("book_id", (F.col("k") + 1).cast("long").alias("para_no"), page.alias("page"), "text", F.when(n % 4 == 0, 12.0).when(n % 4 == 1, 11.4).otherwise(11.0).alias("size"), F.lit(False).alias("bold"), F.lit(1).alias("n_lines"), F.lit(False).alias("first_on_page"))
    return D.merged_across_pages(paras).select("book_id", "para_no", "page", F.col("n_lines").cast("long").alias("n_lines"), "text", F.size("breaks").cast("long").alias("n_breaks"), "size")


_PRINT = f"""{PARAGRAPHS_SQL},
o AS (SELECT book_id, para_no AS line_no, (para_no - 1) // 12 AS page, (para_no - 1) % 12 AS row, text, length(text) AS n FROM paragraphs WHERE trim(text) <> ''),
lines AS (SELECT book_id, line_no, page, row // 6 AS block, 50.0 + CASE WHEN n % 5 = 0 THEN 20 ELSE 0 END + CASE WHEN n % 6 = 1 THEN 200 ELSE 0 END AS x0,
  row * 12.0 - CASE WHEN n % 6 = 1 THEN 12 ELSE 0 END + CASE WHEN n % 7 = 0 THEN 6 ELSE 0 END AS y0, text || CASE WHEN n % 8 = 2 THEN ' end-' ELSE '' END AS text, CASE WHEN n % 11 = 0 THEN 16.0 ELSE 11.0 END AS size, n % 3 = 0 AS bold FROM o),
s AS (SELECT *, y0 + 10 AS y1, CASE WHEN abs(y0 - lag(y0) OVER w) < 2 AND x0 > lag(x0) OVER w THEN 0 ELSE 1 END AS new FROM lines WINDOW w AS (PARTITION BY book_id, page, block ORDER BY round(y0), x0, line_no)),
f AS (SELECT *, sum(new) OVER (PARTITION BY book_id, page, block ORDER BY round(y0), x0, line_no) AS l FROM s),
whole AS (SELECT book_id, page, block, l, min(x0) AS x0, arg_min(y0, x0) AS y0, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, line_no) AS text, max(size) AS size, bool_and(bold) AS bold FROM f GROUP BY 1, 2, 3, 4),
d AS (SELECT *, median(x0) OVER (PARTITION BY book_id, page, block) AS left_ FROM whole),
c AS (SELECT *, CASE WHEN abs(size - lag(size) OVER v) > greatest(1.0, 0.15 * 11) OR y0 - lag(y1) OVER v > 1.1 * size
  OR (x0 - left_ > greatest(6.0, 0.8 * size) AND regexp_matches(lag(text) OVER v, '{_TERMINAL_SQL}')) OR lag(l) OVER v IS NULL THEN 1 ELSE 0 END AS cut FROM d WINDOW v AS (PARTITION BY book_id, page, block ORDER BY l)),
q AS (SELECT *, sum(cut) OVER (PARTITION BY book_id, page, block ORDER BY l) AS p FROM c),
a AS (SELECT book_id, page, block, p, max(size) AS size, bool_and(bold) AS bold, count(*) AS n_lines, list(text ORDER BY l) AS ts FROM q GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_PRINT}
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page, block, p) AS para_no, page, size, bold, n_lines, row_number() OVER (PARTITION BY book_id, page ORDER BY block, p) = 1 AS first_on_page,
  list_reduce(ts, lambda a, b: CASE WHEN a LIKE '%-' AND a NOT LIKE '%--' AND regexp_matches(b, '^\\p{{Ll}}') THEN substr(a, 1, length(a) - 1) || b
    WHEN a LIKE '%-' AND a NOT LIKE '%--' AND regexp_matches(b, '^\\p{{Lu}}') THEN a || b ELSE a || ' ' || b END) AS text FROM a""")
def printed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of blocks to paragraphs: fragments side by side, sizes, gaps and indents, words cut at lines' ends."""
    n, row = F.length("text"), (F.col("para_no") - 1) % 12
    beside = F.when(n % 6 == 1, 1).otherwise(0)
    lines = paragraphs(spark, sf_dir).where(F.trim("text") != "").select(
        "book_id", F.col("para_no").alias("line_no"), F.floor((F.col("para_no") - 1) / 12).cast("long").alias("page"), F.floor(row / 6).cast("long").alias("block"), (50.0 + F.when(n % 5 == 0, 20).otherwise(0) + beside * 200).alias("x0"),
        (row * 12.0 - beside * 12 + F.when(n % 7 == 0, 6).otherwise(0)).alias("y0"), F.concat("text", F.when(n % 8 == 2, " end-").otherwise("")).alias("text"), F.when(n % 11 == 0, 16.0).otherwise(11.0).alias("size"), (n % 3 == 0).alias("bold"),
    ).withColumn("y1", F.col("y0") + 10)
    sizes = lines.select("book_id").distinct().withColumn("body_size", F.lit(11.0))
    return D.paragraphs(lines, sizes).select("book_id", "para_no", "page", "size", "bold", F.col("n_lines").cast("long").alias("n_lines"), "first_on_page", "text")


@query(f"""WITH {_SIZED},
s AS (SELECT book_id, line_no AS para_no, page, text AS t, size, bold, body_size, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS ws FROM lines JOIN b USING (book_id)),
l AS (SELECT *, list_filter(ws, lambda w: length(w) > 3) AS long FROM s),
u AS (SELECT book_id, para_no, page, trim(t) AS sub FROM l WHERE para_no % 4 <> 1 AND len(ws) BETWEEN 1 AND 10 AND NOT regexp_matches(t, '{_OTHER}') AND NOT regexp_matches(t, '{T.CHAPTER}') AND NOT regexp_matches(t, '{T.SPECIAL.replace("'", "''")}') AND NOT regexp_matches(t, '{T.HAN_HEADING}')
  AND (size >= body_size * 1.08 OR bold OR (t = upper(t) AND regexp_matches(t, '\\p{{Lu}}')) OR (len(long) > 0 AND len(list_filter(long, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= 0.6 * len(long))))
SELECT l.book_id, l.para_no, CASE WHEN sub IS NULL THEN trim(t) ELSE regexp_replace(trim(t), '[ .:]+$', '') || CASE WHEN regexp_matches(t, '[㐀-鿿]') THEN ' ' ELSE ': ' END || sub END AS title, CASE WHEN sub IS NULL THEN 1 ELSE 2 END AS skip
FROM l LEFT JOIN u ON u.book_id = l.book_id AND u.para_no = l.para_no + 1 AND u.page = l.page WHERE l.para_no % 4 = 1""")
def titled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line after a heading joins its title if it looks like a subtitle; every fourth line is a heading here."""
    paras = _paras(spark, sf_dir)
    heads = paras.where("para_no % 4 = 1").select("book_id", "para_no", "page", F.trim("text").alias("title"))
    return D.with_subtitles(heads, paras, D.body_size(_lines(spark, sf_dir))).select("book_id", "para_no", "title", F.col("skip").cast("long").alias("skip"))


_CAPS = f"""{PARAGRAPHS_SQL},
t AS (SELECT book_id, para_no, text, length(text) % 3 AS k FROM paragraphs WHERE regexp_matches(text, '^[A-Z][a-z][a-z]')),
r AS (SELECT book_id, 2 * para_no - 1 AS no, substr(text, 1, 1) AS text FROM t WHERE k = 0 UNION ALL
  SELECT book_id, 2 * para_no, CASE k WHEN 0 THEN substr(text, 2) WHEN 1 THEN substr(text, 1, 1) || ' ' || substr(text, 2) ELSE text END FROM t),
v AS (SELECT book_id, word, count(*) AS n FROM (SELECT book_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ’'']+')) AS word FROM r) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN k = 0 THEN lower(regexp_extract(substr(text, 2), '^[A-Za-zÀ-ÿ’'']+')) ELSE regexp_extract(substr(text, 2), '^[a-z’'']+') END AS piece FROM t),
n AS (SELECT f.*, coalesce(a.n, 0) AS np, coalesce(b.n, 0) AS nj FROM f LEFT JOIN v a ON a.book_id = f.book_id AND a.word = piece LEFT JOIN v b ON b.book_id = f.book_id AND b.word = lower(substr(text, 1, 1)) || piece)"""


@query(f"""WITH {_CAPS} SELECT book_id, 2 * para_no AS para_no, k = 0 AS first_on_page, CASE WHEN k = 0 THEN substr(text, 1, 1) || CASE WHEN nj >= np THEN '' ELSE ' ' END || substr(text, 2)
  WHEN k = 1 AND nj <= 2 * np THEN substr(text, 1, 1) || ' ' || substr(text, 2) ELSE text END AS text FROM n""")
def drop_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big first letters that stand alone or apart go to their words, if the book knows these better; lines are taken apart for it."""
    said = paragraphs(spark, sf_dir).where(F.col("text").rlike("^[A-Z][a-z][a-z]")).withColumn("k", F.length("text") % 3)
    one, rest, k = F.substring("text", 1, 1), F.expr("substring(text, 2)"), F.col("k")
    parts = F.array(
        F.struct((2 * F.col("para_no") - 1).alias("para_no"), F.when(k == 0, one).alias("text"), F.lit(30.0).alias("size"), F.lit(True).alias("first_on_page")),
        F.struct((2 * F.col("para_no")).alias("para_no"), F.when(k == 0, rest).when(k == 1, F.concat(one, F.lit(" "), rest)).otherwise(F.col("text")).alias("text"), F.lit(11.0).alias("size"), F.lit(False).alias("first_on_page")),
    )
    paras = said.select("book_id", F.col("para_no").alias("page"), F.inline(parts)).where("text is not null").select("book_id", "para_no", "page", "text", "size", F.lit(False).alias("bold"), F.lit(1).alias("n_lines"), "first_on_page")
    sizes = paras.select("book_id").distinct().withColumn("body_size", F.lit(11.0))
    return D.drop_caps(paras, sizes).select("book_id", "para_no", "first_on_page", "text")


@query()
def imported_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S05."""
    return imported(_lines(spark, sf_dir), folder(spark, "import"))[0]
