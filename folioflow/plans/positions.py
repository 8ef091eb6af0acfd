"""Queries of positions in books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import positions as P
from ..operators import sequences as S
from .model import CHAPTERS_SQL, chapters, table
from .registry import query

_OFFSETS = f"""{CHAPTERS_SQL},
offsets AS (
  SELECT *, round(coalesce(sum(duration) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS "offset" FROM chapters),
paged AS (
  SELECT *, CAST(1 + coalesce(sum(words % 40 + 1) OVER w, 0) AS BIGINT) AS first_page, CAST(coalesce(sum(words % 40 + 1) OVER w, 0) + words % 40 AS BIGINT) AS last_page FROM chapters
  WINDOW w AS (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
probes AS (SELECT o_orderkey AS book_id, floor(o_totalprice / 8) AS t, CAST(o_custkey % 120 + 1 AS BIGINT) AS page FROM orders)"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("book_id"), F.floor(F.col("o_totalprice") / 8).cast("double").alias("t"), (F.col("o_custkey") % 120 + 1).alias("page")
    )


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with ranges of pages; a chapter has one page less than the room it takes."""
    room = F.col("words") % 40 + 1
    laid = chapters(spark, sf_dir).withColumn("_p", S.before(room, ["book_id"], ["chapter_no"]))
    return laid.withColumns({"first_page": F.col("_p") + 1, "last_page": F.col("_p") + room - 1}).drop("_p")


@query(f'WITH {_OFFSETS} SELECT book_id, chapter_no, duration, "offset" FROM offsets')
def chapter_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.offsets(chapters(spark, sf_dir)).select("book_id", "chapter_no", "duration", "offset")


@query(f"""WITH {CHAPTERS_SQL}
SELECT book_id, chapter_no, coalesce(sum(CASE WHEN include THEN coalesce(nullif(duration, 0), est_seconds) ELSE 0 END)
  OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM chapters""")
def book_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.book_position(chapters(spark, sf_dir)).select("book_id", "chapter_no", "position")


@query(f"WITH {CHAPTERS_SQL} SELECT book_id, chapter_no, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no) AS number FROM chapters WHERE include")
def chapter_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chapter_numbers(chapters(spark, sf_dir)).select("book_id", "chapter_no", "number")


@query(f"""WITH {_OFFSETS}
SELECT p.book_id, p.t, coalesce(o.chapter_no, f.chapter_no) AS chapter_no
FROM probes p ASOF LEFT JOIN (SELECT book_id, "offset" - 0.05 AS at_, max(chapter_no) AS chapter_no FROM offsets GROUP BY 1, 2) o ON p.book_id = o.book_id AND p.t >= o.at_
LEFT JOIN (SELECT book_id, min(chapter_no) AS chapter_no FROM offsets GROUP BY book_id) f ON p.book_id = f.book_id""")
def chapter_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chapter_at(_probes(spark, sf_dir).drop("page"), P.offsets(chapters(spark, sf_dir)))


@query(f"""WITH {_OFFSETS},
marks AS (SELECT book_id, first_page AS page, 0.6 + coalesce(sum(est_seconds) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM paged),
probe AS (SELECT book_id, floor(t / 4) AS t FROM probes)
SELECT p.book_id, p.t, coalesce(m.page, f.page) AS page
FROM probe p ASOF LEFT JOIN (SELECT book_id, at_ - 0.05 AS a, max(page) AS page FROM marks GROUP BY 1, 2) m ON p.book_id = m.book_id AND p.t >= m.a
LEFT JOIN (SELECT book_id, min(page) AS page FROM marks GROUP BY book_id) f ON p.book_id = f.book_id""")
def page_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _paged(spark, sf_dir).withColumn("at", 0.6 + S.before(F.col("est_seconds"), ["book_id"], ["chapter_no"])).select("book_id", F.col("first_page").alias("page"), "at")
    probes = _probes(spark, sf_dir).select("book_id", F.floor(F.col("t") / 4).cast("double").alias("t"))
    return P.page_at(probes, marks, ["book_id"])


@query(f"""WITH {_OFFSETS},
inc AS (
  SELECT book_id, chapter_no, coalesce(nullif(duration, 0), est_seconds) AS len,
    coalesce(sum(coalesce(nullif(duration, 0), est_seconds)) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM chapters WHERE include)
SELECT p.book_id, p.t, i.chapter_no, greatest(0, least(p.t - i.start, i.len)) AS time
FROM probes p ASOF LEFT JOIN inc i ON p.book_id = i.book_id AND p.t >= i.start""")
def chapter_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chapter_of_position(_probes(spark, sf_dir).drop("page"), chapters(spark, sf_dir))


@query(f"""WITH {_OFFSETS},
inc AS (SELECT *, lead(chapter_no) OVER w AS n_no, lead(first_page) OVER w AS n_a, lead(last_page) OVER w AS n_b FROM paged WHERE include WINDOW w AS (PARTITION BY book_id ORDER BY chapter_no)),
f AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY first_page) = 1),
j AS (
  SELECT p.book_id, p.page, coalesce(i.chapter_no, f.chapter_no) AS c, coalesce(i.first_page, f.first_page) AS a, coalesce(i.last_page, f.last_page) AS b,
    CASE WHEN i.book_id IS NULL THEN f.n_no ELSE i.n_no END AS n_no, i.n_a, i.n_b
  FROM probes p ASOF LEFT JOIN inc i ON p.book_id = i.book_id AND p.page >= i.first_page JOIN f ON p.book_id = f.book_id),
k AS (SELECT *, n_no IS NOT NULL AND page >= a AND page > b + 1 AS later FROM j)
SELECT k.book_id, page, CASE WHEN later THEN n_no ELSE c END AS chapter_no,
  CASE WHEN later THEN least(greatest(page, n_a), n_b) ELSE least(greatest(page, a), b) END AS target,
  (SELECT min(chapter_no) FROM paged s WHERE NOT s.include AND s.book_id = k.book_id AND k.page BETWEEN s.first_page AND s.last_page) AS skipped_no
FROM k""")
def locate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.locate(_probes(spark, sf_dir).drop("t"), _paged(spark, sf_dir))


_LABELS = """labels AS (
  SELECT l_orderkey % 100 AS book_id, row_number() OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pdf_page,
    CASE WHEN l_quantity < 5 THEN '' WHEN l_quantity < 8 THEN 'x' || l_linenumber ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS label
  FROM lineitem)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    w = Window.partitionBy("book_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    keyed = table(spark, sf_dir, "lineitem").withColumn("book_id", F.col("l_orderkey") % 100)
    label = F.when(q < 5, "").when(q < 8, F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))).otherwise(q.cast("long").cast("string"))
    return keyed.select("book_id", F.row_number().over(w).cast("long").alias("pdf_page"), label.alias("label"))


@query(f"""WITH {_LABELS},
asked AS (SELECT DISTINCT o_custkey % 100 AS book_id, CASE o_custkey % 3 WHEN 0 THEN 'X' || o_custkey % 9 WHEN 1 THEN CAST(o_custkey % 60 AS VARCHAR) ELSE 'q' END AS page FROM orders)
SELECT a.book_id, a.page, coalesce(
    (SELECT min(pdf_page) FROM labels l WHERE l.book_id = a.book_id AND lower(l.label) = lower(a.page)),
    CASE WHEN TRY_CAST(a.page AS BIGINT) IS NULL THEN 1 ELSE coalesce(
      (SELECT max(pdf_page) FROM labels l WHERE l.book_id = a.book_id AND TRY_CAST(l.label AS BIGINT) <= TRY_CAST(a.page AS BIGINT)),
      (SELECT min(pdf_page) FROM labels l WHERE l.book_id = a.book_id AND TRY_CAST(l.label AS BIGINT) IS NOT NULL), greatest(1, TRY_CAST(a.page AS BIGINT))) END) AS pdf_page
FROM asked a""")
def printed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    asked = table(spark, sf_dir, "orders").select(
        (k % 100).alias("book_id"), F.when(k % 3 == 0, F.concat(F.lit("X"), (k % 9).cast("string"))).when(k % 3 == 1, (k % 60).cast("string")).otherwise("q").alias("page")
    )
    return P.page_in_pdf(asked.distinct(), _labels(spark, sf_dir))


@query(f"""WITH {_LABELS}
SELECT book_id, CASE WHEN count(*) FILTER (label <> '') >= 0.3 * count(*) THEN 'printed' ELSE 'pdf' END AS numbering,
  CASE WHEN count(*) FILTER (label <> '') >= 0.3 * count(*) THEN coalesce(min(TRY_CAST(label AS BIGINT)), 1) ELSE 1 END AS first_page,
  CASE WHEN count(*) FILTER (label <> '') >= 0.3 * count(*) THEN coalesce(max(TRY_CAST(label AS BIGINT)), count(*)) ELSE count(*) END AS last_page
FROM labels GROUP BY book_id""")
def reader_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reader_pages(_labels(spark, sf_dir))


_PARTS = f"""{CHAPTERS_SQL},
parts AS (
  SELECT book_id, part AS p, (ascii(part) % 3)::BIGINT AS chapter_no, chapter_no AS part_no, CASE WHEN words % 4 = 0 THEN NULL WHEN words % 4 = 1 THEN 0.0 ELSE duration END AS duration,
    CASE WHEN ready THEN est_seconds END AS est_seconds, ready
  FROM chapters),
imputed AS (
  SELECT book_id, chapter_no, part_no, ready, duration, coalesce(CASE WHEN duration > 0 THEN duration END, avg(CASE WHEN duration > 0 THEN duration END) OVER w,
    nullif(coalesce(est_seconds, 0) / count(*) OVER w, 0), 30) AS length
  FROM parts WINDOW w AS (PARTITION BY book_id, chapter_no))"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("words") % 4
    return chapters(spark, sf_dir).select(
        "book_id", (F.ascii("part") % 3).cast("long").alias("chapter_no"), F.col("chapter_no").alias("part_no"),
        F.when(k == 0, F.lit(None)).when(k == 1, F.lit(0.0)).otherwise(F.col("duration")).alias("duration"),
        F.when(F.col("ready"), F.col("est_seconds")).alias("est_seconds"), "ready",
    )


@query(f"WITH {_PARTS} SELECT book_id, chapter_no, part_no, length FROM imputed")
def part_duration_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.part_durations(_parts(spark, sf_dir)).select("book_id", "chapter_no", "part_no", "length")


def _whole(parts: DataFrame) -> DataFrame:
    return parts.withColumn("length", F.floor("length").cast("double"))


@query(f"""WITH {_PARTS},
s AS (SELECT *, coalesce(sum(floor(length)) OVER (PARTITION BY book_id, chapter_no ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, floor(length) AS len FROM imputed),
p AS (SELECT DISTINCT book_id, chapter_no, part_no * 9000.0::DOUBLE AS t FROM imputed)
SELECT p.book_id, p.chapter_no, p.t, s.part_no, greatest(0, least(p.t - s.start, s.len)) AS inside
FROM p ASOF LEFT JOIN s ON p.book_id = s.book_id AND p.chapter_no = s.chapter_no AND p.t >= s.start""")
def part_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _whole(P.part_durations(_parts(spark, sf_dir)))
    probes = parts.select("book_id", "chapter_no", (F.col("part_no") * 9000.0).alias("t")).distinct()
    return P.part_at(probes, parts)


@query(f"""WITH {CHAPTERS_SQL}
SELECT book_id, chapter_no, min(CASE WHEN include AND ready THEN chapter_no END) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_no,
  max(CASE WHEN include AND ready THEN chapter_no END) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_no FROM chapters""")
def next_playable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.neighbours(chapters(spark, sf_dir), F.col("include") & F.col("ready")).select("book_id", "chapter_no", "next_no", "previous_no")


@query(f"""WITH {CHAPTERS_SQL},
pos AS (
  SELECT o_orderkey AS book_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 7 + 1 END AS saved_no, floor(o_totalprice / 16) AS saved_time, floor(o_totalprice / 4) AS furthest FROM orders),
inc AS (
  SELECT book_id, chapter_no, coalesce(nullif(duration, 0), est_seconds) AS len,
    coalesce(sum(coalesce(nullif(duration, 0), est_seconds)) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM chapters WHERE include),
at_ AS (
  SELECT p.book_id, coalesce(p.saved_no, CASE WHEN p.furthest > 30 THEN i.chapter_no END) AS no,
    CASE WHEN p.saved_no IS NOT NULL THEN p.saved_time WHEN p.furthest > 30 THEN greatest(0, least(p.furthest - i.start, i.len)) END AS t
  FROM pos p ASOF LEFT JOIN inc i ON p.book_id = i.book_id AND p.furthest >= i.start),
play AS (SELECT *, lead(chapter_no) OVER (PARTITION BY book_id ORDER BY chapter_no) AS nxt FROM chapters WHERE include AND ready),
f AS (SELECT book_id, min(chapter_no) AS first_no FROM play GROUP BY book_id),
j AS (
  SELECT a.book_id, a.no, a.t, p.chapter_no AS here, p.duration, p.nxt, f.first_no,
    (SELECT min(chapter_no) FROM play q WHERE q.book_id = a.book_id AND q.chapter_no > a.no) AS after,
    p.chapter_no IS NOT NULL AND p.duration > 0 AND coalesce(a.t, 0) > p.duration - 3 AND p.nxt IS NOT NULL AS over_
  FROM at_ a JOIN f ON a.book_id = f.book_id LEFT JOIN play p ON p.book_id = a.book_id AND p.chapter_no = a.no)
SELECT book_id, CASE WHEN over_ THEN nxt WHEN here IS NOT NULL THEN no ELSE coalesce(after, first_no) END AS chapter_no,
  CASE WHEN here IS NOT NULL AND NOT over_ THEN coalesce(t, 0) ELSE 0 END AS time FROM j""")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_custkey"), F.col("o_totalprice")
    positions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("book_id"), F.when(k % 3 != 0, k % 7 + 1).alias("saved_no"),
        F.floor(price / 16).cast("double").alias("saved_time"), F.floor(price / 4).cast("double").alias("furthest"),
    )
    return P.resume(positions, chapters(spark, sf_dir), F.col("include") & F.col("ready"))


@query(f"""WITH {CHAPTERS_SQL},
t AS (
  SELECT book_id, chapter_no, words % 3 AS page, round(0.6 + coalesce(sum(est_seconds + 1) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS t,
    lag(words % 3) OVER (PARTITION BY book_id ORDER BY chapter_no) AS b FROM chapters)
SELECT book_id, chapter_no, page, t FROM t WHERE page IS DISTINCT FROM b""")
def page_change_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = chapters(spark, sf_dir).select("book_id", "chapter_no", (F.col("words") % 3).alias("page"), F.col("est_seconds").alias("seconds"), F.lit(1.0).alias("pause"))
    return P.page_marks(clips, ["book_id"], ["chapter_no"]).select("book_id", "chapter_no", "page", "t")


@query(f"""WITH {CHAPTERS_SQL},
d AS (SELECT book_id, chapter_no, words % 3 AS page, words, max(duration) OVER (PARTITION BY book_id) AS duration,
  lag(words % 3) OVER (PARTITION BY book_id ORDER BY chapter_no) AS b, sum(words) OVER (PARTITION BY book_id) AS total,
  coalesce(sum(words) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM chapters)
SELECT book_id, chapter_no, page, CAST(floor(round(0.6::DOUBLE + greatest(duration - 2.0::DOUBLE, 0) * pos / greatest(total, 1), 2)) AS BIGINT) AS t FROM d WHERE page IS DISTINCT FROM b""")
def estimated_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("book_id")
    paras = chapters(spark, sf_dir).select(
        "book_id", F.lit(1).alias("chapter_no"), F.col("chapter_no").alias("para_no"), (F.col("words") % 3).alias("page"), F.col("words").alias("chars"), F.max("duration").over(w).alias("duration")
    )
    return P.estimated_marks(paras).select("book_id", F.col("para_no").alias("chapter_no"), "page", F.floor("t").cast("long").alias("t"))


@query("""WITH r AS (
  SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) THEN 1 ELSE 0 END AS new,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
SELECT conv_id, turn, role, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE new END) OVER (PARTITION BY conv_id ORDER BY k) AS BIGINT) AS run FROM r""")
def contiguous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.groups(table(spark, sf_dir, "conversations"), "role", ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", "run")


@query(f"""WITH {CHAPTERS_SQL},
n AS (SELECT *, CASE WHEN part IS DISTINCT FROM lag(part) OVER (PARTITION BY book_id ORDER BY chapter_no) THEN 1 ELSE 0 END AS new FROM chapters),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY book_id ORDER BY chapter_no) AS BIGINT) AS run FROM n)
SELECT book_id, run, any_value(part) AS part, min(chapter_no) AS first_no, max(chapter_no) AS last_no, count(*) AS n, count(*) FILTER (ready) AS n_ready,
  sum(CASE WHEN ready THEN coalesce(nullif(duration, 0), est_seconds) ELSE est_seconds END) AS seconds FROM r GROUP BY book_id, run""")
def part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.group_summary(chapters(spark, sf_dir), "part", ["book_id"], "chapter_no")


@query(f"""WITH {CHAPTERS_SQL}
SELECT book_id, (sum(CASE WHEN chapter_no > 2 THEN coalesce(nullif(duration, 0), est_seconds) ELSE 0 END)
  + sum(CASE WHEN chapter_no = 2 THEN greatest(coalesce(nullif(duration, 0), est_seconds) - 60, 0) ELSE 0 END)) / 2 AS "left" FROM chapters WHERE include GROUP BY book_id""")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.time_left(chapters(spark, sf_dir), F.lit(2), F.lit(60.0), F.lit(2.0))


@query(f"""WITH {_PARTS}
SELECT book_id, coalesce(min(CASE WHEN (chapter_no, part_no) >= (1, 2) THEN chapter_no * 1000 + part_no END), min(chapter_no * 1000 + part_no)) // 1000 AS chapter_no,
  coalesce(min(CASE WHEN (chapter_no, part_no) >= (1, 2) THEN chapter_no * 1000 + part_no END), min(chapter_no * 1000 + part_no)) % 1000 AS part_no
FROM parts WHERE NOT ready GROUP BY book_id""")
def next_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.struct(F.lit(1).cast("long").alias("chapter_no"), F.lit(2).cast("long").alias("part_no"))
    return P.next_work(_parts(spark, sf_dir), want)


@query(f"""WITH {CHAPTERS_SQL} SELECT book_id, sum(CASE WHEN NOT ready THEN est_seconds ELSE 0 END) AS remaining, sum(CASE WHEN NOT ready THEN est_seconds ELSE 0 END) / 4 AS eta_seconds FROM chapters GROUP BY book_id""")
def remaining_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.remaining(chapters(spark, sf_dir), F.lit(4.0))


@query(f"""WITH {_OFFSETS},
n AS (SELECT *, CASE WHEN include IS DISTINCT FROM lag(include) OVER (PARTITION BY book_id ORDER BY chapter_no) THEN 1 ELSE 0 END AS new FROM paged),
r AS (SELECT *, sum(new) OVER (PARTITION BY book_id ORDER BY chapter_no) AS run FROM n),
o AS (SELECT book_id, run, min(first_page) AS a, max(last_page) AS b, min(chapter_no) AS skipped_no FROM r WHERE NOT include GROUP BY book_id, run)
SELECT p.book_id, p.page, CASE WHEN p.page <= o.b THEN o.skipped_no END AS skipped_no FROM probes p ASOF LEFT JOIN o ON p.book_id = o.book_id AND p.page >= o.a""")
def skipped_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.skipped_title(_probes(spark, sf_dir).drop("t"), _paged(spark, sf_dir))


@query(f"""WITH RECURSIVE {CHAPTERS_SQL},
w AS (
  SELECT book_id, chapter_no, est_seconds + 1 AS c, 0 AS bin, est_seconds + 1 AS acc FROM chapters WHERE chapter_no = 1
  UNION ALL
  SELECT n.book_id, n.chapter_no, n.est_seconds + 1, CASE WHEN w.acc + n.est_seconds + 1 > 1500 THEN w.bin + 1 ELSE w.bin END,
    CASE WHEN w.acc + n.est_seconds + 1 > 1500 THEN n.est_seconds + 1 ELSE w.acc + n.est_seconds + 1 END
  FROM w JOIN chapters n ON n.book_id = w.book_id AND n.chapter_no = w.chapter_no + 1)
SELECT book_id, chapter_no, CAST(bin AS INT) AS bin FROM w""")
def greedy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G02."""
    return S.binned(chapters(spark, sf_dir), ["book_id"], ["chapter_no"], F.col("est_seconds") + 1, 1500.0, close_after=False).select("book_id", "chapter_no", "bin")


@query(f"""WITH RECURSIVE {CHAPTERS_SQL},
w AS (
  SELECT book_id, chapter_no, 0 AS bin, est_seconds AS acc FROM chapters WHERE chapter_no = 1
  UNION ALL
  SELECT n.book_id, n.chapter_no, CASE WHEN w.acc >= 1200 THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.acc >= 1200 THEN n.est_seconds ELSE w.acc + n.est_seconds END
  FROM w JOIN chapters n ON n.book_id = w.book_id AND n.chapter_no = w.chapter_no + 1)
SELECT book_id, chapter_no, CAST(bin AS INT) AS bin FROM w""")
def sections_20min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G03."""
    return S.binned(chapters(spark, sf_dir), ["book_id"], ["chapter_no"], F.col("est_seconds"), 1200.0, close_after=True).select("book_id", "chapter_no", "bin")


@query(f"""WITH {CHAPTERS_SQL},
a AS (SELECT book_id, chapter_no, words % 16 AS page FROM chapters),
p AS (SELECT book_id, chapter_no - 1 AS part, 2 * chapter_no AS low, CASE WHEN ready THEN 2 * chapter_no + 1 ELSE 2 * chapter_no END AS high, duration FROM chapters)
SELECT a.book_id, a.chapter_no, page, coalesce(arg_max(duration, low) FILTER (low <= page), 0) AS t,
  CAST(coalesce(min(part) FILTER (page BETWEEN low AND high), max(part) FILTER (low <= page), 0) AS INT) AS part
FROM a JOIN p ON a.book_id = p.book_id GROUP BY a.book_id, a.chapter_no, page""")
def time_at_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and parts of the book's own chapters; some parts tell their pages by a range."""
    laid = chapters(spark, sf_dir)
    n = F.col("chapter_no")
    pages = P.page_list(F.when(F.col("ready"), F.array(2 * n, 2 * n + 1)), 2 * n, 2 * n)
    rows = laid.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct((2 * n).alias("page"), F.col("duration").alias("t"), pages.alias("pages")))).alias("rows"))
    asked = laid.select("book_id", "chapter_no", (F.col("words") % 16).alias("page")).join(rows, "book_id")
    return asked.select("book_id", "chapter_no", "page", P.time_at(F.col("rows"), F.col("page")).alias("t"), P.part_of_page(F.transform("rows", lambda r: r["pages"]), F.col("page")).alias("part"))


@query(f"""WITH {CHAPTERS_SQL},
p AS (SELECT *, max(CASE WHEN include AND ready THEN chapter_no END) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_no FROM chapters)
SELECT book_id, chapter_no, CASE WHEN words % 7 > 3 THEN chapter_no ELSE coalesce(previous_no, chapter_no) END AS back_no FROM p""")
def going_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the chapter's beginning when it has run for more than 3 s, else to the one before."""
    near = P.neighbours(chapters(spark, sf_dir), F.col("include") & F.col("ready"))
    return near.select("book_id", "chapter_no", P.going_back(F.col("words") % 7, F.col("previous_no"), F.col("chapter_no")).alias("back_no"))


@query(f"""WITH {CHAPTERS_SQL},
t AS (SELECT book_id, chapter_no, est_seconds, words, round(0.6 + coalesce(sum(est_seconds + 1) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS t FROM chapters)
SELECT book_id, chapter_no, k AS page, round((t + est_seconds * (k * 16) / greatest(words, 1)) * 4) / 4 AS t FROM t, (SELECT unnest([1, 2]) AS k) WHERE k * 16 < words""")
def pages_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that begin inside a clip, by their share of its text."""
    seconds, size = F.col("est_seconds"), F.col("words")
    timed = chapters(spark, sf_dir).withColumn("t", F.round(F.lit(P.LEAD_IN) + P.before(seconds + 1, ["book_id"], ["chapter_no"]), 2).cast("double"))
    pages = timed.withColumn("page", F.explode(F.array(F.lit(1), F.lit(2)))).where(F.col("page") * 16 < size)
    return pages.select("book_id", "chapter_no", "page", (F.round(P.page_inside(F.col("t"), seconds, F.col("page") * 16, size) * 4) / 4).alias("t"))
