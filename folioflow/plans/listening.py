"""Queries of listening analytics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import listening as L
from ..operators.sequences import Aggregate, aggregated, user_aggregate
from .model import TICKS_SQL, table, ticks
from .registry import query

TODAY = "2024-01-20"


def _today() -> Column:
    return F.lit(TODAY).cast("date")


DAYS_SQL = f"""{TICKS_SQL},
days AS (
  SELECT account, day, sum(CASE WHEN kind <> 'click' THEN seconds ELSE 0 END) AS listen,
    sum(CASE WHEN kind = 'click' THEN seconds ELSE 0 END) AS app
  FROM ticks GROUP BY account, day),
day_books AS (
  SELECT account, day, book_id, sum(seconds) AS seconds FROM ticks WHERE kind <> 'click' GROUP BY account, day, book_id)"""

DEVICE_BOOKS_SQL = f"""{DAYS_SQL},
device_books AS (
  SELECT account, device % 2 AS doc_order, book_id, max(seconds) AS furthest, max(seconds) + 100 AS total,
    min(CASE WHEN kind = 'purchase' THEN day END) AS finished_at, max(event_id) AS last_played_at,
    CASE WHEN book_id % 7 = 0 AND device % 2 = 0 THEN '' ELSE 'Book ' || book_id || '/' || (device % 2) END AS title,
    CASE WHEN book_id % 5 = 0 THEN '' ELSE 'Author ' || (book_id % 10) END AS author
  FROM ticks GROUP BY account, device % 2, book_id),
books AS (
  SELECT account, book_id, max(furthest) AS furthest, max(total) AS total, min(finished_at) AS finished_at,
    max(last_played_at) AS last_played_at,
    arg_min(nullif(title, ''), CASE WHEN title <> '' THEN doc_order END) AS title,
    arg_min(nullif(author, ''), CASE WHEN author <> '' THEN doc_order END) AS author
  FROM device_books GROUP BY account, book_id)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_days(ticks(spark, sf_dir))


def _device_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, order = F.col("book_id"), F.pmod(F.col("device"), F.lit(2)).cast("long")
    said = ticks(spark, sf_dir).withColumn("doc_order", order)
    one = said.groupBy("account", "doc_order", "book_id").agg(
        F.max("seconds").alias("furthest"),
        (F.max("seconds") + 100).alias("total"),
        F.min(F.when(F.col("kind") == "purchase", F.col("day"))).alias("finished_at"),
        F.max("event_id").alias("last_played_at"),
    )
    title = F.concat(F.lit("Book "), book.cast("string"), F.lit("/"), F.col("doc_order").cast("string"))
    return one.withColumns({
        "title": F.when((book % 7 == 0) & (F.col("doc_order") == 0), "").otherwise(title),
        "author": F.when(book % 5 == 0, "").otherwise(F.concat(F.lit("Author "), (book % 10).cast("string"))),
    })


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_books(_device_books(spark, sf_dir))


@query(f"WITH {DAYS_SQL} SELECT * FROM days")
def daily_listening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir)


@query(f"WITH {DAYS_SQL} SELECT * FROM day_books")
def daily_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.merge_day_books(ticks(spark, sf_dir))


@query(f"WITH {DEVICE_BOOKS_SQL} SELECT * FROM books")
def device_merge_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir)


@query(f"""WITH {TICKS_SQL},
d AS (SELECT account, device, max(event_id) % 3 AS updated_at, device % 2 AS doc_order, max(book_id) % 4 * 15 AS goal_minutes FROM ticks GROUP BY account, device)
SELECT account, coalesce(arg_max(goal_minutes, CASE WHEN goal_minutes <> 0 THEN updated_at * 10 - doc_order END), 30) AS goal_minutes FROM d GROUP BY account""")
def goal_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ticks(spark, sf_dir).groupBy("account", "device").agg((F.max("event_id") % 3).alias("updated_at"), (F.max("book_id") % 4 * 15).alias("goal_minutes"))
    return L.latest_goal(docs.withColumn("doc_order", F.col("device") % 2))


_USUAL = f"""WITH {DAYS_SQL},
usual AS (
  SELECT account, day, listen, app,
    CASE WHEN count(CASE WHEN listen >= 60 THEN 1 END) OVER w >= 3 THEN quantile_cont(CASE WHEN listen >= 60 THEN listen END, 0.5) OVER w ELSE 1800.0 END AS usual
  FROM days
  WINDOW w AS (PARTITION BY account ORDER BY day RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))"""


@query(f"{_USUAL} SELECT * FROM usual")
def usual_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usual_days(_days(spark, sf_dir))


_LEVEL = """CASE WHEN listen < 60 THEN 0 WHEN listen / usual < 0.5 THEN 1 WHEN listen / usual < 1 THEN 2 WHEN listen / usual < 1.5 THEN 3 ELSE 4 END"""


@query(f"{_USUAL} SELECT account, day, listen, usual, {_LEVEL} AS level FROM usual")
def heat_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = L.usual_days(_days(spark, sf_dir))
    return days.select("account", "day", "listen", "usual", L.level(F.col("listen"), F.col("usual")).alias("level"))


_RUNS = f"""WITH {DAYS_SQL},
ok AS (SELECT account, day, day - CAST(row_number() OVER (PARTITION BY account ORDER BY day) AS INT) AS g FROM days WHERE listen >= 300),
runs AS (SELECT account, min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM ok GROUP BY account, g)"""


@query(f"{_RUNS} SELECT * FROM runs")
def streak_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.streak_days(_days(spark, sf_dir))


@query(f"""{_RUNS},
s AS (
  SELECT account, coalesce(
      max(CASE WHEN DATE '{TODAY}' BETWEEN first_day AND last_day THEN DATE '{TODAY}' - first_day + 1 END),
      max(CASE WHEN DATE '{TODAY}' - 1 BETWEEN first_day AND last_day THEN DATE '{TODAY}' - first_day END), 0) AS current,
    max(length) AS longest, bool_or(DATE '{TODAY}' BETWEEN first_day AND last_day) AS today
  FROM runs GROUP BY account)
SELECT account, CAST(coalesce(current, 0) AS BIGINT) AS current, coalesce(longest, 0) AS longest, coalesce(today, false) AS today
FROM (SELECT DISTINCT account FROM days) LEFT JOIN s USING (account)""")
def streak_current_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.streaks(_days(spark, sf_dir), _today())


_HISTORY = """history AS (
  SELECT o_custkey AS account, o_orderdate::DATE AS day, sum(floor(o_totalprice / 64)) AS listen, sum(floor(o_totalprice / 256)) AS app
  FROM orders GROUP BY 1, 2)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of days: orders by customer."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day")).agg(
        F.sum(F.floor(F.col("o_totalprice") / 64).cast("double")).alias("listen"), F.sum(F.floor(F.col("o_totalprice") / 256).cast("double")).alias("app")
    )


@query(f"""WITH {_HISTORY}
SELECT account, date_trunc('month', day)::DATE AS month, sum(listen) AS listen, sum(app) AS app, count(*) FILTER (listen >= 60) AS active
FROM history GROUP BY 1, 2""")
def month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.month_totals(_history(spark, sf_dir))


@query(f"""WITH {_HISTORY},
m AS (SELECT account, date_trunc('month', day)::DATE AS month, sum(listen) AS listen FROM history WHERE day(day) <= 20 GROUP BY 1, 2)
SELECT a.account, a.month, a.listen, b.listen AS previous,
  CASE WHEN b.listen >= 60 THEN CAST(floor((a.listen - b.listen) / b.listen * 100 + 0.5) AS BIGINT) END AS delta_percent
FROM m a LEFT JOIN m b ON a.account = b.account AND b.month = (a.month - INTERVAL 1 MONTH)::DATE""")
def month_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.month_delta(_history(spark, sf_dir), until_day=20)


@query(f"WITH {DAYS_SQL} SELECT account, sum(listen) AS listen, bool_or(listen >= 60) AS any_listening FROM days GROUP BY account")
def active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.total_listened(_days(spark, sf_dir))


@query(f"""{_RUNS.replace(DAYS_SQL, DEVICE_BOOKS_SQL)},
l AS (SELECT account, max(length) AS longest FROM runs GROUP BY account),
t AS (SELECT account, sum(listen) AS listen FROM days GROUP BY account),
f AS (SELECT account, count(*) AS n FROM books WHERE finished_at IS NOT NULL GROUP BY account)
SELECT account, coalesce(n, 0) > 0 AS first_book, coalesce(longest, 0) >= 7 AS week_streak, coalesce(longest, 0) >= 30 AS month_streak,
  listen >= 36000 AS ten_hours, listen >= 180000 AS fifty_hours, greatest(0, 36000 - listen) AS to_ten_hours
FROM t LEFT JOIN l USING (account) LEFT JOIN f USING (account)""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.milestones(_days(spark, sf_dir), _books(spark, sf_dir).where("finished_at is not null"), _today())


@query(f"""WITH {DEVICE_BOOKS_SQL}
SELECT account, book_id, finished_at, row_number() OVER (PARTITION BY account ORDER BY finished_at, book_id) AS position
FROM books WHERE date_trunc('month', finished_at) = DATE '2024-01-01'""")
def finished_in_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.finished_in(_books(spark, sf_dir), F.lit("2024-01-01").cast("date"))


@query(f"""WITH {_HISTORY}
SELECT account, date_trunc('month', day)::DATE AS month, coalesce(max(day) FILTER (listen >= 60), date_trunc('month', min(day))::DATE) AS day
FROM history GROUP BY account, date_trunc('month', day)""")
def default_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.default_day(_history(spark, sf_dir))


@query(f"""WITH {DEVICE_BOOKS_SQL}
SELECT d.account, d.day, d.book_id, d.seconds, coalesce(b.title, 'A deleted book') AS title, coalesce(b.finished_at = d.day, false) AS finished,
  row_number() OVER (PARTITION BY d.account, d.day ORDER BY d.seconds DESC, d.book_id) AS position
FROM day_books d LEFT JOIN (SELECT * FROM books WHERE furthest >= 100) b ON d.account = b.account AND d.book_id = b.book_id WHERE d.seconds >= 1""")
def books_on_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _books(spark, sf_dir).where("furthest >= 100")  # books that were hardly begun are deleted
    return L.books_on(L.merge_day_books(ticks(spark, sf_dir)), known)


@query(f"""WITH {DEVICE_BOOKS_SQL},
done AS (SELECT account, book_id, (finished_at + CAST(book_id % 2 AS INT)) AS day FROM books WHERE finished_at IS NOT NULL)
SELECT * FROM done x WHERE NOT EXISTS (SELECT 1 FROM day_books d WHERE d.account = x.account AND d.book_id = x.book_id AND d.day = x.day AND d.seconds >= 1)""")
def finished_not_listened(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _books(spark, sf_dir).withColumn("finished_at", F.date_add("finished_at", (F.col("book_id") % 2).cast("int")))
    return L.finished_not_listened(L.merge_day_books(ticks(spark, sf_dir)), moved)


@query(f"""WITH {_HISTORY},
m AS (SELECT DISTINCT account, date_trunc('month', day)::DATE AS month FROM history),
e AS (SELECT account, month, unnest(generate_series(month::TIMESTAMP, (month + INTERVAL 1 MONTH - INTERVAL 1 DAY)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM m)
SELECT e.account, e.month, e.day, coalesce(h.listen, 0) AS listen, CAST(isodow(e.month) - 1 AS INT) AS lead, e.day > DATE '1998-06-10' AS future
FROM e LEFT JOIN history h ON e.account = h.account AND e.day = h.day""")
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.month_calendar(_history(spark, sf_dir), F.lit("1998-06-10").cast("date"))


@query("""WITH p AS (
  SELECT o_custkey AS account, o_orderkey % 10 AS book_id, o_orderdate::DATE AS day, max(floor(o_totalprice)) AS furthest,
    max(floor(o_totalprice * 0.5) + 40000) AS total, bool_and(o_orderstatus <> 'P') AS ready
  FROM orders GROUP BY 1, 2, 3),
r AS (
  SELECT *, max(furthest) OVER w AS f, max(total) OVER w AS t FROM p WINDOW w AS (PARTITION BY account, book_id ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT account, book_id, max(furthest) AS furthest, max(total) AS total, min(CASE WHEN ready AND t > 0 AND f >= 0.98::DOUBLE * t THEN day END) AS finished_at
FROM r GROUP BY account, book_id""")
def finished_first_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    said = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 10).alias("book_id"), F.to_date("o_orderdate").alias("day")).agg(
        F.max(F.floor(price).cast("double")).alias("furthest"), F.max(F.floor(price * 0.5).cast("double") + 40000).alias("total"), F.bool_and(F.col("o_orderstatus") != "P").alias("ready")
    )
    return L.first_finished(said)


@query(f"""WITH {TICKS_SQL},
m AS (
  SELECT device, event_id, ts, kind = 'error' AS reset, CAST(event_id % 3 AS DOUBLE) / 2 AS rate,
    sum(floor(seconds / 16)) OVER (PARTITION BY device ORDER BY ts, event_id) AS media_time FROM ticks),
s AS (SELECT *, media_time - lag(CASE WHEN NOT reset THEN media_time END) OVER (PARTITION BY device ORDER BY ts) AS d FROM m)
SELECT device, event_id, CASE WHEN NOT reset AND d > 0 AND d < 30 THEN d / CASE WHEN rate = 0 THEN 1.0 ELSE rate END ELSE 0.0 END AS listened FROM s""")
def tick_listening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("device").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = ticks(spark, sf_dir).withColumns({
        "reset": F.col("kind") == "error",
        "rate": (F.col("event_id") % 3).cast("double") / 2,
        "media_time": F.sum(F.floor(F.col("seconds") / 16).cast("double")).over(w),
    })
    return L.listened(said, ["device"]).select("device", "event_id", "listened")


@query(f"""WITH {TICKS_SQL},
s AS (SELECT device, event_id, kind <> 'signup' AS visible,
  (epoch_us(ts) - lag(CASE WHEN kind <> 'signup' THEN epoch_us(ts) END) OVER (PARTITION BY device ORDER BY ts)) / 1e6::DOUBLE AS gap FROM ticks)
SELECT device, event_id, CASE WHEN visible THEN least(coalesce(gap, 0), 3600.0) ELSE 0.0 END AS in_app FROM s""")
def tick_app_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ticks(spark, sf_dir).withColumn("visible", F.col("kind") != "signup")
    return L.in_app(said, ["device"], longest=3600).select("device", "event_id", "in_app")


@query(f"""WITH {DEVICE_BOOKS_SQL}
SELECT account, book_id, CAST(CASE WHEN finished_at IS NOT NULL THEN 100 ELSE
  least(greatest(coalesce(floor(coalesce(furthest, 0) / nullif(CASE WHEN book_id % 2 = 0 THEN coalesce(nullif(book_id * 10.0, 0), nullif(total, 0))
    ELSE coalesce(nullif(total, 0), nullif(book_id * 10.0, 0)) END, 0) * 100 + 0.5), 0), 0), 99) END AS INT) AS percent FROM books""")
def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir)
    total = L.book_progress(F.col("book_id") * 10.0, F.col("total"), F.col("book_id") % 2 == 0)
    return b.select("account", "book_id", N.progress_percent(F.col("furthest"), total, F.col("finished_at").isNotNull()).alias("percent"))


@query(f"""WITH {DAYS_SQL}
SELECT account, day, least(listen / 1800.0::DOUBLE, 1.0::DOUBLE) AS share, CAST(greatest(ceil((1800 - listen) / 60.0::DOUBLE), 0) AS BIGINT) AS minutes_left FROM days""")
def goal_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("account", "day", N.goal_ring(F.col("listen"), F.lit(30)).alias("g")).select("account", "day", "g.*")


@query(f"""WITH {DAYS_SQL} SELECT account, day, CASE WHEN day = DATE '{TODAY}' THEN 'Today' WHEN day = DATE '{TODAY}' - 1 THEN 'Yesterday'
  ELSE strftime(day, '%A, %-d %B') END AS label, strftime(day, '%Y-%m') AS month_key, CAST(day(last_day(day)) AS INT) AS days_in_month,
  CAST(isodow(day) - 1 AS INT) AS weekday, least((date_trunc('month', day) + INTERVAL 1 MONTH)::DATE, DATE '2024-01-01') AS next_month FROM days""")
def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    return _days(spark, sf_dir).select(
        "account", "day", N.relative_day(day, _today()).alias("label"), N.month_key(day).alias("month_key"), N.days_in_month(day).alias("days_in_month"),
        N.monday_first(day).cast("int").alias("weekday"), N.shifted_month(day, 1, _today()).alias("next_month"),
    )


@query(f"""WITH {TICKS_SQL} SELECT device, CAST((ts - CAST(device % 12 AS INT) * INTERVAL 1 HOUR) AS DATE) AS local_day, sum(seconds) AS seconds FROM ticks GROUP BY 1, 2""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.concat(F.lit("-"), F.lpad((F.col("device") % 12).cast("string"), 2, "0"), F.lit(":00"))
    return ticks(spark, sf_dir).groupBy("device", N.date_key(F.col("ts"), zone).alias("local_day")).agg(F.sum("seconds").alias("seconds"))


@query(f"""WITH {DAYS_SQL} SELECT account, book_id, day, seconds, coalesce(sum(seconds) OVER (PARTITION BY account, book_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM day_books""")
def running_listened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.running_listened(L.merge_day_books(ticks(spark, sf_dir)))


@query(f"""WITH {DAYS_SQL} SELECT account, min(day) AS earliest FROM days GROUP BY account""")
def earliest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far back the calendar can be turned."""
    return _days(spark, sf_dir).groupBy("account").agg(F.min("day").alias("earliest"))


@query(f"""WITH {DAYS_SQL} SELECT account, median(listen) AS usual FROM days WHERE listen >= 60 GROUP BY account""")
def usual_by_user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user's aggregate function."""
    median = user_aggregate(lambda v: float(v.median()))
    return _days(spark, sf_dir).where("listen >= 60").groupBy("account").agg(median(F.col("listen")).alias("usual"))


#: How many values, the sum of their logarithms, and the greatest.
_GEOMETRIC = Aggregate(
    "n long, logs double, most double", (0, 0.0, 0.0), lambda b, v: (b[0] + len(v), b[1] + float(np.log(v).sum()), max(b[2], float(v.max()))), lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])),
    lambda b: {"n": b[0], "mean": float(np.exp(b[1] / b[0])), "most": b[2]}, "struct<n:bigint,mean:double,most:double>",
)


@query(f"""WITH {DAYS_SQL} SELECT account > 20 AS many, count(*) AS n, round(exp(avg(ln(listen))), 6) AS mean, max(listen) AS most FROM days WHERE listen >= 60 GROUP BY 1""")
def geometric_by_user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a user's aggregate of partial results, of two groups one of which has most of the rows."""
    days = _days(spark, sf_dir).where("listen >= 60").withColumn("many", F.col("account") > 20)
    found = aggregated(days, ["many"], F.col("listen"), _GEOMETRIC)
    return found.select("many", "value.n", F.round("value.mean", 6).alias("mean"), "value.most")
