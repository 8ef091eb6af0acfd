"""Streams over events, run to their end; the batch queries give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequences import throttled
from ..sources.shared import folder
from ..streaming import listening as S
from .model import TICKS_SQL, ticks
from .registry import ORACLES, query


def _arrive(spark: SparkSession, rows: DataFrame, at: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that arrive in three lots, in order of time; after each the stream is run to its end, from its checkpoint."""
    third = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
    for k in range(3):
        rows.where(third == k).write.mode("append").parquet(f"{at}/in")
        found = run(S.read_ticks(spark, f"{at}/in", rows.schema))
    return found


@query(f"WITH {TICKS_SQL} SELECT device, day, sum(seconds) AS seconds FROM ticks GROUP BY device, day")
def stream_daily_listening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's totals, complete at the end."""
    at = folder(spark, "daily")
    return _arrive(spark, ticks(spark, sf_dir).select("device", "ts", "seconds"), at, lambda said: S.run_to_table(S.daily_totals(said, ["device"]), f"{at}/out", f"{at}/state", "complete"))


@query(f"""WITH {TICKS_SQL},
m AS (
  SELECT device, event_id, ts, kind = 'error' AS reset, CAST(event_id % 3 AS DOUBLE) / 2 AS rate,
    sum(floor(seconds / 16)) OVER (PARTITION BY device ORDER BY ts, event_id) AS media_time FROM ticks),
s AS (SELECT *, media_time - lag(CASE WHEN NOT reset THEN media_time END) OVER (PARTITION BY device ORDER BY ts, event_id) AS d FROM m)
SELECT device, event_id, CASE WHEN NOT reset AND d > 0 AND d < 30 THEN d / CASE WHEN rate = 0 THEN 1.0 ELSE rate END ELSE 0.0 END AS listened FROM s""")
def stream_tick_listening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by device, over micro-batches."""
    at = folder(spark, "ticks")
    w = Window.partitionBy("device").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ticks(spark, sf_dir).select(
        "device", "event_id", "ts", (F.col("kind") == "error").alias("reset"), ((F.col("event_id") % 3).cast("double") / 2).alias("rate"), F.sum(F.floor(F.col("seconds") / 16).cast("double")).over(w).alias("media_time")
    )
    return _arrive(spark, rows, at, lambda said: S.run_to_table(S.listened(said), f"{at}/out", f"{at}/state", "append"))


@query(f"WITH {TICKS_SQL} SELECT device, arg_max(book_id, (ts, event_id)) AS book_id, max(ts) AS ts FROM ticks GROUP BY device")
def stream_latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key, batch by batch."""
    at = folder(spark, "latest")

    def run(said: DataFrame) -> DataFrame:
        write = S.upsert_sink(f"{at}/out", ["device"], ["ts", "event_id"])
        S.finished(said.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
        return S.read_version(spark, f"{at}/out")

    found = _arrive(spark, ticks(spark, sf_dir).select("device", "event_id", "book_id", "ts"), at, run)
    return found.select("device", "book_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {TICKS_SQL},
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ticks),
r AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT device, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS ticks FROM r GROUP BY device, run""")
def listening_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of playback, as a stream that is complete at its end."""
    at = folder(spark, "sessions")
    found = _arrive(spark, ticks(spark, sf_dir).select("device", "ts"), at, lambda said: S.run_to_table(S.sessions(said, ["device"], gap="6 hours"), f"{at}/out", f"{at}/state", "complete"))
    return found.select("device", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "ticks")


@query(f"""WITH {TICKS_SQL}
SELECT device, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM ticks GROUP BY device, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')""")
def stream_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each device in every six hours."""
    at = folder(spark, "throttled")
    said = ticks(spark, sf_dir).select("device", "event_id", "ts")
    found = _arrive(spark, said, at, lambda stream: S.run_to_table(S.throttled(stream, ["device"], every="6 hours"), f"{at}/out", f"{at}/state", "complete"))
    return found.select("device", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query(f"""WITH {TICKS_SQL}, s AS (SELECT device, list(seconds / 16 - 1 ORDER BY ts, event_id) FILTER (seconds / 16 - 1 > 0) AS f FROM ticks GROUP BY device)
SELECT device::VARCHAR AS engine, round(list_reduce(f, lambda a, b: 0.9::DOUBLE * a + 0.1::DOUBLE * b), 6) AS factor FROM s WHERE f IS NOT NULL""")
def stream_realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average of each engine's speed, carried from batch to batch."""
    at = folder(spark, "factor")
    said = ticks(spark, sf_dir).select(F.col("device").cast("string").alias("engine"), "ts", "event_id", (F.col("seconds") / 16 - 1).alias("factor"))
    found = _arrive(spark, said, at, lambda stream: S.run_to_table(S.realtime_factor(stream), f"{at}/out", f"{at}/state", "update"))
    return found.groupBy("engine").agg(F.round(F.max_by("factor", "version"), 6).alias("factor")).where("factor is not null")


_SIX = 6 * 3600 * 1_000_000


@query(f"""WITH RECURSIVE {TICKS_SQL},
e AS (SELECT device, event_id, epoch_us(ts) AS at_, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS i FROM ticks),
s AS (SELECT device, event_id, at_, i, at_ AS last_, true AS due FROM e WHERE i = 1 UNION ALL
  SELECT e.device, e.event_id, e.at_, e.i, CASE WHEN e.at_ - last_ >= {_SIX} THEN e.at_ ELSE last_ END, e.at_ - last_ >= {_SIX} FROM s JOIN e ON e.device = s.device AND e.i = s.i + 1)
SELECT device, event_id FROM s WHERE due""")
def stream_throttled_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each device, and then the next that is six hours or more after the last that went through."""
    at = folder(spark, "exactly")
    said = ticks(spark, sf_dir).select("device", "event_id", "ts")
    return _arrive(spark, said, at, lambda stream: S.run_to_table(S.throttled_exactly(stream, "device", 6 * 3600), f"{at}/out", f"{at}/state", "append"))


@query(ORACLES["stream_throttled_exactly"])
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a table, in one pass over sorted events."""
    return throttled(ticks(spark, sf_dir).select("device", "event_id", "ts"), ["device"], "ts", ["event_id"], 6 * 3600).select("device", "event_id")


def _server(device: int, at: int, doc: int) -> bool:
    """A server that is down in every third hour of each device's own."""
    return (at // 3_600_000_000 + device) % 3 != 0


@query(f"""WITH RECURSIVE {TICKS_SQL},
e AS (SELECT device, event_id, epoch_us(ts) AS at_, kind IN ('click', 'purchase') AS changed, kind = 'error' AS forced, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS i FROM ticks),
w AS (SELECT max(at_) // 1000 * 1000 - 60000000 AS mark FROM e),
s AS (
  SELECT DISTINCT device, CAST(0 AS BIGINT) AS i, false AS pending, CAST(-{_SIX} AS BIGINT) AS last_, CAST(-1 AS BIGINT) AS doc, false AS sent, false AS ok FROM e
  UNION ALL
  SELECT device, CASE WHEN timer THEN i ELSE i + 1 END, CASE WHEN send THEN NOT ok_ ELSE wants END, CASE WHEN send THEN now_ ELSE last_ END, doc_, send, ok_
  FROM (SELECT *, (now_ // 3600000000 + device) % 3 <> 0 AS ok_, timer OR (wants AND (forced OR now_ - last_ >= {_SIX})) AS send FROM (
    SELECT s.device, s.i, s.last_, e.forced, s.pending AND s.last_ + {_SIX} < coalesce(e.at_, 9000000000000000000) AS timer, CASE WHEN timer THEN s.last_ + {_SIX} ELSE e.at_ END AS now_,
      CASE WHEN timer THEN s.doc WHEN e.changed THEN e.event_id ELSE s.doc END AS doc_, s.pending OR (NOT timer AND e.changed) AS wants
    FROM s LEFT JOIN e ON e.device = s.device AND e.i = s.i + 1, w WHERE e.i IS NOT NULL OR (s.pending AND s.last_ + {_SIX} <= mark))))
SELECT device, last_ AS at, doc, ok FROM s WHERE sent""")
def stream_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are put at most once in six hours unless forced, again where the server said no, and by a timer where no more is heard."""
    at = folder(spark, "synced")
    said = ticks(spark, sf_dir).select("device", "ts", "event_id", F.col("kind").isin("click", "purchase").alias("changed"), (F.col("kind") == "error").alias("forced"))
    return _arrive(spark, said, at, lambda stream: S.run_to_table(S.synced(stream, _server, every=6 * 3600), f"{at}/out", f"{at}/state", "append"))


@query(f"""WITH {TICKS_SQL},
p AS (SELECT account, book_id, day, max(seconds) AS furthest, max(60 + event_id % 400) AS total, bool_and(kind <> 'error') AS ready FROM ticks GROUP BY 1, 2, 3),
r AS (SELECT *, max(furthest) OVER w AS f, max(total) OVER w AS t FROM p WINDOW w AS (PARTITION BY account, book_id ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT account, book_id, max(furthest) AS furthest, max(total)::DOUBLE AS total, CAST(min(CASE WHEN ready AND t > 0 AND f >= 0.98::DOUBLE * t THEN day END) AS VARCHAR) AS finished_at FROM r GROUP BY account, book_id""")
def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that only grow, and the day that a book was finished, which stays, over micro-batches."""
    at = folder(spark, "positions")
    days = ticks(spark, sf_dir).groupBy("account", "book_id", "day").agg(
        F.max("seconds").alias("furthest"), F.max(60 + F.col("event_id") % 400).cast("double").alias("total"), F.bool_and(F.col("kind") != "error").alias("ready"), F.min("ts").alias("ts")
    )
    found = _arrive(spark, days, at, lambda stream: S.run_to_table(S.positions(stream), f"{at}/out", f"{at}/state", "update"))
    last = F.max_by(F.struct("furthest", "total", "finished_at"), "version")
    return found.groupBy("account", "book_id").agg(last.alias("r")).select("account", "book_id", "r.*")


@query(f"""WITH {TICKS_SQL},
s AS (SELECT device, event_id, kind <> 'signup' AS visible,
  (epoch_us(ts) - lag(CASE WHEN kind <> 'signup' THEN epoch_us(ts) END) OVER (PARTITION BY device ORDER BY ts, event_id)) / 1e6::DOUBLE AS gap FROM ticks)
SELECT device, event_id, round(CASE WHEN visible THEN least(coalesce(gap, 0), 3600.0) ELSE 0.0 END, 3) AS in_app FROM s""")
def stream_app_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in the app between visible ticks, an hour at most, over micro-batches."""
    at = folder(spark, "app")
    said = ticks(spark, sf_dir).select("device", "event_id", "ts", (F.col("kind") != "signup").alias("visible"))
    found = _arrive(spark, said, at, lambda stream: S.run_to_table(S.app_time(stream, 3600.0), f"{at}/out", f"{at}/state", "append"))
    return found.select("device", "event_id", F.round("in_app", 3).alias("in_app"))
