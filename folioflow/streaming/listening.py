"""Listening as Structured Streaming: ticks in, running totals out.

Totals are event-time aggregations with a watermark. What depends on the tick before (listened time,
positions that only grow, a moving average) is state by key, in one stateful operator for each; its
state is a few numbers, however long a key's history is. Sinks replace rows by key, so a batch that
is run twice leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import delete, names

LONGEST, FINISHED, KEEP = 30.0, 0.98, 0.9


def read_ticks(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, so many of them in a batch, or all that are new; times as timestamps, which watermarks need."""
    reader = spark.readStream.schema(schema)
    ticks = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
    return ticks.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(ticks: DataFrame, by: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Seconds by day and key; days later than the watermark are closed. ``ticks`` has ts, seconds."""
    day = F.window("ts", "1 day")
    return ticks.withWatermark("ts", delay).groupBy(*by, day).agg(F.sum("seconds").alias("seconds")).select(*by, F.col("window.start").cast("date").alias("day"), "seconds")


def sessions(ticks: DataFrame, by: Sequence[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of playback: ticks without a longer gap."""
    return ticks.withWatermark("ts", delay).groupBy(*by, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("ticks")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "ticks")


def throttled(events: DataFrame, by: Sequence[str], every: str = "2 seconds", delay: str = "1 minute") -> DataFrame:
    """The first event of each window of time and key."""
    return events.withWatermark("ts", delay).groupBy(*by, F.window("ts", every)).agg(F.min("ts").alias("ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select(*by, "ts", "event_id")


def throttled_exactly(events: DataFrame, by: str, every: float) -> DataFrame:
    """The events that a leading-edge throttle lets through, which no windows' edges cut: state is when the last of a key went through. ``events`` has ``by`` (long), ts, event_id."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for e, at in zip(rows["event_id"], rows["at"]):
            if last is None or at - last >= every * 1_000_000:
                out.append((key[0], e))
                last = int(at)
        state.update((last,))
        yield pd.DataFrame(out, columns=[by, "event_id"])

    slim = events.select(by, F.unix_micros("ts").alias("at"), "event_id")
    return slim.groupBy(by).applyInPandasWithState(run, f"{by} long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def synced(changes: DataFrame, put: Callable[[int, int, int], bool], every: float = 60.0, delay: str = "1 minute") -> DataFrame:
    """What a device's changes send to the server: device, at (microseconds), doc (the change that its document is as of), ok.

    ``changes`` has device, ts, event_id, changed, forced: every row is a moment at which a device may send, and
    some change its document or must be sent at once. A document that isn't sent yet goes whole, at most
    once in ``every`` seconds unless forced; where ``put(device, at, doc)`` says no it is still to be sent. If
    nothing more is heard of a device, a timer sends at the end of the time: state is whether anything is to be
    sent, when the last was, and the document. Whole documents are replaced, so one that is sent twice does no harm.
    """
    wait = round(every * 1_000_000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last, doc = state.get if state.exists else (False, -wait, -1)
        out: list[tuple] = []

        def send(at: int) -> None:
            nonlocal pending, last
            last, pending = at, not put(key[0], at, doc)
            out.append((key[0], at, doc, not pending))

        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
            for at, event, changed, forced in zip(rows["at"].tolist(), rows["event_id"].tolist(), rows["changed"], rows["forced"]):
                while pending and last + wait < at:
                    send(last + wait)
                if changed:
                    pending, doc = True, event
                if pending and (forced or at - last >= wait):
                    send(at)
        now = state.getCurrentWatermarkMs() * 1000
        while pending and last + wait <= now:
            send(last + wait)
        state.update((pending, last, doc))
        if pending:
            state.setTimeoutTimestamp(-(-(last + wait) // 1000))
        yield pd.DataFrame(out, columns=["device", "at", "doc", "ok"])

    slim = changes.withWatermark("ts", delay).select("device", "ts", F.unix_micros("ts").alias("at"), "event_id", "changed", "forced")
    return slim.groupBy("device").applyInPandasWithState(run, "device long, at long, doc long, ok boolean", "pending boolean, last long, doc long", "append", GroupStateTimeout.EventTimeTimeout)


def listened(ticks: DataFrame) -> DataFrame:
    """Seconds listened at each tick. ``ticks`` has device, event_id, ts, media_time, rate, reset; state is the last media time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists and state.get[0] >= 0 else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for e, t, rate, reset in zip(rows["event_id"], rows["media_time"], rows["rate"], rows["reset"]):
            step = None if last is None or reset else t - last
            out.append((key[0], e, step / (rate or 1.0) if step is not None and 0 < step < LONGEST else 0.0))
            last = None if reset else float(t)
        state.update((-1.0 if last is None else last,))  # -1: nothing to count from
        yield pd.DataFrame(out, columns=["device", "event_id", "listened"])

    return ticks.groupBy("device").applyInPandasWithState(run, "device long, event_id long, listened double", "last double", "append", GroupStateTimeout.NoTimeout)


#: Groups that keys of :func:`positions` are held in: few enough that a group is worth a call, many enough that one is small.
HELD_IN = 512


def positions(ticks: DataFrame) -> DataFrame:
    """Per account and book the greatest position and total, and the day it was finished, which never changes again.

    ``ticks`` has account, book_id, day, furthest, total, ready. Keys are held together by a hash: a call handles all of a
    group's keys that a batch has, and its state is their columns.
    """
    key = ["_account", "_book", "_no_account", "_no_book"]
    values = ["furthest", "total", "finished_at"]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip([*key, *values], state.get if state.exists else [[] for _ in range(7)])))
        new = pd.concat(list(batches)).sort_values("day", kind="stable")
        rows = pd.concat([held.assign(ready=False, day=None, _new=False), new.assign(finished_at=None, _new=True)] if len(held) else [new.assign(finished_at=None, _new=True)], ignore_index=True)
        rows[["furthest", "total"]] = rows[["furthest", "total"]].astype(float).fillna(0.0).clip(lower=0.0)
        keys = rows.groupby(key, sort=False)
        rows["furthest"], rows["total"] = keys["furthest"].cummax(), keys["total"].cummax()
        done = (rows["ready"] == True) & (rows["total"] > 0) & (rows["furthest"] >= FINISHED * rows["total"])  # noqa: E712
        rows.loc[done, "finished_at"] = rows.loc[done, "day"].map(str)
        # The first day that is known stays; "first" and "last" pass over nulls.
        last = rows.groupby(key, sort=False).agg(furthest=("furthest", "last"), total=("total", "last"), finished_at=("finished_at", "first"), changed=("_new", "last")).reset_index()
        last["finished_at"] = last["finished_at"].astype(object).where(last["finished_at"].notna(), None)
        state.update(tuple(last[c].tolist() for c in [*key, *values]))
        yield last.loc[last["changed"], [*key, *values]]

    whole = ticks.select(
        F.coalesce("account", F.lit(0)).cast("long").alias("_account"), F.coalesce("book_id", F.lit(0)).cast("long").alias("_book"), F.isnull("account").alias("_no_account"), F.isnull("book_id").alias("_no_book"),
        "day", "furthest", "total", "ready", F.pmod(F.xxhash64("account", "book_id"), F.lit(HELD_IN)).alias("_held"),
    )
    row = "_account long, _book long, _no_account boolean, _no_book boolean, furthest double, total double, finished_at string"
    told = whole.groupBy("_held").applyInPandasWithState(run, row, "_account array<long>, _book array<long>, _no_account array<boolean>, _no_book array<boolean>, furthest array<double>, total array<double>, finished_at array<string>", "update", GroupStateTimeout.NoTimeout)
    return told.select(F.when(~F.col("_no_account"), F.col("_account")).alias("account"), F.when(~F.col("_no_book"), F.col("_book")).alias("book_id"), *values)


def realtime_factor(samples: DataFrame) -> DataFrame:
    """The moving average of each engine's speed. ``samples`` has engine, ts, event_id, factor."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        for v in pd.concat(list(batches)).sort_values(["ts", "event_id"])["factor"]:
            if v > 0:
                mean = float(v) if mean is None else KEEP * mean + (1 - KEEP) * float(v)
        state.update((mean,))
        yield pd.DataFrame([(key[0], mean)], columns=["engine", "factor"])

    return samples.groupBy("engine").applyInPandasWithState(run, "engine string, factor double", "factor double", "update", GroupStateTimeout.NoTimeout)


def app_time(ticks: DataFrame, longest: float = 10.0) -> DataFrame:
    """Seconds in the app at each visible tick, gaps capped. ``ticks`` has device, event_id, ts, visible."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists and state.get[0] >= 0 else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for e, ts, visible in zip(rows["event_id"], rows["ts"], rows["visible"]):
            now = ts.timestamp()
            out.append((key[0], e, min(longest, now - last) if visible and last is not None else 0.0))
            last = now if visible else None
        state.update((-1.0 if last is None else last,))
        yield pd.DataFrame(out, columns=["device", "event_id", "in_app"])

    return ticks.groupBy("device").applyInPandasWithState(run, "device long, event_id long, in_app double", "last double", "append", GroupStateTimeout.NoTimeout)


def latest_by_key(batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that comes last."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert_sink(path: str, key: Sequence[str], order: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table below ``path`` whose rows are replaced by key.

    Rows lie in buckets by their key. A batch writes the buckets of its own keys anew, as its version, each
    from its greatest version below the batch's number; so its cost goes with what changes, and running it again writes the
    same again. Of a bucket the versions before the last two are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # as many as there are buckets at most
        held = versions(spark, path)
        below = {b: [v for v in held.get(b, []) if v < number] for b in touched}
        old = [f"{path}/version={found[-1]}/bucket={b}" for b, found in below.items() if found]
        now = latest_by_key(batch, key, order)
        if old:
            now = latest_by_key(spark.read.schema(batch.schema).parquet(*old).unionByName(now), key, order)
        now.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
        for b, found in below.items():
            for v in found[:-1]:
                delete(spark, f"{path}/version={v}/bucket={b}")

    return write


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names(spark, path) if n.startswith(prefix))


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of every bucket of a table."""
    found: dict[int, list[int]] = {}
    for v in _numbers(spark, path, "version="):
        for b in _numbers(spark, f"{path}/version={v}", "bucket="):
            found.setdefault(b, []).append(v)
    return found


def read_version(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """A table as of its last batch, or of one not more than one change before: of each bucket the greatest version."""
    latest = {b: [v for v in found if upto is None or v <= upto] for b, found in versions(spark, path).items()}
    paths = [f"{path}/version={found[-1]}/bucket={b}" for b, found in latest.items() if found]
    return spark.read.parquet(*paths) if paths else None


def work_queue(events: DataFrame) -> DataFrame:
    """The state of each piece of work from its events (id, ts, state): last one wins; waiting ones in order of arrival, each once."""
    last = events.groupBy("id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.min("ts").alias("since"))
    return last.where(F.col("state").isin("queued", "rendering"))


def finished(query) -> None:
    """Run a query over what there is, and stop it."""
    query.awaitTermination()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Everything there is, in micro-batches, into files; a batch that is run again replaces its own.

    Of a ``complete`` stream the last batch is the table; of an ``append`` one all are. An ``update``
    stream's rows carry the number of their batch, as ``version``.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    finished(stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    found = _numbers(spark, path, "version=")
    if not found:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{path}/version={found[-1]}")
    every = spark.read.option("basePath", path).parquet(path)
    return every if mode == "update" else every.drop("version")
