"""Listening analytics: days merged across devices, levels, streaks, months, milestones.

Inputs are facts: ``days`` (account, day, listen, app), ``day_books`` (account, day, book_id, seconds),
``device_books`` (account, doc_order, book_id, title, author, furthest, total, finished_at,
last_played_at). All operators are built-in expressions and window functions over an account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .sequences import before, island

# Seconds of an active day and of a day of a streak; the trailing window; the default goal.
ACTIVE, STREAK, TRAILING, LEAST_DAYS, GOAL = 60, 300, 60, 3, 30
#: A book counts as finished from this share on.
FINISHED = 0.98


def merge_days(ticks: DataFrame, by: str = "account") -> DataFrame:
    """Seconds listened and in the app per day, summed over devices. ``ticks`` has kind, day, seconds."""
    return ticks.groupBy(by, "day").agg(
        F.sum(F.when(F.col("kind") != "click", F.col("seconds")).otherwise(0.0)).alias("listen"),
        F.sum(F.when(F.col("kind") == "click", F.col("seconds")).otherwise(0.0)).alias("app"),
    )


def merge_day_books(ticks: DataFrame, by: str = "account") -> DataFrame:
    """Seconds per day and book."""
    return ticks.where("kind != 'click'").groupBy(by, "day", "book_id").agg(F.sum("seconds").alias("seconds"))


def merge_books(device_books: DataFrame, by: str = "account") -> DataFrame:
    """One row per book: greatest position, first finish, the first title that isn't empty."""

    def first_of(c: str) -> Column:
        return F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.col(c) != "", F.col("doc_order")))

    return device_books.groupBy(by, "book_id").agg(
        F.max("furthest").alias("furthest"),
        F.max("total").alias("total"),
        F.min("finished_at").alias("finished_at"),
        F.max("last_played_at").alias("last_played_at"),
        first_of("title").alias("title"),
        first_of("author").alias("author"),
    )


def latest_goal(documents: DataFrame, by: str = "account") -> DataFrame:
    """The goal of the document that changed last; of equal ones the first; 0 and null don't count."""
    told = F.when(F.coalesce(F.col("goal_minutes"), F.lit(0)) != 0, F.struct(F.coalesce("updated_at", F.lit(0)).alias("u"), (-F.col("doc_order")).alias("o")))
    return documents.groupBy(by).agg(F.coalesce(F.max_by("goal_minutes", told), F.lit(GOAL)).alias("goal_minutes"))


def live_documents(own: DataFrame, remote: DataFrame, device: str) -> DataFrame:
    """A device's own live document before all others; its remote copy is left out."""
    return own.withColumn("doc_order", F.lit(0)).unionByName(remote.where(F.col("device") != device).withColumn("doc_order", F.lit(1)))


def usual_days(days: DataFrame, by: str = "account", goal_minutes: int = GOAL) -> DataFrame:
    """``days`` with usual, the median of the active days among the 60 days before; else the goal."""
    n = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(by).orderBy(n).rangeBetween(-TRAILING, -1)
    active = F.when(F.col("listen") >= ACTIVE, F.col("listen"))
    enough = F.count(active).over(w) >= LEAST_DAYS
    return days.withColumn("usual", F.when(enough, F.percentile(active, F.lit(0.5)).over(w)).otherwise(F.lit(60.0 * goal_minutes)))


def level(listen: Column, usual: Column) -> Column:
    """0 to 4 by the day's share of the usual day."""
    share = listen / F.when(F.coalesce(usual, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(usual)
    low = F.isnan(F.coalesce(listen, F.lit(0.0))) | (F.coalesce(listen, F.lit(0.0)) < ACTIVE)
    return F.when(low, 0).when(share < 0.5, 1).when(share < 1, 2).when(share < 1.5, 3).otherwise(4)


def streak_days(days: DataFrame, by: str = "account") -> DataFrame:
    """Islands of consecutive streak days: first_day, last_day, length."""
    ok = days.where(F.col("listen") >= STREAK)
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(by).orderBy("day"))) != 1
    runs = ok.withColumn("_gap", F.coalesce(gap, F.lit(True))).withColumn("_run", island(F.col("_gap"), [by], ["day"]))
    return runs.groupBy(by, "_run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("length")).drop("_run")


def streaks(days: DataFrame, today: Column, by: str = "account") -> DataFrame:
    """Current (up to today, or to yesterday if today is short) and longest streak."""
    runs = streak_days(days, by)
    upto = F.datediff(F.least(F.col("last_day"), today), F.col("first_day")) + 1
    holds_today = F.col("first_day").isNotNull() & today.between(F.col("first_day"), F.col("last_day"))
    holds_before = F.date_sub(today, 1).between(F.col("first_day"), F.col("last_day"))
    current = F.coalesce(F.max(F.when(holds_today, upto)), F.max(F.when(holds_before, upto)), F.lit(0))
    found = runs.groupBy(by).agg(current.cast("long").alias("current"), F.max("length").alias("longest"), F.coalesce(F.bool_or(holds_today), F.lit(False)).alias("today"))
    every = days.select(by).distinct()
    return every.join(found, by, "left").select(by, F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("today", F.lit(False)).alias("today"))


def month_totals(days: DataFrame, by: str = "account", until_day: int | None = None) -> DataFrame:
    """By month: listened, in the app, active days; up to a day of the month if given."""
    chosen = days if until_day is None else days.where(F.dayofmonth("day") <= until_day)
    return chosen.groupBy(by, F.trunc("day", "month").alias("month")).agg(
        F.sum("listen").alias("listen"), F.sum("app").alias("app"), F.count_if(F.col("listen") >= ACTIVE).alias("active")
    )


def month_delta(days: DataFrame, by: str = "account", until_day: int | None = None) -> DataFrame:
    """Percent more or less than the month before, over as many days of it as have gone by."""
    day = F.dayofmonth("day")
    until = F.lit(until_day if until_day is not None else 31)
    this = days.where(day <= until).groupBy(by, F.trunc("day", "month").alias("month")).agg(F.sum("listen").alias("listen"))
    moved = this.select(by, F.add_months("month", 1).cast("date").alias("month"), F.col("listen").alias("previous"))
    joined = this.join(moved, [by, "month"], "left")
    share = (F.col("listen") - F.col("previous")) / F.col("previous") * 100
    return joined.withColumn("delta_percent", F.when(F.col("previous") >= ACTIVE, half_up(share).cast("long")))


def total_listened(days: DataFrame, by: str = "account") -> DataFrame:
    """All-time seconds, and whether there was an active day."""
    return days.groupBy(by).agg(F.sum("listen").alias("listen"), F.bool_or(F.col("listen") >= ACTIVE).alias("any_listening"))


def milestones(days: DataFrame, finished: DataFrame, today: Column, by: str = "account") -> DataFrame:
    """Which milestones are reached. ``finished`` has the accounts' finished books."""
    totals = total_listened(days, by).join(streaks(days, today, by), by)
    books = finished.groupBy(by).agg(F.count(F.lit(1)).alias("_books"))
    longest = F.greatest("longest", "current")
    return totals.join(books, by, "left").select(
        by,
        (F.coalesce("_books", F.lit(0)) > 0).alias("first_book"),
        (longest >= 7).alias("week_streak"),
        (longest >= 30).alias("month_streak"),
        (F.col("listen") >= 36_000).alias("ten_hours"),
        (F.col("listen") >= 180_000).alias("fifty_hours"),
        F.greatest(F.lit(0.0), 36_000 - F.col("listen")).alias("to_ten_hours"),
    )


def finished_in(books: DataFrame, month: Column, by: str = "account") -> DataFrame:
    """The month's finished books, numbered oldest first."""
    done = books.where(F.trunc("finished_at", "month") == month)
    w = Window.partitionBy(by).orderBy("finished_at", "book_id")
    return done.select(by, "book_id", "finished_at", F.row_number().over(w).cast("long").alias("position"))


def default_day(days: DataFrame, by: str = "account") -> DataFrame:
    """By month: its latest active day, else the first of the month."""
    latest = F.max(F.when(F.col("listen") >= ACTIVE, F.col("day")))
    return days.groupBy(by, F.trunc("day", "month").alias("month")).agg(latest.alias("_latest")).select(by, "month", F.coalesce("_latest", "month").alias("day"))


def books_on(day_books: DataFrame, books: DataFrame, by: str = "account") -> DataFrame:
    """The books of each day, most listened first."""
    known = books.select(by, "book_id", "title", "finished_at")
    w = Window.partitionBy(by, "day").orderBy(F.desc("seconds"), "book_id")
    return (
        day_books.where("seconds >= 1")
        .join(known, [by, "book_id"], "left")
        .select(
            by, "day", "book_id", "seconds",
            F.coalesce(F.nullif("title", F.lit("")), F.lit("A deleted book")).alias("title"),
            F.coalesce(F.col("finished_at") == F.col("day"), F.lit(False)).alias("finished"),
            F.row_number().over(w).cast("long").alias("position"),
        )
    )


def finished_not_listened(day_books: DataFrame, books: DataFrame, by: str = "account") -> DataFrame:
    """Books finished on a day on which they weren't listened to."""
    done = books.where(F.col("finished_at").isNotNull()).select(by, "book_id", F.col("finished_at").alias("day"))
    return done.join(day_books.where("seconds >= 1"), [by, "book_id", "day"], "left_anti")


def month_calendar(days: DataFrame, today: Column, by: str = "account") -> DataFrame:
    """Every day of the months that have any, with the grid's lead before the first, Monday first."""
    months = days.select(by, F.trunc("day", "month").alias("month")).distinct()
    every = months.withColumn("day", F.explode(F.sequence("month", F.last_day("month"))))
    return every.join(days.select(by, "day", "listen"), [by, "day"], "left").select(
        by, "month", "day",
        F.coalesce("listen", F.lit(0.0)).alias("listen"),
        F.weekday("month").cast("int").alias("lead"),
        (F.col("day") > today).alias("future"),
    )


def first_finished(positions: DataFrame, by: str = "account") -> DataFrame:
    """The first day on which a ready book's furthest position reached its share of the total."""
    w = Window.partitionBy(by, "book_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = positions.withColumn("_f", F.max("furthest").over(w)).withColumn("_t", F.max("total").over(w))
    return running.groupBy(by, "book_id").agg(
        F.max("furthest").alias("furthest"),
        F.max("total").alias("total"),
        F.min(F.when(F.col("ready") & (F.col("_t") > 0) & (F.col("_f") >= FINISHED * F.col("_t")), F.col("day"))).alias("finished_at"),
    )


def listened(ticks: DataFrame, session: list[str], longest: float = 30.0) -> DataFrame:
    """Seconds listened between ticks of media time; a reset, a seek or a long gap gives none.

    ``ticks`` has ts, media_time, rate, reset.
    """
    w = Window.partitionBy(*session).orderBy("ts")
    step = F.col("media_time") - F.lag(F.when(~F.col("reset"), F.col("media_time"))).over(w)
    good = ~F.col("reset") & (step > 0) & (step < longest)
    return ticks.withColumn("listened", F.when(good, step / F.when(F.coalesce(F.col("rate"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("rate"))).otherwise(F.lit(0.0)))


def in_app(ticks: DataFrame, session: list[str], longest: float = 10.0) -> DataFrame:
    """Seconds in the app between visible ticks, each gap capped. ``ticks`` has ts (timestamp), visible."""
    w = Window.partitionBy(*session).orderBy("ts")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.when(F.col("visible"), F.unix_micros(F.col("ts").cast("timestamp")))).over(w)) / 1e6
    return ticks.withColumn("in_app", F.when(F.col("visible"), F.least(F.coalesce(gap, F.lit(0.0)), F.lit(float(longest)))).otherwise(F.lit(0.0)))


def compact(documents: DataFrame, today: Column, keep_days: int = 366) -> DataFrame:
    """Per-book detail of days long gone is dropped; ``books`` is a map column."""
    return documents.withColumn("books", F.when(F.col("day") < F.date_sub(today, keep_days), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(F.col("books")))


def book_progress(total_ready: Column, merged_total: Column, ready: Column) -> Column:
    """A book's length, by its own reckoning first where it is ready, else by the devices'."""
    own, other = F.nullif(total_ready, F.lit(0.0)), F.nullif(merged_total, F.lit(0.0))
    return F.when(ready, F.coalesce(own, other)).otherwise(F.coalesce(other, own))


def running_listened(day_books: DataFrame, by: str = "account") -> DataFrame:
    """Seconds of a book before each day, rounded once at the end."""
    return day_books.withColumn("before", before(F.col("seconds"), [by, "book_id"], ["day"]))
