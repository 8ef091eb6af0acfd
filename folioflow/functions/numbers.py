"""Numbers, times and dates as Catalyst expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column | str, places: int = 0) -> Column:
    """Rounding with halves upward, as in ``floor(x + 1/2)``."""
    k = 10.0**places
    return F.floor(_c(c) * k + 0.5) / k if places else F.floor(_c(c) + 0.5)


def half_even(c: Column | str, places: int) -> Column:
    """Rounding of the very binary value, exact halves to the even digit; an Arrow function, as decimals of the printed value round otherwise."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if pd.isna(v) or v in (float("inf"), float("-inf")) else round(v, places))

    return run(_c(c).cast("double"))


def falsy(c: Column | str, default) -> Column:
    """``default`` where the value is null, 0 or empty."""
    c = _c(c)
    return F.when(c.isNull() | (c.cast("string").isin("", "0", "0.0", "-0.0")), F.lit(default)).otherwise(c)


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Between two bounds; what isn't a number counts as the lower one."""
    return F.least(F.greatest(F.nanvl(F.coalesce(_c(c).cast("double"), F.lit(float(low))), F.lit(float(low))), F.lit(float(low))), F.lit(float(high)))


def pace(c: Column | str) -> Column:
    """A speaking pace within what voices take."""
    return clamp(c, 0.8, 1.2)


def _whole(c: Column | str) -> Column:
    return F.greatest(F.floor(F.coalesce(F.nanvl(_c(c).cast("double"), F.lit(0.0)), F.lit(0.0))), F.lit(0)).cast("long")


def clock(c: Column | str) -> Column:
    """``h:mm:ss`` or ``m:ss``."""
    s = _whole(c)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def long_time(c: Column | str) -> Column:
    """Hours and minutes in words; less than a minute is told apart from nothing."""
    x = _c(c).cast("double")
    m = half_up(F.greatest(x, F.lit(0.0)) / 60).cast("long")
    h = F.floor(m / 60)
    some = F.when(h > 0, F.format_string("%d h %02d m", h, m % 60)).otherwise(F.format_string("%d m", m))
    return F.when(x.isNull() | F.isnan(x), "").when(m < 1, F.when(x > 0, "< 1 m").otherwise("0 m")).otherwise(some)


def short_time(c: Column | str) -> Column:
    """Minutes, or from an hour on as :func:`long_time`."""
    m = half_up(F.coalesce(_c(c).cast("double"), F.lit(0.0)) / 60).cast("long")
    return F.when(m < 60, F.format_string("%d min", m)).otherwise(long_time(c))


def grouped(c: Column | str) -> Column:
    """A whole number with marks at thousands."""
    return F.format_number(_c(c), 0)


def plural(n: Column | str, one: str, many: str) -> Column:
    """A number with its noun."""
    return F.concat(grouped(n), F.lit(" "), F.when(_c(n) == 1, one).otherwise(many))


def _one_place(x: Column) -> Column:
    """One decimal by whole numbers, so that engines agree."""
    tenths = F.floor(x * 10 + 0.5).cast("long")
    return F.format_string("%d.%d", F.floor(tenths / 10), tenths % 10)


def bytes_text(c: Column | str) -> Column:
    """Kilobytes, megabytes (one decimal below ten) or gigabytes."""
    n = F.coalesce(_c(c).cast("double"), F.lit(0.0))
    mb = n / 1048576
    kb = F.format_string("%d KB", F.greatest(half_up(n / 1024), F.lit(1)).cast("long"))
    return (
        F.when(n == 0, "0 MB")
        .when(mb < 1, kb)
        .when(mb < 10, F.concat(_one_place(mb), F.lit(" MB")))
        .when(mb < 1024, F.format_string("%d MB", half_up(mb).cast("long")))
        .otherwise(F.concat(_one_place(mb / 1024), F.lit(" GB")))
    )


def size_text(c: Column | str) -> Column:
    """Kilobytes, or megabytes with one decimal."""
    n = _c(c).cast("double")
    return F.when(F.coalesce(n, F.lit(0.0)) == 0, "").when(n < 1048576, F.format_string("%d KB", half_up(n / 1024).cast("long"))).otherwise(F.concat(_one_place(n / 1048576), F.lit(" MB")))


def pages_text(first: Column | str, last: Column | str) -> Column:
    """One page or a range."""
    a, b = _c(first), _c(last)
    one = F.coalesce(a, b)
    return F.when(one.isNull(), "").when(b > a, F.concat(F.lit("pages "), a.cast("string"), F.lit("–"), b.cast("string"))).otherwise(F.concat(F.lit("page "), one.cast("string")))


def greeting(hour: Column | str) -> Column:
    """By the hour of the day."""
    h = _c(hour)
    return F.when(h < 5, "Good night").when(h < 12, "Good morning").when(h < 18, "Good afternoon").otherwise("Good evening")


def progress_percent(furthest: Column, total: Column, finished: Column) -> Column:
    """100 once finished, else rounded and at most 99."""
    share = half_up(F.coalesce(furthest, F.lit(0.0)) / F.nullif(total, F.lit(0.0)) * 100)
    return F.when(finished, F.lit(100)).otherwise(F.least(F.greatest(F.coalesce(share, F.lit(0)), F.lit(0)), F.lit(99))).cast("int")


def goal_ring(listen: Column, goal_minutes: Column) -> Column:
    """The filled share of the day's goal, and the minutes left."""
    goal = goal_minutes * 60
    left = F.greatest(F.ceil((goal - listen) / 60.0), F.lit(0)).cast("long")
    return F.struct(F.least(listen / goal, F.lit(1.0)).alias("share"), left.alias("minutes_left"))


def voice_rate(sample_seconds: Column, estimate: Column) -> Column:
    """How much slower a voice speaks than estimated."""
    return sample_seconds / F.greatest(estimate, F.lit(0.5))


def chunk_limit(cap: float, pace_: Column, rate: Column) -> Column:
    return F.lit(cap) * pace_ / rate


def chunk_target(estimate: Column, rate: Column, pace_: Column, budget: float = 30.0) -> Column:
    return F.least(F.greatest(estimate * rate / pace_, F.lit(0.5)), F.lit(budget))


def voice_seed(seed: Column, take: Column) -> Column:
    """Another seed for every take."""
    return seed + 7919 * (take - 1)


def sleep_left(until: Column, now: Column) -> Column:
    """Seconds until sleep."""
    return F.greatest(until - now, F.lit(0.0))


def percent_floor(done: Column, total: Column) -> Column:
    """Whole percent, never more than is done."""
    return F.coalesce(F.floor(100.0 * done / F.nullif(total, F.lit(0.0))), F.lit(0)).cast("int")


def render_estimate(estimate: Column, pace_: Column, factor: Column) -> Column:
    """The audio's length, and how long it takes to make; unknown without a factor."""
    length = estimate / F.coalesce(F.nullif(pace_, F.lit(0.0)), F.lit(1.0))
    return F.struct(length.alias("length"), (length / F.nullif(factor, F.lit(0.0))).alias("ready_in"))


def date_key(ts: Column, zone: Column | str = "UTC") -> Column:
    """The day in the device's own calendar."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone if isinstance(zone, str) else zone))


def month_key(day: Column | str) -> Column:
    """``yyyy-MM``."""
    return F.date_format(_c(day), "yyyy-MM")


def days_in_month(day: Column | str) -> Column:
    return F.dayofmonth(F.last_day(_c(day)))


def monday_first(day: Column | str) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(_c(day))


def relative_day(day: Column, today: Column) -> Column:
    """Today, yesterday, or the date in words."""
    return F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").otherwise(F.date_format(day, "EEEE, d MMMM"))


def shifted_month(month: Column, by: int, latest: Column) -> Column:
    """Another month, but none after the latest."""
    return F.least(F.add_months(F.trunc(month, "month"), by), F.trunc(latest, "month")).cast("date")


def valid_day(key: Column | str) -> Column:
    """The date of a key; null where it has another form or isn't a day of the calendar."""
    return F.when(_c(key).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(_c(key), "yyyy-MM-dd"))
