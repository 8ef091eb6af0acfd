"""Operators on ordered rows that SQL has no name for: as-of joins, islands, folds into bins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_at: str,
    right_at: str,
    take: Sequence[str],
    tolerance: float = 0.0,
    first_if_none: bool = False,
) -> DataFrame:
    """Every left row with the columns ``take`` of the last right row at or before ``left_at + tolerance``.

    One union, one shuffle by ``by`` and one sort, whatever the sizes; no pair of rows is made. With
    ``first_if_none`` a left row before all right rows takes the first. Of right rows at one point the
    last by ``take`` counts. Rows of a null key match null keys.
    """
    key = F.struct(*take)
    none = F.lit(None)
    kind = right.select(key.alias("k")).schema["k"].dataType
    row = F.struct(*left.columns)
    row_kind = left.select(row.alias("r")).schema["r"].dataType
    a = left.select(*by, F.col(left_at).cast("double").alias("_at"), F.lit(1).alias("_side"), row.alias("_row"), none.cast(kind).alias("_found"))
    b = right.where(F.col(right_at).isNotNull()).select(
        *by, (F.col(right_at).cast("double") - F.lit(float(tolerance))).alias("_at"), F.lit(0).alias("_side"), none.cast(row_kind).alias("_row"), key.alias("_found")
    )
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_found")
    found = F.last("_found", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if first_if_none:
        found = F.coalesce(found, F.first("_found", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return a.unionByName(b).withColumn("_found", found).where("_side = 1").select("_row.*", *[F.col(f"_found.{t}").alias(t) for t in take])


def island(changed: Column, partition: Sequence[str], order: Sequence[str | Column]) -> Column:
    """A number that goes up where ``changed`` holds: the row's run within its partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def before(value: Column, partition: Sequence[str], order: Sequence[str | Column]) -> Column:
    """The sum of ``value`` over the rows before this one, 0 for the first."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def scanned(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, start, step: Callable, kind: str, name: str) -> DataFrame:
    """``df`` with what a fold says of every row: ``step(state, value) -> (state, said)`` goes over each key's rows in order, from ``start``.

    Rows are dealt by key and sorted, and stream through a task; between rows it holds the state alone, so
    a key of any length is no more than its rows' time.
    """
    told = StructType([*df.schema.fields, StructField(name, df.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType)])
    schema = to_arrow_schema(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for b in batches:
            said = []
            for k, v in zip(zip(*[b[c].to_pylist() for c in by]), b["_value"].to_pylist()):
                if k != key:
                    key, state = k, start
                state, out = step(state, v)
                said.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(said, schema.field(name).type)], schema=schema)

    rows = df.withColumn("_value", value).repartition(*by).sortWithinPartitions(*by, *order)
    return rows.mapInArrow(run, told)


def _filling(limit: float, close_after: bool) -> Callable:
    """A step of :func:`scanned`: state is the bin, what is in it, and whether that is nothing."""

    def step(state: tuple[int, float, bool], cost: float) -> tuple[tuple[int, float, bool], int]:
        now, total, empty = state
        if not close_after and not empty and total + cost > limit:
            now, total = now + 1, 0.0
        total += cost
        if close_after and total >= limit:
            return (now + 1, 0.0, True), now
        return (now, total, False), now

    return step


def bins(costs: Column, limit: float, close_after: bool) -> Column:
    """The bin of every element of an array of costs, as :func:`binned` gives rows theirs."""
    step = _filling(limit, close_after)

    @F.pandas_udf("array<int>")
    def run(many: pd.Series) -> pd.Series:
        out = []
        for each in many:
            state, told = (0, 0.0, True), []
            for c in each:
                state, k = step(state, c)
                told.append(k)
            out.append(told)
        return pd.Series(out)

    return run(costs)


def binned(df: DataFrame, partition: Sequence[str], order: Sequence[str], cost: Column, limit: float, close_after: bool, name: str = "bin") -> DataFrame:
    """``df`` with the bin of every row among its partition's rows in order.

    A bin closes before it would go over the limit (a row that does so alone has a bin to itself), or with
    ``close_after`` once it has reached the limit.
    """
    return scanned(df, partition, order, cost.cast("double"), (0, 0.0, True), _filling(limit, close_after), "int", name)


def throttled(events: DataFrame, by: Sequence[str], at: str, order: Sequence[str], every: float) -> DataFrame:
    """The events that a leading-edge throttle lets through: of each key the first, and then the next that is ``every`` seconds or more after the last."""

    def step(last: int | None, now: int) -> tuple[int | None, bool]:
        due = last is None or now - last >= every * 1_000_000
        return (now if due else last), due

    return scanned(events, by, [at, *order], F.unix_micros(F.col(at).cast("timestamp")), None, step, "boolean", "_due").where("_due").drop("_due")


def smoothed(values: Column, keep: float = 0.9) -> Column:
    """The moving average of an array; the first positive sample starts it, others that aren't positive don't count."""
    none = F.lit(None).cast("double")
    return F.aggregate(values, none, lambda a, v: F.when(F.coalesce(v, F.lit(0.0)) <= 0, a).when(a.isNull(), v.cast("double")).otherwise(a * keep + v * (1 - keep)))


def when_first(condition: Column, value: Column) -> Column:
    """An aggregate: the least value among the rows where a condition holds."""
    return F.min(F.when(condition, value))


Transform = Callable[[DataFrame], DataFrame]


def applied(df: DataFrame, *steps: Transform) -> DataFrame:
    """user functions from rows to rows, one after the other."""
    for step in steps:
        df = df.transform(step)
    return df


@dataclass(frozen=True)
class Aggregate:
    """a user's aggregate. ``buffer`` (DDL) is what it keeps; ``reduce`` takes many values into it, ``merge`` puts two together, ``finish`` makes the result of ``kind``."""

    buffer: str
    zero: tuple
    reduce: Callable[[tuple, pd.Series], tuple]
    merge: Callable[[tuple, tuple], tuple]
    finish: Callable[[tuple], object]
    kind: str = "double"


def aggregated(df: DataFrame, by: Sequence[str], value: Column, how: Aggregate, name: str = "value", held: int = 10_000) -> DataFrame:
    """``by`` and the aggregate of each group.

    Every task reduces its own rows to one buffer a key, of up to ``held`` keys at a time, and only buffers are
    shuffled; they are merged as they stream by, sorted by key. So a key may hold any share of the rows, and
    no group's values are gathered.
    """
    keys = StructType([df.schema[c] for c in by])
    buffer = StructType.fromDDL(how.buffer)
    partial = StructType([*keys, StructField("_buffer", buffer)])
    slim = df.select(*by, value.alias("_value"))
    schema, names = to_arrow_schema(partial), buffer.fieldNames()
    result = StructType([*keys, *StructType.fromDDL(f"x {how.kind}")])
    out_schema = to_arrow_schema(result).set(len(by), pa.field(name, to_arrow_schema(result).field(len(by)).type))

    def rows_of(found: dict[tuple, tuple]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in found], schema.field(i).type) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([dict(zip(names, b)) for b in found.values()], schema.field(len(by)).type)], schema=schema)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}
        for b in batches:
            places: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[b[c].to_pylist() for c in by])):
                places.setdefault(k, []).append(i)
            values = b["_value"].to_pandas()
            for k, at in places.items():
                found[k] = how.reduce(found.get(k, how.zero), values.iloc[at])
            if len(found) >= held:
                yield rows_of(found)
                found = {}
        if found:
            yield rows_of(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for b in batches:
            done: list[tuple] = []
            for k, more in zip(zip(*[b[c].to_pylist() for c in by]), b["_buffer"].to_pylist()):
                more = tuple(more[n] for n in names)
                if k == key:
                    now = how.merge(now, more)
                    continue
                if key is not None:
                    done.append((*key, how.finish(now)))
                key, now = k, more
            yield said(done)
        if key is not None:
            yield said([(*key, how.finish(now))])

    def said(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(out_schema)], schema=out_schema)

    buffers = slim.mapInArrow(reduce, partial).repartition(*by).sortWithinPartitions(*by)
    return buffers.mapInArrow(merge, StructType([*keys, StructField(name, result[len(by)].dataType)]))


def user_aggregate(f: Callable[[pd.Series], float], kind: str = "double") -> Callable[[Column], Column]:
    """a user's function from a group's values to one as an aggregate; a group's values are held at a time."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> float:
        return f(values)

    return run
