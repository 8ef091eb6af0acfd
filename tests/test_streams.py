"""Folds over sorted rows, user aggregates, exact throttles, syncing with a timer, tables replaced by bucket."""

import datetime
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import sequences as Q
from folioflow.streaming import listening as R

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain_bins(costs, limit, after):
    out, held, now = [], 0.0, 0
    for k, c in enumerate(costs):
        if not after and k and out[-1] == now and held + c > limit:
            now, held = now + 1, 0.0
        out.append(now)
        held += c
        if after and held >= limit:
            now, held = now + 1, 0.0
    return out


@pytest.mark.parametrize("after", [False, True])
def test_bins_of_rows(spark, after):
    """Of keys with nulls among them, in any order, over several partitions."""
    draw = random.Random(1)
    rows = [(b, k, float(draw.choice([0, 3, 10, 29.5, 30, 45]))) for b in (None, 0, 1, 2, "x") for k in range(draw.randint(1, 60)) if b != "x"]
    draw.shuffle(rows)
    found = Q.binned(spark.createDataFrame(rows, "b long, k long, c double").repartition(5), ["b"], ["k"], F.col("c"), 30.0, after).collect()
    for b in (None, 0, 1, 2):
        mine = sorted((r.k, r.c, r.bin) for r in found if r.b == b)
        assert [x[2] for x in mine] == plain_bins([x[1] for x in mine], 30.0, after)
    assert len(found) == len(rows) and Q.binned(spark.createDataFrame([], "b long, k long, c double"), ["b"], ["k"], F.col("c"), 30.0, after).count() == 0


SPREAD = Q.Aggregate(
    "n long, total double, squares double", (0, 0.0, 0.0), lambda b, v: (b[0] + len(v), b[1] + float(v.sum()), b[2] + float((v**2).sum())), lambda a, b: tuple(x + y for x, y in zip(a, b)),
    lambda b: b[2] / b[0] - (b[1] / b[0]) ** 2,
)


@pytest.mark.parametrize("held", [1, 10_000])
def test_user_aggregates(spark, held):
    """A key with nine rows of ten, null keys, two key columns; buffers that are passed on early."""
    draw = random.Random(6)
    rows = [("hot" if draw.random() < 0.9 else draw.choice(["a", "b", None]), draw.choice([1, None]), draw.random()) for _ in range(3_000)]
    found = {(r.x, r.y): r.spread for r in Q.aggregated(spark.createDataFrame(rows, "x string, y int, v double").repartition(6), ["x", "y"], F.col("v"), SPREAD, "spread", held).collect()}
    groups = {k: [v for x, y, v in rows if (x, y) == k] for k in {r[:2] for r in rows}}
    assert found == {k: pytest.approx(statistics.pvariance(v)) for k, v in groups.items()}
    assert Q.aggregated(spark.createDataFrame([], "x string, v double"), ["x"], F.col("v"), SPREAD).count() == 0


def test_throttles_agree(spark, tmp_path):
    """Two events close to each other over a window's edge give one; rows of one time go by their id."""
    rows = [(1, 0, at(1.9)), (1, 1, at(2.0)), (1, 2, at(3.9)), (1, 3, at(3.95)), (1, 4, at(9)), (2, 5, at(0)), (2, 6, at(0)), (2, 7, at(2))]
    df = spark.createDataFrame(rows, "device long, event_id long, ts timestamp")
    assert sorted(r.event_id for r in Q.throttled(df, ["device"], "ts", ["event_id"], 2).collect()) == [0, 2, 4, 5, 7]
    for k, part in enumerate((df.where("ts < '2024-01-01 00:00:03.92'"), df.where("ts >= '2024-01-01 00:00:03.92'"))):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        found = R.run_to_table(R.throttled_exactly(R.read_ticks(spark, f"{tmp_path}/in", df.schema), "device", 2), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    assert sorted(r.event_id for r in found.collect()) == [0, 2, 4, 5, 7]


def test_documents_are_sent_again(spark, tmp_path):
    """At most once a minute unless forced; what the server refuses is sent again; a timer sends what is left."""
    rows = [
        (1, 0, at(0), True, False), (1, 1, at(10), True, False), (1, 2, at(20), False, False), (1, 3, at(30), True, True), (1, 4, at(100), True, False), (1, 5, at(101), False, False),
        (2, 6, at(0), False, True), (2, 7, at(5), True, False), (2, 8, at(400), False, False), (3, 9, at(1000), True, False),
    ]
    df = spark.createDataFrame(rows, "device long, event_id long, ts timestamp, changed boolean, forced boolean")
    down = {(2, 5), (2, 65), (1, 100)}
    start = int(START.timestamp())
    put = lambda device, when, doc: (device, when // 1_000_000 - start) not in down
    for part in (df.where("event_id in (0, 1, 2, 3, 6, 7)"), df.where("event_id in (4, 5)"), df.where("event_id in (8, 9)")):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        found = R.run_to_table(R.synced(R.read_ticks(spark, f"{tmp_path}/in", df.schema), put), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    told = sorted((r.device, r.at // 1_000_000 - start, r.doc, r.ok) for r in found.collect())
    assert told == [
        (1, 0, 0, True), (1, 30, 3, True), (1, 100, 4, False), (1, 160, 4, True),
        (2, 5, 7, False), (2, 65, 7, False), (2, 125, 7, True), (3, 1000, 9, True),
    ]


def test_tables_are_replaced_by_bucket(spark, tmp_path):
    """A batch writes the buckets of its keys alone, a second time the same; older versions go."""
    path = f"file://{tmp_path}/latest"
    write = R.upsert_sink(path, ["key"], ["ts"], buckets=8)
    kind = "key string, ts long"
    now = {}
    for number in range(6):
        rows = [(f"k{k}", 10 * number + k) for k in range(number, number + 3)]
        for _ in range(2):
            write(spark.createDataFrame(rows, kind), number)
        now |= dict(rows)
        assert {r.key: r.ts for r in R.read_version(spark, path).collect()} == now
    held = R.versions(spark, path)
    assert all(len(v) <= 2 for v in held.values()) and len({v[-1] for v in held.values()}) > 1
    write(spark.createDataFrame([("k7", 1)], kind), 6)  # older than what is there
    assert {r.key: r.ts for r in R.read_version(spark, path).collect()} == now
    assert R.read_version(spark, f"file://{tmp_path}/none") is None


def test_bins_of_arrays(spark):
    costs = [float(x) for x in np.random.default_rng(0).integers(0, 40, 50)]
    for after in (False, True):
        found = spark.createDataFrame([(costs,)], "c array<double>").select(Q.bins(F.col("c"), 30.0, after).alias("b")).first().b
        assert found == plain_bins(costs, 30.0, after)
