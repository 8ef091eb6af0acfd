"""Queries on small tables that the given ones don't hold: odd texts, large clips."""

import datetime
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folioflow.operators import signals as A
from folioflow.plans import ORACLES, QUERIES
from folioflow.plans import pdf as Q
from folioflow.streaming import listening as R

from .conftest import rows_of


def _agrees(spark, tmp_path, name, **tables):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    found = con.sql(ORACLES[name])
    rows = rows_of(df.columns, df.collect())
    assert rows == rows_of(found.columns, found.fetchall())
    return rows


DOCS = "doc_id long, text string, lang string, source string"


def test_clips_go_back_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD", 1000)
    sizes = []

    def said(text, seconds, pitch, seed):
        return np.full(round(seconds), seed, dtype=np.float32)

    A.register_engine("counted", said)
    batch = (pd.Series(["a"] * 30), pd.Series(range(30)) * 20.0, pd.Series([200.0] * 30), pd.Series(range(30)))
    for part in A.speak("counted").func(iter([batch])):
        sizes.append(sum(map(len, part)))
    assert sum(sizes) == 20 * 435 and max(sizes) < 1000 + 600 and len(sizes) > 5
    rows = spark.range(500).select("id", F.size(A.speak("counted")(F.lit("a"), F.col("id") % 7 * 100.0, F.lit(1.0), F.col("id").cast("int"))).alias("n"))
    assert all(r.n == r.id % 7 * 100 for r in rows.collect())


def test_seconds_of_texts_without_letters(spark, tmp_path):
    rows = [(k, t, "fr", "s") for k, t in enumerate(["É.", "É.", "Éé", "12345 67890 11", "Éaux.", "4", "", None, "x", "ÉÉÉÉÉÉ"])]
    assert len(_agrees(spark, tmp_path, "estimate_seconds", documents=(rows, DOCS))) == 10


def test_lines_that_begin_as_titles_do(spark, tmp_path):
    last = ["par", "Head", "hea", "Part 1", "para", "x"]
    rows = [(k, "\n".join(["one two three four"] * n + [t]), "fr", "s") for k, (n, t) in enumerate((n, t) for n in range(8, 29) for t in last)]
    assert _agrees(spark, tmp_path, "outlined_books", documents=(rows, DOCS))


def test_positions_are_held_by_groups_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "HELD_IN", 3)
    kind = "account long, book_id long, day date, furthest double, total double, ready boolean"
    day = lambda d: datetime.date(2024, 1, d)
    rnd = random.Random(5)
    big = 2**53 + 1
    rows = [(rnd.choice([1, 2, big, big + 1, None]), rnd.choice([7, 8, None]), day(d), float(rnd.randrange(100)), float(rnd.randrange(80, 110)), rnd.random() < 0.7) for d in range(1, 29) for _ in range(6)]
    rows = list({r[:3]: r for r in rows}.values())
    for k in range(4):
        spark.createDataFrame([r for r in rows if (r[2].day - 1) // 7 == k], kind).withColumn("ts", F.col("day").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = R.run_to_table(R.positions(R.read_ticks(spark, f"{tmp_path}/in", f"{kind}, ts timestamp")), f"{tmp_path}/out", f"{tmp_path}/state", "update")
    plain = {}
    for a, b, d, f, t, ready in sorted(rows, key=lambda r: r[2]):
        furthest, total, done = plain.get((a, b), (0.0, 0.0, None))
        furthest, total = max(furthest, f), max(total, t)
        plain[a, b] = (furthest, total, done or (str(d) if ready and furthest >= R.FINISHED * total else None))
    last = {}
    for r in sorted(found.collect(), key=lambda r: r.version):
        last[r.account, r.book_id] = (r.furthest, r.total, r.finished_at)
    assert last == plain and any(v[2] for v in plain.values())


def test_files_in_a_table_are_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "folder", lambda spark, label: f"{tmp_path}/{label}")
    rows = [(k, f"Heading {k}\n\nA line of print that is longer than a heading.", "en", "s") for k in range(40)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    told = QUERIES["pdf_books"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.pages, r.n_entries) for r in told) == [(k, 1, 1) for k in range(40)]
    assert len(list((tmp_path / "pdf").glob("part-*"))) < 10


def test_lines_of_print_keep_odd_texts(spark, tmp_path):
    odd = ["C H A P T E R   O N E", "a b c d", "one\ttwo", "\ttab first", "a\x01b\x1fc", "\x1c", "x\x1d", "\x0b", "\x0bvt\x0b", "\xa0", "\xa0nbsp\xa0", "soft\xadhyphen", "\xad", "zero\u200bwidth", "\u200b", "\ufb01ne"]
    odd += ["private \ue000 use", "\ue000", "thin\u2009blank", "\u3000wide\u3000", "\x85", "next\x85", "line\u2028", "\u4e2d\u6587 text", "\U0001f600 here", "\xe9", "1 2", "* *", "end\r", " \r ", "form\ffeed", "(a\\b)", "~>", "del\x7f", "\x00nul", "a  b   c"]
    rows = [(0, "\n".join(odd), "fr", "s"), (1, "\n".join(reversed(odd)), "fr", "s"), (-7, "\n".join(odd[:5]), "fr", "s"), (3, None, "fr", "s"), (4, "", "fr", "s")]
    rows += [(10 + k, "\n".join([t] * 13), "fr", "s") for k, t in enumerate(odd)]
    rng = random.Random(4)
    rows += [(100 + k, "\n".join("".join(rng.choice("ab. \t\r\f\x0b\x1e\x85\xa0\xad\u2009\u4e2d\ufb02") for _ in range(rng.randrange(40))) for _ in range(70)), "fr", "s") for k in range(10)]
    assert len(_agrees(spark, tmp_path, "pdf_lines", documents=(rows, DOCS))) > 800
