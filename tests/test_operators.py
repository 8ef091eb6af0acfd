"""Operators on small fixtures."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import listening as L
from folioflow.operators import positions as P
from folioflow.operators import sequences as S
from folioflow.operators import signals as A
from folioflow.operators import structure as D
from folioflow.sources import documents as J
from folioflow.streaming import listening as R


def test_asof(spark):
    left = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, 1.0), (None, 5.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 2.04, "b"), (None, 4.0, "n")], "k int, at double, v string")
    found = {(r.k, r.t): r.v for r in S.asof_join(left, right, ["k"], "t", "at", ["v"], 0.05, first_if_none=True).collect()}
    assert found == {(1, 0.5): "a", (1, 2.0): "b", (2, 1.0): None, (None, 5.0): "n"}


@pytest.mark.parametrize("after, expected", [(False, [0, 0, 1, 2, 3]), (True, [0, 0, 0, 1, 2])])
def test_bins(spark, after, expected):
    df = spark.range(1).select(S.bins(F.array(*[F.lit(x) for x in (10.0, 20.0, 5.0, 40.0, 1.0)]), 30.0, after).alias("b"))
    found = df.first()["b"]
    assert found == ([0, 0, 1, 2, 3] if not after else [0, 0, 1, 1, 2])


def _days(spark, rows):
    return spark.createDataFrame([("x", datetime.date(2024, 1, d), s, 0.0) for d, s in rows], "account string, day date, listen double, app double")


def test_streaks(spark):
    days = _days(spark, [(1, 400.0), (2, 300.0), (3, 299.0), (5, 900.0), (6, 900.0), (7, 10.0)])
    on = lambda d: L.streaks(days, F.lit(f"2024-01-{d:02d}").cast("date")).first()
    assert (on(7).current, on(7).longest, on(7).today) == (2, 2, False)
    assert (on(6).current, on(6).today) == (2, True)
    assert on(9).current == 0


def test_usual_day_and_level(spark):
    days = _days(spark, [(1, 60.0), (2, 59.0), (3, 100.0), (4, 200.0), (5, 150.0)])
    usual = {r.day.day: r.usual for r in L.usual_days(days).collect()}
    assert usual == {1: 1800.0, 2: 1800.0, 3: 1800.0, 4: 1800.0, 5: 100.0}
    levels = spark.createDataFrame([(59.0,), (60.0,), (100.0,), (199.0,), (300.0,), (None,)], "x double").select(L.level(F.col("x"), F.lit(200.0)).alias("l"))
    assert [r.l for r in levels.collect()] == [0, 1, 2, 2, 4, 0]


def test_goal_ties_and_zeros(spark):
    docs = spark.createDataFrame([("x", 0, 5, 45), ("x", 1, 5, 60), ("x", 2, 9, 0), ("y", 0, 1, None)], "account string, doc_order int, updated_at int, goal_minutes int")
    assert {r.account: r.goal_minutes for r in L.latest_goal(docs).collect()} == {"x": 45, "y": 30}


def test_estimated_marks(spark):
    rows = [(1, 1, n, p, c, 402.0) for n, (p, c) in enumerate([(5, 100), (6, 100), (7, 200)])]
    found = P.estimated_marks(spark.createDataFrame(rows, "book_id int, chapter_no int, para_no int, page int, chars int, duration double")).collect()
    assert {r.page: r.t for r in found} == {5: 0.6, 6: 100.6, 7: 200.6}


def test_printed_page(spark):
    labels = spark.createDataFrame([(1, 1, "i"), (1, 2, "ii"), (1, 3, "1"), (1, 4, "2"), (1, 5, ""), (1, 6, "2")], "book_id int, pdf_page int, label string")
    asked = spark.createDataFrame([(1, "II"), (1, "2"), (1, "9"), (1, "0"), (1, "zz")], "book_id int, page string")
    assert {r.page: r.pdf_page for r in P.page_in_pdf(asked, labels).collect()} == {"II": 2, "2": 4, "9": 6, "0": 3, "zz": 1}


def test_stats_are_bounded(spark):
    doc = {"days": {"2024-01-01": {"listen": 999999, "app": -5, "books": {"b" * 50: 1.5}}, "bad-day": {"listen": 1}}, "books": {"b": {"title": "t" * 400, "furthest": 1e9, "finished_at": "never"}}, "goal_minutes": 0}
    raw = spark.createDataFrame([("device_01", json.dumps(doc)), ("no", json.dumps(doc)), ("device_02", "[broken")], "device string, body string")
    found = {r.device: r for r in J.parsed_stats(raw).collect()}
    one = found["device_01"]
    assert list(one.days) == ["2024-01-01"] and one.days["2024-01-01"].listen == 86400 and one.days["2024-01-01"].app == 0
    assert one.days["2024-01-01"].books == {"b" * 40: 1.5}
    assert len(one.books["b"].title) == 300 and one.books["b"].furthest == 1e7 and one.books["b"].finished_at is None
    assert one.goal_minutes == 30 and "no" not in found


def test_library_round_trip(spark, tmp_path):
    path = str(tmp_path / "books")
    book = {"id": "bk_00000001", "title": "T", "created_at": 5, "status": "ready", "chapters": [{"index": 0, "title": "One", "include": True}]}
    (tmp_path / "books").mkdir()
    (tmp_path / "books/a.json").write_text(json.dumps(book))
    (tmp_path / "books/b.json").write_text("{broken")
    books = J.read_books(spark, path)
    assert [(r.id, r.pace) for r in books.collect()] == [("bk_00000001", 1.0)]
    assert J.chapters_of(books).first().title == "One"
    assert J.book(books, "../etc").count() == 0
    changed = J.updated(books, books.select("id"), lambda b: b.withColumn("title", F.lit("U")))
    assert changed.first().title == "U"
    assert J.deleted(books, books).count() == 0


def test_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 text")
    (tmp_path / "b.pdf").write_bytes(b"no such thing")
    assert {r.path.rsplit("/", 1)[1]: r.verdict for r in J.uploads(spark, str(tmp_path)).collect()} == {"a.pdf": "ok", "b.pdf": "not a PDF"}


def _line(no, page, y, text, size=11.0, x=50.0, block=0):
    return (1, no, page, x, y, y + size, text, size, False, block, 600.0)


LINES = "book_id int, line_no int, page int, x0 double, y0 double, y1 double, text string, size double, bold boolean, block int, page_height double"


def test_overprint_keeps_one(spark):
    lines = spark.createDataFrame([_line(k, 0, 100.0, "same", x=50.0 + dx) for k, dx in enumerate((0, 1.5, 3.5, 4.8))], LINES)
    assert [r.line_no for r in D.without_overprint(lines).collect()] == [0]


def test_running_headers_go_and_paragraphs_join(spark):
    rows, no = [], 0
    for page in range(4):
        for y, text in ((20.0, f"My Book {page + 1}"), (200.0, "A line that goes on and"), (212.0, "ends here."), (580.0, str(page + 1))):
            rows.append(_line(no, page, y, text, block=0 if y in (200.0, 212.0) else no))
            no += 1
    lines = spark.createDataFrame(rows, LINES)
    sizes = D.body_size(lines)
    kept = D.without_running_lines(lines, sizes)
    assert kept.count() == 8
    assert {r.page: r.number for r in D.printed_numbers(lines).collect()} == {0: "1", 1: "2", 2: "3", 3: "4"}
    paras = D.paragraphs(kept, sizes)
    assert [r.text for r in paras.orderBy("para_no").collect()] == ["A line that goes on and ends here."] * 4


def _para(no, page, text, size=11.0, n=1):
    return (1, no, page, text, size, False, n, False)


PARAS = "book_id int, para_no int, page int, text string, size double, bold boolean, n_lines int, first_on_page boolean"


def test_merge_uses_what_was_merged(spark):
    paras = spark.createDataFrame([_para(1, 0, "It began"), _para(2, 1, "and went on"), _para(3, 2, "to the end."), _para(4, 2, "then more")], PARAS)
    found = D.merged_across_pages(paras).orderBy("para_no").collect()
    assert [r.text for r in found] == ["It began and went on to the end.", "then more"]
    assert [(b.offset, b.page) for b in found[0].breaks] == [(9, 1), (21, 2)]


def test_drop_caps(spark):
    paras = spark.createDataFrame([_para(1, 0, "W", 30.0), _para(2, 0, "e were there and we knew."), _para(3, 1, "I", 30.0), _para(4, 1, "am here. I am.")], PARAS)
    sizes = spark.createDataFrame([(1, 11.0)], "book_id int, body_size double")
    assert [r.text for r in D.drop_caps(paras, sizes).orderBy("para_no").collect()] == ["We were there and we knew.", "I am here. I am."]


def test_chapters_with_parts(spark):
    text = "word " * 50 + "end."
    rows = [("PART ONE", 20.0), ("Chapter 1", 18.0), ("The Storm", 14.0), (text, 11.0), ("Chapter 2", 18.0), (text, 11.0), ("PART TWO", 20.0), ("Chapter 1", 18.0), (text, 11.0), ("Chapter 2", 18.0), (text, 11.0)]
    pages = [0, 1, 1, 1, 5, 5, 9, 10, 10, 14, 14]
    paras = spark.createDataFrame([_para(k, p, t, s) for k, ((t, s), p) in enumerate(zip(rows, pages))], PARAS)
    sizes = spark.createDataFrame([(1, 11.0, 15)], "book_id int, body_size double, pages int")
    found = D.detect(paras, sizes)
    told = D.with_parts(D.chapter_extents(D.with_subtitles(found, paras, sizes.drop("pages")), paras)).orderBy("chapter_no").collect()
    assert [r.title for r in told] == ["Chapter 1: The Storm", "Chapter 2", "Chapter 1", "Chapter 2"]
    assert [r.part for r in told] == ["Part One", "Part One", "Part Two", "Part Two"]
    assert [r.spoken_title for r in told] == ["Part One. Chapter 1: The Storm", None, "Part Two. Chapter 1", None]
    assert {r.words for r in told} == {51} and {r.method for r in told} == {"headings"}


def test_large_type(spark):
    rows = []
    for k in range(4):
        rows += [_para(3 * k, 3 * k, f"Storm {'abcd'[k]}", 22.0), _para(3 * k + 1, 3 * k, "text of the body.", 11.0), _para(3 * k + 2, 3 * k + 1, "a note", 15.0)]
    paras = spark.createDataFrame(rows, PARAS)
    sizes = spark.createDataFrame([(1, 11.0, 12)], "book_id int, body_size double, pages int")
    found = D.detect(paras, sizes).orderBy("para_no").collect()
    assert [r.title for r in found] == ["Storm a", "Storm b", "Storm c", "Storm d"] and found[0].method == "fontsize"


def test_outline(spark):
    toc = [(1, 0, 1, "Book", 1), (1, 1, 2, "Part I", 1), (1, 2, 3, "One", 2), (1, 3, 4, "a section", 3), (1, 4, 3, "Two", 5), (1, 5, 2, "Part II", 9), (1, 6, 3, "Three", 9)]
    df = spark.createDataFrame([(*t, 20) for t in toc], "book_id long, ord long, level long, title string, page long, pages long")
    found = D.outline_levels(df).orderBy("ord").collect()
    assert [(r.title, r.part, [tuple(x) for x in r.sections]) for r in found] == [("One", "Part I", [("a section", 3)]), ("Two", "Part I", []), ("Three", "Part II", [])]


def test_page_labels(spark):
    pages = spark.createDataFrame([(1, p, None) for p in range(6)], "book_id int, page int, label string")
    printed = spark.createDataFrame([(1, 1, "11"), (1, 2, "12"), (1, 4, "14")], "book_id int, page int, number string")
    assert [r.label for r in D.page_labels(pages, printed).orderBy("page").collect()] == ["10", "11", "12", "13", "14", "15"]


def test_signals(spark):
    x = A.tones("one two three", 1.0, 200.0, 7)
    assert len(x) == A.RATE and 150 < A.pitch_of(x) < 250
    quiet = np.concatenate([A.silence(0.5), x, A.silence(0.5)])
    assert len(A.trimmed(quiet)) < len(quiet) - 0.7 * A.RATE
    assert abs(A.levelled(x)).max() <= A.PEAK + 1e-6
    back, rate = A.read_wav(A.write_wav(x))
    assert rate == A.RATE and np.abs(back - x).max() < 1e-3
    assert len(A.assembled([x, x], [0.5, 0.0])) == round((2.5 + A.LEAD_IN + A.TAIL) * A.RATE)
    df = spark.createDataFrame([("a bc", 0.5, 200.0, 1)], "t string, s double, p double, n int").select(A.speak("tones")("t", "s", "p", "n").alias("x"))
    assert df.select(F.size("x").alias("n"), A.wav_seconds(A.encode(F.col("x"))).alias("s")).first() == (12000, 0.5)


def test_levels_are_relative_to_the_loudest_frame():
    """A soft half counts only within 35 decibels of a loud one; a short last frame has no level; edges fade over a quarter at most."""
    loud, soft = np.full(48, 0.2, dtype=np.float32), np.full(48, 0.2 * 10 ** (-40 / 20), dtype=np.float32)
    x = np.concatenate([loud, soft, np.ones(5, dtype=np.float32)])
    assert A.frame_rms(x, 400) == pytest.approx([0.2] * 6 + [0.002] * 6, rel=1e-3)
    assert A.levelled(x[:96], 400) == pytest.approx(x[:96] * 10 ** (-19 / 20) / 0.2, rel=1e-4)
    assert (A.levelled(np.zeros(20, dtype=np.float32), 400) == 0).all() and len(A.trimmed(np.zeros(0), 400)) == 0
    out = A.trimmed(np.full(800, 0.5, dtype=np.float32), 1000)
    assert out[0] == out[-1] == 0 and (out[10:-10] == 0.5).all() and out[5] == pytest.approx(0.5 * 5 / 9)
    assert (A.trimmed(np.full(8, 0.5, dtype=np.float32), 1000) == [0, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0]).all()
    with pytest.raises(ValueError):
        import io
        import wave

        data = io.BytesIO()
        with wave.open(data, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(b"abc")
        A.read_wav(data.getvalue())


def test_books_without_headings_are_cut_by_time(spark):
    """Sections of twenty minutes; a paragraph that reaches the limit closes one."""
    text = "some words of plain text that nobody would call a heading at all, " * 200  # 14 minutes
    paras = spark.createDataFrame([_para(k, k, text.strip()) for k in range(5)], PARAS)
    sizes = spark.createDataFrame([(1, 11.0, 5)], "book_id int, body_size double, pages int")
    langs = spark.createDataFrame([(1, "en")], "book_id int, lang string")
    found = D.with_subtitles(D.detect(paras, sizes), paras, sizes.drop("pages"))
    told = D.chapters(found, paras, langs).orderBy("chapter_no").collect()
    assert [(r.method, r.title, r.spoken_title, r.first_page, r.last_page) for r in told] == [("sections", f"Section {k + 1}", f"Section {k + 1}", 2 * k, min(2 * k + 1, 4)) for k in range(3)]
    assert all(r.include for r in told) and [r.words for r in told] == [5200, 5200, 2600]
    assert told[0].est_seconds == pytest.approx(len(f"{text.strip()} {text.strip()}") * 0.0656 + 9 * 0.0656 / 0.3, abs=0.06)
    assert told[0].preview == text[:220]


def test_import(spark, tmp_path):
    """A book of lines becomes one of chapters; one without text is left out."""
    from folioflow.sources.imports import imported

    kind = "book_id long, line_no long, page long, x0 double, y0 double, y1 double, text string, size double, bold boolean, block long, page_height double"
    rows = []

    def line(book, page, y, text, size=11.0):
        rows.append((book, len(rows), page, 50.0, y, y + 12.0, text, size, False, int(y // 100), 800.0))

    for page, title in enumerate(["Chapter 1", "Chapter 2"]):
        line(1, page, 200.0, title, 18.0)
        for k in range(8):
            line(1, page, 300.0 + 14 * k, "the house was on the hill and they had not been there for many years of it" + ("." if k == 7 else ""))
    line(2, 0, 200.0, "scan 1")
    books, chapters, paras = imported(spark.createDataFrame(rows, kind), f"file://{tmp_path}")
    found = books.collect()
    assert [(r.book_id, r.language, r.warning, r.method, r.n_chapters, r.pages) for r in found] == [(1, "en", None, "headings", 2, 2)]
    assert [r.title for r in chapters.orderBy("chapter_no").collect()] == ["Chapter 1", "Chapter 2"] and found[0].words == 272
    assert {r.book_id for r in paras.collect()} == {1}


def test_opening_pages(spark):
    """What stands before the first heading is a chapter from 50 words on, and read from 400 on."""
    langs = spark.createDataFrame([(1, "en")], "book_id int, lang string")
    sizes = spark.createDataFrame([(1, 11.0, 9)], "book_id int, body_size double, pages int")
    body = "word " * 50 + "end."
    for n, include in ((49, None), (60, False), (400, True)):
        rows = [_para(0, 0, "front " * (n - 1) + "end."), _para(1, 1, "Chapter 1", 18.0), _para(2, 1, body), _para(3, 5, "Chapter 2", 18.0), _para(4, 5, body)]
        paras = spark.createDataFrame(rows, PARAS)
        told = D.chapters(D.detect(paras, sizes), paras, langs).orderBy("chapter_no").collect()
        assert [r.title for r in told] == (["Opening pages"] if n >= 50 else []) + ["Chapter 1", "Chapter 2"]
        assert include is None or (told[0].include == include and told[0].words == n and told[0].method == "headings")


def test_subtitles_follow_headings_only(spark):
    rows = []
    for k in range(3):
        rows += [_para(4 * k, 4 * k, f"Storm {'abc'[k]}", 22.0), _para(4 * k + 1, 4 * k, "The Long Night", 13.0), _para(4 * k + 2, 4 * k, "text of the body. " * 30), _para(4 * k + 3, 4 * k + 1, "more text.")]
    paras = spark.createDataFrame(rows, PARAS)
    sizes = spark.createDataFrame([(1, 11.0, 12)], "book_id int, body_size double, pages int")
    found = D.with_subtitles(D.detect(paras, sizes), paras, sizes.drop("pages")).collect()
    assert {r.method for r in found} == {"fontsize"} and {r.title for r in found} == {"Storm a", "Storm b", "Storm c"}


def test_stream_state(spark, tmp_path):
    rows = [("e", datetime.datetime(2024, 1, 1, 0, k), k, v) for k, v in enumerate([2.0, -1.0, 4.0, 3.0])]
    stream = _in_batches(spark, tmp_path, rows, "engine string, ts timestamp, event_id long, factor double")
    found = R.run_to_table(R.realtime_factor(stream), f"{tmp_path}/out", f"{tmp_path}/state", "update").orderBy("version").collect()
    assert [r.factor for r in found] == pytest.approx([2.0, (2.0 * 0.9 + 0.4) * 0.9 + 0.3])


def _in_batches(spark, path, rows, kind, parts=2):
    n = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * n : (k + 1) * n], kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return R.read_ticks(spark, f"{path}/in", kind, files_per_batch=1)


def test_stream_positions_never_go_back(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, 7, at(1), 50.0, 100.0), (1, 7, at(2), 99.0, 100.0), (1, 7, at(3), 10.0, 100.0), (1, 7, at(4), 100.0, 100.0)]
    stream = _in_batches(spark, tmp_path, rows, "account long, book_id long, ts timestamp, furthest double, total double")
    told = stream.withColumns({"day": F.to_date("ts"), "ready": F.lit(True)})
    last = max(R.run_to_table(R.positions(told), f"{tmp_path}/out", f"{tmp_path}/state", "update").collect(), key=lambda r: r.version)
    assert (last.furthest, last.total, last.finished_at) == (100.0, 100.0, "2024-01-02")


def test_stream_app_time_caps_gaps(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 0, at(0), True), (1, 1, at(5), True), (1, 2, at(30), True), (1, 3, at(31), False), (1, 4, at(40), True), (1, 5, at(42), True)]
    stream = _in_batches(spark, tmp_path, rows, "device long, event_id long, ts timestamp, visible boolean", parts=3)
    found = R.run_to_table(R.app_time(stream), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    assert {r.event_id: r.in_app for r in found.collect()} == {0: 0.0, 1: 5.0, 2: 10.0, 3: 0.0, 4: 0.0, 5: 2.0}


def test_stream_throttle_and_upsert(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", k, at(k)) for k in range(6)]
    stream = _in_batches(spark, tmp_path, rows, "key string, event_id long, ts timestamp")
    found = R.run_to_table(R.throttled(stream, ["key"]), f"{tmp_path}/out", f"{tmp_path}/state", "complete")
    assert sorted(r.event_id for r in found.collect()) == [0, 2, 4]
    write = R.upsert_sink(f"{tmp_path}/latest", ["key"], ["ts"])
    first, second = (spark.createDataFrame(rows[a:b], "key string, event_id long, ts timestamp") for a, b in ((0, 3), (3, 6)))
    write(first, 0)
    write(second, 1)
    write(second, 1)
    assert R.read_version(spark, f"{tmp_path}/latest").first().event_id == 5 and R.read_version(spark, f"{tmp_path}/latest", 0).first().event_id == 2
