"""Document structure against plain definitions: outlines, tiers of type, merged paragraphs, audits, chapters' texts, imports of files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import speech as S
from folioflow.functions import text as T
from folioflow.operators import structure as D
from folioflow.plans import QUERIES
from folioflow.plans import pdf as Q
from folioflow.plans import structure as SP
from folioflow.sources import imports as I
from folioflow.sources import pdf as P

PARAS = "book_id long, para_no long, page long, text string, size double, bold boolean, n_lines int, first_on_page boolean"
BODY = "some words of the text " * 12 + "and the end."


def para(no, page, text, size=11.0, book=1, bold=False, n_lines=1):
    return (book, no, page, text, size, bold, n_lines, False)


def sizes_of(spark, pages=30, books=(1,)):
    return spark.createDataFrame([(b, 11.0, pages) for b in books], "book_id long, body_size double, pages long")


def outline_of(spark, entries, pages=30, book=1):
    """Entries are level, title, page from 1."""
    rows = [(book, k, *e, pages) for k, e in enumerate(entries, 1)]
    return spark.createDataFrame(rows, "book_id long, ord long, level long, title string, page long, pages long")


def placed(spark, entries, paras, sizes):
    levels = D.outline_levels(outline_of(spark, entries))
    return D.outline_places(levels.withColumn("page", F.col("page") - 1), paras, sizes)


def test_chapters_from_an_outline(spark):
    """Parts are announced once, sections belong to their chapters, what the title holds is skipped, and the outline comes before headings."""
    rows = [("PART ONE", 30.0, 0), ("Chapter 1", 18.0, 1), ("The Storm", 14.0, 1), (BODY, 11.0, 1), ("Chapter 2", 18.0, 3), (BODY, 11.0, 3), ("A section", 12.0, 4), (BODY, 11.0, 4), ("Part Two", 30.0, 8), ("Chapter 1", 18.0, 9), (BODY, 11.0, 9), (BODY, 11.0, 12)]
    paras = spark.createDataFrame([para(k, p, t, s) for k, (t, s, p) in enumerate(rows)], PARAS)
    entries = [(1, "My Book", 1), (2, "Part One", 1), (3, "Chapter 1: The Storm", 2), (3, "Chapter 2", 4), (4, "A section", 5), (2, "PART TWO", 9), (3, "Chapter 1", 10), (4, "Deep", 10), (5, "deeper", 11), (2, "Coda", 12)]
    sizes = sizes_of(spark)
    found = D.detect(paras, sizes, placed(spark, entries, paras, sizes))
    langs = spark.createDataFrame([(1, "en")], "book_id long, lang string")
    chapters = D.chapters(found, paras, langs)
    told = chapters.orderBy("chapter_no").collect()
    assert {r.method for r in told} == {"outline"}
    assert [r.title for r in told] == ["Chapter 1: The Storm", "Chapter 2", "Chapter 1", "Coda"]
    assert [r.part for r in told] == ["Part One", "Part One", "Part Two", None]
    assert [r.spoken_title for r in told] == ["Part One. Chapter 1: The Storm", None, "Part Two. Chapter 1", None]
    assert [[tuple(s) for s in r.sections] for r in told] == [[], [("A section", 5)], [("Deep", 10), ("deeper", 11)], []]
    assert [r.start_page for r in told] == [2, 4, 10, 13]  # nothing is on the last one's page
    # The heading goes, and with it the subtitle that the title holds; a part's page belongs to the chapter before it.
    assert [r.words for r in told] == [63, 130, 63, 63]
    assert told[0].preview == BODY[:220] and told[0].est_seconds == round(S.seconds(BODY, "en") + S.seconds(told[0].spoken_title, "en"), 1)
    texts = D.chapter_texts(found, chapters, paras, langs).orderBy("chapter_no", "para_no").collect()
    assert [(r.chapter_no, r.para_no, r.text[:9], r.page) for r in texts] == [(1, 1, BODY[:9], 2), (2, 1, BODY[:9], 4), (2, 2, "A section", 5), (2, 3, BODY[:9], 5), (2, 4, "Part Two", 9), (3, 1, BODY[:9], 10), (4, 1, BODY[:9], 13)]


def plain_levels(toc):
    """What an outline's entries (level, title, page) give, one step after the other."""
    toc = [e for e in toc if e[1] and 1 <= e[2] <= 30]
    if len(toc) < 2:
        return []
    while len(toc) > 2 and sum(e[0] == min(x[0] for x in toc) for e in toc) == 1:
        toc = [e for e in toc if e[0] != min(x[0] for x in toc)]
    top = min(e[0] for e in toc)
    tops = [e for e in toc if e[0] == top]
    named = [e for e in tops if re.match(T.PART_TITLE, e[1]) or (e[1].strip(". ") and re.match(T.ROMAN, e[1].strip(". ")))]
    parts = any(a[0] == top < b[0] for a, b in zip(toc, toc[1:])) and 2 * len(named) >= len(tops) and any(e[0] == top + 1 for e in toc)
    at, above, out = top + parts, None, []
    for k, (level, title, page) in enumerate(toc):
        last = k + 1 == len(toc) or toc[k + 1][0] <= level
        if level == at or (parts and level == at - 1 and last):
            out.append((title, page, above if parts and level == at else None, []))
        elif level > at and out:
            out[-1][3].append((title, page))
        if level == at - 1:
            above = title
    return out if len(out) >= 2 else []


def test_outlines_equal_the_plain_way(spark):
    draw = random.Random(8)
    books = {b: [(draw.choice([1, 1, 2, 2, 3, 4] if b % 3 else [b % 2 + 1, 2, 3]), draw.choice(["Part I", "II", "One", "", "Book 2", "x"]), draw.choice([0, 1, 5, 31, 7])) for _ in range(draw.randint(0, 9))] for b in range(150)}
    rows = [(b, k, *e, 30) for b, es in books.items() for k, e in enumerate(es)]
    found = D.outline_levels(spark.createDataFrame(rows, "book_id long, ord long, level long, title string, page long, pages long")).orderBy("book_id", "ord").collect()
    told = {}
    for r in found:
        told.setdefault(r.book_id, []).append((r.title, r.page, r.part, [tuple(s) for s in r.sections]))
    assert told == {b: want for b, es in books.items() if (want := plain_levels(es))} and len(told) > 50


def test_entries_at_one_paragraph(spark):
    """Of several chapters that begin at one paragraph the last has the text."""
    paras = spark.createDataFrame([para(1, 0, BODY), para(2, 1, BODY), para(3, 4, BODY)], PARAS)
    sizes = sizes_of(spark)
    entries = [(1, "First", 1), (1, "Second", 2), (1, "Third", 2), (1, "Lost", 20), (1, "Fourth", 5)]
    found = D.detect(paras, sizes, placed(spark, entries, paras, sizes))
    told = D.chapters(found, paras, spark.createDataFrame([(1, "en")], "book_id long, lang string")).orderBy("chapter_no").collect()
    assert [(r.title, r.words) for r in told] == [("First", 63), ("Second", 0), ("Third", 63), ("Fourth", 63)]
    assert D.detect(paras, sizes, placed(spark, entries[:1], paras, sizes)).count() == 0


def test_sizes_of_speech_add_up(spark):
    """As expressions, paragraph by paragraph, and as the whole text's."""
    draw = random.Random(2)
    rows = [(b, k, 0, "".join(draw.choices(["a", "Word ", "漢", "。", "12", " ", "é", "ひ"], k=draw.randint(0, 6)))) for b in range(80) for k in range(draw.randint(1, 5))]
    df = spark.createDataFrame(rows, "book_id long, para_no long, page long, text string")
    for lang in ("en", "zh"):
        found = {r.book_id: r.s for r in D.summed(df, ["book_id"]).select("book_id", S.seconds_of(F.col("size_"), F.lit(lang)).alias("s")).collect()}
        for b in range(80):
            whole = " ".join(t for i, _, _, t in rows if i == b)
            if len(whole.strip().encode()) >= 12:  # below, a pause counts by the bytes without blanks at the ends
                assert found[b] == pytest.approx(S.seconds(whole, lang)), whole
        each = df.select("text", S.seconds_of(S.script_sizes("text"), F.lit(lang)).alias("s")).collect()
        assert [r.s for r in each] == pytest.approx([S.seconds(r.text, lang) for r in each])


def plain_merge(rows):
    out = []
    for r in rows:
        last = out[-1] if out else None
        if last and 0 <= r["page"] - last["page"] <= 2 and not re.search(T.TERMINAL, last["text"]) and r["text"][:1].islower() and abs(r["size"] - last["size"]) < 1:
            a, b = last["text"], r["text"]
            cjk = re.compile(f"[{T.HAN}豈-﫿぀-ヿ]")
            whole = a[:-1] + b if a.endswith("-") and not a.endswith("--") else a + b if cjk.match(a[-1]) else f"{a} {b}"
            if r["page"] != last["page"]:
                last["breaks"].append((len(whole) - len(b), r["page"]))
            last |= {"text": whole, "n_lines": last["n_lines"] + r["n_lines"]}
        else:
            out.append(r | {"breaks": []})
    return [(r["book_id"], r["para_no"], r["page"], r["text"], r["size"], r["n_lines"], r["breaks"]) for r in out]


def test_merged_paragraphs_equal_the_plain_fold(spark):
    draw = random.Random(3)
    rows = []
    for b in range(40):
        page = 0
        for k in range(draw.randint(0, 40)):
            page += draw.choice([0, 0, 0, 1, 1, 3])
            rows.append({"book_id": b, "para_no": k + 1, "page": page, "text": draw.choice(["it went", "on and", "the end.", "New", "half-", "dash--", "漢字", "é went", "x", "and)", " a"]), "size": draw.choice([11.0, 11.0, 11.0, 11.6, 12.2]), "bold": False, "n_lines": draw.randint(1, 3), "first_on_page": False})
    found = [(r.book_id, r.para_no, r.page, r.text, r.size, r.n_lines, [tuple(x) for x in r.breaks]) for r in D.merged_across_pages(spark.createDataFrame(rows, PARAS)).collect()]
    assert sorted(found) == sorted(r for b in range(40) for r in plain_merge([x for x in rows if x["book_id"] == b]))


def plan_of(df):
    """The nodes of a query's plan as it is made."""
    return re.findall(r"Exchange hashpartitioning|\w*Join\b|\w*Window\b", df._jdf.queryExecution().executedPlan().toString())


def test_lines_are_dealt_by_book_once(spark, data):
    """From lines to merged paragraphs all runs by book: besides the lines only their sizes are shuffled, and lines are joined by book alone."""
    lines = SP._lines(spark, data)
    row = (F.col("line_no") - 1) % 4  # short pages with a line at the head of each
    lines = lines.withColumns({"page": F.floor((F.col("line_no") - 1) / 4), "y0": row * 20.0 + 10, "y1": row * 20.0 + 22, "text": F.when(row == 0, F.concat(F.lit("A book, page "), "page")).otherwise(F.col("text"))})
    sizes = D.body_size(lines)
    kept = D.without_running_lines(lines, sizes)
    gone = D.running_lines(lines, sizes)
    want = lines.join(gone, ["book_id", "page", "line_no"], "left_anti").select(*lines.columns)
    assert kept.columns == lines.columns and gone.count() > 0 and sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
    # Sizes are ready-made here, so any other exchange would be of lines.
    ready = spark.createDataFrame(sizes.collect(), sizes.schema)
    plan = D.structured(lines, ready)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("REPARTITION_BY_COL" in x for x in dealt) == 1, dealt
    assert all(re.search(r"hashpartitioning\(book_id#\d+L, \d+\)", x) for x in dealt), dealt
    assert plan.count("FileScan parquet") == 1


def test_merged_paragraphs_are_dealt_once(spark, data):
    """Texts go over the network once, and no text meets itself in a join; words are cut once a document."""
    df = QUERIES["merged_paragraphs"](spark, data)
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning") == 1 and not any(n.endswith("Join") for n in plan)
    assert df._jdf.queryExecution().executedPlan().toString().count("split(text") <= 2  # the words, and whether there are any


@pytest.mark.parametrize("few", [0, 64])
def test_audit_equals_all_pairs(spark, monkeypatch, few):
    """By grams and by pairs; keys of every length, empty ones, and many that share their beginning."""
    monkeypatch.setattr(D, "FEW_TITLES", few)
    draw = random.Random(5)
    title = lambda: draw.choice(["", "!?", "a", "ab", "chapter", "Chapter 1", f"Chapter {draw.randint(1, 30)}: the {draw.choice(['long', 'short'])} road home", "the long road", "漢字の章", "".join(draw.choices("ab", k=draw.randint(1, 14)))])
    found, truth = ([(b, title()) for b in range(25) for _ in range(draw.randint(0, 8))] for _ in range(2))
    key = lambda t: re.sub(f"[^0-9a-z{T.HAN}]+", "", t.lower())
    want = {(b, t) for b, t in truth if not any(c == b and (key(t) in key(x) or key(x) in key(t)) for c, x in found)}
    frames = [spark.createDataFrame(x, "book_id long, title string") for x in (found, truth)]
    assert {tuple(r) for r in D.audit(*frames).collect()} == want and want


def test_audit_meets_titles_in_their_book(spark, data, monkeypatch):
    """Documents are read once for either side; a book of many titles is looked up by grams, without its keys beside every gram."""
    plan = QUERIES["audit_titles"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [doc_id") <= 2
    title = lambda k: f"On the road {k} to the {k * k} hills"
    rows = [(b, title(k)) for b, n in ((1, 5), (2, 300)) for k in range(n)]
    frames = [spark.createDataFrame([(b, t[s:e]) for b, t in rows if (len(t) + int(t.split()[3])) % m], "book_id long, title string") for s, e, m in ((0, 22, 3), (0, 40, 2))]
    monkeypatch.setattr(D, "FEW_TITLES", 20)
    kept = []
    stored = lambda df: kept.append(df) or df
    found = {tuple(r) for r in D.audit(*frames, stored).collect()}
    assert {r.book_id for r in kept[0].collect()} == {2} and {r.book_id for r in kept[1].collect()} == {2}
    key = lambda t: re.sub("[^0-9a-z]+", "", t.lower())
    sides = [{(r.book_id, r.title) for r in f.collect()} for f in frames]
    assert found == {(b, t) for b, t in sides[1] if not any(c == b and (key(t) in key(x) or key(x) in key(t)) for c, x in sides[0])} and {b for b, _ in found} == {1, 2}
    grams = D._grams(spark.createDataFrame([(1, "a" * 20 + "b")], "book_id long, _k string"), F.lit(8))
    assert grams.columns == ["book_id", "_h", "_g"] and grams.count() == 2


def _pages(rows):
    """Pages of lines (text, size, bold) for a file, one list for each."""
    return [[(k, t, s, b) for k, (t, s, b) in enumerate(page)] for page in rows]


def test_import_of_files(spark, tmp_path):
    """Books are cut by their bookmarks; a book is imported once; a lot that broke off is done again; what can't be read has its reason."""
    body = lambda p: [(f"{p}{'bcdfghjklmnpqr'[k]}a begins a line of the text with words enough.", 11.0, False) for k in range(14)]
    pages = _pages([[("PART ONE", 20.0, True)], [("Chapter 1", 16.0, True), *body("A")], body("E"), [("Chapter 2", 16.0, True), *body("O")], [("Chapter 3", 16.0, True), *body("U")]])
    marks = [(1, "Part One", 1), (2, "Chapter 1", 2), (3, "a section", 3), (2, "Chapter 2", 4), (1, "Part Two", 5), (2, "Chapter 3", 5)]
    whole = Q.written("A made book", pages, marks, 1, True).encode()
    at, inside = f"file://{tmp_path}/out", tmp_path / "in"
    inside.mkdir()
    (inside / "b.pdf").write_bytes(whole)
    (inside / "a.pdf").write_bytes(whole)
    (inside / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    files = P.files(spark, str(inside))
    assert I.import_files(files, at, "one")
    books = I.library(spark, at, "books").collect()
    assert len(books) == 1 and (books[0].method, books[0].pages, books[0].n_chapters, books[0].language) == ("outline", 5, 3, "en")
    chapters = I.library(spark, at, "chapters").orderBy("chapter_no").collect()
    assert [(r.title, r.part, r.spoken_title, len(r.sections), r.start_page) for r in chapters] == [("Chapter 1", "Part One", "Part One. Chapter 1", 1, 2), ("Chapter 2", "Part One", None, 0, 4), ("Chapter 3", "Part Two", "Part Two. Chapter 3", 0, 5)]
    assert chapters[0].words == 2 * chapters[1].words == 2 * 14 * 10
    texts = I.library(spark, at, "texts").groupBy("chapter_no").agg(F.sum(T.word_count("text")).alias("n")).orderBy("chapter_no").collect()
    assert [r.n for r in texts] == [r.words for r in chapters]
    told = {r.path.rsplit("/", 1)[1]: r for r in I.library(spark, at, "files").collect()}
    assert {k: r.reason for k, r in told.items()} == {"a.pdf": None, "b.pdf": None, "broken.pdf": "broken"} and told["a.pdf"].title == "A made book"
    assert [r.label for r in I.library(spark, at, "labels").orderBy("page").collect()] == ["i", "1", "2", "3", "4"]
    before = sorted(str(p) for p in (tmp_path / "out").rglob("*"))
    assert not I.import_files(files, at, "two") and sorted(str(p) for p in (tmp_path / "out").rglob("*")) == before
    assert I.import_files(files, at, "one")  # the same lot again: replaced, not added
    assert I.library(spark, at, "books").count() == 1
    (inside / "c.pdf").write_bytes(Q.written("Another", _pages([body("W"), body("Y")]), [], 0, False).encode())
    I.import_stream(spark, str(inside), at, f"{tmp_path}/state")
    I.import_stream(spark, str(inside), at, f"{tmp_path}/state")
    assert I.library(spark, at, "books").count() == 2 and I.library(spark, at, "books").groupBy("lot").count().count() == 2


def test_lots_give_the_same_books(spark, data, tmp_path):
    """Books in lots: the same tables; no table of paragraphs beside the one that is read."""
    lines = SP._lines(spark, data).where("book_id < 40")
    one, many = ([sorted(map(str, df.collect())) for df in I.imported(lines, f"file://{tmp_path}/{n}", lots=n)] for n in (1, 3))
    assert one == many and all(one)
    texts = [sorted(map(str, spark.read.parquet(f"{tmp_path}/{n}/texts").collect())) for n in (1, 3)]
    assert texts[0] == texts[1] and texts[0] and not (tmp_path / "1" / "lines").exists()


def test_changed_chapters(spark):
    kind = "book_id long, chapter_no long, para_no long, text string"
    old = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (1, 3, 1, "c"), (2, 1, 1, "x")], kind)
    new = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "B"), (1, 3, 1, "c"), (1, 3, 2, "more"), (2, 1, 1, "y"), (2, 2, 1, "z")], kind)
    assert {tuple(r) for r in I.changed_chapters(old, new).collect()} == {(1, 2), (1, 3)}
