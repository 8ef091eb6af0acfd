"""Document structure: lines to paragraphs, paragraphs to headings, headings to chapters.

``lines`` has book_id, line_no, page, x0, y0, y1, text, size, bold, block, page_height; ``paragraphs``
book_id, para_no, page, text, size, bold, n_lines, first_on_page, and ``books`` book_id, body_size,
pages. Everything runs by book, so a book's rows are what a task holds at most.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import speech as S
from ..functions import text as T
from .sequences import asof_join, binned, island

# Margins, repeats and sizes that tell headings and running lines from text.
MARGIN, REPEATS, BIG_LINE, BIG, NUMERIC_SIZE, SUBTITLE_SIZE, DROP_CAP = 0.16, 3, 1.25, 1.3, 1.15, 1.08, 1.5
HEADER_PAGES, CONTENTS_NAMES, OVERPRINT_X, OVERPRINT_Y, SECTION_SECONDS, MERGE_PAGES, MERGE_SIZE = 3, 3, 0.5, 0.3, 1200.0, 2, 1.0


def _by(*order: str):
    return Window.partitionBy("book_id").orderBy(*order)


def line_text(c: Column) -> Column:
    """A line as it reads: letters set apart as words, then :func:`text.clean_text`."""
    return T.clean_text(T.unspace_letters(c))


def line_of_spans(spans: DataFrame, tidy: Callable[[Column], Column] = line_text) -> DataFrame:
    """Lines of spans: footnote marks go, size weighs by characters, bold by majority. ``spans`` has book_id, line_no, span_no, text, size, bold, raised. ``tidy`` makes a line's text of what its spans hold."""
    n = F.length(F.trim("text"))
    base = F.max_by("size", F.struct(n, -F.col("span_no"))).over(Window.partitionBy("book_id", "line_no"))
    mark = (n > 0) & (F.col("raised") | (F.col("size") < 0.75 * base)) & F.col("text").rlike(r"^\s*[\d*†‡§]+\s*$")
    kept = spans.withColumns({"_n": n, "_mark": mark}).where("not _mark")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"])
    return kept.groupBy("book_id", "line_no").agg(
        tidy(F.array_join(parts, "")).alias("text"),
        F.round(F.sum(F.col("size") * F.col("_n")) / F.greatest(F.sum("_n"), F.lit(1)), 1).alias("size"),
        (F.sum(F.when(F.col("bold"), F.col("_n")).otherwise(0)) > F.sum("_n") / 2).alias("bold"),
    ).where("text != ''")


def without_overprint(lines: DataFrame) -> DataFrame:
    """A line printed on top of an equal one goes; only lines that stay count. One fold per page and text."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", "x0", "y0", "size", F.struct(*lines.columns).alias("row"))))
    grouped = lines.groupBy("book_id", "page", "text").agg(rows.alias("_rows"))

    def step(kept: Column, r: Column) -> Column:
        on_top = F.exists(kept, lambda k: (F.abs(k["x0"] - r["x0"]) < OVERPRINT_X * r["size"]) & (F.abs(k["y0"] - r["y0"]) < OVERPRINT_Y * r["size"]))
        return F.when(on_top, kept).otherwise(F.concat(kept, F.array(r)))

    return grouped.select(F.explode(F.aggregate("_rows", F.filter("_rows", lambda _: F.lit(False)), step)).alias("_r")).select("_r.row.*")


def body_size(lines: DataFrame) -> DataFrame:
    """The size of most characters, to half points, of equal ones the first seen."""
    sized = lines.groupBy("book_id", (F.round(F.col("size") * 2) / 2).alias("_s")).agg(F.sum(F.length("text")).alias("_n"), F.min("line_no").alias("_at"))
    return sized.groupBy("book_id").agg(F.coalesce(F.max_by("_s", F.struct("_n", -F.col("_at"))), F.lit(11.0)).alias("body_size"))


def _edges(lines: DataFrame) -> DataFrame:
    """``lines`` with whether each is at its page's edge."""
    w = Window.partitionBy("book_id", "page")
    ranked = lines.withColumns({"_up": F.row_number().over(w.orderBy("y0", "line_no")), "_down": F.row_number().over(w.orderBy(F.desc("y0"), F.desc("line_no")))})
    zone = F.col("page_height") * MARGIN
    edge = ((F.col("_up") <= 2) | (F.col("_down") <= 2)) & ((F.col("y1") < zone) | (F.col("y0") > F.col("page_height") - zone))
    return ranked.withColumn("_edge", F.coalesce(edge, F.lit(False))).drop("_up", "_down")


def edge_lines(lines: DataFrame) -> DataFrame:
    """The lines at the pages' edges with their keys and how often these occur in the book."""
    keyed = _edges(lines).where("_edge").drop("_edge").withColumn("key", T.edge_key("text"))
    return keyed.withColumns({"times": F.count(F.lit(1)).over(Window.partitionBy("book_id", "key")), "is_number": F.col("text").rlike(T.PAGE_NUMBER)})


def _repeated() -> Column:
    return (F.col("key") != "") & (F.col("times") >= REPEATS) & (F.col("size") < F.col("body_size") * BIG_LINE)


def running_lines(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Page numbers and repeated lines in the margins; big lines are headings."""
    edge = edge_lines(lines).join(sizes, "book_id")
    return edge.where(F.col("is_number") | _repeated()).select("book_id", "page", "line_no", "text", "key", "is_number")


def without_running_lines(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lines`` but for those of :func:`running_lines`, which are marked where they are: lines dealt by book aren't dealt again."""
    told = _edges(lines).withColumn("key", F.when(F.col("_edge"), T.edge_key("text")))
    told = told.withColumn("times", F.count_if("_edge").over(Window.partitionBy("book_id", "key"))).join(sizes.select("book_id", "body_size"), "book_id", "left")
    running = F.col("_edge") & F.col("body_size").isNotNull() & (F.col("text").rlike(T.PAGE_NUMBER) | _repeated())
    return told.where(~F.coalesce(running, F.lit(False))).select(*lines.columns)


def printed_numbers(lines: DataFrame) -> DataFrame:
    """The printed number of each page: the longest, of equal ones the upper."""
    number = T.strip(F.regexp_replace(F.col("text"), r"(?i)^\W*(?:page\s*)?|\s*(?:of|/)\s*\d+\W*$|\W+$", ""))
    found = edge_lines(lines).where("is_number").withColumn("number", number).where("number != ''")
    return found.groupBy("book_id", "page").agg(F.max_by("number", F.struct(F.length("number"), -F.col("y0"), -F.col("line_no"))).alias("number"))


def page_labels(pages: DataFrame, printed: DataFrame) -> DataFrame:
    """The label of every page: the file's own if half have one, else printed numbers, with gaps filled by the offset that most follow. ``pages`` has book_id, page, label."""
    own = pages.groupBy("book_id").agg((F.count_if(F.coalesce("label", F.lit("")) != "") >= 0.5 * F.count(F.lit(1))).alias("_own"))
    numbered = printed.where(F.col("number").rlike("^[0-9]{1,9}$")).withColumn("_offset", F.col("number").cast("int") - F.col("page"))
    votes = numbered.groupBy("book_id", "_offset").agg(F.count(F.lit(1)).alias("_n"), F.min("page").alias("_at"))
    n_printed = printed.groupBy("book_id").agg(F.count(F.lit(1)).alias("_printed"))
    best = votes.groupBy("book_id").agg(F.max_by(F.struct("_offset", "_n"), F.struct("_n", -F.col("_at"))).alias("_best")).join(n_printed, "book_id")
    sure = best.where(F.col("_best._n") >= F.greatest(F.lit(3), 0.2 * F.col("_printed"))).select("book_id", F.col("_best._offset").alias("_offset"))
    told = pages.join(own, "book_id").join(sure, "book_id", "left").join(printed, ["book_id", "page"], "left")
    filled = F.when(F.col("page") + F.col("_offset") >= 1, (F.col("page") + F.col("_offset")).cast("string"))
    label = F.when(F.col("_own"), F.coalesce("label", F.lit(""))).when(F.col("_offset").isNull(), "").otherwise(F.coalesce("number", filled, F.lit("")))
    return told.select("book_id", "page", label.alias("label"))


def paragraphs(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Paragraphs of lines: fragments of one printed line first, then breaks at size, gap and indent."""
    block = ["book_id", "page", "block"]
    w = Window.partitionBy(*block).orderBy(F.round("y0"), "x0", "line_no")
    apart = ~((F.abs(F.col("y0") - F.lag("y0").over(w)) < 2) & (F.col("x0") > F.lag("x0").over(w)))
    pieces = lines.withColumn("_new", F.coalesce(apart, F.lit(True)))
    pieces = pieces.withColumn("_l", F.sum(F.col("_new").cast("int")).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "line_no", "text"))), lambda p: p["text"]), " ")
    whole = pieces.groupBy(*block, "_l").agg(
        F.min("line_no").alias("line_no"), F.min_by("x0", "x0").alias("x0"), F.min_by("y0", "x0").alias("y0"), F.max("y1").alias("y1"), text.alias("text"), F.max("size").alias("size"), F.bool_and("bold").alias("bold")
    )
    placed = whole.withColumn("_left", F.median("x0").over(Window.partitionBy(*block))).join(sizes, "book_id")
    v = Window.partitionBy(*block).orderBy("_l")
    jump = F.abs(F.col("size") - F.lag("size").over(v)) > F.greatest(F.lit(1.0), 0.15 * F.col("body_size"))
    gap = F.col("y0") - F.lag("y1").over(v) > 1.1 * F.col("size")
    indent = (F.col("x0") - F.col("_left") > F.greatest(F.lit(6.0), 0.8 * F.col("size"))) & F.lag("text").over(v).rlike(T.TERMINAL)
    cut = placed.withColumn("_cut", F.coalesce(jump | gap | indent, F.lit(True)))
    cut = cut.withColumn("_p", island(F.col("_cut"), block, ["_l"]))
    in_order = F.sort_array(F.collect_list(F.struct("_l", "text")))
    paras = cut.groupBy(*block, "_p").agg(
        F.min("line_no").alias("_at"), F.min_by("y0", "_l").alias("y"), F.transform(in_order, lambda p: p["text"]).alias("lines"), F.max("size").alias("size"), F.bool_and("bold").alias("bold")
    )
    order = ["page", "block", "_p"]
    return paras.select(
        "book_id", F.row_number().over(_by(*order)).cast("long").alias("para_no"), "page", "y", T.join_lines("lines").alias("text"), "size", "bold",
        F.size("lines").alias("n_lines"), (F.row_number().over(Window.partitionBy("book_id", "page").orderBy("block", "_p")) == 1).alias("first_on_page"), "lines",
    )


def words_of(text: Column) -> Column:
    """The words of a text, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ’']+"), F.lit(0))


def vocabulary(rows: DataFrame, by: list[str]) -> DataFrame:
    """How often each word occurs, in small letters."""
    return rows.select(*by, F.explode(words_of(F.col("text"))).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def drop_caps(paras: DataFrame, sizes: DataFrame) -> DataFrame:
    """A lone big capital goes to the next paragraph, glued if the book knows the joined word better.

    Words are counted in the book's row, and only those that a capital asks for, so paragraphs dealt by book aren't dealt again.
    """
    w = _by("para_no")
    letter = F.regexp_replace(F.trim("text"), "^[‘“'\"]+", "")
    lone = (F.length(letter) == 1) & (F.length(F.trim("text")) <= 2) & letter.rlike(r"^\p{Lu}$") & (F.col("size") >= DROP_CAP * F.col("body_size"))
    same = (F.lead("page").over(w) == F.col("page")) & (F.lead("size").over(w) < F.col("size"))
    told = paras.join(sizes.select("book_id", "body_size"), "book_id").withColumn("_cap", F.coalesce(lone & same, F.lit(False)))
    # Of two such capitals in a row the first takes the second along, which then is a paragraph's text.
    told = told.withColumn("_cap", F.col("_cap") & ~F.coalesce(F.lag("_cap").over(w), F.lit(False)))
    told = told.withColumns({"_from": F.when(F.lag("_cap").over(w), F.trim(F.lag("text").over(w))), "_first": F.lag("first_on_page").over(w)})
    rest = F.ltrim("text")
    fragment = F.lower(F.regexp_extract(rest, "^[A-Za-zÀ-ÿ’']+", 0))
    inline = r"^([‘“'\"]?)([A-Z]) ([a-z’']+)"
    told = told.withColumns({
        "_fragment": F.when(F.col("_from").isNotNull(), fragment).otherwise(F.regexp_extract(F.trim("text"), inline, 3)),
        "_joined": F.lower(F.when(F.col("_from").isNotNull(), F.concat(F.regexp_replace("_from", "^[‘“'\"]+", ""), fragment)).otherwise(F.concat(F.regexp_extract(F.trim("text"), inline, 2), F.regexp_extract(F.trim("text"), inline, 3)))),
    })
    asks = ~F.col("_cap") & (F.col("_fragment") != "")
    own = [c for c in paras.columns if c != "book_id"] + ["_cap", "_from", "_first", "_fragment", "_joined"]
    books = told.groupBy("book_id").agg(F.collect_list(F.struct(*own)).alias("_rows"), F.array_distinct(F.flatten(F.collect_list(F.when(asks, F.array("_fragment", "_joined"))))).alias("_asked"))
    none = F.array().cast("array<string>")
    known = F.transform("_rows", lambda r: F.coalesce(F.filter(words_of(r["text"]), lambda x: F.array_contains("_asked", x)), none))
    books = books.withColumn("_known", F.when(F.size("_asked") > 0, F.flatten(known)).otherwise(none))
    times = lambda r, c: F.when(r["_fragment"] != "", F.size(F.filter("_known", lambda x: x == r[c]))).otherwise(0)
    counted = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in own], times(r, "_fragment").alias("_nf"), times(r, "_joined").alias("_nj")))
    told = books.select("book_id", F.inline(counted)).where("not _cap")
    nf, nj = F.col("_nf"), F.col("_nj")
    glued = (F.col("_fragment") != "") & (nj >= nf)
    text = F.when(F.col("_from").isNotNull(), F.concat("_from", F.when(glued, "").otherwise(" "), rest)).when(
        (F.col("_fragment") != "") & (nj > 2 * nf), F.regexp_replace(F.trim("text"), inline, "$1$2$3")
    ).otherwise(F.col("text"))
    return told.select(*[c for c in paras.columns if c not in ("text", "first_on_page")], text.alias("text"), (F.col("first_on_page") | F.coalesce("_first", F.lit(False))).alias("first_on_page"))


def _starts(pages: Column, sizes: Column) -> Column:
    """Of a chain's pages and sizes, the places (from 1) where a paragraph begins: the first, and those too far from the last that does in page or size."""

    @F.pandas_udf("array<int>")
    def run(pages: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for chain in zip(pages, sizes):
            page = size = None
            told = []
            for k, (p, s) in enumerate(zip(*(c.tolist() for c in chain)), 1):
                if page is None or not 0 <= p - page <= MERGE_PAGES or abs(s - size) >= MERGE_SIZE:
                    page, size = p, s
                    told.append(k)
            out.append(told)
        return pd.Series(out)

    return run(pages, sizes)


def merged_across_pages(paras: DataFrame) -> DataFrame:
    """A sentence that a page or block cuts in two becomes one paragraph; where pages begin in it is kept.

    Whether a paragraph may go on from the one before shows in the two texts alone, which cuts books into
    chains. Within a chain only pages and sizes are looked at one after the other, as these are
    compared with the paragraph that began; texts are put together and offsets added up by Spark.
    Paragraphs are dealt by book once, and nothing is joined.
    """
    order = _by("para_no")
    before = F.lag("text").over(order)
    linked = F.coalesce(F.col("text").rlike(r"^\p{Ll}") & ~before.rlike(T.TERMINAL), F.lit(False))
    rows = paras.select("book_id", "para_no", F.col("page").cast("long").alias("page"), "text", F.col("size").cast("double").alias("size"), "bold", F.col("n_lines").cast("int").alias("n_lines"), "first_on_page")
    # What joins it to the text before: a hyphen goes, or nothing, or a space comes between.
    cjk = f"[{T.HAN}豈-﫿぀-ヿ]"
    hyphen = before.rlike("-$") & ~before.rlike("--$")
    rows = rows.withColumns({"_linked": linked, "_glue": F.when(hyphen, -1).when(before.rlike(f"{cjk}$") | F.col("text").rlike(f"^{cjk}"), 0).otherwise(1)})
    rows = rows.withColumn("_chain", island(~F.col("_linked"), ["book_id"], ["para_no"]))
    row = F.struct("para_no", "page", "text", "size", "bold", "n_lines", "first_on_page", "_glue")
    chains = rows.groupBy("book_id", "_chain").agg(F.sort_array(F.collect_list(row)).alias("_c"))
    chains = chains.withColumn("_s", _starts(F.col("_c.page"), F.col("_c.size")))
    stop = lambda k: F.coalesce(F.get("_s", k + 1), F.size("_c") + 1)
    told = chains.select("book_id", F.explode(F.transform("_s", lambda s, k: F.slice("_c", s, stop(k) - s))).alias("_p"))
    p, head = F.col("_p"), F.col("_p")[0]

    def piece(x: Column, k: Column) -> Column:
        text = F.when(F.get(p, k + 1)["_glue"] == -1, F.substring(x["text"], F.lit(1), F.length(x["text"]) - 1)).otherwise(x["text"])
        return F.when((k > 0) & (x["_glue"] == 1), F.concat(F.lit(" "), text)).otherwise(text)

    def step(told: Column, x: Column) -> Column:
        # Offsets: the lengths before, with what joined them.
        at = told["at"] + x["_glue"]
        found = F.when(x["page"] != head["page"], F.concat(told["breaks"], F.array(F.struct(at.alias("offset"), x["page"].alias("page"))))).otherwise(told["breaks"])
        return F.struct((at + F.length(x["text"])).alias("at"), found.alias("breaks"))

    none = F.struct((-head["_glue"]).alias("at"), F.array().cast("array<struct<offset:int,page:bigint>>").alias("breaks"))
    return told.select(
        "book_id", head["para_no"].alias("para_no"), head["page"].alias("page"), F.array_join(F.transform(p, piece), "").alias("text"), head["size"].alias("size"), head["bold"].alias("bold"),
        F.aggregate(p, F.lit(0), lambda n, x: n + x["n_lines"]).alias("n_lines"), head["first_on_page"].alias("first_on_page"), F.aggregate(p, none, step, lambda told: told["breaks"]).alias("breaks"),
    )


def structured(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Paragraphs of lines as printed. Lines are dealt by book once, to which all steps keep."""
    kept = without_running_lines(lines.repartition("book_id"), sizes)
    return merged_across_pages(drop_caps(paragraphs(kept, sizes).drop("y", "lines"), sizes))


# ---- headings


def looks_like_subtitle(body: Column) -> Column:
    """P17."""
    s = F.col("text")
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 3)
    titled = (F.size(long) > 0) & (F.size(F.filter(long, lambda w: w.rlike(r"^\p{Lu}"))) >= 0.6 * F.size(long))
    other = s.rlike(r"""[.!?;。！？]['"”’]?$""") | s.rlike(T.CHAPTER) | s.rlike(T.SPECIAL) | s.rlike(T.HAN_HEADING)
    upper = (s == F.upper(s)) & s.rlike(r"\p{Lu}")
    return (F.col("n_lines") <= 2) & F.size(words).between(1, 10) & ~other & ((F.col("size") >= body * SUBTITLE_SIZE) | F.col("bold") | upper | titled)


def heading_candidates(paras: DataFrame, sizes: DataFrame) -> DataFrame:
    """Paragraphs that read like headings; pages with several names are contents."""
    s = F.trim("text")
    p = paras.join(sizes, "book_id").withColumn("title", s).withColumn("_big", F.col("size") >= F.col("body_size") * BIG)
    t = F.col("title")
    few = F.col("n_lines") <= F.when(F.col("_big"), 4).otherwise(2)
    contents = t.rlike(T.CONTENTS_LINE) | (t.rlike(T.CHAPTER) & F.regexp_extract(t, T.CHAPTER, 3).rlike(r"(^|\s)\d{1,4}$") & ~F.col("_big"))
    special = t.rlike(T.SPECIAL) & (F.size(F.split(t, r"\s+")) <= 6)
    found = p.where(few & (F.length(t) <= 110) & ~contents & (t.rlike(T.CHAPTER) | t.rlike(T.HAN_HEADING) | special))
    found = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("book_id", "page"))).where(F.col("_n") < CONTENTS_NAMES)
    return found.select("book_id", "para_no", "page", "size", "title", t.rlike(T.PART_TITLE).alias("is_part"))


def numeric_candidates(paras: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lone numbers that stand out, of books in which they mostly rise by one."""
    token = F.regexp_extract(F.trim("text"), T.NUMERIC, 1)
    p = paras.join(sizes, "book_id").withColumn("title", token).where((token != "") & (F.col("n_lines") == 1))
    p = p.where((F.col("size") >= F.col("body_size") * NUMERIC_SIZE) | F.col("bold") | F.col("first_on_page"))
    p = p.withColumn("_v", F.coalesce(F.col("title").try_cast("int"), T.roman_value("title"))).where("_v > 0")
    w = Window.partitionBy("book_id")
    rising = F.sum(F.col("_next").cast("int")).over(w)
    p = p.withColumn("_next", F.coalesce(F.col("_v") == F.lag("_v").over(w.orderBy("para_no")) + 1, F.lit(False))).withColumns({"_n": F.count(F.lit(1)).over(w), "_rising": rising})
    return p.where((F.col("_n") >= 3) & (F.col("_rising") >= 0.7 * (F.col("_n") - 1))).select("book_id", "para_no", "page", "size", "title", F.lit(False).alias("is_part"))


def large_candidates(paras: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines in the smallest large type that isn't too frequent. ``sizes`` also has pages.

    Neighbours on a page are one heading wherever both are large enough, so at any tier there are as many
    headings as members at or above it, less the pairs of neighbours whose lesser size is. Sums over
    tiers give all counts; only the tier that wins is put together.
    """
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    # What shows in a paragraph alone comes first, so long ones aren't shuffled.
    named = paras.where((F.col("n_lines") <= 3) & words.between(1, 14) & F.col("text").rlike(r"\p{L}"))
    p = named.join(sizes, "book_id").where(F.col("size") >= F.col("body_size") * BIG).withColumn("tier", F.round("size"))
    w = _by("para_no")
    p = p.withColumn("_beside", F.coalesce((F.col("para_no") == F.lag("para_no").over(w) + 1) & (F.col("page") == F.lag("page").over(w)), F.lit(False)))
    p = p.withColumn("_pair", F.when(F.col("_beside"), F.least("tier", F.lag("tier").over(w))))
    counts = F.array(F.struct(F.col("tier").alias("tier"), F.lit(1).alias("n")), F.struct(F.col("_pair").alias("tier"), F.lit(-1).alias("n")))
    tiers = p.select("book_id", "pages", F.inline(counts)).where("tier is not null").groupBy("book_id", "tier").agg(F.sum("n").alias("_n"), F.first("pages").alias("pages"))
    down = Window.partitionBy("book_id").orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tiers = tiers.withColumn("_n", F.sum("_n").over(down)).withColumn("_stop", F.bool_or(F.col("_n") > F.greatest(F.lit(3.0), F.col("pages") / 2.5)).over(down))
    best = tiers.where("not _stop and _n >= 2").groupBy("book_id").agg(F.min("tier").alias("_tier"))
    kept = p.join(best, "book_id").where("tier >= _tier")
    apart = ~((F.col("para_no") == F.lag("para_no").over(w) + 1) & (F.col("page") == F.lag("page").over(w)))
    kept = kept.withColumn("_h", island(F.coalesce(apart, F.lit(True)), ["book_id"], ["para_no"]))
    title = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "text"))), lambda t: t["text"]), " ")
    heads = kept.groupBy("book_id", "_h").agg(F.min("para_no").alias("para_no"), F.min("page").alias("page"), F.max("size").alias("size"), title.alias("title"), F.count(F.lit(1)).alias("skip"))
    return heads.select("book_id", "para_no", "page", "size", "title", F.lit(False).alias("is_part"), "skip")


def without_running_headers(found: DataFrame) -> DataFrame:
    """Of equal titles within a few pages the largest stays, of equal ones the first; later ones are other chapters."""
    keyed = found.withColumn("_key", T.title_key("title"))
    by = ["book_id", "_key"]
    far = F.col("page") - F.lag("page").over(Window.partitionBy(*by).orderBy("para_no")) > HEADER_PAGES
    runs = keyed.withColumn("_far", F.coalesce(far, F.lit(True))).withColumn("_run", island(F.col("_far"), by, ["para_no"]))
    kept = runs.groupBy(*by, "_run").agg(F.max_by(F.struct(*found.columns), F.struct("size", -F.col("para_no"))).alias("_r"))
    return kept.select("_r.*")


def with_subtitles(found: DataFrame, paras: DataFrame, sizes: DataFrame) -> DataFrame:
    """The paragraph after a heading joins its title if it looks like a subtitle; other ways than headings have none. ``found`` may have skip and method."""
    heads = found if "skip" in found.columns else found.withColumn("skip", F.lit(1).cast("long"))
    after = heads.select("book_id", (F.col("para_no") + F.col("skip")).alias("para_no"))
    next_ = paras.join(after, ["book_id", "para_no"], "left_semi").join(heads.select("book_id", "para_no"), ["book_id", "para_no"], "left_anti")
    subs = next_.join(sizes, "book_id").where(looks_like_subtitle(F.col("body_size")))
    subs = subs.select("book_id", F.col("para_no").alias("_at"), F.col("page").alias("_page"), F.trim("text").alias("_sub"))
    joined = heads.withColumn("_at", F.col("para_no") + F.col("skip")).join(subs, ["book_id", "_at"], "left")
    has = F.col("_sub").isNotNull() & (F.col("_page") == F.col("page"))
    has = has & (F.col("method") == "headings") if "method" in found.columns else has
    gap = F.when(F.col("title").rlike(f"[{T.HAN}]"), " ").otherwise(": ")
    title = F.when(has, F.concat(F.regexp_replace("title", "[ .:]+$", ""), gap, "_sub")).otherwise(F.col("title"))
    return joined.withColumns({"title": title, "skip": F.col("skip") + F.when(has, 1).otherwise(0)}).drop("_at", "_page", "_sub")


#: Characters of a chapter's beginning that are looked at.
BEGINNING = 3000


def summed(body: DataFrame, by: list[str]) -> DataFrame:
    """Paragraphs (para_no, page, text) by ``by``: words, first_page, last_page, n_paras, first_para, body (its beginning) and size, that of the paragraphs joined by spaces. Sizes add up, so no chapter's text is put together."""
    w = Window.partitionBy(*by).orderBy("para_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = body.withColumn("_s", S.script_sizes("text"))
    after = F.last("_s.last", ignorenulls=True).over(before)
    told = told.withColumns({"_lead": F.col("_s.lead") + (F.row_number().over(w) > 1).cast("int"), "_after": after, "_at": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))})
    lead = lambda script: F.sum(F.when(F.col("_after").eqNullSafe(F.lit(script)), F.col("_lead")).otherwise(0))
    size = F.struct(
        lead(None).alias("lead"), (F.sum("_s.en") + lead("en")).alias("en"), (F.sum("_s.zh") + lead("zh")).alias("zh"),
        F.min_by("_s.first", F.when(F.col("_s.first").isNotNull(), F.col("para_no"))).alias("first"), F.max_by("_s.last", "para_no").alias("last"), (F.sum("_s.solid") + F.count(F.lit(1)) - 1).alias("solid"),
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_at") < BEGINNING, F.struct("para_no", "text")))), lambda p: p["text"]), " ")
    return told.groupBy(*by).agg(
        F.sum(T.word_count("text")).alias("words"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n_paras"), F.min("para_no").alias("first_para"), F.substring(text, 1, BEGINNING).alias("body"), size.alias("size_")
    )


def _headed(heads: DataFrame) -> list[str]:
    """The order of headings: outlines may have several at one paragraph."""
    return ["para_no", *(["ord"] if "ord" in heads.columns else [])]


def chapter_bodies(heads: DataFrame, paras: DataFrame) -> DataFrame:
    """Each heading's paragraphs: from after it up to the next heading, with the heading's paragraph as ``head``. Of several headings at one paragraph the last has them."""
    last = heads.groupBy("book_id", "para_no").agg(F.max_by("skip", F.struct(*_headed(heads)[1:], F.col("skip"))).alias("skip")).withColumn("head", F.col("para_no"))
    body = asof_join(paras, last, ["book_id"], "para_no", "para_no", ["head", "skip"])
    return body.where(F.col("head").isNotNull() & (F.col("para_no") >= F.col("head") + F.col("skip"))).drop("skip")


def chapter_extents(heads: DataFrame, paras: DataFrame) -> DataFrame:
    """What :func:`summed` tells of each heading's paragraphs."""
    order = _headed(heads)
    laid = heads.withColumn("_head", F.when(F.coalesce(F.lead("para_no").over(_by(*order)) != F.col("para_no"), F.lit(True)), F.col("para_no")))
    sums = summed(chapter_bodies(heads, paras.select("book_id", "para_no", "page", "text")), ["book_id", "head"])
    told = laid.join(sums.withColumnRenamed("head", "_head").drop("first_para"), ["book_id", "_head"], "left").drop("_head")
    return told.withColumns({"words": F.coalesce("words", F.lit(0)), "n_paras": F.coalesce("n_paras", F.lit(0)), "body": F.coalesce("body", F.lit(""))})


def with_parts(chapters: DataFrame) -> DataFrame:
    """A part's own page without text goes, and gives the following chapters their part; the first of a part announces it. A part that an outline gives counts first."""
    order = _by(*_headed(chapters))
    w = order.rowsBetween(Window.unboundedPreceding, -1)
    title = T.pretty_title("title")
    own = T.pretty_title("part") if "part" in chapters.columns else F.lit(None).cast("string")
    told = chapters.withColumns({"title": title, "part": own, "_lone": F.col("is_part") & (F.col("words") < 60)})
    told = told.withColumns({"part": F.coalesce("part", F.last(F.when(F.col("_lone"), F.col("title")), ignorenulls=True).over(w)), "_page": F.when(F.lag("_lone").over(order), F.lag("title").over(order))})
    told = told.where("not _lone")
    known = F.last("part", ignorenulls=True).over(w)
    opens = F.col("part").isNotNull() & ~F.col("part").eqNullSafe(known)
    said = F.coalesce("_page", F.when(opens, F.col("part")))  # the page of a part just before is announced in any case
    told = told.withColumn("spoken_title", F.when(said.isNotNull(), F.concat(said, F.lit(". "), "title")))
    return told.withColumn("chapter_no", F.row_number().over(order).cast("long")).drop("_lone", "_page")


def included(title: Column, words: Column) -> Column:
    """Chapters with text that aren't front or back matter."""
    return (words >= 40) & ~F.regexp_replace(title, "^[ .:]+|[ .:]+$", "").rlike(T.SKIP_TITLE)


def opening(words: Column, text: Column) -> Column:
    """Whether pages before the first heading make a chapter, and whether it is read: kept, included."""
    return F.struct((words >= 50).alias("kept"), ((words >= 400) & ~F.substring(text, 1, 3000).rlike(T.JUNK_TEXT)).alias("included"))


def opening_pages(found: DataFrame, paras: DataFrame) -> DataFrame:
    """What stands before a book's first heading, if it is a chapter's worth."""
    first = found.groupBy("book_id").agg(F.min("para_no").alias("_first"), F.min("method").alias("method"))
    front = paras.join(first, "book_id").where("para_no < _first")
    told = summed(front, ["book_id", "method"]).withColumnRenamed("first_para", "para_no")
    told = told.withColumn("_o", opening(F.col("words"), F.col("body"))).where("_o.kept")
    return told.withColumns({"title": F.lit("Opening pages"), "include": F.col("_o.included"), "page": F.lit(0).cast("long")}).drop("_o")


def _timed(paras: DataFrame, langs: DataFrame, limit: float) -> DataFrame:
    timed = paras.join(langs, "book_id").withColumn("_seconds", S.seconds_of(S.script_sizes("text"), F.col("lang"))).select("book_id", "para_no", "page", "text", "_seconds")
    return binned(timed, ["book_id"], ["para_no"], F.col("_seconds"), limit, close_after=True)


def timed_sections(paras: DataFrame, langs: DataFrame, limit: float = SECTION_SECONDS) -> DataFrame:
    """Books by time alone: a section closes with the paragraph that reaches the limit. ``langs`` has book_id, lang."""
    timed = _timed(paras, langs, limit)
    title = F.concat(F.lit("Section "), (F.col("bin") + 1).cast("string"))
    found = summed(timed, ["book_id", "bin"]).withColumnRenamed("first_para", "para_no")
    return found.withColumns({"method": F.lit("sections"), "title": title, "spoken_title": title, "page": F.col("first_page").cast("long")}).drop("bin")


def chapters(found: DataFrame, paras: DataFrame, langs: DataFrame, preview: int = 220) -> DataFrame:
    """The chapters of all books: of headings, of the pages before them, and of books without headings by time.

    book_id, chapter_no, method, title, part, spoken_title, words, est_seconds, start_page (from 1), first_page, last_page, preview,
    include, sections (title, page from 1), para_no (of its heading).
    """
    headed = with_parts(chapter_extents(found, paras)).drop("chapter_no")
    lone = paras.join(found.select("book_id").distinct(), "book_id", "left_anti")
    told = headed.unionByName(opening_pages(found, paras), allowMissingColumns=True).unionByName(timed_sections(lone, langs), allowMissingColumns=True)
    order = _headed(told)
    told = told.join(langs, "book_id").withColumn("_said", F.coalesce("spoken_title", "title"))
    body = F.coalesce(S.seconds_of(F.col("size_"), F.col("lang")), F.lit(0.0))
    inner = F.transform("sections", lambda s: F.struct(T.pretty_title(s["title"]).alias("title"), s["page"].alias("page"))) if "sections" in told.columns else F.lit(None).cast(_SECTIONS)
    return told.select(
        "book_id", F.row_number().over(_by(*order)).cast("long").alias("chapter_no"), "method", "title", "part", "spoken_title", "words", F.round(body + S.seconds_of(S.script_sizes("_said"), F.col("lang")), 1).alias("est_seconds"),
        (F.col("page") + 1).cast("long").alias("start_page"), "first_page", "last_page", F.substring("body", 1, preview).alias("preview"), F.coalesce("include", included(F.col("title"), F.col("words"))).alias("include"),
        F.coalesce(inner, F.array().cast(_SECTIONS)).alias("sections"), "para_no",
    )


def chapter_texts(found: DataFrame, chapters: DataFrame, paras: DataFrame, langs: DataFrame) -> DataFrame:
    """The paragraphs of every chapter of :func:`chapters`, as chunking takes them: book_id, chapter_no, para_no (in its chapter, from 1), text, page (from 1), breaks (offset, page from 1)."""
    own = ["book_id", "para_no", "page", "text", *(["breaks"] if "breaks" in paras.columns else [])]
    first = found.groupBy("book_id").agg(F.min("para_no").alias("_first"))
    front = paras.select(*own).join(first, "book_id").where("para_no < _first").drop("_first")
    front = front.withColumn("head", F.min("para_no").over(Window.partitionBy("book_id")))
    lone = _timed(paras.join(first, "book_id", "left_anti"), langs, SECTION_SECONDS).withColumn("head", F.min("para_no").over(Window.partitionBy("book_id", "bin"))).select("book_id", "para_no", "head")
    lone = lone.join(paras.select(*own), ["book_id", "para_no"])
    body = chapter_bodies(found, paras.select(*own)).unionByName(front).unionByName(lone.select(*own, "head"))
    # Of several chapters at one paragraph the last has the text.
    named = chapters.groupBy("book_id", F.col("para_no").alias("head")).agg(F.max("chapter_no").alias("chapter_no"))
    w = Window.partitionBy("book_id", "chapter_no").orderBy("para_no")
    told = body.join(named, ["book_id", "head"]).withColumns({"page": (F.col("page") + 1).cast("long"), "_n": F.row_number().over(w).cast("long")})
    if "breaks" in own:
        told = told.withColumn("breaks", F.transform("breaks", lambda b: F.struct(b["offset"].alias("offset"), (b["page"] + 1).alias("page"))))
    return told.select("book_id", "chapter_no", F.col("_n").alias("para_no"), "text", "page", *(["breaks"] if "breaks" in own else []))


def is_textless(paras: DataFrame) -> DataFrame:
    """P10: books whose pages hold pictures of text alone."""
    return paras.groupBy("book_id").agg(_textless(F.sum).alias("textless"))


def _textless(total: Callable[[Column], Column]) -> Column:
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    return (total(words) < 20) & (total(F.length("text")) < 200)


def with_text(paras: DataFrame) -> DataFrame:
    """The paragraphs of books that aren't :func:`is_textless`, told where they are, so that paragraphs dealt by book aren't dealt again."""
    book = Window.partitionBy("book_id")
    told = paras.withColumn("_textless", _textless(lambda c: F.sum(c).over(book)))
    return told.where(~F.coalesce("_textless", F.lit(False))).drop("_textless")


_SECTIONS = "array<struct<title:string,page:bigint>>"


def detect(paras: DataFrame, sizes: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Headings by the first way that finds two or more in a book: outline, headings, numbers, large type. Adds method; ``outline`` is as :func:`outline_places` gives it, whose chapters also have part and sections."""
    ways: list[tuple[str, DataFrame]] = [] if outline is None else [("outline", outline)]
    ways += [("headings", f(paras, sizes)) for f in (heading_candidates, numeric_candidates)] + [("fontsize", large_candidates(paras, sizes))]
    defaults = {"size": F.lit(None).cast("double"), "is_part": F.lit(False), "skip": F.lit(1).cast("long"), "part": F.lit(None).cast("string"), "sections": F.lit(None).cast(_SECTIONS), "ord": F.lit(0).cast("long")}
    cols = ["book_id", "para_no", "page", "size", "title", "is_part", "skip", *(["part", "sections", "ord"] if outline is not None else [])]
    every: DataFrame | None = None
    for k, (method, found) in enumerate(ways):
        told = found if method == "outline" else without_running_headers(found)
        told = told.withColumns({c: v for c, v in defaults.items() if c in cols and c not in told.columns})
        told = told.select(*cols).withColumns({"method": F.lit(method), "_k": F.lit(k)})
        every = told if every is None else every.unionByName(told)
    n = F.count(F.lit(1)).over(Window.partitionBy("book_id", "_k"))
    enough = every.withColumn("_n", n).where("_n >= 2")
    return enough.withColumn("_best", F.min("_k").over(Window.partitionBy("book_id"))).where("_k = _best").drop("_k", "_n", "_best")


def outline_levels(toc: DataFrame) -> DataFrame:
    """The outline's chapters with part and sections (title, page of each). ``toc`` has book_id, ord, level, title, page (from 1), pages.

    A level that has one entry alone, below no other such level's, is a wrapper around the rest and goes, as long as two entries
    stay. Chapters are the level on top, or the one below it where the top names parts. What lies above and
    below a chapter is found by intervals of ``ord``: its part is the last entry above it, its sections are the deeper ones up to the next.
    """
    rows = toc.where((F.coalesce("title", F.lit("")) != "") & F.col("page").between(1, F.col("pages")))
    book = Window.partitionBy("book_id")
    levels = rows.groupBy("book_id", "level").agg(F.count(F.lit(1)).alias("_n"))
    by_level = book.orderBy("level")
    # The k-th level from the top is a wrapper if it and all above have one entry, and more than two are left with it.
    left = F.sum("_n").over(book) - (F.row_number().over(by_level) - 1)
    wrapper = F.bool_and((F.col("_n") == 1) & (left > 2)).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    levels = levels.withColumn("_wrapper", wrapper)
    rows = rows.join(levels.where("not _wrapper").select("book_id", "level"), ["book_id", "level"])
    core = F.regexp_replace("title", "^[. ]+|[. ]+$", "")
    named = F.col("title").rlike(T.PART_TITLE) | ((core != "") & core.rlike(T.ROMAN))
    order = book.orderBy("ord")
    rows = rows.withColumns({"_top": F.min("level").over(book), "_next": F.lead("level").over(order), "_many": F.count(F.lit(1)).over(book)})
    on_top = F.col("level") == F.col("_top")
    tops, parts_named = F.count_if(on_top).over(book), F.count_if(on_top & named).over(book)
    children = F.bool_or(on_top & F.coalesce(F.col("_next") > F.col("_top"), F.lit(False))).over(book)
    rows = rows.withColumn("_parts", children & (2 * parts_named >= tops) & F.bool_or(F.col("level") == F.col("_top") + 1).over(book))
    rows = rows.withColumn("_at", F.col("_top") + F.col("_parts").cast("int"))
    childless = F.coalesce(F.col("_next") <= F.col("level"), F.lit(True))
    wanted = (F.col("level") == F.col("_at")) | (F.col("_parts") & (F.col("level") == F.col("_at") - 1) & childless)
    above = F.last(F.when(F.col("level") == F.col("_at") - 1, F.col("title")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_wanted": wanted & (F.col("_many") >= 2), "part": F.when(F.col("_parts") & (F.col("level") == F.col("_at")), above)})
    rows = rows.withColumn("_chapter", F.last(F.when(F.col("_wanted"), F.col("ord")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    deeper = F.col("level") > F.col("_at")
    inner = F.transform(F.sort_array(F.collect_list(F.when(deeper, F.struct("ord", F.col("title").alias("title"), F.col("page").cast("long").alias("page"))))), lambda e: F.struct(e["title"].alias("title"), e["page"].alias("page")))
    mine = rows.where("_chapter is not null and (_wanted or level > _at)").groupBy("book_id", F.col("_chapter").alias("ord")).agg(
        F.max_by("title", F.col("_wanted")).alias("title"), F.max_by("page", F.col("_wanted")).cast("long").alias("page"), F.max_by("part", F.col("_wanted")).alias("part"), inner.alias("sections")
    )
    mine = mine.withColumn("_n", F.count(F.lit(1)).over(book)).where("_n >= 2").drop("_n")
    return mine.select("book_id", F.row_number().over(order).cast("long").alias("ord"), "title", "page", "part", "sections")


def outline_places(entries: DataFrame, paras: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The paragraph of each outline entry: the first on its page whose key begins with the title's or the other way round, else the first on that page or the next two.

    ``entries`` have pages from 0, as paragraphs have. With ``sizes`` (book_id, body_size) up to two paragraphs after an exact one are
    skipped with it, if they look like subtitles and the title holds them.
    """
    key = T.title_key("title")
    text = F.col("_key")
    w = _by("para_no")
    keyed = paras.withColumns({"_key": T.title_key("text"), "_page": F.col("page")})
    sub = F.lit(False)
    if sizes is not None:
        keyed = keyed.join(sizes.select("book_id", "body_size"), "book_id")
        sub = looks_like_subtitle(F.col("body_size")) & (F.length("_key") >= 3)
    keyed = keyed.withColumn("_sub", F.when(sub, F.col("_key")))
    after = [F.when(F.lead("_page", k).over(w) == F.col("_page"), F.lead("_sub", k).over(w)) for k in (1, 2)]
    keyed = keyed.withColumns({"_sub1": after[0], "_sub2": after[1]}).where(F.length("text") <= 200).select("book_id", "_page", F.col("para_no").alias("_no"), "_key", "_sub1", "_sub2")
    e = entries.withColumns({"_whole": key, "_title": F.substring(key, 1, 40)})
    hit = (F.col("_title") != "") & (F.startswith(text, F.col("_title")) | ((F.length(text) >= 3) & F.startswith(F.col("_title"), text)))
    first = F.coalesce(F.contains("_whole", F.col("_sub1")), F.lit(False))
    skip = 1 + first.cast("long") + (first & F.coalesce(F.contains("_whole", F.col("_sub2")), F.lit(False))).cast("long")
    exact = e.join(keyed.withColumnRenamed("_page", "page"), ["book_id", "page"]).where(hit)
    exact = exact.groupBy("book_id", "ord").agg(F.min(F.struct(F.col("_no").alias("no"), skip.alias("skip"))).alias("_exact"))
    firsts = paras.groupBy("book_id", F.col("page").alias("_page")).agg(F.min("para_no").alias("_no"))
    near = e.select("book_id", "ord", F.explode(F.sequence(F.col("page"), F.col("page") + 2)).alias("_page")).join(firsts, ["book_id", "_page"]).groupBy("book_id", "ord").agg(F.min(F.struct("_page", "_no")).alias("_near"))
    placed = entries.join(exact, ["book_id", "ord"], "left").join(near, ["book_id", "ord"], "left")
    page = F.when(F.col("_exact").isNotNull(), F.col("page")).otherwise(F.col("_near._page"))
    return placed.withColumns({"para_no": F.coalesce("_exact.no", "_near._no"), "page": page, "skip": F.coalesce("_exact.skip", F.lit(0).cast("long"))}).drop("_exact", "_near").where("para_no is not null")


GRAM = 8


def _grams(keys: DataFrame, n: Column) -> DataFrame:
    """Every different run of ``n`` characters of every key, as a hash; of the key there is a hash too, so that a row is small however long the key."""
    places = F.sequence(F.lit(1), F.length("_k") - n + 1)
    return keys.where(F.length("_k") >= n).select("book_id", F.xxhash64("_k").alias("_h"), F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substr("_k", i, n))))).alias("_g"))


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs book_id, _in, _out of keys (book_id, _k) the first of which is in the second.

    A key that is in another has all its grams there, so it is looked up under its gram that the
    fewest have; others are never met. Keys shorter than a gram are looked up among runs of their length.
    What hashes meet is compared as text.
    """
    long, short = inner.where(F.length("_k") >= GRAM), inner.where(F.length("_k").between(1, GRAM - 1))
    index = _grams(outer, F.lit(GRAM))
    many = index.groupBy("book_id", "_g").agg(F.count(F.lit(1)).alias("_n"))
    # A gram that no key has is the rarest.
    probe = _grams(long, F.lit(GRAM)).join(many, ["book_id", "_g"], "left").groupBy("book_id", F.col("_h").alias("_a")).agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
    runs = _grams(outer.join(short.select("book_id", F.length("_k").alias("_l")).distinct(), "book_id"), F.col("_l"))
    equal = short.select("book_id", F.xxhash64("_k").alias("_a"), F.xxhash64("_k").alias("_g"))
    met = probe.join(index, ["book_id", "_g"]).unionByName(equal.join(runs, ["book_id", "_g"])).select("book_id", "_a", F.col("_h").alias("_b")).distinct()
    named = lambda keys, h, k: keys.select("book_id", F.xxhash64("_k").alias(h), F.col("_k").alias(k))
    return met.join(named(inner, "_a", "_in"), ["book_id", "_a"]).join(named(outer, "_b", "_out"), ["book_id", "_b"]).where(F.contains("_out", F.col("_in"))).select("book_id", "_in", "_out")


#: Titles of a book on either side, of 1,024 characters, up to which all are compared; beyond, they are looked up by grams.
FEW_TITLES = 512


def audit(found: DataFrame, truth: DataFrame, stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Titles of the truth that aren't found, by equal or contained keys of a book; an empty key is in every other.

    A book's titles meet in its own row, so titles are dealt by book once. ``stored`` writes a table and reads it back: the
    numbers of the books with too many titles for that, and these titles, are used several times.
    """
    sides = truth.select("book_id", "title", F.lit(0).alias("_side")).unionByName(found.select("book_id", "title", F.lit(1).alias("_side")))
    size = lambda side: F.struct(F.count_if(F.col("_side") == side).alias("n"), F.coalesce(F.sum(F.when(F.col("_side") == side, F.length("title"))), F.lit(0)).alias("c"))
    sized = sides.groupBy("book_id").agg(size(0).alias("_t"), size(1).alias("_f"))
    # What all pairs read of each other.
    work = F.col("_t.n") * F.col("_f.c") + F.col("_f.n") * F.col("_t.c")
    many = stored(sized.where(work > 1024 * FEW_TITLES * FEW_TITLES).select("book_id"))
    titles = lambda side: F.collect_set(F.when(F.col("_side") == side, F.struct("title")))
    books = sides.join(many, "book_id", "left_anti").groupBy("book_id").agg(titles(0).alias("_t"), titles(1).alias("_f"))
    keyed = F.transform("_t", lambda t: F.struct(t["title"].alias("missing"), T.title_key(t["title"]).alias("k")))
    books = books.select("book_id", keyed.alias("_t"), F.array_distinct(F.transform("_f", lambda f: T.title_key(f["title"]))).alias("_f"))
    lacks = F.filter("_t", lambda t: ~F.coalesce(F.exists("_f", lambda k: F.contains(k, t["k"]) | F.contains(t["k"], k)), F.lit(False)))
    missing = books.select("book_id", F.explode(lacks).alias("_m")).select("book_id", "_m.missing")
    return missing.unionByName(_looked_up(stored(sides.join(many, "book_id", "left_semi").withColumn("_k", T.title_key("title")))))


def _looked_up(sides: DataFrame) -> DataFrame:
    """The missing titles of books with many (book_id, title, _k, _side)."""
    a = sides.where("_side = 0").select("book_id", F.col("title").alias("missing"), "_k").distinct()
    held, keys = sides.where("_side = 1").select("book_id", "_k").distinct(), a.select("book_id", "_k").distinct()
    met = _within(keys, held).select("book_id", F.col("_in").alias("_k")).unionByName(_within(held, keys).select("book_id", F.col("_out").alias("_k")))
    empty = F.lit("")
    any_, none = held.select("book_id").distinct(), held.where(F.col("_k") == empty).select("book_id")
    missing = a.join(met, ["book_id", "_k"], "left_anti").join(none, "book_id", "left_anti")
    return missing.join(any_.withColumn("_k", empty), ["book_id", "_k"], "left_anti").select("book_id", "missing")


def coverage(chapters: DataFrame, totals: DataFrame) -> DataFrame:
    """Words kept of all, starts out of order, gaps of more than two pages. ``totals`` has book_id, words."""
    w = _by("chapter_no")
    before = chapters.withColumns({"_back": F.col("first_page") < F.lag("first_page").over(w), "_gap": F.col("first_page") - F.lag("last_page").over(w) > 2})
    sums = before.groupBy("book_id").agg(F.sum("words").alias("_kept"), F.count_if("_back").alias("out_of_order"), F.count_if("_gap").alias("gaps"))
    all_words = totals.select("book_id", F.col("words").alias("_all"))
    return sums.join(all_words, "book_id").select("book_id", (F.col("_kept") / F.greatest(F.col("_all"), F.lit(1))).alias("coverage"), "out_of_order", "gaps")


