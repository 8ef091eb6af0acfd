"""Text functions as Catalyst expressions: they stay inside generated code and need no Python worker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words by language, in the order that breaks ties.
STOP_WORDS = {
    "en": "the and of to a in is was that he it for with as his on be at by had not are but from or have an they which you were her she",
    "fr": "le la les des est et une que pas pour dans du un il elle qui sur au avec ne se son sa ce mais nous vous",
    "es": "el la los las de que y en un una es por con no se su para al lo como más pero sus le ya",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "it": "il di che la e in un per non una sono le si con del della gli lo ma mi ha anche",
    "pt": "de que e o a do da em um para com não uma os no se na por mais as dos como mas ao",
    "nl": "de het een en van ik te dat die in is niet zijn op aan met voor er maar om",
}
# Language names.
LANGUAGE_NAMES = {
    "en": "English", "zh": "Chinese", "fr": "French", "es": "Spanish", "de": "German", "it": "Italian",
    "pt": "Portuguese", "nl": "Dutch", "ar": "Arabic", "ru": "Russian", "hi": "Hindi", "ja": "Japanese",
    "other": "an unrecognised language",
}
# What replaces ligatures and invisible characters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
INVISIBLE = "­​‌‍﻿"
WIDE_BLANKS = "   "
# Character ranges and patterns of headings.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
HAN = "㐀-鿿"
ARABIC, CYRILLIC, LATIN, HINDI = "؀-ۿݐ-ݿ", "Ѐ-ӿ", "A-Za-zÀ-ɏ", "ऀ-ॿ"
_NUMBER_NAMES = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
    "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last|final"
)
CHAPTER = (
    r"(?i)^(chapter|chap\.|part|book|letter|volume|act|canto|chapitre|partie|livre|cap[ií]tulo|capitolo|parte|libro)\s+"
    rf"(\d{{1,3}}|[ivxlcdm]{{1,8}}|(?:{_NUMBER_NAMES})(?:[\s-](?:{_NUMBER_NAMES}))*)\b[.:\s—–-]*(.{{0,70}})$"
)
SPECIAL = (
    r"(?i)^(prologue|epilogue|introduction|preface|foreword|afterword|interlude|conclusion|appendix(?: [a-z0-9]+)?|postscript|coda|"
    r"author'?s note|a note from the author|acknowledge?ments|[ée]pilogue|pr[ée]face|avant-propos|pr[óo]logo|ep[íi]logo|"
    r"introducci[óo]n|prefacio|introduzione|prefazione|introdu[çc][ãa]o|pref[áa]cio)\W*$"
)
HAN_HEADING = r"^(第[一二三四五六七八九十百千零〇两\d]+[章节回卷部篇集幕]|序章|序言|序|楔子|尾声|后记|前言|引子|番外|终章)(.{0,40})$"
NUMERIC = r"^(\d{1,3}|[IVXLC]{1,7})\.?$"
CONTENTS_LINE = r"(\.{3,}|…|\s{3,}|\t)\s*\d{1,4}$"
PART_TITLE = r"(?i)^(part|book|volume|partie|livre|parte|libro)\b|^第[一二三四五六七八九十百千零〇两\d]+[部卷篇]"
SKIP_TITLE = (
    r"(?i)^((table of )?contents|index|copyright.*|bibliography|references|works cited|(end)?notes|acknowledge?ments|"
    r"about the (author|authors|publisher)|also by .*|other (books|titles) by .*|books by .*|praise for .*|cover|"
    r"title page|half title|glossary|colophon|目录|版权.*|索引|参考文献)$"
)
JUNK_TEXT = r"(?i)all rights reserved|isbn|printed in|library of congress|copyright ©|©"
PAGE_NUMBER = r"(?i)^\W*(?:page\s*)?(?:\d{1,4}|[ivxlcdm]{1,7})(?:\s*(?:of|/)\s*\d{1,4})?\W*$"
TERMINAL = r"""[.!?…:;。！？；]['"”’)\]」』]*$"""
META_JUNK = r"(?i)^(unknown|anonymous|untitled|none|null|document\s*\d*|book\s*\d*|pdf|scan(ned)?( document)?|converted( by| with)?.*|adobe.*|calibre.*|created by.*)$"
META_FILE = r"(?i)microsoft word|\.docx?$|\.pdf$|\.indd$"
SMALL_WORDS = ["a", "an", "the", "of", "and", "or", "in", "on", "at", "to", "for", "by", "with"]
ROMAN = r"(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
DIGIT_NAMES = "zero one two three four five six seven eight nine".split()


def _s(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Private-use characters out, ligatures apart, blanks collapsed and trimmed."""
    c = F.regexp_replace(_s(c), "[-�\U000f0000-\U0010ffff]", "")
    c = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)
    c = F.translate(F.regexp_replace(c, f"[{INVISIBLE}]", ""), WIDE_BLANKS, " " * len(WIDE_BLANKS))
    return strip(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " "))


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_s(c), r"^\s+|\s+$", "")


def is_scene_break(c: Column | str) -> Column:
    """A short mark between scenes, without a letter or digit."""
    s = strip(c)
    return F.length(s).between(1, 12) & ~s.rlike(f"[A-Za-z0-9{CJK}]")


def _share(text: Column, ranges: str) -> Column:
    """Characters of some scripts."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{ranges}]+", ""))


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scripts(text: Column) -> Column:
    """The language that a text's script alone tells, or null."""
    shares = F.struct(
        _share(text, CJK).alias("cjk"), _share(text, "぀-ヿ").alias("kana"), _share(text, ARABIC).alias("arabic"),
        _share(text, CYRILLIC).alias("cyrillic"), _share(text, LATIN).alias("latin"), _share(text, HINDI).alias("hindi"),
    )

    def told(s: Column) -> Column:
        letters = s["cjk"] + s["arabic"] + s["cyrillic"] + s["latin"]
        return (
            F.when(s["hindi"] > 0.3 * (letters + s["hindi"]), "hi")
            .when(letters == 0, "other")
            .when(s["cjk"] > 0.2 * letters, F.when(s["kana"] > 0.1 * s["cjk"], "ja").otherwise("zh"))
            .when(s["arabic"] > 0.3 * letters, "ar")
            .when(s["cyrillic"] > 0.3 * letters, "ru")
        )

    # Most texts are in Latin letters alone, which one look tells.
    return F.when(text.rlike(f"[{CJK}{ARABIC}{CYRILLIC}{HINDI}]"), _once(shares, told)).when(~text.rlike(f"[{LATIN}]"), "other")


def _voted(n: Column, votes: list[Column]) -> Column:
    """The language with most stop words, earlier ones winning ties; of no words at all none."""
    each = [F.struct(v.alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")) for i, (lang, v) in enumerate(zip(STOP_WORDS, votes))]
    return F.when(n == 0, "other").otherwise(_once(F.array_max(F.array(*each)), lambda best: F.when(best["n"] > 0, best["lang"]).otherwise("en")))


#: Letters of the words that are looked at.
_LETTERS = "a-zà-ÿ"


def detect_language(c: Column | str, sample: int = 300_000) -> Column:
    """By script, else by stop words, of one text; all are counted in place, and no word becomes a row."""
    text = F.substring(_s(c), 1, sample)

    every = sorted({w for stops in STOP_WORDS.values() for w in stops.split()})

    def counts(said: Column) -> Column:
        """How often each language's stop words occur, and whether there is any word."""
        known = F.filter(F.split(said, f"[^{_LETTERS}]+"), lambda w: w.isin(*every))
        among = lambda stops: lambda w: w.isin(*stops.split())
        votes = lambda ws: F.struct(*[F.size(F.filter(ws, among(stops))).alias(lang) for lang, stops in STOP_WORDS.items()])
        return F.struct(said.rlike(f"[{_LETTERS}]").cast("int").alias("n"), _once(known, votes).alias("votes"))

    voted = _once(_once(F.lower(text), counts), lambda s: _voted(s["n"], [s["votes"][lang] for lang in STOP_WORDS]))
    return F.coalesce(_scripts(text), voted)


def detect_languages(docs: DataFrame, keep: list[str], text: str, sample: int = 300_000) -> DataFrame:
    """T09 for tables: ``keep`` and detected, of every row."""
    return docs.select(*keep, detect_language(F.coalesce(F.col(text), F.lit("")), sample).alias("detected"))


def language_name(c: Column | str) -> Column:
    """The name of a language code."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, _s(c)), F.lit(LANGUAGE_NAMES["other"]))


def narration_language(detected: Column | str, supported: tuple[str, ...] = ("en", "zh")) -> Column:
    """The language to narrate in, and a warning where it isn't the text's."""
    c = _s(detected)
    known = ", ".join(LANGUAGE_NAMES[x] for x in sorted(supported) if x in LANGUAGE_NAMES)
    name = language_name(c)
    warning = F.concat(
        F.lit("This book looks like it's in "), name, F.lit(f". The current voice engine reads {known}, so "), name,
        F.lit(" narration may sound wrong or heavily accented. Try one chapter first."),
    )
    fine = F.coalesce(c.isin(*supported), F.lit(False))
    return F.struct(F.when(fine, c).otherwise("en").alias("language"), F.when(~fine, warning).alias("warning"))


def digits_words(c: Column | str) -> Column:
    """Digits read one by one."""
    names = F.array(*[F.lit(x) for x in DIGIT_NAMES])
    return F.array_join(F.transform(F.regexp_extract_all(_s(c), F.lit("[0-9]"), F.lit(0)), lambda d: F.get(names, d.cast("int"))), " ")


def roman_value(c: Column | str) -> Column:
    """The value of a well-formed Roman numeral, else null. A letter before a greater one counts against it."""
    s = F.lower(_s(c))
    values = F.create_map(*[x for k, v in ROMAN_VALUES.items() for x in (F.lit(k), F.lit(v))])
    letters = F.transform(F.split(s, ""), lambda x: F.coalesce(F.try_element_at(values, x), F.lit(0)))
    signed = F.transform(letters, lambda v, i: F.when(v < F.coalesce(F.get(letters, i + 1), F.lit(0)), -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda a, b: a + b)
    return F.when((s != "") & s.rlike(ROMAN), F.nullif(total, F.lit(0)))


def join_lines(lines: Column | str) -> Column:
    """Lines into one text; a hyphen at a line's end goes before a small letter, and stays before a capital."""
    cjk = f"[{HAN}豈-﫿぀-ヿ]"

    def merge(out: Column, line: Column) -> Column:
        hyphen = out.rlike("-$") & ~out.rlike("--$")
        return (
            F.when(out == "", line)
            .when(hyphen & line.rlike(r"^\p{Ll}"), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), line))
            .when(hyphen & line.rlike(r"^\p{Lu}"), F.concat(out, line))
            .when(out.rlike(f"{cjk}$") | line.rlike(f"^{cjk}"), F.concat(out, line))
            .otherwise(F.concat(out, F.lit(" "), line))
        )

    return F.aggregate(_s(lines), F.lit(""), merge)


def split_unspaced(c: Column | str) -> Column:
    """Sentences of a script without spaces."""
    return _sentences(_s(c), "([。！？；…]+[”’」』）)]*)")


def split_hindi(c: Column | str) -> Column:
    """Sentences of Hindi, whose ends need a space after them."""
    return _sentences(_s(c), r"""([।॥!?]+["'”’)]*)(?=\s)""")


def _sentences(c: Column, end: str) -> Column:
    marked = F.regexp_replace(c, end, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda x: x != "")


def unspace_letters(c: Column | str) -> Column:
    """T17: "C H A P T E R   O N E" as words."""
    s = strip(c)
    tokens = F.filter(F.split(s, " "), lambda t: t != "")
    singles = F.size(F.filter(tokens, lambda t: t.rlike(r"^\p{L}$")))
    words = F.transform(F.split(s, " {2,}"), lambda w: F.replace(w, F.lit(" "), F.lit("")))
    other = (F.size(tokens) < 4) | (singles < 0.7 * F.size(tokens)) | (~s.rlike(r"\S {2,}\S") & (F.size(tokens) > 12))
    return F.when(other, _s(c)).otherwise(F.array_join(F.filter(words, lambda w: w != ""), " "))


def edge_key(c: Column | str) -> Column:
    """A line's text without what changes from page to page."""
    s = F.regexp_replace(F.lower(_s(c)), r"[0-9]+", "#")
    s = F.regexp_replace(s, r"^\W*[ivxlcdm]+\W+|\W+[ivxlcdm]+\W*$", "")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ .|–—-]+|[ .|–—-]+$", "")


def title_key(c: Column | str) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(F.lower(_s(c)), f"[^0-9a-z{HAN}]+", "")


def word_count(c: Column | str) -> Column:
    """Han characters, and runs of Latin letters and digits."""
    return F.regexp_count(_s(c), F.lit(f"[{HAN}]")) + F.regexp_count(_s(c), F.lit("[A-Za-zÀ-ÿ0-9']+"))


def pretty_title(c: Column | str) -> Column:
    """A title in capitals as a title; each side of a colon by itself."""
    small = F.array(*[F.lit(w) for w in SMALL_WORDS])

    def one(part: Column) -> Column:
        letters = F.regexp_replace(part, r"[^\p{L}]", "")
        words = F.split(F.lower(part), " ")
        cased = F.array_join(
            F.transform(words, lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))), " "
        )
        return F.when((F.length(letters) > 3) & (letters == F.upper(letters)) & letters.rlike(r"\p{Lu}"), _upper_numeral(cased)).otherwise(part)

    return F.array_join(F.transform(F.split(strip(F.regexp_replace(_s(c), r"\s+", " ")), ": "), one), ": ")


def _upper_numeral(c: Column) -> Column:
    """The Roman numeral after the word of a heading in capitals."""
    found = r"(?i)^(.*?\b(?:Chapter|Part|Book|Letter|Volume|Act|Canto|Section)\s+)([ivxlcdm]+)\b(.*)$"
    numeral = F.regexp_extract(c, found, 2)
    return F.when((numeral != "") & roman_value(numeral).isNotNull(), F.concat(F.regexp_extract(c, found, 1), F.upper(numeral), F.regexp_extract(c, found, 3))).otherwise(c)


def curly_quotes(c: Column | str) -> Column:
    """Straight double quotes as opening and closing ones in turn; white space collapsed."""
    pieces = F.split(_s(c), '"')
    marks = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i % 2 == 1, "“").otherwise("”"), p)))
    return strip(F.regexp_replace(F.array_join(marks, ""), r"\s+", " "))


def clean_meta(c: Column | str) -> Column:
    """A title or author, or nothing where it is a placeholder."""
    s = F.regexp_replace(clean_text(F.coalesce(_s(c), F.lit(""))), r"""^[()\[\]{}<>"'“”‘’ \t_-]+|[()\[\]{}<>"'“”‘’ \t_-]+$""", "")
    return F.when(s.rlike(META_FILE) | s.rlike(META_JUNK), "").otherwise(s)


def title_from_filename(c: Column | str) -> Column:
    """A title from a file's name."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(_s(c), F.lit("")), F.lit("Untitled")), "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    words = F.coalesce(F.nullif(strip(F.regexp_replace(F.regexp_replace(stem, r"[_-]+", " "), r"\s+", " ")), F.lit("")), F.lit("Untitled"))
    return F.when((words == F.lower(words)) & words.rlike(r"\p{Ll}"), F.initcap(words)).otherwise(words)


def safe_filename(c: Column | str, fallback: str = "audiobook") -> Column:
    """A file's name without what file systems may refuse."""
    kept = F.regexp_replace(F.regexp_replace(_s(c), r"[^\p{L}\p{N} \-_.,'()]", ""), "^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.substring(kept, 1, 120), F.lit("")), F.lit(fallback))


def safe_name(c: Column | str, fallback: str = "audiobook") -> Column:
    """A name for a download: reserved characters as blanks, at most 80 characters."""
    kept = F.substring(strip(F.regexp_replace(F.regexp_replace(_s(c), r'[\\/:*?"<>|]+', " "), r"\s+", " ")), 1, 80)
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def meta_escape(c: Column | str) -> Column:
    """A value for a metadata file."""
    return F.regexp_replace(_s(c), r"([=;#\\\n])", r"\\$1")


def concat_line(path: Column | str) -> Column:
    """A line of a list of files to join."""
    return F.concat(F.lit("file '"), F.replace(_s(path), F.lit("'"), F.lit(r"'\''")), F.lit("'"))


def collapse(c: Column | str, most: int) -> Column:
    """White space collapsed, cut to a length."""
    return F.left(strip(F.regexp_replace(F.coalesce(_s(c), F.lit("")), r"\s+", " ")), F.lit(most))


def hue(c: Column | str) -> Column:
    """A stable number of degrees for a text, by the 31-hash in 32 bits."""
    codes = F.transform(F.regexp_extract_all(_s(c), F.lit("(?s)."), F.lit(0)), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: (a * 31 + b) % F.lit(4294967296)) % 360


def pitch(c: Column | str) -> Column:
    """A stable pitch for a voice."""
    return 150 + F.conv(F.substring(F.sha1(_s(c).cast("binary")), 1, 6), 16, 10).cast("long") % 140


def plan_key(*cols: Column | str) -> Column:
    """A key of contents; work that has it already needn't be done again."""
    return F.substring(F.sha1(F.concat_ws("\u0001", *[_s(c).cast("string") for c in cols]).cast("binary")), 1, 16)


def server_address(c: Column | str) -> Column:
    """A server's address with a scheme and without a slash at the end."""
    s = strip(c)
    s = F.when(s.rlike("(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[?#].*$", ""), "/+$", ""), "(?i)/api$", "")
    return F.when(strip(c) == "", "").otherwise(F.regexp_replace(s, "/+$", ""))


def without_token(url: Column | str) -> Column:
    """An address as a cache key, without the parameter ``token``."""
    s = F.regexp_replace(_s(url), r"([?&])token=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"&&+", "&"), r"\?&", "?"), r"[?&](?=#|$)", "")


def with_token(url: Column | str, token: Column | str) -> Column:
    """An address with the parameter ``token``."""
    u = _s(url)
    return F.when(F.coalesce(_s(token), F.lit("")) == "", u).otherwise(F.concat(u, F.when(u.contains("?"), "&").otherwise("?"), F.lit("token="), F.url_encode(_s(token))))
